"""Reading source tables and files, and writing datasets."""

from __future__ import annotations

import datetime
import decimal
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_SCHEMA = "public"


@dataclass(frozen=True)
class ParquetSource:
    """Tables kept as ``<root>/<table>.parquet``."""

    root: str

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.parquet(f"{self.root}/{table.split('.')[-1]}.parquet")


#: Values of a split column that bounds are planned from.
MOST_SAMPLED = 100_000


def literal(value: object) -> str:
    """A value as it stands in SQL."""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float, decimal.Decimal)):
        return str(value)
    if isinstance(value, datetime.datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, datetime.date):
        return f"DATE '{value.isoformat()}'"
    return "'" + str(value).replace("'", "''") + "'"


def split_bounds(sample: DataFrame, column: str, parts: int) -> list:
    """At most ``parts`` - 1 different values that cut a sample's column into parts of about equal size."""
    values = sorted(r[0] for r in sample.select(column).dropna().limit(MOST_SAMPLED).collect())
    return sorted({values[len(values) * i // parts] for i in range(1, parts)}) if values else []


def split_predicates(column: str, bounds: list) -> list[str]:
    """Conditions that cut a table at the bounds: every row, null or not, meets exactly one."""
    if not bounds:
        return ["1 = 1"]
    texts = [literal(b) for b in bounds]
    inner = [f"{column} >= {low} AND {column} < {high}" for low, high in zip(texts, texts[1:], strict=False)]
    return [f"{column} < {texts[0]} OR {column} IS NULL", *inner, f"{column} >= {texts[-1]}"]


@dataclass(frozen=True)
class JdbcSource:
    """A relational source, read by as many connections as its split has parts.

    ``partitioning`` holds partitionColumn, lowerBound, upperBound, numPartitions where the bounds are known. Otherwise
    ``split_column`` names a column (an indexed one, best) whose sampled quantiles cut tables and queries into
    ``split_parts``; ``sample_clause`` is what the database calls a sample of a table, such as ``TABLESAMPLE SYSTEM (1)``,
    and is left out for queries.
    """

    url: str
    options: dict[str, str] = field(default_factory=dict)
    partitioning: dict[str, str] = field(default_factory=dict)
    split_column: str | None = None
    split_parts: int = 64
    sample_clause: str = ""

    @staticmethod
    def target(table: str | None = None, query: str | None = None) -> str:
        """What to select from: a table, or a query as a sub-select."""
        return f"({query.strip().rstrip(';')}) q" if query else qualified(table)

    def read_options(self, table: str | None = None, query: str | None = None) -> dict[str, str]:
        return {"url": self.url, **self.options, "dbtable": self.target(table, query), **self.partitioning}

    def sample_options(self, table: str | None = None, query: str | None = None) -> dict[str, str]:
        """How the values are read that the split is planned from."""
        clause = f" {self.sample_clause}" if self.sample_clause and not query else ""
        sql = f"SELECT {self.split_column} FROM {self.target(table, query)}{clause}"
        return {"url": self.url, **self.options, "query": sql}

    def _load(self, spark: SparkSession, table: str | None = None, query: str | None = None) -> DataFrame:
        if not self.split_column or self.partitioning:
            return spark.read.format("jdbc").options(**self.read_options(table, query)).load()
        sample = spark.read.format("jdbc").options(**self.sample_options(table, query)).load()
        predicates = split_predicates(self.split_column, split_bounds(sample, self.split_column, self.split_parts))
        return spark.read.jdbc(self.url, self.target(table, query), predicates=predicates, properties=dict(self.options))

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return self._load(spark, table)

    def query(self, spark: SparkSession, sql: str) -> DataFrame:
        return self._load(spark, query=sql)


# URI scheme of each object store.
SCHEMES = {"s3": "s3a", "gcs": "gs", "azure": "abfss", "file": "file"}


@dataclass(frozen=True)
class BucketSource:
    """Files of an object store: each table is a folder or file below the prefix, or those of its files a glob names.

    For provider ``path`` the bucket is a path or an address of its own.
    """

    provider: str
    bucket: str
    prefix: str = ""
    fmt: str = "parquet"
    glob: str | None = None
    schema: str | None = None

    @property
    def root(self) -> str:
        if self.provider not in (*SCHEMES, "path"):
            raise ValueError(f"unknown provider {self.provider!r}")
        base = self.bucket.rstrip("/") if self.provider == "path" else f"{SCHEMES[self.provider]}://{self.bucket}"
        return "/".join([base, *[p for p in self.prefix.split("/") if p]])

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return extract_files(spark, f"{self.root}/{table}", self.fmt, self.glob, schema=self.schema).drop(SOURCE_FILE)


Source = ParquetSource | JdbcSource | BucketSource


def qualified(table: str) -> str:
    """An unqualified table name belongs to the default schema."""
    return table if "." in table else f"{DEFAULT_SCHEMA}.{table}"


def extract(
    spark: SparkSession,
    source: Source,
    table: str | None = None,
    query: str | None = None,
    inputs: dict[str, str] | None = None,
) -> DataFrame:
    """A whole table, or the rows of the user's own SQL.

    For file sources the SQL names its inputs as ``{name}``; ``inputs`` maps each to a source table.
    """
    if query is None:
        return source.read(spark, table)
    if isinstance(source, JdbcSource):
        return source.query(spark, query)
    frames = {name: source.read(spark, tbl) for name, tbl in (inputs or {}).items()}
    return spark.sql(query, **frames)


def extract_incremental(
    df: DataFrame, watermark: str, last: Column, inclusive: bool = False, loaded: DataFrame | None = None,
    keys: list[str] | None = None, upto: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows above the last high-water mark, and the new mark.

    ``inclusive`` also re-reads rows equal to the mark (late ties) and drops those of them whose keys ``loaded`` has at
    the mark; a key updated since has a higher mark and is kept. ``upto`` is an upper bound fixed beforehand, so that
    rows and mark agree while rows still arrive. With no new rows the old mark is kept. Rows without a mark are in
    neither; ``extract_unmarked`` returns them.
    """
    if upto is not None:
        df = df.where(F.col(watermark) <= upto)
    if inclusive:
        fresh = df.where(F.col(watermark) >= last)
        if loaded is not None:
            # Only ties with the mark can have been loaded before, so only those keys are compared.
            ties = loaded.where(F.col(watermark) == last).select(*keys, watermark).distinct()
            fresh = fresh.join(ties, [*keys, watermark], "left_anti")
    else:
        fresh = df.where(F.col(watermark) > last)
    mark = fresh.agg(F.coalesce(F.max(watermark), last).alias("high_watermark"), F.count("*").alias("new_rows"))
    return fresh, mark


def landed_mark(landed: DataFrame, watermark: str, last: Column) -> DataFrame:
    """The new high-water mark and the rows that came with it, from the rows that were landed and from nothing else.

    Rows that reach the source while it is read are either landed, and below the mark, or neither.
    """
    return landed.agg(F.coalesce(F.max(watermark), last).alias("high_watermark"), F.count(F.lit(1)).alias("new_rows"))


def extract_unmarked(df: DataFrame, watermark: str) -> DataFrame:
    """Rows that no incremental extract can reach, as their watermark is null."""
    return df.where(F.col(watermark).isNull())


@dataclass(frozen=True)
class ExtractOptions:
    """How one source object is extracted and landed."""

    table: str
    load_strategy: str = "full_load"
    watermark_column: str | None = None
    partition_column: str | None = None
    compression: str | None = None
    encoding: str = "utf-8"
    query: str | None = None


def extract_configured(
    spark: SparkSession, source: Source, options: ExtractOptions, last_mark: Column | None = None
) -> DataFrame:
    """Rows to land. The mark of an incremental extract is known once they are landed, by ``land_configured``.

    With a query of their own users filter by watermark themselves. Change feeds (``cdc``) are extracted
    whole and applied downstream.
    """
    if options.load_strategy not in ("full_load", "incremental", "cdc"):
        raise ValueError(f"unknown load strategy {options.load_strategy!r}")
    name = options.table.split(".")[-1]
    rows = extract(spark, source, options.table, options.query, {name: options.table})
    if options.load_strategy != "incremental" or options.query is not None or last_mark is None:
        return rows
    if options.watermark_column is None:
        raise ValueError("an incremental extract needs a watermark column")
    return rows.where(F.col(options.watermark_column) > last_mark)


def land_configured(
    spark: SparkSession, source: Source, options: ExtractOptions, path: str, last_mark: Column | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Extract, land at ``path``, and read back: the landed rows, and the mark where the extract is incremental.

    ``path`` is this extract's own folder; a retry replaces it, and the mark is that of the files which then lie there.
    """
    rows = extract_configured(spark, source, options, last_mark)
    land(rows, path, options)
    landed = spark.read.schema(rows.schema).parquet(path)
    if options.load_strategy != "incremental" or options.query is not None or last_mark is None:
        return landed, None
    return landed, landed_mark(landed, options.watermark_column, last_mark)


def land(df: DataFrame, path: str, options: ExtractOptions, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write extracted rows in the layout, compression and encoding the options ask for."""
    partitions = [options.partition_column] if options.partition_column else None
    write_dataset(df, path, fmt, mode, partitions, options.compression, options.encoding)


SOURCE_FILE = "source_file"


def _decoded(text: Column) -> Column:
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def _path_values(root: str) -> Column:
    """The ``column=value`` folders of a file's path below the root, as a map; Hive's mark for null is null."""
    depth = len([p for p in root.split("/") if p and not p.endswith(":")])
    # The path is written as an address, the folders' names have escapes of their own.
    folders = F.split(F.regexp_replace(F.col("_metadata.file_path"), r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*", ""), "/")
    below = F.slice(folders, depth + 1, F.greatest(F.size(folders) - depth - 1, F.lit(0)))
    below = F.filter(F.transform(below, _decoded), lambda p: p.contains("="))
    value = F.transform(below, lambda p: _decoded(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)))
    value = F.transform(value, lambda v: F.when(v != "__HIVE_DEFAULT_PARTITION__", v))
    return F.map_from_arrays(F.transform(below, lambda p: _decoded(F.substring_index(p, "=", 1))), value)


def extract_files(
    spark: SparkSession, root: str, fmt: str = "parquet", glob: str | None = None, recursive: bool = True,
    schema: str | None = None, options: dict[str, str] | None = None, partitions: str | None = None,
) -> DataFrame:
    """All files below a provider's bucket or prefix that match a name glob, with their path.

    Folders named ``column=value`` become columns again, which a recursive listing leaves out: text, or of the types that
    ``partitions`` (a schema) gives them. A column that the files hold themselves is taken from them.
    """
    reader = spark.read.format(fmt).options(**(options or {}))
    reader = reader.option("recursiveFileLookup", str(recursive).lower())
    lister = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader, lister = reader.option("pathGlobFilter", glob), lister.option("pathGlobFilter", glob)
    if schema:
        reader = reader.schema(schema)
    found = reader.load(root)
    path = F.col("_metadata.file_path")
    if not recursive:
        return found.select("*", path.alias(SOURCE_FILE))
    if partitions:
        kinds = {f.name: f.dataType for f in spark.createDataFrame([], partitions).schema}
    else:
        # The names of folders, from the listing alone: as many as there are partition columns.
        names = lister.load(root).select(F.explode(F.map_keys(_path_values(root))).alias("name")).distinct()
        kinds = dict.fromkeys(sorted(r.name for r in names.collect()), "string")
    values = _path_values(root)
    parts = [values[name].cast(kind).alias(name) for name, kind in kinds.items() if name not in found.columns]
    return found.select("*", *parts, path.alias(SOURCE_FILE))


def write_dataset(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "errorifexists",
    partition_by: list[str] | None = None,
    compression: str | None = None,
    encoding: str = "utf-8",
    max_records: int | None = None,
    schema: str | None = None,
) -> None:
    """Write one dataset.

    An asked-for ``compression`` is used as it is; else it is snappy, and bzip2 for csv, json and text.
    ``schema`` pins the output columns and types instead of leaving them to each batch;
    ``max_records`` bounds the rows per file. Partitioned output is rebalanced by the partition columns
    first: adaptive execution splits a value that holds much of the table and merges tiny ones.
    """
    if schema:
        wanted = df.sparkSession.createDataFrame([], schema).schema
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])
    text = fmt in ("csv", "json", "text")
    # Unasked, text gets a codec whose files can be split.
    writer_options: dict[str, str | int] = {"compression": compression or ("bzip2" if text else "snappy")}
    if text:
        writer_options["encoding"] = encoding
    if max_records:
        writer_options["maxRecordsPerFile"] = max_records
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.format(fmt).mode(mode).options(**writer_options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def load(
    df: DataFrame, path: str, mode: str = "append", merge_schema: bool = False, fmt: str = "parquet"
) -> None:
    """Append to, or truncate and load, a destination. ``merge_schema`` admits new source columns."""
    if mode not in ("append", "truncate"):
        raise ValueError(f"unknown load mode {mode!r}")
    if mode == "append" and not merge_schema:
        df = align_to(df, path, fmt)
    df.write.format(fmt).mode("append" if mode == "append" else "overwrite").save(path)


def align_to(df: DataFrame, path: str, fmt: str) -> DataFrame:
    """Refuse columns the destination does not have; keep its column order."""
    hadoop_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(hadoop_path):
        return df
    known = df.sparkSession.read.format(fmt).load(path).columns
    extra = [c for c in df.columns if c not in known]
    if extra:
        raise ValueError(f"columns not in destination: {extra}")
    return df.select(*[c for c in known if c in df.columns])


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """Read a destination whose files have different columns; absent ones are null."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def merge_frames(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right, allowMissingColumns=True)
