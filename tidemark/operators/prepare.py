"""Landing to clean: canonical names, contract types, processing time, manifests, the ingestion chain."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.names import canonical_names
from tidemark.functions.types import SPARK_TYPES, canonical_of
from tidemark.sources.tables import write_dataset

PROCESSED_AT = "_processed_at"
#: Landed with every row: the names of the columns whose value the contract's type could not hold. Readers leave it out.
FAILED_CASTS = "_failed_casts"


def canonicalize(df: DataFrame) -> DataFrame:
    return df.toDF(*canonical_names(df.columns))


@dataclass(frozen=True)
class Element:
    """One column of a destination contract."""

    name: str
    destination_type: str
    required: bool = False
    nullable: bool = True


def _spark_type(element: Element) -> str:
    return SPARK_TYPES.get(element.destination_type, element.destination_type)


def _contract_casts(df: DataFrame, elements: list[Element]) -> dict[str, tuple[Column, Column]]:
    """Per contract column: the cast value and whether casting lost a value."""
    casts = {}
    for element in elements:
        if element.name in df.columns:
            cast = F.col(element.name).try_cast(_spark_type(element))
            casts[element.name] = (cast, F.col(element.name).isNotNull() & cast.isNull())
        else:
            casts[element.name] = (F.lit(None).cast(_spark_type(element)), F.lit(False))
    return casts


def cast_to_contract(df: DataFrame, elements: list[Element]) -> tuple[DataFrame, DataFrame]:
    """Cast to the destination types; and, per column, how many values could not be cast.

    Columns outside the contract are dropped, contract columns the source lacks become null.
    """
    casts = _contract_casts(df, elements)
    clean = df.select(*[value.alias(name) for name, (value, _) in casts.items()])
    return clean, long_counts(df.agg(*[F.count_if(lost).alias(name) for name, (_, lost) in casts.items()]),
                              list(casts), "failed_casts")


def null_count(column: str) -> Column:
    return F.count_if(F.col(column).isNull())


def long_counts(wide: DataFrame, columns: list[str], value: str, keys: list[str] | None = None) -> DataFrame:
    """One row per counted column from a one-row-per-key aggregate."""
    return wide.unpivot([*(keys or [])], columns, "column", value)


def with_processing_ts(df: DataFrame, ts: str | Column) -> DataFrame:
    """Stamp rows with the job's own time, passed in so that a retry writes the same bytes."""
    stamp = F.lit(ts).cast("timestamp_ntz") if isinstance(ts, str) else ts
    return df.withColumn(PROCESSED_AT, stamp)


def schema_manifest(frames: dict[str, DataFrame]) -> DataFrame:
    """Ordered (column, type) of each dataset, from its schema alone."""
    spark = next(iter(frames.values())).sparkSession
    rows = [
        (name, i, f.name, canonical_of(f.dataType), f.dataType.simpleString())
        for name, df in frames.items()
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, "object string, ordinal int, column string, type string, spark_type string")


def row_counts(spark: SparkSession, readers: dict[str, Callable[[], DataFrame]], at_once: int = 8) -> DataFrame:
    """Row count of each table, null with the error's text where a table cannot be read, at planning or at run time.

    Every table is counted by a job of its own, a few at once, so a broken one fails alone.
    """
    def count(read: Callable[[], DataFrame]) -> tuple[int | None, str | None]:
        try:
            return read().count(), None
        except Exception as error:  # whatever a source may raise is that table's outcome, and is returned
            return None, f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"

    with ThreadPoolExecutor(at_once) as pool:
        counted = list(pool.map(inheritable_thread_target(spark)(count), readers.values()))
    rows = [(name, *outcome) for name, outcome in zip(readers, counted, strict=True)]
    return spark.createDataFrame(rows, "object string, row_count bigint, error string")


def bytes_written(spark: SparkSession, path: str) -> DataFrame:
    """Bytes below a path, from file listings only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes_written"))


def extract_metrics(df: DataFrame, path: str | None = None, pages: Column | None = None) -> DataFrame:
    """The extract's metrics manifest: row_count, and bytes_written and pages_fetched where known."""
    aggs = [F.count("*").alias("row_count")]
    if pages is not None:
        aggs.append(F.count_distinct(pages).alias("pages_fetched"))
    metrics = df.agg(*aggs)
    if path is None:
        return metrics
    # Two single rows become one without a join.
    rows = metrics.unionByName(bytes_written(df.sparkSession, path), allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


METRICS_SCHEMA = "metric string, value bigint"


def write_manifests(metrics: DataFrame, manifest: DataFrame, path: str) -> None:
    """Keep a dataset's metrics and schema manifests next to it, a few rows of JSON each."""
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/schema")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS_SCHEMA).json(f"{path}/metrics")


def transform(
    spark: SparkSession, step: str | Callable[..., DataFrame] | None, inputs: dict[str, DataFrame],
    engine: str = "dbt",
) -> DataFrame:
    """One model step over named inputs: SQL with ``{name}`` references, or a DataFrame function.

    Engine ``none`` passes its single input through.
    """
    if engine == "none":
        if len(inputs) != 1:
            raise ValueError("a pass-through step takes exactly one input")
        return next(iter(inputs.values()))
    if step is None:
        raise ValueError(f"engine {engine!r} needs a step")
    return spark.sql(step, **inputs) if isinstance(step, str) else step(**inputs)


@dataclass(frozen=True)
class IngestConfig:
    """One table's way from landing to clean."""

    elements: list[Element]
    processed_at: str
    path: str
    partition_by: list[str] = field(default_factory=list)


def landed_metrics(landed: DataFrame) -> DataFrame:
    """Row, null and failed-cast counts of a landed dataset, from its files alone: metric, value."""
    names = [c for c in landed.columns if c not in (PROCESSED_AT, FAILED_CASTS)]
    counts = {"row_count": F.count(F.lit(1))}
    for name in names:
        counts[f"null_count_{name}"] = null_count(name)
        if FAILED_CASTS in landed.columns:
            counts[f"failed_casts_{name}"] = F.count_if(F.array_contains(FAILED_CASTS, name))
    wide = landed.agg(*[count.alias(name) for name, count in counts.items()])
    return wide.unpivot([], list(counts), "metric", "value")


def run_ingestion(source: DataFrame, config: IngestConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Canonicalize, cast, stamp and write in one pass over the source; return dataset, metrics, manifest.

    The metrics are those of the files that were landed, read once more; nothing is counted while tasks, which may run
    twice, write them.
    """
    spark = source.sparkSession
    casts = _contract_casts(canonicalize(source), config.elements)
    failed = F.array_compact(F.array(*[F.when(lost, F.lit(name)) for name, (_, lost) in casts.items()])).cast("array<string>")
    values = canonicalize(source).select(*[value.alias(name) for name, (value, _) in casts.items()], failed.alias(FAILED_CASTS))
    stamped = with_processing_ts(values, config.processed_at)
    write_dataset(stamped, config.path, mode="overwrite", partition_by=config.partition_by or None)
    landed = spark.read.schema(stamped.schema).parquet(config.path)
    dataset = landed.drop(FAILED_CASTS)
    return dataset, landed_metrics(landed), schema_manifest({"dataset": dataset})
