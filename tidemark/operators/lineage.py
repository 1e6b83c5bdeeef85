"""Column lineage: edges, tracing in both directions, impact of sensitive columns, upserts, exports."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import commits
from tidemark.session import scratch_path

EDGE_COLUMNS = ["src_object", "src_column", "dst_object", "dst_column", "expression"]
MAPPING_KEY = ["pipeline_id", "source_object_id", "destination_object_id"]


def edges(mappings: DataFrame) -> DataFrame:
    """Distinct column edges. ``column_mappings``: array<struct<source_column, destination_column, expression>>."""
    return mappings.select(
        F.col("source_object_id").alias("src_object"), F.col("destination_object_id").alias("dst_object"),
        F.explode("column_mappings").alias("m"),
    ).select(
        "src_object", F.col("m.source_column").alias("src_column"), "dst_object",
        F.col("m.destination_column").alias("dst_column"),
        F.when(F.col("m.expression") != "", F.col("m.expression")).alias("expression"),
    ).distinct()


def split_direct(lineage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain copies, and columns computed by an expression."""
    return lineage.where("expression IS NULL"), lineage.where("expression IS NOT NULL")


class LineageStore:
    """Column edges kept in two sorted copies, by source and by destination, for any number of traces.

    Edges are added in folders of their own, and a manifest names those that count; nothing is copied for a trace, which
    reads the copy that is sorted the way it walks.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def write(cls, lineage: DataFrame, path: str) -> LineageStore:
        """A store of these edges alone, whatever was at the path before."""
        store = cls(lineage.sparkSession, path)
        folder = store._add(lineage)
        commits.append(store.spark, path, lambda entry: {"folders": [folder]})
        return store

    def add(self, lineage: DataFrame) -> None:
        folder = self._add(lineage)
        commits.append(self.spark, self.path, lambda entry: {"folders": [*entry["folders"], folder]})

    def _add(self, lineage: DataFrame) -> str:
        folder = f"{self.path}/edges/{uuid.uuid4().hex}"
        once = lineage.select(*EDGE_COLUMNS).distinct()
        once.sortWithinPartitions("src_object", "src_column").write.parquet(f"{folder}/downstream")
        # The other order is made from the first copy, so the edges are derived once and dealt out once; each file of both
        # is sorted by itself.
        first = self.spark.read.schema(once.schema).parquet(f"{folder}/downstream")
        first.sortWithinPartitions("dst_object", "dst_column").write.parquet(f"{folder}/upstream")
        return folder

    def edges(self, way: str = "downstream") -> DataFrame:
        """All edges, from the copy sorted for walking that way."""
        folders = commits.latest(self.spark, self.path)["folders"]
        return self.spark.read.parquet(*[f"{folder}/{way}" for folder in folders])


def _steps(lineage: DataFrame | LineageStore, ways: tuple[str, ...]) -> DataFrame:
    """One row per edge and way it may be walked."""
    parts = []
    for way in ways:
        near, far = ("src", "dst") if way == "downstream" else ("dst", "src")
        edges = lineage.edges(way) if isinstance(lineage, LineageStore) else lineage
        parts.append(edges.select(
            F.lit(way).alias("direction"),
            F.col(f"{near}_object").alias("object_id"), F.col(f"{near}_column").alias("column_name"),
            F.col(f"{far}_object").alias("next_object"), F.col(f"{far}_column").alias("next_column"),
        ))
    return reduce(lambda a, b: a.unionByName(b), parts).dropna()


#: Steps taken before anything is written, and rounds after which what was reached is written together again. The edges are
#: dealt out once a round, whatever its steps.
HOPS, FOLD = 5, 8


class _Rounds:
    """Rows that rounds add to, each in a folder of its own; every few rounds the folders become one."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base, self.folders, self.taken = spark, scratch_path(spark, label), [], 0
        self.schema = None

    def write(self, rows: DataFrame, newest: Column) -> int:
        """Write a round's rows and count those that ``newest`` holds for (a re-run task may count twice, zero is zero)."""
        watch = Observation()
        self.schema = rows.schema
        path = f"{self.base}/{self.taken}"
        rows.observe(watch, F.count_if(newest).alias("n")).write.parquet(path)
        self.folders.append(path)
        self.taken += 1
        if len(self.folders) > FOLD:
            whole = f"{self.base}/{self.taken}"
            self.all().write.parquet(whole)
            self.taken += 1
            # The last round's folder is read by itself once more.
            self.last, self.folders = path, [whole]
        else:
            self.last = path
        return watch.get["n"]

    def newest(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.last)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.folders)


def _onward(rows: DataFrame, steps: DataFrame, here: list[str], kept: list[str]) -> DataFrame:
    """The next columns of some rows; ``kept`` columns go along."""
    joined = rows.join(steps.select(*here, "next_object", "next_column"), here)
    return joined.select(*kept, F.col("next_object").alias("object_id"), F.col("next_column").alias("column_name"))


def trace(lineage: DataFrame | LineageStore, starts: DataFrame, direction: str, labels: list[str] | None = None) -> DataFrame:
    """Columns reachable from the start columns, with the smallest number of steps.

    ``starts`` has object_id, column_name. The result holds each reached column once for the whole start
    set, or once per value of the ``labels`` columns of ``starts`` (kept few, such as tags), so it grows
    with the graph and never with pairs of columns. A start is left out unless another start leads to it, and then has the
    steps from there; unknown starts and cycles are harmless. ``both`` walks both ways in the same rounds and tells them apart.

    A round takes HOPS steps, each with its columns made distinct, and writes those newly reached; only the columns of
    the last step are walked on from. A small frontier is broadcast by its size; a large one is joined by shuffle, where
    adaptive execution splits the edges of a hub. (Edges are not bucketed by column, since a bucket cannot be split.)
    """
    if direction not in ("upstream", "downstream", "both"):
        raise ValueError(f"unknown direction {direction!r}")
    ways = ("upstream", "downstream") if direction == "both" else (direction,)
    labels = list(labels or [])
    spark = starts.sparkSession
    here = ["direction", "object_id", "column_name"] if direction == "both" else ["object_id", "column_name"]
    node = [*labels, *here]
    carried = [c for c in node if c not in ("object_id", "column_name")]
    steps = _steps(lineage, ways)
    begin = starts.withColumn("direction", F.explode(F.array(*[F.lit(way) for way in ways]))).select(*node).dropna().distinct()
    rounds = _Rounds(spark, "trace")
    depth = 0
    found = rounds.write(begin.withColumn("depth", F.lit(0).cast("bigint")), F.lit(True))
    while found:
        at, parts = rounds.newest().where(F.col("depth") == depth).select(*node), []
        for hop in range(1, HOPS + 1):
            at = _onward(at, steps, here, carried).select(*node).distinct()
            parts.append(at.withColumn("depth", F.lit(depth + hop).cast("bigint")))
        reached = reduce(lambda a, b: a.unionByName(b), parts).groupBy(*node).agg(F.min("depth").alias("depth"))
        depth += HOPS
        found = rounds.write(reached.join(rounds.all(), node, "left_anti"), F.col("depth") == depth)
    walked = rounds.all().where("depth > 0")
    # A start may be reached by another one only if an edge leads into it from what was reached.
    into = steps.join(rounds.all().where("depth = 0").select(*node).withColumnsRenamed({"object_id": "next_object", "column_name": "next_column"}),
                      [*([] if direction != "both" else ["direction"]), "next_object", "next_column"], "left_semi")
    if into.join(rounds.all().select(*here).distinct(), here, "left_semi").isEmpty():
        return walked
    return walked.unionByName(_from_other_starts(steps, rounds.all().where("depth = 0").select(*node), node, here))


def _from_other_starts(steps: DataFrame, begin: DataFrame, node: list[str], here: list[str]) -> DataFrame:
    """Starts that another start leads to, with the fewest steps from one.

    Every column takes part for the two different starts nearest to it: whichever start it leads to, one of them is
    another. So a column is walked on from twice at most.
    """
    source = F.struct("object_id", "column_name")
    carried = [*[c for c in node if c not in ("object_id", "column_name")], "source"]
    rounds, depth = _Rounds(begin.sparkSession, "starts"), 0
    found = rounds.write(begin.withColumn("source", source).withColumn("depth", F.lit(0).cast("bigint")), F.lit(True))
    while found:
        depth += 1
        onward = _onward(rounds.newest(), steps, here, carried).distinct()
        fresh = onward.join(rounds.all(), [*node, "source"], "left_anti")
        ranked = fresh.withColumn("nth", F.row_number().over(Window.partitionBy(*node).orderBy("source"))).where("nth <= 2")
        known = rounds.all().groupBy(*node).agg(F.count(F.lit(1)).alias("known"))
        room = ranked.join(known, node, "left").where(F.col("nth") + F.coalesce("known", F.lit(0)) <= 2)
        found = rounds.write(room.select(*node, "source", F.lit(depth).cast("bigint").alias("depth")), F.lit(True))
    others = rounds.all().where(F.col("source") != source).join(begin, node, "left_semi")
    return others.groupBy(*node).agg(F.min("depth").alias("depth"))


def extend(traced: DataFrame, starts: DataFrame, store: LineageStore, added: DataFrame, direction: str) -> DataFrame:
    """A trace of a whole start set after edges were added to the store, from the trace before.

    Only columns that the new edges reach, or reach in fewer steps, are walked on from. Starts stay out of the result; where
    edges went, trace anew.
    """
    if direction not in ("upstream", "downstream"):
        raise ValueError(f"cannot extend a trace of direction {direction!r}")
    node = ["object_id", "column_name"]
    steps = _steps(store, (direction,))
    rounds = _Rounds(store.spark, "extended")
    begin = starts.select(*node).dropna().distinct().withColumn("depth", F.lit(0).cast("bigint"))
    known = traced.select(*node, "depth").unionByName(begin)
    fresh = _onward(known, _steps(added, (direction,)), node, ["depth"])
    rounds.write(known, F.lit(True))
    while True:
        best = rounds.all().groupBy(*node).agg(F.min("depth").alias("least"))
        nearer = fresh.groupBy(*node).agg((F.min("depth") + 1).alias("depth")).join(best, node, "left")
        nearer = nearer.where(F.col("least").isNull() | (F.col("depth") < F.col("least"))).select(*node, "depth")
        if not rounds.write(nearer, F.lit(True)):
            break
        fresh = _onward(rounds.newest(), steps, node, ["depth"])
    return rounds.all().groupBy(*node).agg(F.min("depth").alias("depth")).join(begin, node, "left_anti")


def with_transformation(traced: DataFrame, lineage: DataFrame | LineageStore) -> DataFrame:
    """Add the expression a column is computed by: the smallest of its incoming edges', null if copied."""
    node = ["object_id", "column_name"]
    edges = lineage.edges("upstream") if isinstance(lineage, LineageStore) else lineage
    into = edges.select(F.col("dst_object").alias("object_id"), F.col("dst_column").alias("column_name"), "expression")
    # Edges into columns that were not reached are dropped before anything is grouped.
    into = into.where("expression IS NOT NULL").join(traced.select(*node), node, "left_semi")
    incoming = into.groupBy(*node).agg(F.min("expression").alias("transformation"))
    return traced.join(incoming, ["object_id", "column_name"], "left")


def neighbourhood(mappings: DataFrame, objects: DataFrame, direction: str) -> DataFrame:
    """Mappings that can be reached from an object going up, down or both ways."""
    links = mappings.select(
        F.col("source_object_id").alias("src_object"), F.lit("").alias("src_column"),
        F.col("destination_object_id").alias("dst_object"), F.lit("").alias("dst_column"),
    )
    starts = objects.select("object_id", F.lit("").alias("column_name"))
    seen = trace(links, starts, direction)
    kept = []
    for way in ("upstream", "downstream") if direction == "both" else (direction,):
        ours = seen.where(F.col("direction") == way) if direction == "both" else seen
        ours = ours.select("object_id").unionByName(starts.select("object_id"))
        near = "source_object_id" if way == "downstream" else "destination_object_id"
        kept.append(mappings.join(ours.withColumnRenamed("object_id", near), near, "left_semi").select(*mappings.columns))
    # Only a cycle puts a mapping on both sides.
    return kept[0] if len(kept) == 1 else kept[0].unionByName(kept[1]).dropDuplicates(MAPPING_KEY)


def upsert(mappings: DataFrame, new: DataFrame) -> DataFrame:
    """Replace mappings with the same (pipeline, source, destination), add the others.

    A key repeated in ``new`` is stored once, with the greatest of its other values; null key parts equal each other.
    """
    rest = [c for c in mappings.columns if c not in MAPPING_KEY]
    once = new.groupBy(*MAPPING_KEY).agg(F.max(F.struct(*rest)).alias("_v")).select(*MAPPING_KEY, *[F.col(f"_v.{c}").alias(c) for c in rest])
    taken = once.select(*[F.col(c).alias(f"_n_{c}") for c in MAPPING_KEY])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_n_{c}")) for c in MAPPING_KEY])
    return mappings.join(taken, same, "left_anti").unionByName(once)


def raw_lineage(source_fields: DataFrame, destination_fields: DataFrame, links: DataFrame) -> DataFrame:
    """Direct-copy edges between linked objects for columns of the same name.

    ``links``: src_object, dst_object.
    """
    src = source_fields.select(F.col("object_id").alias("src_object"), F.col("name").alias("src_column"))
    dst = destination_fields.select(F.col("object_id").alias("dst_object"), F.col("name").alias("dst_column"))
    return (
        links.join(src, "src_object")
        .join(dst.withColumn("src_column", F.col("dst_column")), ["dst_object", "src_column"])
        .select("src_object", "src_column", "dst_object", "dst_column", F.lit(None).cast("string").alias("expression"))
    )


def tag_reach(lineage: DataFrame | LineageStore, tagged: DataFrame) -> DataFrame:
    """Columns each tag's values end up in, those included that have the tag themselves and are fed by others that have it.

    ``tagged``: object_id, column_name, tag; all traced at once.
    """
    return trace(lineage, tagged.select("object_id", "column_name", "tag"), "downstream", ["tag"])


def lookup(mappings: DataFrame, pipeline_id: str | None = None, destination: str | None = None) -> DataFrame:
    if pipeline_id is not None:
        mappings = mappings.where(F.col("pipeline_id") == pipeline_id)
    if destination is not None:
        mappings = mappings.where(F.col("destination_object_id") == destination)
    return mappings


def dataset_urn(platform: Column | str, object_id: Column) -> Column:
    head = F.lit(platform) if isinstance(platform, str) else platform
    return F.concat(F.lit("urn:li:dataset:(urn:li:dataPlatform:"), head, F.lit(","), object_id, F.lit(",PROD)"))


def urn_edges(lineage: DataFrame, platform: str) -> DataFrame:
    """Field-level edges as resource names."""
    def field(side: str) -> Column:
        return F.concat(F.lit("urn:li:schemaField:("), dataset_urn(platform, F.col(f"{side}_object")), F.lit(","),
                        F.col(f"{side}_column"), F.lit(")"))

    return lineage.select(
        field("src").alias("upstream"), field("dst").alias("downstream"),
        F.col("expression").alias("transform_operation"), F.lit(1.0).alias("confidence"),
    )


def type_class(normalized: Column) -> Column:
    """The four classes a catalog distinguishes."""
    return (
        F.when(normalized.isin("integer", "bigint", "decimal", "float"), "number")
        .when(normalized == "boolean", "boolean")
        .when(normalized.isin("date", "timestamp"), "date")
        .otherwise("string")
    )


def roots_and_leaves(lineage: DataFrame) -> DataFrame:
    """Columns nothing feeds (root) and columns that feed nothing (leaf)."""
    ends = lineage.select(
        F.inline(F.array(
            F.struct(F.col("src_object").alias("object_id"), F.col("src_column").alias("column_name"),
                     F.lit(True).alias("feeds")),
            F.struct(F.col("dst_object").alias("object_id"), F.col("dst_column").alias("column_name"),
                     F.lit(False).alias("feeds")),
        ))
    )
    roles = ends.groupBy("object_id", "column_name").agg(
        F.bool_or("feeds").alias("feeds"), F.bool_or(~F.col("feeds")).alias("fed")
    )
    return roles.where("NOT (feeds AND fed)").select(
        "object_id", "column_name", F.when(F.col("fed"), "leaf").otherwise("root").alias("role")
    )
