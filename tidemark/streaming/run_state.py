"""Run reports as a stream, kept as the current state of each run.

The state is a set of folders that are written once; a log of manifests says which of them count.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators import commits
from tidemark.operators.runs import upsert_runs
from tidemark.session import remove_path


def track_runs(
    spark: SparkSession, source: str, schema: StructType, state_path: str, checkpoint: str,
    files_per_batch: int | None = None,
) -> None:
    """Fold every new report file into the state below ``state_path``.

    Each micro-batch writes one deduplicated delta into a folder of its own and commits it under its batch id. A replayed
    batch takes the place of the folder it wrote before, so at-least-once delivery still gives exact state, and a batch
    costs what it brings rather than a rewrite of all runs.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def fold(batch: DataFrame, batch_id: int) -> None:
        path = _fresh(state_path)
        collapse(batch).write.parquet(path)
        commits.append(spark, state_path, lambda entry: {**entry, "batches": {**entry.get("batches", {}), str(batch_id): path}})

    query = (
        reader.parquet(source)
        .writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def collapse(reports: DataFrame) -> DataFrame:
    """One row per run from reports alone."""
    fields = [c for c in reports.columns if c not in ("run_id", "reported_at")]
    nothing = reports.limit(0).select(
        "run_id", *fields, F.col("reported_at").alias("last_run_at"), F.col("reported_at").alias("last_success_at")
    )
    return upsert_runs(nothing, reports)


def _fresh(state_path: str) -> str:
    return f"{state_path}/data/{uuid.uuid4().hex}"


def folders(entry: commits.Entry | None) -> list[str]:
    """Folders that an entry of the log counts in."""
    entry = entry or {}
    return [*([entry["folded"]] if "folded" in entry else []), *entry.get("batches", {}).values()]


def current_runs(spark: SparkSession, state_path: str) -> DataFrame:
    """State over all batches: deltas merge with the same rules as reports."""
    found = folders(commits.latest(spark, state_path))
    if not found:
        raise FileNotFoundError(f"no run reports at {state_path}")
    return _merge(spark.read.parquet(*found))


def _merge(deltas: DataFrame) -> DataFrame:
    fields = [c for c in deltas.columns if c not in ("run_id", "last_run_at", "last_success_at")]
    newest = F.max_by(F.struct(*fields), F.struct("last_run_at", *[c for c in ("seq",) if c in fields]))
    return deltas.groupBy("run_id").agg(
        newest.alias("r"), F.max("last_run_at").alias("last_run_at"), F.max("last_success_at").alias("last_success_at")
    ).select("run_id", "r.*", "last_run_at", "last_success_at")


def compact_runs(spark: SparkSession, state_path: str, upto: int) -> None:
    """Fold what was folded before and the deltas of the batches up to ``upto`` into one new folder.

    Batches may arrive meanwhile: the new manifest takes away only what was folded. Merging may be repeated, so a crash
    leaves the old state, or the new one, and at worst folders that no manifest names. Folders that the last two manifests
    do not name are removed, so a reader that has just looked still finds its own.
    """
    entry = commits.latest(spark, state_path) or {}
    folded = {b: path for b, path in entry.get("batches", {}).items() if int(b) <= upto}
    old = [*([entry["folded"]] if "folded" in entry else []), *folded.values()]
    if len(old) < 2:
        return
    path = _fresh(state_path)
    _merge(spark.read.parquet(*old)).write.parquet(path)

    def change(now: commits.Entry) -> commits.Entry:
        rest = {b: p for b, p in now.get("batches", {}).items() if folded.get(b) != p}
        return {**now, "folded": path, "batches": rest}

    commits.append(spark, state_path, change)
    entries = commits.history(spark, state_path)
    kept = {f for e in entries[:2] for f in folders(e)}
    for gone in sorted({f for e in entries[2:] for f in folders(e)} - kept):
        remove_path(spark, gone)
