"""A quality gate for every micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidemark.operators.quality import Rule, evaluate_gate, profile, rules_frame
from tidemark.session import cut, remove_path, scratch_path


def gate_stream(
    spark: SparkSession, source: str, schema: StructType, rules: list[Rule], accepted: str, rejected: str,
    checkpoint: str, files_per_batch: int | None = None,
) -> None:
    """Write each batch of new files whole to ``accepted``, or to ``rejected`` when a rule fails.

    The folder of a batch is named by its id and replaced on replay; a replay that is judged otherwise removes the
    batch from the other side. The batch is staged in the shared folder between the audit and the write, so its files
    are read a single time and no executor holds it.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def judge(batch: DataFrame, batch_id: int) -> None:
        staged = scratch_path(spark, "gate")
        try:
            held = cut(batch, at=staged)
            failed = evaluate_gate(profile(held, rules), rules_frame(held.sparkSession, rules))
            target, other = (accepted, rejected) if failed.isEmpty() else (rejected, accepted)
            held.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
            remove_path(spark, f"{other}/batch={batch_id}")
        finally:
            remove_path(spark, staged)

    query = (
        reader.parquet(source)
        .writeStream.foreachBatch(judge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
