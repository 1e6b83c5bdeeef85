"""Comparing what was expected with what arrived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.checksum import checksum

# Fixed value: largest accepted share of missing or extra rows.
ROW_TOLERANCE = 0.005


def row_delta(expected: Column, actual: Column) -> Column:
    """Share by which the actual count differs; zero when nothing was expected."""
    return F.when(expected > 0, F.abs(actual - expected) / expected).otherwise(F.lit(0.0))


def _present(value: Column) -> Column:
    return value.isNotNull() & (value != "")


def reconcile(
    loads: DataFrame, expected: str = "expected_rows", actual: str = "actual_rows",
    source_checksum: str | None = None, destination_checksum: str | None = None,
) -> DataFrame:
    """Add row_delta, rows_ok and, when checksums are named, checksum_ok and the overall validation_ok.

    Checksums disagree only when both are present and differ.
    """
    delta = row_delta(F.col(expected), F.col(actual))
    result = loads.withColumn("row_delta", delta).withColumn("rows_ok", F.col("row_delta") <= ROW_TOLERANCE)
    if source_checksum and destination_checksum:
        left, right = F.col(source_checksum), F.col(destination_checksum)
        result = result.withColumn("checksum_ok", ~(_present(left) & _present(right) & (left != right)))
    else:
        result = result.withColumn("checksum_ok", F.lit(True))
    return result.withColumn("validation_ok", F.col("rows_ok") & F.col("checksum_ok"))


def side_totals(df: DataFrame, columns: list[str], by: list[str], side: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias(f"{side}_rows"), checksum(df, columns).alias(f"{side}_checksum")
    )


def validate_delivery(source: DataFrame, delivered: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Rows and checksum per delivered unit (``by``) against the source, both sides aggregated first."""
    left = side_totals(source, columns, by, "expected")
    right = side_totals(delivered, columns, by, "actual")
    # Grouped rather than joined, so that a null unit meets its like.
    joined = left.unionByName(right, allowMissingColumns=True).groupBy(*by).agg(
        F.coalesce(F.max("expected_rows"), F.lit(0)).alias("expected_rows"),
        F.coalesce(F.max("actual_rows"), F.lit(0)).alias("actual_rows"),
        F.max("expected_checksum").alias("expected_checksum"), F.max("actual_checksum").alias("actual_checksum"),
    )
    checked = reconcile(joined, source_checksum="expected_checksum", destination_checksum="actual_checksum")
    # A delivery has to be complete and unexpected units fail it, so no tolerance applies.
    exact = (F.col("expected_rows") == F.col("actual_rows")) & F.col("checksum_ok")
    return checked.select(
        *by, "expected_rows", "actual_rows", "checksum_ok", exact.alias("delivered_ok")
    )


def failed_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs that did not end in success, with the error text a reader sees."""
    error = F.coalesce(F.col("error_message"), F.lit("Unknown error"))
    status = F.coalesce(F.col("status"), F.lit("None"))
    return jobs.where(F.col("status").isNull() | (F.col("status") != "success")).select(
        "job_id", "status",
        F.concat(F.lit("Compute job '"), F.col("job_id").cast("string"), F.lit("' ended with status='"), status,
                 F.lit("'. Error: "), error).alias("error_text"),
    )
