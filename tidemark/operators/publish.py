"""Write-audit-publish: a version is staged, audited, and only then becomes the one readers see."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import commits
from tidemark.operators.prepare import FAILED_CASTS
from tidemark.operators.quality import Rule, evaluate_gate, profile, rules_frame
from tidemark.sources.tables import write_dataset


def current_version(spark: SparkSession, target: str) -> str | None:
    """Name of the published version, null before the first publish."""
    entry = commits.latest(spark, target)
    return entry["version"] if entry else None


def version_path(target: str, version: str) -> str:
    return f"{target}/versions/{version}"


def read_version(spark: SparkSession, target: str, version: str) -> DataFrame:
    return spark.read.parquet(version_path(target, version)).drop(FAILED_CASTS)


def read_published(spark: SparkSession, target: str) -> DataFrame:
    version = current_version(spark, target)
    if version is None:
        raise FileNotFoundError(f"nothing published at {target}")
    return read_version(spark, target, version)


def was_published(spark: SparkSession, target: str, version: str) -> bool:
    """Whether a version was ever published; its files are not touched again."""
    return any(entry["version"] == version for entry in commits.history(spark, target))


def _point_to(spark: SparkSession, target: str, version: str) -> None:
    commits.append(spark, target, lambda entry: {**entry, "version": version})


def rollback(spark: SparkSession, target: str, version: str) -> None:
    """Make a version that was published before the one readers see, by a new manifest."""
    if not was_published(spark, target, version):
        raise ValueError(f"version {version!r} was never published at {target}")
    _point_to(spark, target, version)


@dataclass(frozen=True)
class PublishResult:
    published: bool
    violations: list[str]


def write_audit_publish(
    df: DataFrame, rules: list[Rule], target: str, version: str, partition_by: list[str] | None = None,
    extra_metrics: DataFrame | None = None,
) -> PublishResult:
    """Stage ``df`` as ``version``, audit what was written, publish it if no rule is violated.

    A retry with the same version overwrites its own staging only, and nothing once that was published, so nothing is
    loaded twice; a failed audit leaves the published data as it was. Only the violated rules' messages reach the driver.
    """
    spark = df.sparkSession
    if was_published(spark, target, version):
        return PublishResult(True, [])
    write_dataset(df, version_path(target, version), mode="overwrite", partition_by=partition_by)
    return audit_and_publish(spark, rules, target, version, extra_metrics)


def audit_and_publish(
    spark: SparkSession, rules: list[Rule], target: str, version: str, extra_metrics: DataFrame | None = None
) -> PublishResult:
    """Audit a staged version as it was written and make it current if no rule is violated."""
    metrics = profile(read_version(spark, target, version), rules)
    if extra_metrics is not None:
        metrics = metrics.unionByName(extra_metrics)
    failed = evaluate_gate(metrics, rules_frame(spark, rules)).orderBy("rule_id").collect()
    if failed:
        return PublishResult(False, [row.message for row in failed])
    _point_to(spark, target, version)
    return PublishResult(True, [])


def export_publish(
    df: DataFrame, path: str, partition_by: list[str] | None = None, max_records: int = 5_000_000, fmt: str = "parquet"
) -> None:
    """Deliver partitioned files of bounded size to a destination directory, replacing that delivery."""
    write_dataset(df, path, fmt, "overwrite", partition_by, max_records=max_records)
