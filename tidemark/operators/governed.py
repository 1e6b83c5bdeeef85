"""One governed load from extract to run record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import canonical_names
from tidemark.operators.lineage import raw_lineage
from tidemark.operators.prepare import Element, IngestConfig, read_metrics, run_ingestion, write_manifests
from tidemark.operators.publish import (
    PublishResult, audit_and_publish, read_version, version_path, was_published,
)
from tidemark.operators.quality import Rule
from tidemark.operators.reconcile import reconcile
from tidemark.operators.runs import GATE_TASK
from tidemark.operators.schema import snapshot


@dataclass(frozen=True)
class LoadPlan:
    """What to load where, and what has to hold before readers may see it."""

    source_name: str
    destination_name: str
    elements: list[Element]
    rules: list[Rule]
    target: str
    processed_at: str


@dataclass(frozen=True)
class LoadOutcome:
    """The observed metrics, the column lineage and the one-row run record of a load."""

    metrics: DataFrame
    lineage: DataFrame
    run: DataFrame


RUN_SCHEMA = (
    "run_id string, status string, failed_task string, rows_extracted bigint, rows_published bigint, "
    "n_violations int, violations string"
)


def governed_load(source: DataFrame, plan: LoadPlan, run_id: str) -> LoadOutcome:
    """Clean and stage the source as version ``run_id``, gate it, publish it, reconcile, and record the run.

    The source is read once; counts come from the landed files. A blocked load leaves the published data as it was and has
    published nothing. A retry under the same ``run_id`` replaces its own staging, and once that is published it is not
    touched again.
    """
    spark = source.sparkSession
    manifests = f"{plan.target}/manifests/{run_id}"
    if was_published(spark, plan.target, run_id):
        clean, result = read_version(spark, plan.target, run_id), PublishResult(True, [])
    else:
        config = IngestConfig(plan.elements, plan.processed_at, version_path(plan.target, run_id))
        clean, observed, manifest = run_ingestion(source, config)
        write_manifests(observed, manifest, manifests)
        result = audit_and_publish(spark, plan.rules, plan.target, run_id)
    metrics = read_metrics(spark, manifests)
    extracted = metrics.where("metric = 'row_count'").first().value
    visible = read_version(spark, plan.target, run_id).count() if result.published else 0
    run = spark.createDataFrame(
        [(run_id, None, None, extracted, visible, len(result.violations), "; ".join(result.violations))], RUN_SCHEMA
    )
    checked = reconcile(run, "rows_extracted", "rows_published")
    status = (
        F.when(F.lit(not result.published), "quality_failed")
        .when(F.col("rows_ok"), "success")
        .otherwise("failed")
    )
    failed_task = F.when(F.lit(not result.published), GATE_TASK).when(~F.col("rows_ok"), "post_load_validation")
    recorded = checked.withColumn("status", status).withColumn("failed_task", failed_task).select(*run.columns)

    landed = source.toDF(*canonical_names(source.columns))
    fields = snapshot({plan.source_name: landed, plan.destination_name: clean})
    links = spark.createDataFrame([(plan.source_name, plan.destination_name)], "src_object string, dst_object string")
    return LoadOutcome(metrics, raw_lineage(fields, fields, links), recorded)
