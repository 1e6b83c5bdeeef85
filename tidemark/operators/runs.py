"""Pipeline run history: final status, current state, dashboards, SLA and trends.

Latest-row questions are answered with ``max_by``, which merges map-side, so a pipeline with a large
share of all runs is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.schema import seconds_between

# The task a failed gate is reported under, statuses that count as a success, default SLA.
GATE_TASK = "validation_and_metrics.quality_gate"
SUCCESSES = ("success", "partial")
DEFAULT_SLA_MINUTES = 90


def run_status(tasks: DataFrame) -> DataFrame:
    """Final status of each run from its tasks (run_id, task_order, task_id, optional, state).

    A run has as many rows as its pipeline has tasks.
    """
    mandatory = ~F.col("optional") & (F.col("state") == "failed")
    degraded = F.col("optional") & F.col("state").isin("failed", "upstream_failed")
    per_run = tasks.groupBy("run_id").agg(
        F.bool_or(mandatory & F.col("task_id").contains("quality_gate")).alias("_gate"),
        F.min_by("task_id", F.when(mandatory, F.col("task_order"))).alias("_first"),
        F.bool_or(mandatory).alias("_failed"),
        F.array_sort(F.collect_list(F.when(degraded, F.col("task_id")))).alias("optional_failures"),
    )
    return per_run.select(
        "run_id",
        F.when(F.col("_gate"), "quality_failed")
        .when(F.col("_failed"), "failed")
        .otherwise(degraded_status(F.lit("success"), F.col("optional_failures")))
        .alias("status"),
        F.when(F.col("_gate"), GATE_TASK).when(F.col("_failed"), F.col("_first")).alias("failed_task"),
        "optional_failures",
    )


def degraded_status(status: Column, optional_failures: Column) -> Column:
    """A success with failed optional tasks is only partial."""
    return F.when((status == "success") & (F.size(optional_failures) > 0), "partial").otherwise(status)


def upsert_runs(current: DataFrame, reports: DataFrame) -> DataFrame:
    """Current record per run after new reports (run_id, reported_at, status, …).

    The newest report sets the fields; last_run_at is the newest report's time, last_success_at the newest
    one that reported success or partial. ``current`` holds earlier results of this function.
    """
    fields = [c for c in reports.columns if c not in ("run_id", "reported_at")]
    incoming = reports.select(
        "run_id", *fields, F.col("reported_at").alias("last_run_at"),
        F.when(F.col("status").isin(*SUCCESSES), F.col("reported_at")).alias("last_success_at"),
    )
    rows = incoming.unionByName(current, allowMissingColumns=True)
    newest = F.max_by(F.struct(*fields), F.struct("last_run_at", *[c for c in ("seq",) if c in fields]))
    return rows.groupBy("run_id").agg(
        newest.alias("r"), F.max("last_run_at").alias("last_run_at"), F.max("last_success_at").alias("last_success_at")
    ).select("run_id", "r.*", "last_run_at", "last_success_at")


def latest_run(runs: DataFrame, columns: list[str]) -> DataFrame:
    """Latest run per pipeline by start."""
    newest = F.max_by(F.struct(*columns), F.struct("started_at", "run_id"))
    return runs.groupBy("pipeline_id").agg(newest.alias("r")).select("pipeline_id", "r.*")


def duration_seconds() -> Column:
    """Null while a run is unfinished."""
    return seconds_between(F.col("started_at"), F.col("finished_at"))


def sla_breached(as_of: Column | None = None) -> Column:
    """Elapsed time above the run's SLA; an unfinished run is measured up to ``as_of``."""
    end = F.col("finished_at") if as_of is None else F.coalesce(F.col("finished_at"), as_of)
    allowed = F.coalesce(F.col("sla_minutes"), F.lit(DEFAULT_SLA_MINUTES)) * 60
    return F.coalesce(seconds_between(F.col("started_at"), end) > allowed, F.lit(False))


def sla(runs: DataFrame, as_of: Column | None = None) -> DataFrame:
    return runs.select(
        "run_id", "pipeline_id", "sla_minutes",
        duration_seconds().alias("duration_seconds"), sla_breached(as_of).alias("sla_breached"),
    )


def dashboard(runs: DataFrame, as_of: Column | None = None) -> DataFrame:
    """One slim row per pipeline: its latest run, and its last success over the whole history."""
    slim = runs.select(
        "pipeline_id", "run_id", "status", "failed_task", "started_at", "finished_at",
        sla_breached(as_of).alias("sla_breached"), duration_seconds().alias("duration_seconds"),
        F.when(F.col("status").isin(*SUCCESSES), F.coalesce("finished_at", "started_at")).alias("_success"),
    )
    shown = ["run_id", "status", "failed_task", "sla_breached", "started_at", "finished_at", "duration_seconds"]
    return slim.groupBy("pipeline_id").agg(
        F.max_by(F.struct(*shown), F.struct("started_at", "run_id")).alias("r"),
        F.max("started_at").alias("last_run_at"),
        F.max("_success").alias("last_success_at"),
    ).select("pipeline_id", "r.*", "last_run_at", "last_success_at")


def triage(runs: DataFrame) -> DataFrame:
    """Failures by pipeline and failed task."""
    return runs.where("failed_task IS NOT NULL").groupBy("pipeline_id", "failed_task").agg(
        F.count("*").alias("failures")
    )


def quality_trend(runs: DataFrame, days: int = 7) -> DataFrame:
    """Violations per pipeline and day, with the mean over the last ``days`` recorded days.

    Runs are totalled per day first: the window sees a pipeline's days, not its runs.
    """
    daily = runs.groupBy("pipeline_id", F.to_date("started_at").alias("day")).agg(
        F.count("*").alias("runs"), F.sum(F.size("quality_violations")).cast("bigint").alias("violations")
    )
    recent = Window.partitionBy("pipeline_id").orderBy("day").rowsBetween(1 - days, 0)
    return daily.withColumn("moving_avg", F.round(F.avg("violations").over(recent), 6))


def degradation(runs: DataFrame) -> DataFrame:
    """Per pipeline: share of partial runs and the optional task that failed most."""
    shares = runs.groupBy("pipeline_id").agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == "partial").alias("partial_runs")
    )
    tasks = runs.select("pipeline_id", F.explode("optional_failures").alias("task")).groupBy("pipeline_id", "task").agg(
        F.count("*").alias("n")
    )
    # Most failures first, then the smaller name.
    worst = tasks.groupBy("pipeline_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "task")).alias("w"))
    return shares.join(worst, "pipeline_id", "left").select(
        "pipeline_id", "runs", "partial_runs",
        F.round(F.col("partial_runs") / F.col("runs"), 6).alias("partial_share"),
        F.col("w.task").alias("worst_task"), (-F.col("w.n")).alias("worst_task_failures"),
    )


def since_success(runs: DataFrame, as_of: Column) -> DataFrame:
    """Seconds from each pipeline's last success to ``as_of``; null when it never succeeded."""
    success = F.max(F.when(F.col("status").isin(*SUCCESSES), F.col("finished_at")))
    return runs.groupBy("pipeline_id").agg(success.alias("last_success_at")).withColumn(
        "seconds_since_success", seconds_between(F.col("last_success_at"), as_of)
    )


def run_counts(runs: DataFrame) -> DataFrame:
    """Runs started by type and day, with all subtotals; ``level`` tells a subtotal from a null."""
    return runs.select("pipeline_type", F.to_date("started_at").alias("day")).cube("pipeline_type", "day").agg(
        F.count("*").alias("runs"), F.grouping_id().cast("int").alias("level")
    )
