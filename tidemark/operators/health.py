"""Freshness, dependencies, readiness and registry checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.runs import SUCCESSES
from tidemark.operators.schema import seconds_between


def freshness(objects: DataFrame, successes: DataFrame, windows: DataFrame, as_of: Column) -> DataFrame:
    """fresh, stale or unknown for each object.

    objects(object_id, object_class), successes(object_id, succeeded_at), windows(object_class,
    window_minutes). Without a recorded success or a window the status is unknown.
    """
    last = successes.groupBy("object_id").agg(F.max("succeeded_at").alias("last_success_at"))
    age = seconds_between(F.col("last_success_at"), as_of)
    return (
        objects.join(last, "object_id", "left")
        .join(windows, "object_class", "left")
        .select(
            "object_id", "object_class", "last_success_at",
            F.when(F.col("last_success_at").isNull() | F.col("window_minutes").isNull(), "unknown")
            .when(age <= F.col("window_minutes") * 60, "fresh")
            .otherwise("stale")
            .alias("freshness_status"),
        )
    )


def all_fresh(status: DataFrame, by: str) -> DataFrame:
    """Whether every source of an export is fresh; ``status``: the export key and freshness_status."""
    fresh = F.col("freshness_status") == "fresh"
    return status.groupBy(by).agg(
        F.bool_and(fresh).alias("ready"), F.count_if(~fresh).alias("blocking_sources")
    )


def unmet_dependencies(deps: DataFrame, runs: DataFrame, logical_date: str) -> DataFrame:
    """Dependencies (pipeline_id, depends_on, require_same_day) whose upstream has not succeeded.

    Successes are reduced to one row per upstream pipeline first, so the date condition becomes a column
    and the join is on the pipeline alone.
    """
    day = F.lit(logical_date).cast("date")
    done = runs.where(F.col("status").isin(*SUCCESSES)).groupBy(F.col("pipeline_id").alias("depends_on")).agg(
        F.lit(True).alias("_ever"), F.bool_or(F.to_date("started_at") == day).alias("_that_day")
    )
    met = F.when(F.col("require_same_day"), F.col("_that_day")).otherwise(F.col("_ever"))
    return deps.join(done, "depends_on", "left").where(~F.coalesce(met, F.lit(False))).select(
        "pipeline_id", "depends_on", "require_same_day"
    )


def truthy(value: Column, kind: str) -> Column:
    """A value that is neither null, false, zero nor empty."""
    if kind == "boolean":
        return F.coalesce(value, F.lit(False))
    if kind == "string":
        return F.coalesce(value != "", F.lit(False))
    if kind.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")) and not kind.startswith("interval"):
        return F.coalesce(value != 0, F.lit(False))
    return value.isNotNull()  # dates, arrays, binaries and the like have no zero


def is_ready(df: DataFrame) -> DataFrame:
    """One row: whether the query has a first row and its first value is truthy."""
    kind = df.dtypes[0][1]
    # Renamed by position, since a query's column may be called anything.
    first = df.limit(1).toDF(*[f"c{i}" for i in range(len(df.columns))])
    first = first.select(truthy(F.col("c0"), kind).alias("_t"))
    return first.agg(F.coalesce(F.bool_or("_t"), F.lit(False)).alias("ready"))


def registry_issues(pipelines: DataFrame, assets: DataFrame) -> DataFrame:
    """Problems of registered pipelines: repeated name, source asset not active, sensor outliving the run.

    pipelines(pipeline_id, name, asset_id, sensor_timeout, execution_timeout), assets(asset_id, state).
    """
    repeated = pipelines.groupBy("name").agg(F.count("*").alias("_n")).where("_n > 1")
    checked = pipelines.join(repeated, "name", "left").join(assets, "asset_id", "left")
    issues = F.array(
        F.when(F.col("_n").isNotNull(), F.lit("duplicate_name")),
        F.when(~F.col("state").eqNullSafe("active"), F.lit("asset_not_active")),
        F.when(F.col("sensor_timeout") > F.col("execution_timeout"), F.lit("sensor_timeout_exceeds_execution")),
    )
    return checked.select("pipeline_id", F.explode(F.array_compact(issues)).alias("issue"))
