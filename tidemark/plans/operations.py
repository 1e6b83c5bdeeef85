"""Registered queries: run history, health, freshness, audit and the streaming twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import audit, health, runs
from tidemark.operators.quality import Rule
from tidemark.plans.registry import Inputs, query
from tidemark.session import scratch_path
from tidemark.streaming.gate import gate_stream
from tidemark.streaming.run_state import current_runs, track_runs

AS_OF = "2024-02-01 00:00:00"


def _day_text(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.col("day").cast("string"))


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


@query("run_final_status", """
    SELECT run_id, CASE WHEN gate THEN 'quality_failed' WHEN failed > 0 THEN 'failed' WHEN degraded IS NOT NULL THEN 'partial'
                        ELSE 'success' END AS status,
           CASE WHEN gate THEN 'validation_and_metrics.quality_gate' WHEN failed > 0 THEN first_failed END AS failed_task,
           coalesce(degraded, '') AS optional_failures
    FROM (SELECT run_id, bool_or(NOT optional AND state = 'failed' AND task_id LIKE '%quality_gate%') AS gate,
                 count(*) FILTER (WHERE NOT optional AND state = 'failed') AS failed,
                 arg_min(task_id, task_order) FILTER (WHERE NOT optional AND state = 'failed') AS first_failed,
                 string_agg(task_id, ',' ORDER BY task_id) FILTER (WHERE optional AND state IN ('failed', 'upstream_failed'))
                     AS degraded
          FROM {run_tasks} GROUP BY run_id)""")
def _(t: Inputs) -> DataFrame:
    return runs.run_status(t.run_tasks).withColumn("optional_failures", F.array_join("optional_failures", ","))


def _reports(t: Inputs) -> DataFrame:
    """Three reports of a run on average: events are reports of the run their user and type form."""
    return t.runs.select(
        F.concat_ws("-", F.col("pipeline_id").cast("string"), F.to_date("started_at").cast("string")).alias("run_id"),
        F.col("started_at").alias("reported_at"), "status", "failed_task", F.col("run_id").alias("seq"))


_REPORTS = """
    SELECT concat(pipeline_id, '-', CAST(started_at AS DATE)) AS run_id, started_at AS reported_at, status, failed_task,
           run_id AS seq FROM {runs}"""
_STATE = f"""
    SELECT run_id, arg_max(status, seq) AS status,
           list_extract(list(failed_task ORDER BY seq DESC), 1) AS failed_task,
           max(seq) AS seq, max(reported_at) AS last_run_at,
           max(reported_at) FILTER (WHERE status IN ('success', 'partial')) AS last_success_at
    FROM ({_REPORTS}) GROUP BY run_id"""


@query("runs_upsert", _STATE)
def _(t: Inputs) -> DataFrame:
    from tidemark.streaming.run_state import collapse

    reports = _reports(t)
    early = F.col("reported_at") < F.lit("2024-01-15").cast("timestamp_ntz")
    return runs.upsert_runs(collapse(reports.where(early)), reports.where(~early))


@query("runs_latest", """
    SELECT pipeline_id, run_id, status, started_at FROM (
      SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY started_at DESC, run_id DESC) AS rn FROM {runs})
    WHERE rn = 1""")
def _(t: Inputs) -> DataFrame:
    return runs.latest_run(t.runs, ["run_id", "status", "started_at"])


@query("runs_dashboard", f"""
    SELECT pipeline_id, run_id, status, failed_task, started_at, finished_at,
           coalesce(coalesce(finished_at, TIMESTAMP '{AS_OF}') - started_at > INTERVAL '1' MINUTE * sla_minutes, false)
               AS sla_breached,
           CAST(date_diff('microsecond', started_at, finished_at) // 1000000 AS BIGINT) AS duration_seconds,
           last_run_at, last_success_at
    FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY started_at DESC, run_id DESC) AS rn,
                 max(started_at) OVER (PARTITION BY pipeline_id) AS last_run_at,
                 max(CASE WHEN status IN ('success', 'partial') THEN coalesce(finished_at, started_at) END)
                     OVER (PARTITION BY pipeline_id) AS last_success_at
          FROM {{runs}}) WHERE rn = 1""")
def _(t: Inputs) -> DataFrame:
    return runs.dashboard(t.runs, _as_of())


@query("runs_sla_breach", f"""
    SELECT run_id, pipeline_id, CAST(sla_minutes AS INTEGER) AS sla_minutes,
           CAST(date_diff('microsecond', started_at, finished_at) // 1000000 AS BIGINT) AS duration_seconds,
           coalesce(finished_at, TIMESTAMP '{AS_OF}') - started_at >= INTERVAL '1' MINUTE * sla_minutes + INTERVAL '1' SECOND
               AS sla_breached
    FROM {{runs}}""")
def _(t: Inputs) -> DataFrame:
    return runs.sla(t.runs, _as_of())


_WINDOWS = "SELECT 'ingestion' AS object_class, 720 AS window_minutes UNION ALL SELECT 'etl', 2880"
_FRESH = f"""
    SELECT o.object_id, o.object_class, last_success_at,
           CASE WHEN last_success_at IS NULL OR window_minutes IS NULL THEN 'unknown'
                WHEN date_diff('microsecond', last_success_at, TIMESTAMP '2024-01-31 00:00:00') // 1000000
                     <= window_minutes * 60 THEN 'fresh' ELSE 'stale' END AS freshness_status
    FROM (SELECT DISTINCT pipeline_id AS object_id, pipeline_type AS object_class FROM {{runs}}) o
    LEFT JOIN (SELECT pipeline_id, max(finished_at) AS last_success_at FROM {{runs}}
               WHERE status IN ('success', 'partial') GROUP BY pipeline_id) s ON s.pipeline_id = o.object_id
    LEFT JOIN ({_WINDOWS}) w ON w.object_class = o.object_class"""


def _freshness(t: Inputs) -> DataFrame:
    history = t.runs
    objects = history.select(F.col("pipeline_id").alias("object_id"), F.col("pipeline_type").alias("object_class")).distinct()
    successes = history.where(F.col("status").isin(*runs.SUCCESSES)).select(
        F.col("pipeline_id").alias("object_id"), F.col("finished_at").alias("succeeded_at"))
    windows = t.spark.createDataFrame([("ingestion", 720), ("etl", 2880)], "object_class string, window_minutes int")
    return health.freshness(objects, successes, windows, F.lit("2024-01-31").cast("timestamp_ntz"))


@query("freshness_status", _FRESH.replace("{{", "{").replace("}}", "}"))
def _(t: Inputs) -> DataFrame:
    return _freshness(t)


@query("deps_unmet", """
    SELECT pipeline_id, depends_on, require_same_day FROM {deps} d
    WHERE NOT EXISTS (SELECT 1 FROM {runs} r WHERE r.pipeline_id = d.depends_on AND r.status IN ('success', 'partial')
                      AND (NOT d.require_same_day OR CAST(r.started_at AS DATE) = DATE '2024-01-15'))""")
def _(t: Inputs) -> DataFrame:
    return health.unmet_dependencies(t.deps, t.runs, "2024-01-15")


@query("sensor_ready", """
    SELECT 'late_orders' AS sensor, count(*) > 0 AS ready FROM {orders} WHERE o_orderstatus = 'P'
    UNION ALL SELECT 'negative_prices', count(*) FILTER (WHERE o_totalprice < 0) > 0 FROM {orders}
    UNION ALL SELECT 'no_rows', false
    UNION ALL SELECT 'has_error', bool_or(event_type = 'error') FROM {events}""")
def _(t: Inputs) -> DataFrame:
    checks = {
        "late_orders": t.orders.where("o_orderstatus = 'P'").agg(F.count("*").alias("n")),
        "negative_prices": t.orders.agg(F.count_if(F.col("o_totalprice") < 0).alias("n")),
        "no_rows": t.orders.where("o_totalprice < 0").select("o_orderkey"),
        "has_error": t.events.agg(F.bool_or(F.col("event_type") == "error").alias("found")),
    }
    parts = None
    for name, check in checks.items():
        part = health.is_ready(check).select(F.lit(name).alias("sensor"), "ready")
        parts = part if parts is None else parts.unionByName(part)
    return parts


@query("export_readiness", f"""
    WITH f AS ({_FRESH.replace("{{", "{").replace("}}", "}")})
    SELECT object_class, bool_and(freshness_status = 'fresh') AS ready,
           count(*) FILTER (WHERE freshness_status <> 'fresh') AS blocking_sources
    FROM f GROUP BY object_class""")
def _(t: Inputs) -> DataFrame:
    return health.all_fresh(_freshness(t), "object_class")


@query("runs_triage", """
    SELECT pipeline_id, failed_task, count(*) AS failures FROM {runs} WHERE failed_task IS NOT NULL
    GROUP BY pipeline_id, failed_task""")
def _(t: Inputs) -> DataFrame:
    return runs.triage(t.runs)


@query("runs_quality_trend", """
    SELECT pipeline_id, CAST(day AS VARCHAR) AS day, runs, violations,
           round(avg(violations) OVER (PARTITION BY pipeline_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6)
               AS moving_avg
    FROM (SELECT pipeline_id, CAST(started_at AS DATE) AS day, count(*) AS runs,
                 CAST(sum(len(quality_violations)) AS BIGINT) AS violations FROM {runs} GROUP BY 1, 2)""")
def _(t: Inputs) -> DataFrame:
    return _day_text(runs.quality_trend(t.runs))


@query("runs_degradation", """
    SELECT s.pipeline_id, s.runs, s.partial_runs, round(s.partial_runs / s.runs, 6) AS partial_share,
           w.task AS worst_task, w.n AS worst_task_failures
    FROM (SELECT pipeline_id, count(*) AS runs, count(*) FILTER (WHERE status = 'partial') AS partial_runs FROM {runs}
          GROUP BY pipeline_id) s
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY n DESC, task) AS rn
               FROM (SELECT pipeline_id, task, count(*) AS n
                     FROM (SELECT pipeline_id, unnest(optional_failures) AS task FROM {runs}) GROUP BY 1, 2)) w
    ON w.pipeline_id = s.pipeline_id AND w.rn = 1""")
def _(t: Inputs) -> DataFrame:
    return runs.degradation(t.runs)


@query("runs_since_success", f"""
    SELECT pipeline_id, last_success_at,
           CAST(date_diff('microsecond', last_success_at, TIMESTAMP '{AS_OF}') // 1000000 AS BIGINT) AS seconds_since_success
    FROM (SELECT pipeline_id, max(CASE WHEN status IN ('success', 'partial') THEN finished_at END) AS last_success_at
          FROM {{runs}} GROUP BY pipeline_id)""")
def _(t: Inputs) -> DataFrame:
    return runs.since_success(t.runs, _as_of())


@query("runs_counts_cube", """
    SELECT pipeline_type, CAST(day AS VARCHAR) AS day, count(*) AS runs, CAST(grouping_id(pipeline_type, day) AS INTEGER) AS level
    FROM (SELECT pipeline_type, CAST(started_at AS DATE) AS day FROM {runs}) GROUP BY CUBE (pipeline_type, day)""")
def _(t: Inputs) -> DataFrame:
    return _day_text(runs.run_counts(t.runs))


@query("audit_trail", """
    SELECT *, row_number() OVER w AS event_number, lag(event_type) OVER w AS previous_event,
           lag(actor_id) OVER w AS previous_actor
    FROM {audit} WINDOW w AS (PARTITION BY entity_id ORDER BY happened_at, audit_id)""")
def _(t: Inputs) -> DataFrame:
    return audit.audit_trail(t.audit)


@query("audit_last_actor", """
    SELECT entity_id, count(*) AS events, arg_max(actor_id, audit_id) AS last_actor, max(happened_at) AS last_at
    FROM {audit} GROUP BY entity_id""")
def _(t: Inputs) -> DataFrame:
    return audit.last_actors(t.audit)


@query("asset_invalid_transitions", """
    SELECT asset_id, event_id, happened_at, from_state, state AS to_state
    FROM (SELECT *, lag(state) OVER (PARTITION BY asset_id ORDER BY happened_at, event_id) AS from_state FROM {state_log})
    WHERE from_state IS NOT NULL AND (from_state, state) NOT IN (('draft', 'active'), ('active', 'deprecated'),
          ('deprecated', 'archived'))""")
def _(t: Inputs) -> DataFrame:
    return audit.invalid_transitions(t.state_log)


@query("registry_issues", """
    WITH n AS (SELECT p_name, count(*) AS c FROM {part} GROUP BY p_name)
    SELECT p_partkey AS pipeline_id, issue FROM (
      SELECT p_partkey, unnest(list_value(
          CASE WHEN (SELECT c FROM n WHERE n.p_name = p.p_name) > 1 THEN 'duplicate_name' END,
          CASE WHEN s_acctbal IS NULL OR s_acctbal <= 0 THEN 'asset_not_active' END,
          CASE WHEN p_size > 45 THEN 'sensor_timeout_exceeds_execution' END)) AS issue
      FROM {part} p LEFT JOIN {supplier} ON s_suppkey = p_size) WHERE issue IS NOT NULL""")
def _(t: Inputs) -> DataFrame:
    # A part stands for a pipeline, the supplier its size names for its source asset.
    pipelines = t.part.select(
        F.col("p_partkey").alias("pipeline_id"), F.col("p_name").alias("name"),
        F.col("p_size").cast("bigint").alias("asset_id"), F.col("p_size").alias("sensor_timeout"),
        F.lit(45).alias("execution_timeout"))
    assets = t.supplier.select(
        F.col("s_suppkey").alias("asset_id"), F.when(F.col("s_acctbal") > 0, "active").otherwise("draft").alias("state"))
    return health.registry_issues(pipelines, assets)


@query("stream_runs_state", _STATE)
def _(t: Inputs) -> DataFrame:
    landing, state, checkpoint = (scratch_path(t.spark, x) for x in ("reports", "state", "offsets"))
    reports = _reports(t)
    early = F.col("reported_at") < F.lit("2024-01-15").cast("timestamp_ntz")
    for part in (early, ~early):
        reports.where(part).write.mode("append").parquet(landing)
        track_runs(t.spark, landing, reports.schema, state, checkpoint)
        track_runs(t.spark, landing, reports.schema, state, checkpoint)
    return current_runs(t.spark, state)


@query("stream_gate", """
    SELECT 'accepted' AS destination, o_orderstatus, count(*) AS n_rows FROM {orders} GROUP BY o_orderstatus
    UNION ALL SELECT 'rejected', o_orderstatus, count(*) FROM {orders_broken} GROUP BY o_orderstatus""")
def _(t: Inputs) -> DataFrame:
    landing, accepted, rejected, checkpoint = (
        scratch_path(t.spark, x) for x in ("orders", "accepted", "rejected", "offsets"))
    rules = [Rule("not_null", "o_custkey"), Rule("accepted_values", "o_orderstatus", accepted=("F", "O", "P"))]
    for batch in (t.orders, t.orders_broken):
        batch.write.mode("append").parquet(landing)
        gate_stream(t.spark, landing, t.orders.schema, rules, accepted, rejected, checkpoint)
    both = [t.spark.read.schema(t.orders.schema).parquet(path).withColumn("destination", F.lit(name))
            for name, path in (("accepted", f"{accepted}/*"), ("rejected", f"{rejected}/*"))]
    return both[0].unionByName(both[1]).groupBy("destination", "o_orderstatus").agg(F.count("*").alias("n_rows"))
