"""Plans that have to hold at scale: pruned and pushed down scans, early aggregation, bounded windows."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidemark.operators import approvals, cdc, quality, runs
from tidemark.plans.catalog import QUERIES
from tidemark.plans.inputs import Inputs
from tidemark.sources import tables


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _columns_read(df):
    found = re.findall(r"ReadSchema: struct<([^>]*)>", df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted"))
    return [sorted(part.split(":")[0] for part in schema.split(",") if part) for schema in found]


def test_watermark_reaches_the_scan(spark, sf_dir):
    fresh, _ = tables.extract_incremental(Inputs(spark, sf_dir).orders, "o_orderdate", F.lit("1998-01-01").cast("timestamp_ntz"))
    assert "GreaterThan(o_orderdate" in _plan(fresh)


def test_metrics_read_their_own_columns_only(spark, sf_dir):
    df = QUERIES["metric_duplicates"](spark, sf_dir)
    assert _columns_read(df) == [["l_linenumber", "l_orderkey"]]


def test_distinct_counts_shrink_before_the_shuffle(spark, sf_dir):
    plan = _plan(quality.profile(Inputs(spark, sf_dir).lineitem, [quality.Rule("unique", "l_orderkey")]))
    assert "HashAggregate(keys=[l_orderkey" in plan[plan.rindex("Exchange hashpartitioning(l_orderkey"):]


def test_orphan_keys_are_counted_before_the_join(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # With a parent too large to broadcast, as it is at scale.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(quality.orphans(t.orders_broken, t.customer_kept, "o_custkey", "c_custkey"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.index("LeftAnti") < plan.index("partial_count")


def test_latest_rows_need_no_window(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    for df in (runs.dashboard(t.runs), runs.latest_run(t.runs, ["run_id"]), approvals.baseline(t.discovery_runs),
               cdc.apply_cdc(t.orders, t.order_changes, ["o_orderkey"], "seq", "op")):
        assert "Window" not in _plan(df)


def test_recent_runs_are_limited_before_the_shuffle(spark, sf_dir):
    plan = _plan(approvals.recent_runs(Inputs(spark, sf_dir).discovery_runs))
    assert plan.count("WindowGroupLimit") == 2


def test_bounded_write_has_to_split_files(spark, sf_dir, monkeypatch):
    from tidemark.plans import ingestion
    from tidemark.plans.catalog import QUERIES

    written = ingestion.tables.write_dataset
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert QUERIES["bounded_batch_write"](spark, sf_dir).first()["n_rows"] == rows
    # Without the bound the same write is found out.
    monkeypatch.setattr(ingestion.tables, "write_dataset", lambda *a, max_records=None, **k: written(*a, **k))
    assert QUERIES["bounded_batch_write"](spark, sf_dir).first()["bounded"] is False
