"""Every registered query against its SQL on the same tables."""

from __future__ import annotations

import pytest
from check_oracle import compare, connect

from tidemark.plans.catalog import ORACLES, QUERIES


# Nothing is joined pair by pair and no row leaves the JVM.
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas")


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, duck, sf_dir, key):
    df = QUERIES[key](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in UNWANTED if node in plan]
    verdict, _, _ = compare(spark, duck, sf_dir, lambda *_: df, ORACLES[key])
    assert verdict == "ok"


def test_entry_points(spark):
    import __spark_entry__ as entry_module

    assert entry_module.entry(spark).count() > 0
    # The training-data queries come on top, where their package is present.
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLES) <= set(entry_module.oracle_sql())


def test_session_time_zone_does_not_matter(spark, duck, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for key in ("runs_dashboard", "runs_quality_trend", "cast_contract_orders", "metric_checksum"):
            assert compare(spark, duck, sf_dir, QUERIES[key], ORACLES[key])[0] == "ok"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("key", [
    "schema_versions", "schema_version_drift", "schema_tag_version", "audit_trail", "asset_invalid_transitions",
    "page_slices_customer", "page_slices_offset"])
def test_hot_keys_give_the_same_rows(spark, duck, sf_dir, monkeypatch, key):
    monkeypatch.setattr("tidemark.functions.ordered.SEGMENT_BYTES", 500)
    assert compare(spark, duck, sf_dir, QUERIES[key], ORACLES[key])[0] == "ok"
