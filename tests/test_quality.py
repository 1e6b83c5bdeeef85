from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality, reconcile
from tidemark.operators.quality import Rule

METRICS = "metric string, column string, value double, text string"


def _messages(spark, metrics, rules):
    found = spark.createDataFrame(metrics, METRICS)
    failed = quality.evaluate_gate(found, quality.rules_frame(spark, rules))
    return [r.message for r in failed.orderBy("rule_id").collect()]


RULES = [
    Rule("row_count_min", value=100), Rule("not_null", "email"), Rule("unique", "customer_id"),
    Rule("accepted_values", "status"), Rule("referential_integrity", "order_id"), Rule("checksum", text="abc123"),
]


def test_all_violations(spark):
    metrics = [("row_count", None, 50.0, None), ("null_count", "email", 5.0, None),
               ("duplicate_count", "customer_id", 3.0, None), ("invalid_value_count", "status", 2.0, None),
               ("orphan_count", "order_id", 1.0, None), ("checksum", None, None, "xyz")]
    assert _messages(spark, metrics, RULES) == [
        "VIOLATION row_count_min: got 50, expected >= 100",
        "VIOLATION not_null: column 'email' has 5 null(s)",
        "VIOLATION unique: column 'customer_id' has 3 duplicate(s)",
        "VIOLATION accepted_values: column 'status' has 2 invalid value(s)",
        "VIOLATION referential_integrity: column 'order_id' has 1 orphan record(s)",
        "VIOLATION checksum: got xyz, expected abc123"]


def test_clean_metrics_pass(spark):
    metrics = [("row_count", None, 100.0, None), ("null_count", "email", 0.0, None),
               ("duplicate_count", "customer_id", 0.0, None), ("invalid_value_count", "status", 0.0, None),
               ("orphan_count", "order_id", 0.0, None), ("checksum", None, None, "abc123")]
    assert _messages(spark, metrics, RULES) == []


def test_missing_metrics_fail(spark):
    assert _messages(spark, [], RULES) == [f"VIOLATION {r.type}: metric not computed/missing" for r in RULES]


def test_unknown_rule_passes(spark):
    assert _messages(spark, [], [Rule("made_up", "x", 1)]) == []


def test_nan_row_count_fails_and_nan_counts_do_not(spark):
    nan = float("nan")
    metrics = [("row_count", None, nan, None), ("null_count", "email", nan, None)]
    assert _messages(spark, metrics, RULES[:2]) == ["VIOLATION row_count_min: got NaN, expected >= 100"]


def test_missing_threshold_is_zero(spark):
    assert _messages(spark, [("row_count", None, 0.0, None)], [Rule("row_count_min")]) == []


def test_numeric_checksum_compares_as_text(spark):
    assert _messages(spark, [("checksum", None, None, "12")], [Rule("checksum", value=12)]) == []


def test_batches_and_table_agree(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 2)], "g string, v int")
    rules = [Rule("not_null", "v"), Rule("unique", "v"), Rule("row_count_min", value=3), Rule("not_null", "w")]
    metrics = quality.profile(df, rules[:3], by=["g"])
    failed = quality.evaluate_gate(metrics, quality.rules_frame(spark, rules), ["g"]).collect()
    by_batch = {g: [r.message for r in sorted(failed, key=lambda r: r.rule_id) if r.g == g] for g in "ab"}
    for g in "ab":
        part = quality.profile(df.where(f"g = '{g}'"), rules[:3])
        alone = quality.evaluate_gate(part, quality.rules_frame(spark, rules)).orderBy("rule_id").collect()
        assert by_batch[g] == [r.message for r in alone]


def test_profile_is_one_scan(spark, sf_dir):
    rules = [Rule("row_count_min"), Rule("not_null", "o_custkey"), Rule("unique", "o_orderkey"),
             Rule("accepted_values", "o_orderstatus", accepted=("F",))]
    plan = quality.profile(spark.read.parquet(f"{sf_dir}/orders.parquet"), rules)._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    assert text.count("Relation [") == 1
    assert "o_totalprice" not in text.split("Project")[-1].splitlines()[0]


def test_approximate_duplicates_stay_close(spark):
    df = spark.range(10000).selectExpr("id % 5000 AS v")
    found = quality.profile(df, [Rule("unique", "v")], approx=0.01).where("metric = 'duplicate_count'").first().value
    assert found == pytest.approx(5000, rel=0.05)


def test_duplicates_skip_nulls(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, None), (None, None), (2, 1)], "a int, b int")
    metrics = quality.profile(df, [Rule("unique", "a,b"), Rule("unique", "a")])
    got = {r.column: r.value for r in metrics.where("metric = 'duplicate_count'").collect()}
    assert got == {"a,b": 1.0, "a": 2.0}


@pytest.mark.parametrize("expected, actual, left, right, ok", [
    (1000, 1000, "a", "a", True), (1000, 995, None, None, True), (1000, 994, None, None, False),
    (1000, 1006, None, None, False), (0, 500, None, None, True), (10, 10, "a", "b", False), (10, 10, "a", None, True),
    (10, 10, "", "b", True)])
def test_reconcile(spark, expected, actual, left, right, ok):
    loads = spark.createDataFrame([(expected, actual, left, right)],
                                  "expected_rows long, actual_rows long, s string, d string")
    result = reconcile.reconcile(loads, source_checksum="s", destination_checksum="d").first()
    assert result.validation_ok is ok


def test_undelivered_and_unexpected_units_fail(spark):
    source = spark.createDataFrame([(1, "a"), (2, "b")], "v int, g string")
    delivered = spark.createDataFrame([(1, "a"), (3, "c")], "v int, g string")
    result = reconcile.validate_delivery(source, delivered, ["v"], ["g"])
    assert {r.g: r.delivered_ok for r in result.collect()} == {"a": True, "b": False, "c": False}


def test_many_unique_rules_split_into_passes(spark):
    names = [f"c{i}" for i in range(6)]
    df = spark.range(60).select(*[(F.col("id") % (i + 2)).alias(c) for i, c in enumerate(names)])
    got = {r.column: r.value for r in quality.profile(df, [Rule("unique", c) for c in names]).collect() if r.column}
    assert got == {c: 60.0 - (i + 2) for i, c in enumerate(names)}
    assert quality.profile(df, [Rule("unique", c) for c in names]).where("metric = 'row_count'").count() == 1
