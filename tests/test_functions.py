from __future__ import annotations

import fnmatch

import pytest
from pyspark.sql import functions as F

from tidemark.functions.checksum import checksum
from tidemark.functions.globs import matches_any
from tidemark.functions.names import canonical_names
from tidemark.functions.ordered import Ordered
from tidemark.functions.types import normalize_types


def test_canonical_names():
    assert canonical_names([" Order ID ", "orderId", "Total (USD)", "a__b", "2nd", "!!!"]) == [
        "order_id", "order_id_2", "total_usd", "a_b", "2nd", "col"]


def test_canonical_names_never_collide():
    assert canonical_names(["a", "A", "a_2", "a"]) == ["a", "a_2", "a_2_2", "a_3"]


@pytest.mark.parametrize("glob", ["*", "raw.*", "raw.t?", "[ab]*", "[!ab]*", "x[", "a.b", "a+b", "*$", "[a-c]1", "", "#*"])
def test_globs_match_like_the_shell(spark, glob):
    names = ["raw.t1", "raw.t12", "a1", "b", "c1", "x[", "a.b", "axb", "a+b", "cost$", "RAW.t1", "", "line\nbreak", "#1"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n for r in df.where(matches_any(F.col("n"), [glob])).collect()}
    assert got == {n for n in names if fnmatch.fnmatchcase(n, glob)}


def test_no_globs_match_nothing(spark):
    assert spark.range(3).where(matches_any(F.col("id").cast("string"), [])).count() == 0


def test_checksum_ignores_order_and_tells_nulls_apart(spark):
    def total(rows):
        return spark.createDataFrame(rows, "a string, b string, c double").agg(
            checksum(spark.createDataFrame([], "a string, b string, c double")).alias("c")).first().c

    base = [("x", None, 1.5), ("y", "z", 2.0)]
    assert total(base) == total(list(reversed(base)))
    assert total(base) != total([(None, "x", 1.5), ("y", "z", 2.0)])
    assert total([]) == "0:0"
    # The same row twice, a thousandth, a sign, no number.
    assert len({total(rows) for rows in (base, [*base, base[0]], [("x", None, 1.501), base[1]], [("x", None, 1.504), base[1]],
                                         [("x", None, -1.5), base[1]], [("x", None, float("nan")), base[1]], [("x", None, None), base[1]])}) == 7


def _skewed(spark):
    """A third of the rows under one key, ties in the first order column, a null key and a single row key."""
    n = 3000
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, F.lit(None)).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 37).cast("string")))
    return spark.range(n).select(key.alias("k"), F.floor(F.col("id") / 5).alias("t"), F.col("id").alias("n"),
                                 F.when(F.col("id") % 4 != 0, F.col("id") * 2).alias("v"))


@pytest.mark.parametrize("keys", [["k"], [], ["k", "j"]])
@pytest.mark.parametrize("segments", [2, 13, 400])
def test_segments_equal_plain_windows(spark, rows, keys, segments):
    """Sums of what stands on a row, and of what differs from the row before, which a boundary may hide."""
    def build(count):
        df = _skewed(spark).withColumn("j", F.when(F.col("n") % 2 == 0, F.col("n") % 4))
        changed = F.col("pv").isNull() | (F.col("pv") < F.col("v"))
        return Ordered(df, ["t", "n"], keys, count).row_number("rn").previous({"pv": "v", "pn": "n"}).running_sum(
            {"s": F.col("v"), "c": changed.cast("int")}).done()

    want, got = build(1), build(segments)
    assert got.columns == want.columns == ["k", "t", "n", "v", "j", "rn", "pv", "pn", "s", "c"]
    assert rows(got) == rows(want)


def test_a_hot_key_lies_in_many_segments_and_none_is_in_one_task(spark):
    ordered = Ordered(_skewed(spark), ["t", "n"], ["k"], 40).row_number().previous({"pn": "n"})
    got = ordered.done()
    plan = got._jdf.queryExecution().executedPlan().toString()
    # The written segments are read for the result and for their ends.
    assert "SinglePartition" not in plan and plan.count("FileScan parquet") == 2
    assert got.where("k = 'hot'").count() == 1000
    whole = Ordered(_skewed(spark), ["t", "n"], None, 40).row_number().done()
    assert "SinglePartition" not in whole._jdf.queryExecution().executedPlan().toString()
    assert whole.agg(F.max("row_number")).first()[0] == 3000


def test_segments_follow_the_bytes(spark, monkeypatch):
    from tidemark.functions import ordered

    assert ordered.segments_for(spark.range(1000)) == 1
    monkeypatch.setattr(ordered, "SEGMENT_BYTES", 1000)
    assert ordered.segments_for(spark.range(1000)) == 8
    assert ordered.segments_for(spark.range(10**6)) == ordered.SEGMENTS_A_TASK * 4


def test_ordering_nothing(spark):
    empty = _skewed(spark).where("n < 0")
    assert Ordered(empty, ["t", "n"], ["k"], 5).row_number().previous({"pn": "n"}).done().collect() == []


def test_type_map_falls_back_to_the_bare_type(spark, rows):
    df = spark.createDataFrame([
        ("openapi", "integer", "int64"), ("openapi", "string", "ipv4"), ("openapi", "file", ""),
        ("relational", "Numeric", None), ("relational", "Inet", ""), ("bson", "date", ""), ("sample", "NoneType", ""),
    ], "system string, type string, format string")
    assert rows(normalize_types(df), "type", "normalized_type") == [
        ("Inet", "unknown"), ("NoneType", "string"), ("Numeric", "float"), ("date", "timestamp"), ("file", "string"),
        ("integer", "bigint"), ("string", "string")]


def test_names_keep_letters_and_fold_accents():
    from tidemark.functions.names import canonical_names

    assert canonical_names(["endereço", "価格", "Ünit Price", "a-b", "__", "orderID"]) == ["endereco", "価格", "unit_price", "a_b", "col", "order_id"]


def test_exact_hash_tells_rows_apart(spark):
    from pyspark.sql import functions as F

    from tidemark.functions.checksum import checksum, exact_hash

    rows = [("a|b", "c", 1e17), ("a", "b|c", 1e17), ("\\N", "c", 0.001), (None, "c", 0.001), ("a", "c", 0.0010000000000000002),
            ("a", "c", float("nan")), ("a", "c", None), ("a", "c", float("inf"))]
    df = spark.createDataFrame(rows, "x string, y string, z double")
    assert df.select(F.count_distinct(exact_hash(df, df.columns))).first()[0] == len(rows)
    assert df.agg(checksum(df)).first()[0]


def test_any_first_value_can_be_ready(spark):
    from tidemark.operators.health import is_ready

    for sql, want in (("SELECT current_date()", True), ("SELECT array()", True), ("SELECT X'00'", True), ("SELECT timestamp '2024-01-01'", True),
                      ("SELECT 0.0", False), ("SELECT CAST(NULL AS DATE)", False), ("SELECT ''", False), ("SELECT 2", True)):
        assert is_ready(spark.sql(sql)).first()["ready"] is want


def test_an_updated_tie_is_fetched_again(spark):
    from pyspark.sql import functions as F

    from tidemark.sources.tables import extract_incremental, extract_unmarked

    now = spark.createDataFrame([(1, 31), (2, 30), (3, 30), (4, 40), (5, None)], "k int, w int")
    loaded = spark.createDataFrame([(1, 30), (2, 30)], "k int, w int")
    fresh, mark = extract_incremental(now, "w", F.lit(30), True, loaded, ["k"], upto=F.lit(35))
    assert sorted(r["k"] for r in fresh.collect()) == [1, 3] and mark.first()["high_watermark"] == 31
    assert [r["k"] for r in extract_unmarked(now, "w").collect()] == [5]


def test_unfit_changes_and_unreadable_documents_are_reported(spark):
    from tidemark.operators.cdc import rejected_changes
    from tidemark.operators.infer import unreadable_documents

    changes = spark.createDataFrame([(1, None, 1), (2, "delete", None), (3, "update", 2)], "k int, op string, seq int")
    assert sorted((r["k"], r["reason"]) for r in rejected_changes(changes, "seq", "op").collect()) == [
        (1, "no operation"), (2, "no sequence number")]
    docs = spark.createDataFrame([("a", "{}"), ("a", "{oops"), ("b", None)], "o string, body string")
    assert sorted(tuple(r) for r in unreadable_documents(docs, "body", "o").collect()) == [("a", 2, 1), ("b", 1, 0)]


def test_mappings_repeated_in_a_batch_are_stored_once(spark):
    from tidemark.operators.lineage import upsert

    kind = "pipeline_id string, source_object_id string, destination_object_id string, mapping string"
    old = spark.createDataFrame([("p", "a", "b", "1"), ("p", None, "c", "2")], kind)
    new = spark.createDataFrame([("p", "a", "b", "3"), ("p", "a", "b", "4"), ("p", None, "c", "5")], kind)
    assert {tuple(r) for r in upsert(old, new).collect()} == {("p", "a", "b", "4"), ("p", None, "c", "5")}
    assert upsert(old, new).count() == 2
