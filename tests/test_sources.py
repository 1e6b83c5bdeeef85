"""Reading sources in parts, landing them, and what is known of them from the landed files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import prepare
from tidemark.session import scratch_path
from tidemark.sources import tables


def test_jdbc_reads_are_split_and_qualified():
    source = tables.JdbcSource("jdbc:x", {"fetchsize": "1000"}, {"partitionColumn": "id", "numPartitions": "8"})
    assert source.read_options("t") == {"url": "jdbc:x", "fetchsize": "1000", "dbtable": "public.t", "partitionColumn": "id",
                                        "numPartitions": "8"}
    assert source.read_options("s.t")["dbtable"] == "s.t"
    # A query is a sub-select, so that it can be split as well.
    assert source.read_options(query="SELECT 1; ") == {"url": "jdbc:x", "fetchsize": "1000", "dbtable": "(SELECT 1) q",
                                                       "partitionColumn": "id", "numPartitions": "8"}
    split = tables.JdbcSource("jdbc:x", split_column="id", sample_clause="TABLESAMPLE SYSTEM (1)")
    assert split.sample_options("t") == {"url": "jdbc:x", "query": "SELECT id FROM public.t TABLESAMPLE SYSTEM (1)"}
    assert split.sample_options(query="SELECT * FROM s.t")["query"] == "SELECT id FROM (SELECT * FROM s.t) q"


@pytest.mark.parametrize(("column", "even"), [
    ("o_orderkey", True), ("o_orderdate", True), ("CAST(o_orderdate AS DATE)", True), ("o_totalprice", True),
    ("CAST(o_totalprice AS DECIMAL(18,2))", True), ("concat(o_orderstatus, chr(39), o_orderpriority)", False)])
def test_predicates_cut_a_table_into_even_parts_that_hold_every_row_once(spark, sf_dir, column, even):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.expr(column).alias("c"))
    rows = orders.unionByName(orders.limit(40).select(F.lit(None).cast(orders.schema["c"].dataType).alias("c")))
    bounds = tables.split_bounds(rows, "c", 8)
    predicates = tables.split_predicates("c", bounds)
    counts = [rows.where(p).count() for p in predicates]
    assert sum(counts) == rows.count() and len(predicates) == len(bounds) + 1 <= 8
    if even:
        assert len(predicates) == 8 and max(counts) < 2 * rows.count() / 8
    assert tables.split_predicates("c", tables.split_bounds(rows.where("c IS NULL"), "c", 8)) == ["1 = 1"]


def test_split_reads_ask_for_one_part_a_predicate(spark):
    """What the reader is asked for, without a database."""
    calls = []

    class Reader:
        def format(self, name):
            return self

        def options(self, **options):
            calls.append(options)
            return self

        def load(self):
            return spark.range(100).select(F.col("id"))

        def jdbc(self, url, table, predicates, properties):
            calls.append((url, table, predicates, properties))

    class Session:
        read = Reader()

    source = tables.JdbcSource("jdbc:x", {"user": "me"}, split_column="id", split_parts=3)
    tables.extract(Session, source, query="SELECT * FROM t")
    assert calls[0] == {"url": "jdbc:x", "user": "me", "query": "SELECT id FROM (SELECT * FROM t) q"}
    assert calls[1] == ("jdbc:x", "(SELECT * FROM t) q", ["id < 33 OR id IS NULL", "id >= 33 AND id < 66", "id >= 66"], {"user": "me"})


def test_extract_by_strategy_and_land(spark, sf_dir):
    source = tables.ParquetSource(sf_dir)
    mark = F.lit("1998-01-01").cast("timestamp_ntz")
    total = tables.extract_configured(spark, source, tables.ExtractOptions("public.orders")).count()
    options = tables.ExtractOptions("orders", "incremental", "o_orderdate", "o_orderstatus", "gzip")
    path = scratch_path(spark, "landed")
    rows, new_mark = tables.land_configured(spark, source, options, path, mark)
    assert 0 < rows.count() == new_mark.first().new_rows < total
    assert spark.read.parquet(path).groupBy("o_orderstatus").count().count() == 3
    assert tables.extract_configured(spark, source, options).count() == total
    own = tables.ExtractOptions("orders", "incremental", "o_orderdate", query="SELECT o_orderkey FROM {orders} LIMIT 3")
    landed, none = tables.land_configured(spark, source, own, scratch_path(spark, "landed"), mark)
    assert landed.count() == 3 and none is None
    with pytest.raises(ValueError):
        tables.extract_configured(spark, source, tables.ExtractOptions("orders", "incremental"), mark)
    with pytest.raises(ValueError):
        tables.extract_configured(spark, source, tables.ExtractOptions("orders", "streaming"))


def test_rows_that_arrive_between_scan_and_landing_are_not_lost(spark):
    """The source grows once its rows were planned, and again once they were landed; the next extract gets the rest."""
    root = scratch_path(spark, "growing")

    def add(low, high):
        spark.range(low, high).selectExpr("id AS k", "id AS w").write.mode("append").parquet(f"{root}/t.parquet")

    source, options = tables.ParquetSource(root), tables.ExtractOptions("t", "incremental", "w")
    add(1, 11)
    seen, mark = [], F.lit(0)
    for step in range(3):
        path = scratch_path(spark, "landed")
        rows = tables.extract_configured(spark, source, options, mark)
        add(100 * step + 11, 100 * step + 21)
        tables.land(rows, path, options)
        add(100 * step + 21, 100 * step + 31)
        landed = spark.read.parquet(path)
        seen += [r.k for r in landed.collect()]
        mark = F.lit(tables.landed_mark(landed, "w", mark).first().high_watermark)
    seen += [r.k for r in tables.extract_configured(spark, source, options, mark).collect()]
    assert sorted(seen) == sorted(r.k for r in spark.read.parquet(f"{root}/t.parquet").collect())


def test_partition_columns_come_back_from_folders(spark):
    root = scratch_path(spark, "parts")
    rows = [(1, "a b", 7), (2, "x/y=z", 8), (3, "50%+1", 7), (4, None, 9), (5, "é", 7)]
    df = spark.createDataFrame(rows, "k int, name string, n int")
    df.write.partitionBy("name", "n").parquet(f"{root}/in/deep")
    found = tables.extract_files(spark, root)
    assert found.columns == ["k", "n", "name", "source_file"]
    assert sorted(tuple(r) for r in found.select("k", "name", "n").collect()) == [(k, name, str(n)) for k, name, n in rows]
    typed = tables.extract_files(spark, root, glob="*.parquet", partitions="n int, name string")
    assert sorted(tuple(r) for r in typed.select("k", "name", "n").collect()) == rows
    bucket = tables.BucketSource("path", root, "in", glob="nothing*", schema="k int")
    assert bucket.read(spark, "deep").count() == 0


def test_a_table_that_cannot_be_read_is_null_with_its_error(spark):
    broken = scratch_path(spark, "broken")
    spark.sql("SELECT 'no parquet' AS t").write.text(broken, compression="none")
    readers = {"a": lambda: spark.range(4), "b": lambda: spark.read.parquet("/nowhere/at/all"),
               "c": lambda: spark.read.schema("a int").parquet(broken), "d": lambda: spark.range(7)}
    counts = {r.object: (r.row_count, r.error) for r in prepare.row_counts(spark, readers).collect()}
    assert counts["a"] == (4, None) and counts["d"] == (7, None)
    assert counts["b"][0] is None and "/nowhere/at/all" in counts["b"][1]
    assert counts["c"][0] is None and counts["c"][1]
