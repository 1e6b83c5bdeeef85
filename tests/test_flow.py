"""Extraction, loading, publishing, streaming and run history."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions.types import canonical_of
from tidemark.operators import audit, cdc, commits, health, publish, runs, schema, tags
from tidemark.operators.governed import LoadPlan, governed_load
from tidemark.operators.prepare import Element
from tidemark.operators.quality import Rule
from tidemark.session import cut_counted, scratch_path
from tidemark.sources import tables
from tidemark.streaming.gate import gate_stream
from tidemark.streaming.landing import load_new_files
from tidemark.streaming.run_state import compact_runs, current_runs, folders, track_runs


def test_bucket_roots():
    assert tables.BucketSource("s3", "lake", "/raw/x/").root == "s3a://lake/raw/x"
    assert tables.BucketSource("azure", "c@a.dfs.core.windows.net").root == "abfss://c@a.dfs.core.windows.net"
    with pytest.raises(ValueError):
        _ = tables.BucketSource("ftp", "x").root


def test_incremental_keeps_the_old_mark_without_news(spark):
    df = spark.createDataFrame([(1, 10), (2, 20)], "k int, w int")
    fresh, mark = tables.extract_incremental(df, "w", F.lit(20))
    assert fresh.isEmpty() and tuple(mark.first()) == (20, 0)


def test_late_ties_arrive_once(spark):
    df = spark.createDataFrame([(1, 20), (2, 20), (3, 30)], "k int, w int")
    fresh, _ = tables.extract_incremental(df, "w", F.lit(20), True, df.where("k = 1"), ["k"])
    assert {r.k for r in fresh.collect()} == {2, 3}


def test_last_change_wins_and_deletes(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    changes = spark.createDataFrame([(1, "x", "update", 1), (1, "y", "update", 2), (2, None, "delete", 1), (4, "n", "insert", 1),
                                     (3, "z", "delete", 1), (3, "back", "insert", 2)], "k int, v string, op string, seq int")
    got = cdc.apply_cdc(base, changes, ["k"], "seq", "op")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "y"), (3, "back"), (4, "n")]


def test_append_refuses_unknown_columns_unless_merging(spark):
    path = scratch_path(spark, "load")
    tables.load(spark.range(3).toDF("a"), path)
    wider = spark.range(2).selectExpr("id AS a", "'x' AS b")
    with pytest.raises(ValueError):
        tables.load(wider, path)
    tables.load(wider, path, merge_schema=True)
    merged = tables.read_merged(spark, path)
    assert (merged.count(), merged.where("b IS NULL").count()) == (5, 3)
    with pytest.raises(ValueError):
        tables.load(wider, path, mode="upsert")


def test_batches_are_bounded_and_typed(spark):
    path = scratch_path(spark, "bounded")
    tables.write_dataset(spark.range(10_000), path, max_records=1000, schema="id int")
    back = spark.read.parquet(path)
    sizes = back.groupBy(F.col("_metadata.file_path").alias("f")).count().collect()
    assert back.dtypes == [("id", "int")] and sum(r["count"] for r in sizes) == 10_000
    assert len(sizes) >= 10 and max(r["count"] for r in sizes) <= 1000


def test_files_by_glob(spark):
    root = scratch_path(spark, "files")
    tables.write_dataset(spark.range(10).selectExpr("id", "id % 2 AS g"), f"{root}/sub", "json", partition_by=["g"])
    found = tables.extract_files(spark, root, "json", "part-*", schema="id long")
    assert found.count() == 10 and found.select("source_file").distinct().count() >= 2
    assert tables.extract_files(spark, root, "json", "nothing*", schema="id long").isEmpty()


def test_types_collapse_to_the_vocabulary(spark):
    df = spark.sql("SELECT 1 a, 1L b, 1.5D c, 1.5BD d, current_date() e, timestamp_ntz'2024-01-01' f, true g, array(1) h, "
                   "map(1, 2) i, X'00' j, 's' k")
    assert [canonical_of(f.dataType) for f in df.schema] == [
        "integer", "bigint", "float", "decimal", "date", "timestamp", "boolean", "json", "json", "bytes", "string"]


def test_counted_cut(spark):
    df, n = cut_counted(spark.range(123).toDF("x"))
    assert n == 123 and df.count() == 123
    assert cut_counted(spark.range(0).toDF("x"))[1] == 0


CLEAN, BROKEN = "SELECT id AS k, 'ok' AS s FROM range(10)", "SELECT nullif(id, 3) AS k, 'ok' AS s FROM range(20)"
RULES = [Rule("row_count_min", value=5), Rule("not_null", "k"), Rule("unique", "k")]


def test_publish_audits_first(spark):
    target = scratch_path(spark, "wap")
    with pytest.raises(FileNotFoundError):
        publish.read_published(spark, target)
    assert publish.write_audit_publish(spark.sql(CLEAN), RULES, target, "v1").published
    blocked = publish.write_audit_publish(spark.sql(BROKEN), RULES, target, "v2")
    assert not blocked.published and blocked.violations == ["VIOLATION not_null: column 'k' has 1 null(s)"]
    assert publish.current_version(spark, target) == "v1" and publish.read_published(spark, target).count() == 10
    # Retries load nothing twice, whether the version is published or not.
    publish.write_audit_publish(spark.sql(CLEAN), RULES, target, "v1")
    assert publish.read_published(spark, target).count() == 10
    assert publish.write_audit_publish(spark.sql(CLEAN).where("k < 6"), RULES, target, "v2").published
    assert publish.read_published(spark, target).count() == 6


def test_governed_load_blocks_retries_and_records(spark):
    plan = LoadPlan("src", "dst", [Element("the_key", "bigint", True, False), Element("s", "string"), Element("extra", "date")],
                    [Rule("row_count_min", value=5), Rule("not_null", "the_key"), Rule("unique", "the_key")],
                    scratch_path(spark, "governed"), "2024-01-01 00:00:00")
    good, bad = (spark.sql(q).toDF("The Key", "s") for q in (CLEAN, BROKEN))
    first = governed_load(bad, plan, "r1")
    assert tuple(first.run.first()) == ("r1", "quality_failed", "validation_and_metrics.quality_gate", 20, 0, 1,
                                        "VIOLATION not_null: column 'the_key' has 1 null(s)")
    assert governed_load(good, plan, "r2").run.first().status == "success"
    again = governed_load(good, plan, "r2")
    assert (again.run.first().status, again.run.first().rows_published) == ("success", 10)
    # A blocked run has published nothing itself.
    assert governed_load(bad, plan, "r3").run.first().rows_published == 0
    assert publish.read_published(spark, plan.target).columns == ["the_key", "s", "extra", "_processed_at"]
    assert {(r.src_column, r.dst_column) for r in again.lineage.collect()} == {("the_key", "the_key"), ("s", "s")}
    assert {r.metric: r.value for r in again.metrics.collect()}["null_count_extra"] == 10


def test_files_land_once(spark):
    source, landed, offsets = (scratch_path(spark, x) for x in ("in", "out", "offsets"))
    schema_of = spark.range(1).schema
    counts = []
    for add in (10, 0, 5):
        if add:
            spark.range(add).write.mode("append").parquet(source)
        load_new_files(spark, source, schema_of, landed, offsets)
        counts.append(spark.read.parquet(landed).count())
    assert counts == [10, 10, 15]


def test_replayed_batches_change_nothing(spark):
    source, state = scratch_path(spark, "in"), scratch_path(spark, "state")
    kind = "run_id int, reported_at timestamp_ntz, status string, failed_task string, seq long"
    at = datetime.datetime(2024, 1, 1)

    def report(run, minute, status):
        return (run, at + datetime.timedelta(minutes=minute), status, None, minute)

    df = spark.createDataFrame([report(1, 0, "running"), report(1, 5, "success"), report(2, 1, "failed"), report(1, 9, "failed")], kind)
    df.write.parquet(source)
    seen = []
    for _ in range(2):  # a lost checkpoint replays everything into the same state
        track_runs(spark, source, df.schema, state, scratch_path(spark, "offsets"))
        seen.append(sorted((r.run_id, r.status, r.last_run_at.minute, r.last_success_at and r.last_success_at.minute)
                           for r in current_runs(spark, state).collect()))
    assert seen[0] == seen[1] == [(1, "failed", 9, 5), (2, "failed", 1, None)]


def test_compaction_keeps_the_state(spark):
    source, state, offsets = (scratch_path(spark, x) for x in ("in", "state", "offsets"))
    kind = "run_id int, reported_at timestamp_ntz, status string"
    at = datetime.datetime(2024, 1, 1)
    for i in range(3):
        df = spark.createDataFrame([(r, at + datetime.timedelta(minutes=10 * i + r), "success" if i == 1 else "failed")
                                    for r in range(i, 4)], kind)
        df.write.mode("append").parquet(source)
        track_runs(spark, source, df.schema, state, offsets)

    def everything():
        return sorted(tuple(r) for r in current_runs(spark, state).collect())

    before = everything()
    compact_runs(spark, state, 1)
    assert everything() == before and len(before) == 4
    assert len(folders(commits.latest(spark, state))) == 2


@pytest.mark.parametrize(("fmt", "asked", "suffix"), [
    ("json", None, ".json.bz2"), ("csv", "gzip", ".csv.gz"), ("json", "snappy", ".json.snappy"), ("parquet", None, ".snappy.parquet")])
def test_codec_is_the_one_asked_for(spark, fmt, asked, suffix):
    path = scratch_path(spark, "codec")
    tables.write_dataset(spark.range(5), path, fmt, compression=asked)
    assert all(f.endswith(suffix) for f in spark.read.format(fmt).load(path).inputFiles())


def test_bad_batches_are_set_aside_whole(spark):
    source, good, bad, offsets = (scratch_path(spark, x) for x in ("in", "good", "bad", "offsets"))
    for sql in (CLEAN, BROKEN):
        spark.sql(sql).write.mode("append").parquet(source)
        gate_stream(spark, source, spark.sql(CLEAN).schema, RULES, good, bad, offsets)
    assert spark.read.parquet(f"{good}/*").count() == 10
    assert spark.read.parquet(f"{bad}/*").count() == 20


def test_export_picks_new_and_changed(spark):
    src = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    dst = spark.createDataFrame([(1, "a"), (2, "old"), (3, "")], "k int, v string")
    assert {r.k for r in cdc.export_select(src, dst, ["k"]).collect()} == {2, 3}
    assert cdc.export_select(src, None, ["k"]).count() == 3
    unkeyed = src.unionByName(spark.sql("SELECT CAST(NULL AS INT) AS k, 'n' AS v"))
    assert {r.k for r in cdc.export_select(unkeyed, dst, ["k"]).collect()} == {2, 3, None}


def test_final_status(spark):
    tasks = [(1, 1, "extract", False, "success"), (1, 2, "lineage", True, "failed"), (2, 1, "a.quality_gate", False, "failed"),
             (2, 2, "load", False, "failed"), (3, 1, "extract", False, "failed"), (3, 2, "load", False, "upstream_failed"),
             (4, 1, "extract", False, "success"), (5, 1, "load", False, "upstream_failed"), (5, 2, "note", True, "upstream_failed")]
    got = {r.run_id: (r.status, r.failed_task, r.optional_failures) for r in runs.run_status(spark.createDataFrame(
        tasks, "run_id int, task_order int, task_id string, optional boolean, state string")).collect()}
    assert got == {1: ("partial", None, ["lineage"]), 2: ("quality_failed", "validation_and_metrics.quality_gate", []),
                   3: ("failed", "extract", []), 4: ("success", None, []), 5: ("partial", None, ["note"])}


def test_last_success_survives_a_later_failure(spark):
    kind = "pipeline_id int, run_id int, status string, failed_task string, started_at timestamp_ntz, finished_at timestamp_ntz, sla_minutes int"
    day = datetime.datetime(2024, 1, 1)
    rows = [(1, 1, "success", None, day, day + datetime.timedelta(minutes=90), 90),
            (1, 2, "failed", "load", day + datetime.timedelta(days=1), day + datetime.timedelta(days=1, minutes=91), 90),
            (2, 3, "running", None, day, None, 90)]
    board = {r.pipeline_id: r for r in runs.dashboard(
        spark.createDataFrame(rows, kind), F.lit("2024-01-01 01:00:00").cast("timestamp_ntz")).collect()}
    assert (board[1].status, board[1].sla_breached, board[1].duration_seconds) == ("failed", True, 5460)
    assert board[1].last_success_at == rows[0][5]
    assert (board[2].duration_seconds, board[2].sla_breached, board[2].last_success_at) == (None, False, None)


def test_dependencies_on_the_logical_day(spark):
    deps = spark.createDataFrame([(1, 9, False), (1, 9, True), (2, 8, False)], "pipeline_id int, depends_on int, require_same_day boolean")
    history = spark.createDataFrame([(9, "success", datetime.datetime(2024, 1, 1)), (8, "failed", datetime.datetime(2024, 1, 2))],
                                    "pipeline_id int, status string, started_at timestamp_ntz")
    assert {tuple(r) for r in health.unmet_dependencies(deps, history, "2024-01-02").collect()} == {(1, 9, True), (2, 8, False)}
    assert {tuple(r) for r in health.unmet_dependencies(deps, history, "2024-01-01").collect()} == {(2, 8, False)}


@pytest.mark.parametrize("sql, ready", [
    ("SELECT 1", True), ("SELECT 0", False), ("SELECT false", False), ("SELECT NULL", False), ("SELECT ''", False),
    ("SELECT 'x'", True), ("SELECT 1 WHERE false", False), ("SELECT 0.5D", True)])
def test_readiness(spark, sql, ready):
    assert health.is_ready(spark.sql(sql)).first().ready is ready


def test_lifecycle(spark):
    states = ["draft", "active", "deprecated", "archived", "active", "active"]
    log = spark.createDataFrame([(1, i, i, s) for i, s in enumerate(states)], "asset_id int, happened_at int, event_id int, state string")
    assert [(r.from_state, r.to_state) for r in audit.invalid_transitions(log).orderBy("event_id").collect()] == [
        ("archived", "active"), ("active", "active")]


def test_scopes(spark):
    df = spark.createDataFrame([("db", "orders"), ("db", "tmp_x"), ("other", "orders"), (None, "orders")], "namespace string, name string")
    def names(*args, **kw):
        return {tuple(r) for r in schema.scope_filter(df, *args, **kw).collect()}
    assert names(["db.*"], ["tmp_*"]) == {("db", "orders")}
    assert names([]) == {tuple(r) for r in df.collect()}
    assert names(["Orders"]) == set()
    assert names(["db.*"], ["tmp_*"], mode="relational") == {("db", "orders"), ("db", "tmp_x")}
    assert names(["db.*"], ["tmp_*"], mode="relational", honour_exclude=True) == {("db", "orders")}
    assert names(["db.ord*", "orders"], mode="relational") == {(None, "orders")}


@pytest.mark.parametrize("name, tag, confidence", [
    ("customer_cpf", "RESTRICTED", "high"), ("user_email_address", "PII", "high"), ("endereco_completo", "PII", "medium"),
    ("first_name", "PII", "low"), ("EMAIL", "PII", "high"), ("nome_senha", "RESTRICTED", "high")])
def test_tag_rules(spark, name, tag, confidence):
    row = tags.infer_policy_tags(spark.createDataFrame([(name,)], "name string")).first()
    assert (row.suggested_tag, row.confidence) == (tag, confidence)


def test_untagged_names(spark):
    assert tags.infer_policy_tags(spark.createDataFrame([("created_at",)], "name string")).isEmpty()
