"""The commit log, and publishing and compaction stopped between any two steps."""

from __future__ import annotations

import datetime

import pytest

from tidemark.operators import commits, publish
from tidemark.operators.quality import Rule
from tidemark.session import scratch_path
from tidemark.streaming import run_state

CLEAN = "SELECT id AS k, 'ok' AS s FROM range(10)"
RULES = [Rule("row_count_min", value=5), Rule("not_null", "k"), Rule("unique", "k")]
REPORT = "run_id int, reported_at timestamp_ntz, status string"


class Stop(Exception):
    pass


def _stopped(monkeypatch, module, name, after):
    """Let a function of a module stop the run, before it does anything or just after it did."""
    real = getattr(module, name)

    def stop(*args, **kw):
        if after:
            real(*args, **kw)
        raise Stop

    monkeypatch.setattr(module, name, stop)


def test_what_was_published_stays_and_can_be_gone_back_to(spark):
    target = scratch_path(spark, "wap")
    assert publish.write_audit_publish(spark.sql(CLEAN), RULES, target, "v1").published
    assert publish.write_audit_publish(spark.sql(CLEAN).where("k < 6"), RULES, target, "v2").published
    publish.write_audit_publish(spark.sql(CLEAN).where("k < 7"), RULES, target, "v1")
    assert publish.current_version(spark, target) == "v2"
    publish.rollback(spark, target, "v1")
    assert publish.read_published(spark, target).count() == 10
    with pytest.raises(ValueError):
        publish.rollback(spark, target, "v9")


@pytest.mark.parametrize(("name", "after", "visible"), [
    ("profile", False, "v1"), ("_point_to", False, "v1"), ("_point_to", True, "v2")])
def test_a_publish_that_stops_anywhere_leaves_a_whole_version(spark, monkeypatch, name, after, visible):
    target = scratch_path(spark, "wap")
    publish.write_audit_publish(spark.sql(CLEAN), RULES, target, "v1")
    with monkeypatch.context() as patch:
        _stopped(patch, publish, name, after)
        with pytest.raises(Stop):
            publish.write_audit_publish(spark.sql(CLEAN).where("k < 6"), RULES, target, "v2")
    assert publish.current_version(spark, target) == visible
    assert publish.read_published(spark, target).count() == {"v1": 10, "v2": 6}[visible]
    assert publish.write_audit_publish(spark.sql(CLEAN).where("k < 6"), RULES, target, "v2").published
    assert publish.read_published(spark, target).count() == 6


def test_a_half_written_manifest_is_passed_over(spark):
    target = scratch_path(spark, "log")
    assert commits.latest(spark, target) is None and commits.history(spark, target) == []
    commits.append(spark, target, lambda e: {**e, "a": 1})
    fs, folder = commits._folder(spark, target)
    out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(folder, commits._name(2)), False)
    out.write(bytearray(b'{"number": 2, "a'))
    out.close()
    assert commits.latest(spark, target)["a"] == 1
    assert commits.append(spark, target, lambda e: {**e, "b": 2})["number"] == 3
    assert {k: commits.latest(spark, target)[k] for k in ("a", "b")} == {"a": 1, "b": 2}


def test_changes_made_at_once_are_all_kept(spark):
    """Another writer commits between reading and writing; and one is overtaken while its file is being written."""
    target = scratch_path(spark, "log")
    once = []

    def meddled(entry):
        if not once:
            once.append(1)
            commits.append(spark, target, lambda e: {**e, "other": True})
        return {**entry, "mine": True}

    commits.append(spark, target, meddled)
    assert {"other", "mine"} <= set(commits.latest(spark, target))
    # Number 9 was made from the same entry while ours, number 8, was on its way: ours is made again on top.
    entry = commits.latest(spark, target)
    base = {k: v for k, v in entry.items() if k not in ("number", "previous")}
    assert commits._create(spark, target, {**base, "late": True, "number": 9, "previous": entry["number"]})
    slow = {**base, "slow": True, "number": 8, "previous": entry["number"]}
    assert commits._create(spark, target, slow) and not commits._create(spark, target, slow)
    assert not commits._descends(commits.history(spark, target), 8)
    commits.append(spark, target, lambda e: {**e, "slow": True})
    assert {"other", "mine", "late", "slow"} <= set(commits.latest(spark, target))


def _batches(spark, count):
    """A state of some batches, the first two folded."""
    source, state, offsets = (scratch_path(spark, x) for x in ("in", "state", "offsets"))
    for i in range(count):
        df = spark.createDataFrame([(i, datetime.datetime(2024, 1, 1, i), "success")], REPORT)
        df.write.mode("append").parquet(source)
        run_state.track_runs(spark, source, df.schema, state, offsets)
        if i == 1:
            run_state.compact_runs(spark, state, 1)
    return source, state


def _runs(spark, state):
    return sorted(r.run_id for r in run_state.current_runs(spark, state).collect())


@pytest.mark.parametrize(("name", "after"), [("_merge", True), ("append", False), ("append", True), ("remove_path", False)])
def test_a_compaction_that_stops_anywhere_loses_no_batch(spark, monkeypatch, name, after):
    _, state = _batches(spark, 4)
    with monkeypatch.context() as patch:
        _stopped(patch, run_state.commits if name == "append" else run_state, name, after)
        with pytest.raises(Stop):
            run_state.compact_runs(spark, state, 9)
    assert _runs(spark, state) == [0, 1, 2, 3]
    run_state.compact_runs(spark, state, 9)
    assert _runs(spark, state) == [0, 1, 2, 3]


def test_batches_that_come_again_or_meanwhile_count_once(spark, monkeypatch):
    source, state = _batches(spark, 3)
    assert len(run_state.folders(commits.latest(spark, state))) == 2
    # A batch arrives while the folder of the compaction is being written.
    merge = run_state._merge

    def meanwhile(deltas):
        monkeypatch.setattr(run_state, "_merge", merge)
        df = spark.createDataFrame([(9, datetime.datetime(2024, 1, 2), "failed")], REPORT)
        df.write.parquet(f"{state}/data/extra")
        commits.append(spark, state, lambda e: {**e, "batches": {**e["batches"], "3": f"{state}/data/extra2"}})
        run_state.collapse(df).write.parquet(f"{state}/data/extra2")
        return merge(deltas)

    monkeypatch.setattr(run_state, "_merge", meanwhile)
    run_state.compact_runs(spark, state, 5)
    assert _runs(spark, state) == [0, 1, 2, 9]
    # A lost checkpoint delivers everything again, in batches of other numbers.
    run_state.track_runs(spark, source, spark.createDataFrame([], REPORT).schema, state, scratch_path(spark, "offsets"))
    assert _runs(spark, state) == [0, 1, 2, 9]


def test_a_batch_that_stops_before_its_commit_is_taken_again(spark, monkeypatch):
    source, state, offsets = (scratch_path(spark, x) for x in ("in", "state", "offsets"))
    df = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1), "success")], REPORT)
    df.write.parquet(source)
    with monkeypatch.context() as patch:
        _stopped(patch, run_state.commits, "append", False)
        with pytest.raises(Exception, match="Stop"):
            run_state.track_runs(spark, source, df.schema, state, offsets)
    with pytest.raises(FileNotFoundError):
        run_state.current_runs(spark, state)
    run_state.track_runs(spark, source, df.schema, state, offsets)
    assert _runs(spark, state) == [1]
