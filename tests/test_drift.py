from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from tidemark.operators import approvals, contract, discovery, drift, versions
from tidemark.operators.infer import discover
from tidemark.session import scratch_path

FIELDS = "object_id string, ordinal long, name string, normalized_type string, nullable boolean, description string"


def _fields(spark, object_id, *fields):
    rows = [(object_id, i, n, t, nullable, "") for i, (n, t, nullable) in enumerate(fields)]
    return spark.createDataFrame(rows, FIELDS)


def _changes(events):
    return [(r.field_name, r.change_type) for r in events.orderBy("object_id", "event_order").collect()]


@pytest.mark.parametrize("old, new, change", [
    ("integer", "bigint", "type_widened"), ("integer", "float", "type_widened"), ("bigint", "float", "type_widened"),
    ("float", "decimal", "type_widened"), ("Integer", "integer", "type_widened"), ("integer", "string", "type_incompatible"),
    ("float", "string", "type_incompatible"), ("bigint", "boolean", "type_incompatible"),
    ("bigint", "integer", "type_incompatible"), ("json", "string", "type_incompatible")])
def test_type_changes(spark, old, new, change):
    events = drift.diff(_fields(spark, "o", ("a", old, True)), _fields(spark, "o", ("a", new, True)))
    assert _changes(events) == [("a", change)]


def test_two_events_on_one_field_in_order(spark):
    before = _fields(spark, "o", ("gone", "string", True), ("a", "integer", True), ("b", "string", False))
    after = _fields(spark, "o", ("b", "string", True), ("a", "string", False), ("new", "date", True))
    assert _changes(drift.diff(before, after)) == [
        ("b", "required_to_nullable"), ("a", "type_incompatible"), ("a", "nullable_to_required"), ("new", "field_added"),
        ("gone", "field_removed")]


def test_new_object_has_one_event_and_removed_only_on_request(spark):
    before, after = _fields(spark, "old", ("a", "string", True)), _fields(spark, "new", ("a", "string", True), ("b", "date", True))
    assert _changes(drift.diff(before, after)) == [(None, "object_added")]
    assert {r.change_type for r in drift.diff(before, after, removed=True).collect()} == {"object_added", "object_removed"}


def test_descriptions_and_order_are_no_drift(spark):
    rng = random.Random(7)
    fields = [(f"f{i}", rng.choice(["string", "integer", "date"]), bool(i % 2)) for i in range(20)]
    shuffled = fields[:]
    rng.shuffle(shuffled)
    assert drift.diff(_fields(spark, "o", *fields), _fields(spark, "o", *shuffled)).isEmpty()


def test_random_schemas_against_a_plain_diff(spark):
    rng = random.Random(3)
    kinds = ["integer", "bigint", "float", "decimal", "string", "Integer", "json", "boolean"]
    wider = {"integer": {"bigint", "float", "decimal"}, "bigint": {"float", "decimal"}, "float": {"decimal"}}

    def side():
        names = rng.sample("abcdefgh", rng.randint(1, 7))
        return {n: (rng.choice(kinds), rng.random() < 0.5) for n in names}

    pairs = {f"o{i}": (side() if rng.random() < 0.9 else {}, side() if rng.random() < 0.9 else {}) for i in range(80)}

    def frame(which):
        rows = [(o, i, n, t, nullable, "") for o, p in pairs.items() for i, (n, (t, nullable)) in enumerate(p[which].items())]
        rng.shuffle(rows)
        return spark.createDataFrame(rows, FIELDS)

    want = []
    for o, (before, after) in pairs.items():
        if not before or not after:
            if before or after:
                want.append((o, None, "object_removed" if before else "object_added"))
            continue
        for n, (t, nullable) in after.items():
            if n not in before:
                want.append((o, n, "field_added"))
                continue
            old, was = before[n]
            if t != old:
                fits = t.lower() == old.lower() or t.lower() in wider.get(old.lower(), set())
                want.append((o, n, "type_widened" if fits else "type_incompatible"))
            if was != nullable:
                want.append((o, n, "nullable_to_required" if was else "required_to_nullable"))
        want += [(o, n, "field_removed") for n in before if n not in after]
    events = drift.diff(frame(0), frame(1), removed=True)
    got = [(r.object_id, r.field_name, r.change_type) for r in events.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    ordered = {}
    for r in events.where("field_name IS NOT NULL").orderBy("object_id", "event_order").collect():
        ordered.setdefault(r.object_id, []).append((r.object_id, r.field_name, r.change_type))
    assert ordered == {o: [e for e in want if e[0] == o] for o in ordered}


def test_gate_reason_lists_blocking_events_in_order(spark):
    before = _fields(spark, "o", ("x", "string", True), ("id", "integer", True), ("n", "string", True))
    after = _fields(spark, "o", ("id", "string", True), ("n", "string", False))
    result = drift.drift_gate(before, after, drift.field_events(before, after)).first()
    assert (result.can_proceed, result.blocked_reason) == (
        False, "Incompatible drift detected: id: type_incompatible; x: field_removed")


def test_gate_lets_one_sided_objects_proceed(spark):
    before, after = _fields(spark, "a", ("x", "string", True)), _fields(spark, "b", ("x", "string", True))
    events = drift.diff(before, after, removed=True)
    assert all(r.can_proceed for r in drift.drift_gate(before, after, events).collect())


def test_critical_drift_blocks_under_any_policy(spark):
    before, after = _fields(spark, "o", ("x", "string", True)), _fields(spark, "o", ("y", "string", True))
    for policy in ("block", "self_heal", "alert_only"):
        assert drift.plan_actions(drift.diff(before, after), policy).first().action == "block"
    harmless = drift.diff(before, _fields(spark, "o", ("x", "string", True), ("y", "string", True)))
    assert [drift.plan_actions(harmless, p).first().action for p in ("block", "self_heal", "alert_only")] == [
        "block", "self_heal", "alert"]


ELEMENTS = ("object_id string, name string, source_type string, destination_type string, required boolean, "
            "nullable boolean, is_primary_key boolean, description string")


def test_self_heal_merges_and_never_drops(spark):
    elements = spark.createDataFrame([
        ("o", "keep", "integer", "integer", False, True, True, "k"), ("o", "wide", "integer", "integer", False, True, False, ""),
        ("o", "refuse", "string", "string", False, True, False, ""), ("o", "gone", "date", "date", True, False, False, "")],
        ELEMENTS)
    snapshot = _fields(spark, "o", ("keep", "integer", True), ("wide", "bigint", False), ("refuse", "integer", True),
                       ("new", "uuid", False))
    healed = {r.name: r for r in contract.apply_snapshot(elements, snapshot).collect()}
    assert {n: r.action for n, r in healed.items()} == {
        "keep": "kept", "wide": "updated", "refuse": "refused", "gone": "kept", "new": "added"}
    assert (healed["wide"].destination_type, healed["wide"].required) == ("bigint", True)
    assert (healed["refuse"].destination_type, healed["new"].destination_type) == ("string", "string")
    assert healed["keep"].is_primary_key and not healed["new"].is_primary_key


def test_no_baseline_heals_everything(spark):
    snapshot = _fields(spark, "o", ("a", "string", True))
    events = drift.with_severity(drift.diff(snapshot, snapshot))
    assert contract.objects_to_heal(snapshot, events, has_baseline=True).isEmpty()
    assert contract.objects_to_heal(snapshot, events, has_baseline=False).count() == 1


def test_decisions_move_pending_approvals_once(spark):
    recorded = spark.createDataFrame([("1", "o", "pending"), ("2", "p", "pending"), ("3", "q", "rejected")],
                                     "approval_id string, object_id string, decision string")
    decisions = spark.createDataFrame(
        [("1", "approved", "ann", "2024-01-01"), ("1", "rejected", "bob", "2024-01-02"), ("3", "approved", "ann", "2024-01-01"),
         ("9", "approved", "ann", "2024-01-01")],
        "approval_id string, decision string, decided_by string, decided_at string").selectExpr("*", "NULL AS notes")
    decided, refused = approvals.decide(recorded, decisions)
    assert {r.approval_id: (r.decision, r.decided_by) for r in decided.collect()} == {
        "1": ("approved", "ann"), "2": ("pending", None), "3": ("rejected", None)}
    assert {r.approval_id: (r.refused, r.reason) for r in refused.collect()} == {
        "1": (1, "already decided"), "3": (1, "already decided"), "9": (1, "not found")}
    assert [r.object_id for r in approvals.approved_snapshots(decided, _fields(spark, "o", ("a", "string", True))).collect()] == ["o"]


VERSIONED = ("object_id string, captured_at int, snapshot_id int, fields array<struct<name:string,source_type:string,"
             "normalized_type:string,nullable:boolean,is_primary_key:boolean,description:string>>")


def _capture(at, *fields):
    return ("o", at, at, [(n, t, t, True, False, d) for n, t, d in fields])


def test_versions_follow_structure_order_and_description(spark):
    a, b = ("a", "integer", None), ("b", "string", None)
    history = versions.version_history(spark.createDataFrame([
        _capture(1, a, b), _capture(2, a, b), _capture(3, b, a), _capture(4, b, a), _capture(5, b, ("a", "integer", "text")),
        _capture(6, a, b)], VERSIONED))
    assert [(r.captured_at, r.version) for r in history.orderBy("version").collect()] == [(1, 1), (3, 2), (5, 3), (6, 4)]
    assert versions.version_drift(history).isEmpty()
    assert versions.latest_version(history).first().version == 4


def test_tagging_makes_a_new_version(spark):
    history = versions.version_history(spark.createDataFrame([_capture(1, ("a", "integer", None))], VERSIONED))
    tags = spark.createDataFrame([("o", {"a": "PII"}), ("unknown", {"a": "PII"})], "object_id string, tags map<string,string>")
    tagged = versions.tag_version(history, tags).collect()
    assert len(tagged) == 1 and tagged[0].version == 2 and '"policy_tag":"PII"' in tagged[0].snapshot_json
    again = versions.tag_version(history.select("object_id", "version", "snapshot_json").unionByName(
        spark.createDataFrame(tagged)), tags.where("object_id = 'o'")).first()
    assert again.version == 3 and again.snapshot_json == tagged[0].snapshot_json


def test_declared_schema_beats_samples(spark):
    kind = "object_id string, name string, source_type string, normalized_type string, nullable boolean, is_primary_key boolean"
    declared = spark.createDataFrame([("a", "x", "bson:int", "integer", True, False)], kind)
    sampled = spark.createDataFrame([("a", "x", "python:str", "string", True, False), ("b", "y", "python:str", "string", True, False)], kind)
    assert {(r.object_id, r.discovery_method) for r in discover(declared, sampled).collect()} == {
        ("a", "declared"), ("b", "payload_sampling")}


FIELD = "object_id string, name string, normalized_type string, nullable boolean, ordinal long"


def test_events_take_one_exchange_of_fields(spark):
    paths = [scratch_path(spark, "fields") for _ in range(2)]
    for path in paths:
        spark.createDataFrame([("a", "x", "integer", True, 0)], FIELD).write.parquet(path)
    before, after = (spark.read.parquet(p) for p in paths)
    plan = drift.with_severity(drift.diff(before, after, removed=True))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_objects_on_one_side_have_one_event_each(spark):
    before = spark.createDataFrame([("gone", "x", "integer", True, 0), ("gone", "y", "string", True, 1), ("both", "x", "integer", True, 0)], FIELD)
    after = spark.createDataFrame([("new", "x", "integer", True, 0), ("new", "y", "string", True, 1), ("both", "x", "integer", False, 0)], FIELD)
    got = sorted((r.object_id, r.field_name, r.change_type) for r in drift.diff(before, after, removed=True).collect())
    assert got == [("both", "x", "nullable_to_required"), ("gone", None, "object_removed"), ("new", None, "object_added")]
    assert {r.change_type for r in drift.diff(before, after).collect()} == {"nullable_to_required", "object_added"}


SNAPSHOT = ("run_id string, asset_id string, object_id string, ordinal long, name string, source_type string, normalized_type string, "
            "nullable boolean, is_primary_key boolean, description string")
ELEMENT = ("object_id string, name string, source_type string, destination_type string, required boolean, nullable boolean, "
           "is_primary_key boolean, description string")


def _seen(run, asset, obj, *fields):
    return [(run, asset, obj, i, name, kind, kind, nullable, False, None) for i, (name, kind, nullable) in enumerate(fields)]


def test_a_discovery_run_heals_asks_and_counts(spark):
    known = _seen("r0", "a", "t1", ("x", "integer", True)) + _seen("r0", "a", "t2", ("x", "integer", True)) + _seen("r0", "b", "u", ("x", "string", True))
    now = (_seen("r1", "a", "t1", ("x", "bigint", True), ("y", "string", True)) + _seen("r1", "a", "t2", ("x", "integer", False))
           + _seen("r2", "c", "v", ("x", "string", True)))
    elements = spark.createDataFrame([(o, "x", "integer", "integer", False, True, False, "") for o in ("t1", "t2")], ELEMENT)
    baseline = spark.createDataFrame(known, SNAPSHOT).drop("run_id")
    found = discovery.discover_runs(spark.createDataFrame(now, SNAPSHOT), baseline, elements, removed=True)
    assert {(r.run_id, r.object_id) for r in found.provisioned.collect()} == {("r2", "v")}
    assert {(r.object_id, r.field_name, r.change_type, r.run_id) for r in found.events.collect()} == {
        ("t1", "x", "type_widened", "r1"), ("t1", "y", "field_added", "r1"), ("t2", "x", "nullable_to_required", "r1"),
        ("v", None, "object_added", "r2")}
    assert [(r.approval_id, r.asset_id) for r in found.approvals.collect()] == [("r1/a/t2/x/nullable_to_required", "a")]
    assert {(r.object_id, r.name, r.destination_type, r.action) for r in found.elements.collect()} == {
        ("t1", "x", "bigint", "updated"), ("t1", "y", "string", "added"), ("t2", "x", "integer", "kept"), ("v", "x", "string", "added")}
    assert {(r.run_id, r.object_id) for r in found.versions.collect()} == {("r1", "t1"), ("r1", "t2"), ("r2", "v")}
    totals = {r.run_id: r.asDict() for r in found.totals.collect()}
    assert totals["r1"] == {"run_id": "r1", "asset_id": "a", "objects": 2, "fields": 3, "critical_events": 1, "informative_events": 2, "approvals": 1,
                            "created": 0, "new_versions": 2, "elements_added": 1, "elements_updated": 1, "elements_refused": 0}
    assert set(totals) == {"r1", "r2"} and totals["r2"]["created"] == 1


def test_an_approval_applies_what_its_own_run_saw(spark):
    snapshots = spark.createDataFrame(
        _seen("r1", "a", "t", ("x", "bigint", True)) + _seen("r2", "a", "t", ("x", "decimal", True)) + _seen("r2", "a", "s", ("x", "date", True)),
        SNAPSHOT).withColumn("at", F.substring("run_id", 2, 1).cast("int"))
    elements = spark.createDataFrame([(o, "x", "integer", "integer", False, True, False, "") for o in ("t", "s", "u")], ELEMENT)

    def applied(*decisions):
        decided = spark.createDataFrame([(r, o, d) for r, o, d in decisions], "run_id string, object_id string, decision string")
        return {r.object_id: (r.destination_type, r.action) for r in approvals.apply_approved(elements, decided, snapshots, "at").collect()}

    rest = {"s": ("integer", "kept"), "u": ("integer", "kept")}
    assert applied(("r1", "t", "approved"), ("r2", "t", "rejected"), ("r2", "s", "pending")) == {"t": ("bigint", "updated"), **rest}
    assert applied(("r1", "t", "approved"), ("r2", "t", "approved")) == {"t": ("decimal", "updated"), **rest}
    assert applied() == {"t": ("integer", "kept"), **rest}


def test_approvals_of_two_runs_never_share_an_id(spark):
    events = spark.createDataFrame(
        [("1", "a", "o/x", None, "object_removed", ""), ("1", "a/o", "x", None, "object_removed", ""), ("2", "a", "o/x", None, "object_removed", "")],
        "run_id string, asset_id string, object_id string, field_name string, change_type string, description string")
    opened = approvals.open_approvals(events)
    assert opened.select("approval_id").distinct().count() == 3
    assert {r.run_id: r.pending for r in approvals.pending_approvals(opened, "run_id").collect()} == {"1": 2, "2": 1}
    assert approvals.approvals_of_run(opened, "2").count() == 1
