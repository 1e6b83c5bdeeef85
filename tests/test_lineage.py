from __future__ import annotations

import random

from tidemark.operators import lineage
from tidemark.session import scratch_path

EDGES = "src_object string, src_column string, dst_object string, dst_column string, expression string"
CHAIN = [("src_table", "id", "dw_table", "id_hash", "SHA256(id)"), ("dw_table", "id_hash", "final_table", "id_hash", None)]


def _edges(spark, rows):
    return spark.createDataFrame(rows, EDGES)


def _starts(spark, *nodes):
    return spark.createDataFrame(list(nodes), "object_id string, column_name string")


def _found(df):
    return {(r.object_id, r.column_name): r.depth for r in df.collect()}


def test_chain_both_ways(spark):
    edges = _edges(spark, CHAIN)
    assert _found(lineage.trace(edges, _starts(spark, ("final_table", "id_hash")), "upstream")) == {
        ("dw_table", "id_hash"): 1, ("src_table", "id"): 2}
    down = lineage.trace(edges, _starts(spark, ("src_table", "id")), "downstream")
    assert _found(down) == {("dw_table", "id_hash"): 1, ("final_table", "id_hash"): 2}
    named = lineage.with_transformation(down, edges).collect()
    assert {r.object_id: r.transformation for r in named} == {"dw_table": "SHA256(id)", "final_table": None}
    both = lineage.trace(edges, _starts(spark, ("dw_table", "id_hash")), "both")
    assert {(r.object_id, r.direction) for r in both.collect()} == {("src_table", "upstream"), ("final_table", "downstream")}


def test_unknown_start_is_empty(spark):
    assert lineage.trace(_edges(spark, CHAIN), _starts(spark, ("nowhere", "x")), "both").isEmpty()


def test_cycles_end_and_leave_the_start_out(spark):
    ring = [("a", "x", "b", "x", None), ("b", "x", "c", "x", None), ("c", "x", "a", "x", None)]
    assert _found(lineage.trace(_edges(spark, ring), _starts(spark, ("a", "x")), "downstream")) == {("b", "x"): 1, ("c", "x"): 2}


def test_random_graphs_against_a_plain_closure(spark):
    rng = random.Random(11)
    nodes = [(f"t{i % 7}", f"c{i}") for i in range(60)]
    # A third of the edges leave one hub.
    pairs = {(nodes[0] if rng.random() < 0.33 else rng.choice(nodes), rng.choice(nodes)) for _ in range(150)}
    edges = _edges(spark, [(*a, *b, None) for a, b in pairs])
    picked = rng.sample(nodes, 5)
    starts = spark.createDataFrame([(*n, f"tag{i}") for i, n in enumerate(picked)], "object_id string, column_name string, tag string")
    got = {(r.tag, r.object_id, r.column_name): r.depth for r in lineage.tag_reach(edges, starts).collect()}
    want = {(f"tag{i}", *n): depth for i, start in enumerate(picked) for n, depth in _closure(pairs, [start]).items()}
    assert got == want


def _closure(pairs, starts):
    """Fewest steps from any start to every column, a start's own ones apart."""
    out = {}
    for start in starts:
        depth, seen, frontier = 0, {start}, {start}
        while frontier:
            depth += 1
            frontier = {b for a, b in pairs if a in frontier} - seen
            seen |= frontier
            for n in frontier:
                out[n] = min(out.get(n, depth), depth)
    return out


def test_starts_that_other_starts_lead_to(spark):
    ring = [("a", "x", "b", "x", None), ("b", "x", "c", "x", None), ("c", "x", "a", "x", None), ("c", "x", "d", "x", None)]
    got = _found(lineage.trace(_edges(spark, ring), _starts(spark, ("a", "x"), ("c", "x")), "downstream"))
    assert got == {("a", "x"): 1, ("b", "x"): 1, ("c", "x"): 2, ("d", "x"): 1}


def test_random_start_sets_and_stores_against_a_plain_closure(spark, monkeypatch):
    """Starts among each other's reach, in cycles, from a store in two folders; folders folded every other round."""
    monkeypatch.setattr(lineage, "HOPS", 2)
    monkeypatch.setattr(lineage, "FOLD", 2)
    for seed in (2,):
        rng = random.Random(seed)
        nodes = [(f"t{i % 7}", f"c{i}") for i in range(40)]
        pairs = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(55)} | {(nodes[i], nodes[i + 1]) for i in range(0, 30)}
        cut = sorted(pairs)[::3]
        rest = sorted(pairs - set(cut))
        starts = rng.sample(nodes, 6)
        store = lineage.LineageStore.write(_edges(spark, [(*a, *b, None) for a, b in rest]), scratch_path(spark, "store"))
        before = lineage.trace(store, _starts(spark, *starts), "downstream")
        assert _found(before) == _closure(rest, starts)
        added = _edges(spark, [(*a, *b, None) for a, b in cut])
        store.add(added)
        assert store.edges().count() == len(pairs)
        assert _found(lineage.trace(store, _starts(spark, *starts), "downstream")) == _closure(pairs, starts)
        assert _found(lineage.trace(store, _starts(spark, *starts), "upstream")) == _closure({(b, a) for a, b in pairs}, starts)
        one = [nodes[0]]
        old = lineage.LineageStore.write(_edges(spark, [(*a, *b, None) for a, b in rest]), scratch_path(spark, "store"))
        known = lineage.trace(old, _starts(spark, *one), "downstream")
        old.add(added)
        assert _found(lineage.extend(known, _starts(spark, *one), old, added, "downstream")) == _closure(pairs, one)


def test_traces_copy_no_edges(spark):
    store = lineage.LineageStore.write(_edges(spark, CHAIN), scratch_path(spark, "store"))
    steps = lineage._steps(store, ("upstream",))
    assert all("/upstream/" in f for f in steps.inputFiles())
    assert "Exchange" not in steps._jdf.queryExecution().executedPlan().toString()


def test_edges_are_dealt_out_once_to_be_stored_and_once_a_round(spark, monkeypatch):
    pairs = [((f"t{level}", f"c{i}"), (f"t{level + 1}", f"c{i // 2}")) for level in range(4) for i in range(300)]
    plans, rounds, schema = [], [], type(spark.range(1).write)
    write, parquet = lineage._Rounds.write, schema.parquet
    monkeypatch.setattr(lineage._Rounds, "write", lambda self, *rest: rounds.append(1) or write(self, *rest))

    def planned(self, path, *rest, **more):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return parquet(self, path, *rest, **more)

    monkeypatch.setattr(schema, "parquet", planned)
    store = lineage.LineageStore.write(_edges(spark, [(*a, *b, None) for a, b in pairs]), scratch_path(spark, "store"))
    assert [p.count("Exchange hashpartitioning") for p in plans] == [1, 0]
    starts = [("t0", f"c{i}") for i in range(300)]
    assert _found(lineage.trace(store, _starts(spark, *starts), "downstream")) == _closure(pairs, starts)
    assert len(rounds) == 2  # the starts, and one round for four steps


def test_upsert_replaces_the_same_triple_only(spark):
    kind = "pipeline_id string, source_object_id string, destination_object_id string, column_mappings array<string>"
    current = spark.createDataFrame([("p", "a", "b", ["1"]), ("p", "a", "c", ["1"])], kind)
    new = spark.createDataFrame([("p", "a", "b", ["2"]), ("q", "a", "b", ["3"])], kind)
    got = {(r[0], r[1], r[2]): r[3] for r in lineage.upsert(current, new).collect()}
    assert got == {("p", "a", "b"): ["2"], ("p", "a", "c"): ["1"], ("q", "a", "b"): ["3"]}


def test_edges_are_distinct_and_blank_expressions_are_copies(spark):
    mapping = [("p", "a", "b", [("x", "y", ""), ("x", "y", ""), ("x", "z", "UPPER(x)")])]
    df = spark.createDataFrame(mapping, "pipeline_id string, source_object_id string, destination_object_id string, "
                               "column_mappings array<struct<source_column:string,destination_column:string,expression:string>>")
    edges = lineage.edges(df)
    direct, transformed = lineage.split_direct(edges)
    assert (edges.count(), direct.count(), transformed.count()) == (2, 1, 1)


def test_roots_and_leaves(spark):
    got = {(r.object_id, r.role) for r in lineage.roots_and_leaves(_edges(spark, CHAIN)).collect()}
    assert got == {("src_table", "root"), ("final_table", "leaf")}
