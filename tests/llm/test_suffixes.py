"""Repeated byte strings against brute force, with nulls, empty and long texts, ties, repeated rows and clashing names."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tidemark.llm import suffixes

SCHEMA = "doc_id long, text string, tag long, packed string, size int, spans int, doc int, key int"


def _brute(rows, length=suffixes.LENGTH):
    """The removal rule, string by string."""
    texts = [(-(1 << 63) if r[0] is None else r[0], (r[1] or "").encode()) for r in rows]
    first = {}
    for doc, raw in texts:
        for i in range(len(raw) - length + 1):
            at = first.setdefault(raw[i : i + length], (doc, i))
            first[raw[i : i + length]] = min(at, (doc, i))
    out = []
    for (given, _), (doc, raw) in zip(rows, texts, strict=True):
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < (doc, i):
                gone[i : i + length] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
        out.append((given, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def _rows():
    pick = random.Random(8)
    words = ["".join(pick.choice("abcdeéü") for _ in range(pick.randint(1, 7))) for _ in range(40)]
    passage = [" ".join(pick.choice(words) for _ in range(30)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(pick.randint(0, 5)):
            parts.append(pick.choice(passage) if pick.random() < 0.5 else " ".join(pick.choice(words) for _ in range(pick.randint(1, 40))))
            if pick.random() < 0.3:
                parts[-1] = parts[-1][pick.randint(0, 60) :]
        rows.append((i, pick.choice([" ", "\n", ""]).join(parts)))
    rows += [(200, None), (201, ""), (202, "x"), (203, "-" * 99), (204, "-" * 100), (205, "-" * 150), (206, "-" * 700), (207, "ab" * 300)]
    rows += [(i, rows[3][1] + passage[0]) for i in range(300, 330)]
    # Repeated rows, one number with two texts, no number.
    rows += [(300, rows[3][1] + passage[0]), (3, passage[1] + passage[2]), (None, passage[3]), (None, passage[3]), (None, None)]
    rows += [(400 - i, " ".join(words) + "\0" + passage[i % 6]) for i in range(20)]
    rows.append((500, " ".join(pick.choice(words) for _ in range(200)) * 3))
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "a", 2, 3, 4, 5) for r in rows], SCHEMA)


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_removal_is_that_of_brute_force(spark):
    rows = _rows()
    got = suffixes.without_repeats(_frame(spark, rows).repartition(5))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert _got(got) == _brute(rows)


def _local(rows, parts):
    """The steps in this process, where the sizes of pieces can be set."""
    docs = [-(1 << 63) if r[0] is None else r[0] for r in rows]
    tags = [int.from_bytes(hashlib.md5((r[1] or "").encode()).digest()[:7], "big") for r in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(docs), pa.array(tags), pa.array([r[1] for r in rows])], names=["doc", "tag", "text"])

    def grouped(batches):
        table = pa.Table.from_batches(list(batches))
        return [table.filter(pc.equal(table["key"], k)) for k in sorted(set(table["key"].to_pylist()))]

    hot = np.sort(np.unique(suffixes._runs_of([(r[1] or "").encode() for r in rows], np.zeros(0, np.uint64))[4])[:: 3])
    found = pa.concat_tables([suffixes._meet(t) for t in grouped(suffixes._pack_runs(parts, hot)(iter([batch])))]).to_pylist()
    packed = next(suffixes._pack_text(iter([batch])))
    at = {(d, t): i for i, (d, t) in enumerate(zip(docs, tags, strict=True))}
    runs = [[] for _ in rows]
    for f in found:
        if f["anchor"] is not None:
            runs[at[f["doc"], f["tag"]]].append({k: f[k] for k in ("start", "n", "key", "anchor")})
    kind = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("key", pa.int32()), ("anchor", pa.int64())]))
    asked = pa.RecordBatch.from_arrays([*packed.columns, pa.array(runs, kind)], names=[*packed.schema.names, "runs"])
    later = pa.concat_tables([suffixes._sort_part(t) for t in grouped(suffixes._carry(iter([asked])))]).to_pylist()
    spans = [[] for _ in rows]
    for f in [f for f in found if f["anchor"] is None] + later:
        spans[at[f["doc"], f["tag"]]].append({"start": f["start"], "n": f["n"]})
    spans = [spans[at[d, t]] for d, t in zip(docs, tags, strict=True)]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))
    last = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), packed["packed"], packed["size"], pa.array(spans, kind)], names=list("abcd"))
    return sorted((tuple(r.values()) for r in next(suffixes._cut_out(iter([last]))).to_pylist()), key=repr)


@pytest.mark.parametrize("setting", [{"CHUNK": 300}, {"PACK": 3000}, {"SORT_BYTES": 2000}, {"MOST_IN_RUN": 5}, {}])
@pytest.mark.parametrize("parts", [1, 5])
def test_sizes_of_pieces_change_no_row(monkeypatch, setting, parts):
    """Long texts in pieces, many parts, large anchors sorted in slices, and hot anchors (every third) dealt string by string."""
    for name, value in setting.items():
        monkeypatch.setattr(suffixes, name, value)
    rows = _rows()
    assert _local(rows, parts) == _brute(rows)


def test_hot_anchors_are_found_and_change_no_row(spark, monkeypatch):
    rows = _rows()
    monkeypatch.setattr(suffixes, "HOT_RUNS", 3)
    monkeypatch.setattr(suffixes, "SAMPLE", 1)
    monkeypatch.setattr(suffixes, "PART_BYTES", 9000)
    df = _frame(spark, rows).repartition(3)
    assert len(suffixes._hot_anchors(suffixes._rows(df), 10_000))
    assert _got(suffixes.without_repeats(df)) == _brute(rows)


def test_empty_table(spark):
    assert suffixes.without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_suffixes_are_in_order():
    pick = np.random.default_rng(3)
    for size, symbols in ((0, 2), (1, 2), (700, 2), (3000, 3), (3000, 250)):
        raw = pick.integers(0, symbols, size).astype(np.uint8)
        raw[size // 3 : size // 2] = raw[: size // 2 - size // 3]
        order = suffixes.sorted_suffixes(raw)
        data = raw.tobytes()
        assert sorted(order.tolist()) == list(range(size))
        cut = [data[i : i + suffixes.LENGTH] for i in order]
        assert all(a <= b or len(a) < suffixes.LENGTH for a, b in zip(cut, cut[1:], strict=False))
        whole = [c for c in cut if len(c) == suffixes.LENGTH]
        assert whole == sorted(whole)
