"""The conversation trie against brute force, with nulls, empty turns, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from tidemark.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, ids int, words string, depth int, share long, first int, place string"


def _rows():
    pick = random.Random(5)
    said = [("user", "hello there"), ("assistant", "yes  yes\tyes"), ("user", None), (None, "x"), ("user", ""), (None, None), ("user", "so\nlong")]
    rows = []
    for conv in [*range(130), 400, 401, 405, -3, -21, 10**15 + 7]:
        if conv % 11 == 5:
            continue
        for turn in range(pick.choice([0, 1, 1, 2, 3, 5, 9])):
            rows.append((conv, turn, *(said[0] if turn == 0 and pick.random() < 0.5 else pick.choice(said))))
    # Copies of one conversation, ties, repeated rows, no turn number, no conversation.
    rows += [(conv, t, *said[t]) for conv in range(700, 760) for t in range(3)]
    rows += [(800, 1, "user", "b"), (800, 1, "user", "a"), (800, 1, "user", "a"), (800, None, "user", "z"), (801, None, None, None)]
    rows += [(None, 1, "user", "a"), (None, None, None, None)]
    rows += [(900 + i, t, "user", f"{t}") for i in range(3) for t in range(300 + i)]
    pick.shuffle(rows)
    return rows


def _brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn, role or "", text or ""))
    for conv, said in own.items():
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        own[conv] = [r[1:] for r in said]
    whole = {}
    for conv, said in own.items():
        share = zlib.crc32(str(conv).encode()) % 4
        family = conv - int(conv % 20 if conv >= 0 else -(-conv % 20))
        whole[conv] = tuple(own.get(family, [])[:share] + said[share:])
    members = {}
    for conv, said in whole.items():
        for d in range(len(said) + 1):
            members.setdefault(said[:d], []).append(conv)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, convs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(convs) - 1) * words
    out = []
    for p, convs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if whole[c] == p))
        out.append((min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), len(kids.get(p, [])), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "a", 2, 3, 4, "b") for r in rows], SCHEMA)


@pytest.mark.parametrize("shard", [turns.SHARD_TURNS, 60])
def test_nodes_are_those_of_brute_force(spark, monkeypatch, shard):
    """One shard, and shards so small that nodes lie in many of them."""
    monkeypatch.setattr(turns, "SHARD_TURNS", shard)
    got = turns.prefix_trie(_frame(spark, _rows()).repartition(4))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _brute(_rows())


def test_no_conversations(spark):
    assert turns.prefix_trie(_frame(spark, [])).collect() == []
    assert turns.prefix_trie(_frame(spark, [(None, 1, "user", "a")])).collect() == []


def test_trees_are_balanced_by_medians():
    tree = turns._Tree()
    for at in turns._medians(1000):
        tree.insert([at], [1], at)
    below, most = {}, 0
    for node in range(1, 1001):
        below[node] = below.get(node, 1)
        for child in (tree.low[node], tree.high[node]):
            if child >= 0:
                below[child] = below[node] + 1
        most = max(most, below[node])
    assert sorted(turns._medians(1000)) == list(range(1000)) and most <= 10
