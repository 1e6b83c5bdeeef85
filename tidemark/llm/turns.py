"""Prefix trie of conversations: shards of ternary search trees over dictionary-encoded turns.

Turns get numbers from a dictionary of distinct (role, text). Distinct sequences of numbers, with their counts, are dealt in
order into shards. Each shard inserts its sequences, medians first, into a ternary search tree, which is so balanced, and
one pass from the last node to the first adds up members, leaves and savings. A shard knows the last sequence before it and
the first one after it; so a node on both sides of a boundary is counted as new, and as childless, once only, and what the
shards say of it is added up.

Rows without conv_id belong to no conversation; null role or text counts as empty. Turns are ordered by turn, null first,
those alike in it by the digest of role and text; repeated rows are repeated turns. An empty table has no nodes. Only
conv_id, turn, role and text are read, so other columns may have any name. The turns of one conversation travel as one row of
16 bytes a turn; equal conversations are counted before they meet. What is sequential by definition, the digest over the
ordered members that end at a node, streams through one task without being held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordered import Ordered
from tidemark.session import cut

#: Conversations of a family are those with one quotient by this; each takes over up to MOST_SHARED - 1 turns of its first.
FAMILY, MOST_SHARED = 20, 4
#: Turns whose sequences one shard holds.
SHARD_TURNS = 1 << 19

_PRIME = (1 << 61) - 1
_LANES = (0x1D4F9C3A7B52E681, 0x0B6E2F8D5C917A43)
_EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = ("lane_a long, lane_b long, depth long, up_a long, up_b long, parent_conv_id long, conv_id long, n_convs long, "
         "n_children long, n_leaves long, saved_tokens long, ends string, shared boolean, parent_shared boolean")
_WORDS = r"[^\x20\x09-\x0D]+"


def _turns(df: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return df.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.regexp_count(text, F.lit(_WORDS)).cast("long").alias("words"))


def _encoded(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, id, words), ids being the numbers of distinct turns in a dictionary written down once."""
    distinct = turns.groupBy("digest").agg(F.max("words").alias("words"))
    dictionary = cut(distinct.withColumn("id", F.monotonically_increasing_id()), "turn-dictionary")
    return turns.drop("words").join(dictionary, "digest")


def rebuilt(df: DataFrame) -> DataFrame:
    """(conv_id, ids, words) of every conversation: the first turns of its family's first one, then its own after as many.

    The number taken over is crc32 of the decimal conv_id, modulo MOST_SHARED.
    """
    encoded = cut(_encoded(_turns(df)), "turns")
    placed = Ordered(encoded, ["turn", "digest"], ["conv_id"]).row_number("place").done()
    placed = cut(placed.select("conv_id", "place", "id", "words"), "placed")
    share = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED
    members = placed.groupBy("conv_id").agg(F.lit(1).alias("one"))
    members = members.select("conv_id", share.alias("share"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"))
    heads = placed.filter(F.col("place") < MOST_SHARED).withColumnRenamed("conv_id", "first")
    taken = members.join(heads, "first").filter("place <= share").select("conv_id", "place", "id", "words")
    own = placed.filter(F.col("place") > share)
    turns = taken.unionByName(own).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "id", "words"))).alias("t"))
    none = F.array().cast("array<bigint>")
    return members.select("conv_id").join(turns, "conv_id", "left").select(
        "conv_id", F.coalesce(F.col("t.id"), none).alias("ids"), F.coalesce(F.col("t.words"), none).alias("words"))


def _common(a: list[int], b: list[int]) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


class _Tree:
    """A ternary search tree; node 0 is the root, a node's ``inner`` leads to the search tree of its children."""

    def __init__(self) -> None:
        self.turn, self.low, self.high, self.inner = [0], [-1], [-1], [-1]
        self.parent, self.depth, self.words, self.end = [-1], [0], [0], [-1]
        self.lanes = [(0, 0)]

    def _new(self, parent: int, turn: int, words: int) -> int:
        for column, value in ((self.turn, turn), (self.low, -1), (self.high, -1), (self.inner, -1), (self.parent, parent),
                              (self.depth, self.depth[parent] + 1), (self.words, words), (self.end, -1)):
            column.append(value)
        a, b = self.lanes[parent]
        self.lanes.append(((a * _LANES[0] + turn + 1) % _PRIME, (b * _LANES[1] + turn + 1) % _PRIME))
        return len(self.turn) - 1

    def child(self, node: int, turn: int, words: int = -1) -> int:
        """The child that a turn leads to, made if it is missing."""
        links, at, link = self.inner, node, self.inner[node]
        while link >= 0:
            if turn == self.turn[link]:
                return link
            links, at = (self.low if turn < self.turn[link] else self.high), link
            link = links[at]
        links[at] = self._new(node, turn, words)
        return links[at]

    def insert(self, ids: list[int], words: list[int], row: int) -> None:
        node = 0
        for turn, count in zip(ids, words, strict=True):
            node = self.child(node, turn, count)
        self.end[node] = row

    def path(self, ids: list[int]) -> list[int]:
        nodes = [0]
        for turn in ids:
            nodes.append(self.child(nodes[-1], turn))
        return nodes


def _medians(count: int) -> Iterator[int]:
    """All places, the middle one of every stretch before its halves."""
    stretches = [(0, count)]
    for low, high in stretches:
        if low < high:
            middle = (low + high) // 2
            yield middle
            stretches += [(low, middle), (middle + 1, high)]


def _grow(table: pa.Table) -> pa.Table:
    """Nodes of one shard with what it knows of them."""
    rows = sorted(zip(*(table[c].to_pylist() for c in ("ids", "words", "n", "least", "ends")), strict=True))
    before, after = table["before"][0].as_py(), table["after"][0].as_py()
    tree = _Tree()
    for at in _medians(len(rows)):
        tree.insert(rows[at][0], rows[at][1], at)
    size = len(tree.turn)
    first, last = rows[0][0], rows[-1][0]
    seen, shared = [False] * size, [False] * size
    for node in [] if before is None else tree.path(first[: _common(first, before)]):
        seen[node] = shared[node] = True
    path = [] if after is None else tree.path(last[: _common(last, after)])
    for node in path:
        shared[node] = True
    extended = path[-1] if len(path) == len(last) + 1 else -1
    members, least, kids, leaves, saved = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size
    for node in range(size - 1, -1, -1):
        row = tree.end[node]
        if row >= 0:
            members[node] += rows[row][2]
            least[node] = rows[row][3] if least[node] is None else min(least[node], rows[row][3])
        if tree.inner[node] < 0 and node != extended:
            leaves[node] = 1
        saved[node] += (members[node] - (not seen[node])) * tree.words[node]
        up = tree.parent[node]
        if up >= 0:
            members[up] += members[node]
            least[up] = least[node] if least[up] is None else min(least[up], least[node])
            kids[up] += not seen[node]
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    ups = [max(p, 0) for p in tree.parent]
    cells = [
        [a for a, _ in tree.lanes], [b for _, b in tree.lanes], tree.depth, [tree.lanes[p][0] for p in ups],
        [tree.lanes[p][1] for p in ups], [None if p < 0 else least[p] for p in tree.parent], least, members, kids, leaves, saved,
        [rows[r][4] if r >= 0 else None for r in tree.end], shared, [p >= 0 and shared[p] for p in tree.parent]]
    fields = [f.strip().split() for f in _NODE.split(",")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(cells, fields, strict=True)], names=[f for f, _ in fields])


def _sharded(sequences: DataFrame) -> DataFrame:
    """Distinct sequences with their shard and the sequences next to it on both sides."""
    turns = sequences.agg(F.coalesce(F.sum(F.size("ids") + 1), F.lit(0))).first()[0]
    ranged = sequences.repartitionByRange(max(1, -(-turns // SHARD_TURNS)), "ids")
    dealt = cut(ranged.withColumn("shard", F.spark_partition_id()), "trie-shards")
    # Two sequences a shard.
    edges = dealt.groupBy("shard").agg(F.min("ids").alias("low"), F.max("ids").alias("high"))
    across = Window.orderBy("shard")
    edges = edges.select("shard", F.lag("high").over(across).alias("before"), F.lead("low").over(across).alias("after"))
    return dealt.join(edges, "shard")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ends, ends_sha256) of rows (ends, conv_id) in order; nothing but the running digest is held."""
    key, state = None, None
    for batch in batches:
        keys, digests = [], []
        for name, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if name != key:
                if state is not None:
                    keys.append(key)
                    digests.append(state.hexdigest())
                key, state = name, hashlib.sha256(str(conv).encode())
            else:
                state.update(f",{conv}".encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(digests, pa.string())], names=["ends", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=["ends", "ends_sha256"])


def prefix_trie(df: DataFrame) -> DataFrame:
    """``df`` (conv_id, turn, role, text) -> one row per node of the trie of its rebuilt conversations.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256. Rows
    that the module's docstring names as odd are treated as it says.
    """
    whole = rebuilt(df).withColumn("ends", F.md5(F.array_join("ids", ",")))
    whole = cut(whole, "conversations")
    sequences = whole.groupBy("ids", "words", "ends").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    nodes = cut(_sharded(sequences).groupBy("shard").applyInArrow(_grow, _NODE), "trie-nodes")
    lanes = ["lane_a", "lane_b", "depth"]
    # Nodes on the path between two shards: a path or two for each shard.
    merged = nodes.filter("shared").groupBy(*lanes, "up_a", "up_b").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends").alias("ends"))
    ups = merged.select(F.col("lane_a").alias("up_a"), F.col("lane_b").alias("up_b"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("up"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    inner = nodes.filter("NOT shared")
    alone = inner.filter("NOT parent_shared").select(*out)
    hanging = inner.filter("parent_shared").drop("parent_conv_id").unionByName(merged, allowMissingColumns=True)
    hanging = hanging.join(ups, ["up_a", "up_b", "depth"], "left").withColumnRenamed("up", "parent_conv_id").select(*out)
    digests = whole.select("ends", "conv_id").repartition("ends").sortWithinPartitions("ends", "conv_id").mapInArrow(
        _digests, "ends string, ends_sha256 string")
    found = alone.unionByName(hanging).join(digests, "ends", "left")
    return found.select(*out[:-1], F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
