"""Exact top-k search of 64-bit codes by Hamming distance: incremental multi-index hashing.

A code is cut into segments; every distinct code is indexed by the value of each. A query probes the values within a
radius of its own segments, radius by radius. A code not met at radius r differs in more than r bits of every segment
probed so far, so once the k-th distance verified is below the sum of those the search is over. A query probes only as
many segments of the next radius as its bound still needs.

The index lies in cells: codes whose values of one segment share their high bits. A query travels once to every cell that
its probes of a radius fall into; the probes themselves are made there, and only the nearest ids of the cell come back.
"""

from __future__ import annotations

import itertools
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

BITS = 64
#: A segment has about as many bits as the number of codes, and no fewer than this.
LEAST_SEGMENT = 16
#: Masks of one radius, and probes, that a task holds at once.
MASKS_AT_ONCE, PROBES_AT_ONCE = 1 << 14, 1 << 17
#: A cell of the index has about so many codes; one with more than twice as many is dealt out in parts.
CELL_CODES = 1 << 17
#: Queries of a block, those searched side by side, and codes met that a task holds at once.
QUERY_BLOCK, QUERIES_AT_ONCE, MET_AT_ONCE = 1 << 18, 1 << 12, 1 << 19
#: Queries sent to cells, made by one task.
SENT_AT_ONCE = 1 << 21


def sign_code(embedding: Column) -> Column:
    """64 sign bits: bit i tells whether the components i, i + 64, ... add up to more than zero."""
    size = F.size(embedding)

    def total(bit: Column) -> Column:
        places = F.when(size > bit, F.sequence(bit + 1, size, F.lit(BITS)))
        return F.aggregate(places, F.lit(0.0), lambda a, i: a + F.element_at(embedding, i).cast("double"))

    bits = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.when(
        total(b) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def segments(codes: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment for so many distinct codes."""
    size = max(LEAST_SEGMENT, min(BITS, round(math.log2(max(2, codes)))))
    count = -(-BITS // size)
    edges = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(edges)]


def _high_bits(codes: int, cuts: list[tuple[int, int]]) -> int:
    """Bits of a segment's value that tell its cell."""
    return min(max(0, math.ceil(math.log2(max(1, codes) / CELL_CODES))), min(bits for _, bits in cuts))


def _cell(code: str, seg: int, first: int, bits: int, high: int) -> Column:
    top = F.shiftrightunsigned(F.col(code), first + bits - high) if high else F.lit(0)
    return F.lit(seg << high).cast("long") + top.bitwiseAND(F.lit((1 << high) - 1)).cast("long")


def _masks(bits: int, radius: int) -> Iterator[np.ndarray]:
    """All values of ``bits`` bits of which ``radius`` are set, some at a time."""
    values = (sum(1 << b for b in c) for c in itertools.combinations(range(bits), radius))
    while some := list(itertools.islice(values, MASKS_AT_ONCE)):
        yield np.array(some, dtype=np.uint64)


def _at_radius(cuts: list[tuple[int, int]], radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, most, need = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for seg, (first, bits) in enumerate(cuts):
                asks = need > seg
                if radius > bits or not asks.any():
                    continue
                codes, bounds = q[asks], most[asks]
                own = (codes.view(np.uint64) >> np.uint64(first)) & np.uint64((1 << bits) - 1)
                for masks in _masks(bits, radius):
                    step = max(1, PROBES_AT_ONCE // len(masks))
                    for low in range(0, len(own), step):
                        some = slice(low, low + step)
                        values = (own[some, None] ^ masks[None, :]).reshape(-1).view(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.repeat(codes[some], len(masks))), pa.array(np.repeat(bounds[some], len(masks)).astype(np.int32)),
                             pa.array(np.full(len(values), seg, dtype=np.int32)), pa.array(values)], names=["q", "most", "seg", "val"])

    return run


def _probes(pending: DataFrame, cuts: list[tuple[int, int]], radius: int) -> DataFrame:
    """(q, most, seg, val): values at exactly ``radius`` from each segment that the query still needs (its first ``need``)."""
    asked = pending.select(F.col("q").cast("long"), F.col("most").cast("int"), F.col("need").cast("int"))
    return asked.mapInArrow(_at_radius(cuts, radius), "q long, most int, seg int, val long")


def _pack(cuts: list[tuple[int, int]], high: int):
    """A part of a cell as one row: its codes in the order of their low bits, their members and where each code's end."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cell, part = table.column("cell")[0].as_py(), table.column("part")[0].as_py()
        codes = table.column("code").to_numpy().view(np.uint64)
        order = np.argsort(_low(codes, cuts[cell >> high], high), kind="stable")
        members = pa.chunked_array(table.column("members")).combine_chunks().take(pa.array(order))
        ends = np.concatenate([[0], np.cumsum(members.value_lengths().to_numpy())])
        packed = pickle.dumps((codes[order], members.flatten().to_numpy(), ends), protocol=5)
        return pa.table({"cell": pa.array([cell], pa.int64()), "part": pa.array([part], pa.int64()), "packed": pa.array([packed], pa.binary())})

    return run


def _low(codes: np.ndarray, segment: tuple[int, int], high: int) -> np.ndarray:
    first, bits = segment
    return ((codes >> np.uint64(first)) & np.uint64((1 << bits - high) - 1)).astype(np.int64)


class _Cell:
    """Codes of one part of a cell, searched by the low bits of their segment."""

    def __init__(self, packed: bytes, segment: tuple[int, int], high: int, k: int):
        self.codes, self.ids, self.ends = pickle.loads(packed)
        self.segment, self.high, self.k = segment, high, k
        self.bits = segment[1] - high
        at = np.bincount(_low(self.codes, segment, high), minlength=1 << self.bits)
        self.starts = np.concatenate([[0], np.cumsum(at)])
        self.least = self.ids[self.ends[:-1]]
        # Of codes with the same least id one is counted, as their ids may be the same rows of the result.
        self.counted = np.zeros(len(self.codes), dtype=bool)
        self.counted[np.unique(self.least, return_index=True)[1]] = True

    def nearest(self, q: np.ndarray, most: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in q, distance, id): the k + 1 first of each query by distance and id, of those at exactly ``radius``."""
        most, own = most.copy(), _low(q, self.segment, self.high)
        best, met, held = (np.zeros(0, np.int64),) * 3, [], 0
        for masks in _masks(self.bits, radius):
            masks = masks.astype(np.int64)
            step = max(1, PROBES_AT_ONCE // len(masks))
            for low in range(0, len(q), step):
                values = (own[low:low + step, None] ^ masks[None, :]).reshape(-1)
                hit = np.flatnonzero(self.starts[values + 1] > self.starts[values])
                begin, who = self.starts[values[hit]], low + hit // len(masks)
                many = self.starts[values[hit] + 1] - begin
                upto = np.cumsum(many)
                at = np.searchsorted(upto, np.arange(MET_AT_ONCE, upto[-1] if len(upto) else 0, MET_AT_ONCE))
                for some in np.split(np.arange(len(hit)), at):
                    asks = np.repeat(who[some], many[some])
                    codes = np.arange(len(asks)) + np.repeat(begin[some] - np.cumsum(many[some]) + many[some], many[some])
                    distance = np.bitwise_count(q[asks] ^ self.codes[codes]).astype(np.int64)
                    near = distance <= most[asks]
                    met.append((asks[near], distance[near], codes[near]))
                    held += len(met[-1][0])
                    if held > MET_AT_ONCE:
                        best, met, held = self._first(best, met, most), [], 0
        return self._first(best, met, most)

    def _first(self, best: tuple, met: list[tuple], most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k + 1 first ids of ``best`` and the codes met; lowers ``most`` to the last of them."""
        if not met:
            return best
        who, distance, codes = (np.concatenate(x) for x in zip(*met, strict=True))
        sure = self.counted[codes]
        counts = np.bincount(who[sure] * (BITS + 1) + distance[sure], minlength=len(most) * (BITS + 1)).reshape(-1, BITS + 1).cumsum(axis=1)
        np.minimum(most, np.where(counts[:, -1] > self.k, (counts > self.k).argmax(axis=1), BITS), out=most)
        near = distance <= most[who]
        who, distance, codes = who[near], distance[near], codes[near]
        # A code behind k + 1 others by its least id adds nothing.
        keep, _ = self._ranked(who, distance, self.least[codes])
        who, distance, codes = who[keep], distance[keep], codes[keep]
        many = self.ends[codes + 1] - self.ends[codes]
        ids = self.ids[np.arange(many.sum()) + np.repeat(self.ends[codes] - np.cumsum(many) + many, many)]
        rows = [np.concatenate(x) for x in zip(best, (np.repeat(who, many), np.repeat(distance, many), ids), strict=True)]
        keep, once = self._ranked(*rows)
        who, distance, ids = (x[keep[once]] for x in rows)
        full = np.bincount(who, minlength=len(most)) > self.k
        last = np.zeros(len(most), dtype=most.dtype)
        np.maximum.at(last, who, distance.astype(most.dtype))
        most[full] = np.minimum(most, last)[full]
        return who, distance, ids

    def _ranked(self, who: np.ndarray, distance: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places, in order, of the rows whose (distance, id) is among the k + 1 first of their query; which of them come first among equals."""
        order = np.lexsort((ids, distance, who))
        who, distance, ids = who[order], distance[order], ids[order]
        fresh = np.ones(len(who), dtype=bool)
        fresh[1:] = (who[1:] != who[:-1]) | (distance[1:] != distance[:-1]) | (ids[1:] != ids[:-1])
        nth = np.cumsum(fresh)
        keep = nth - nth[np.searchsorted(who, who)] <= self.k
        return order[keep], fresh[keep]


def _search(cuts: list[tuple[int, int]], high: int, k: int):
    def run(cells: pa.Table, asks: pa.Table) -> pa.Table:
        parts = []
        if cells.num_rows and asks.num_rows:
            cell = _Cell(cells.column("packed")[0].as_py(), cuts[cells.column("cell")[0].as_py() >> high], high, k)
            q, most, within = (asks.column(c).to_numpy() for c in ("q", "most", "within"))
            for radius in np.unique(within).tolist():
                here = np.flatnonzero(within == radius)
                for low in range(0, len(here), QUERIES_AT_ONCE):
                    some = here[low:low + QUERIES_AT_ONCE]
                    who, distance, ids = cell.nearest(q[some].view(np.uint64), most[some], radius)
                    parts.append((q[some][who], distance.astype(np.int32), ids))
        found = [np.concatenate(x) for x in zip(*parts, strict=True)] or [np.zeros(0, np.int64)] * 3
        return pa.table({"q": pa.array(found[0], pa.int64()), "distance": pa.array(found[1], pa.int32()), "vec_id": pa.array(found[2], pa.int64())})

    return run


def top_k(codes: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, distance): for each row of ``codes`` (vec_id, code) where ``queries`` holds, the ``k`` other
    ids of least Hamming distance, ties to the smaller id. Exact, however close or far the codes are.

    Rows whose id or code is null take no part. Equal codes are searched once; repeated rows (alike in id and code) count
    once. With fewer than ``k`` other ids all of them are returned. An empty table gives no rows. Other columns are ignored.
    """
    rows = codes.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("code").cast("long").alias("code"), queries.alias("asks"))
    rows = cut(rows.filter("vec_id IS NOT NULL AND code IS NOT NULL").groupBy("vec_id", "code").agg(
        F.coalesce(F.bool_or("asks"), F.lit(False)).alias("asks")), "codes")
    # The k + 1 smallest ids of a code are enough: without the query's own, k are left.
    least = Window.partitionBy("code").orderBy("vec_id")
    members = rows.withColumn("at", F.row_number().over(least)).filter(F.col("at") <= k + 1)
    distinct = cut(members.groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("members")), "distinct-codes")
    count = distinct.count()
    cuts = segments(count)
    high = _high_bits(count, cuts)
    cells = F.array(*(_cell("code", seg, first, bits, high) for seg, (first, bits) in enumerate(cuts)))
    # One row per cell: about the codes by CELL_CODES, per segment.
    crowds = cut(distinct.select(F.explode(cells).alias("cell")).groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(2 * CELL_CODES)).cast("long").alias("parts")), "cells")
    asking = cut(rows.filter("asks").select(F.col("code").alias("q")).distinct(), "asking")
    ask_count = asking.count()
    blocks = -(-ask_count // QUERY_BLOCK)
    parted = distinct.withColumn("cell", F.explode(cells)).join(crowds, "cell").withColumn(
        "part", F.pmod(F.xxhash64("code"), F.col("parts"))).select("cell", "part", "code", "members")
    index = cut(parted.groupBy("cell", "part").applyInArrow(_pack(cuts, high), "cell long, part long, packed binary"), "index")
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, blocks - 1)).cast("long"))))
    tops = [(first + bits - high, high) for first, bits in cuts]
    best = None
    # most: distance that a find must not pass; need: segments still to be probed at this radius.
    pending = asking.withColumns({"most": F.lit(BITS), "need": F.lit(len(cuts))})
    for radius in range(max(bits for _, bits in cuts) + 1):
        # A probe apart in some of the high bits leaves the rest of the radius to the low ones.
        tasks = -(-ask_count * len(cuts) * sum(math.comb(high, h) for h in range(radius + 1)) // SENT_AT_ONCE)
        dealt = pending.repartition(max(1, tasks), "q")
        sent = None
        for h in range(min(radius, high) + 1):
            some = _probes(dealt, tops, h).withColumn("within", F.lit(radius - h))
            sent = some if sent is None else sent.union(some)
        sent = sent.withColumn("cell", F.col("seg").cast("long") * F.lit(1 << high) + F.col("val")).join(crowds.hint("broadcast"), "cell")
        sent = sent.withColumns({"part": F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)),
                                 "block": F.pmod(F.xxhash64("q"), F.lit(max(1, blocks)).cast("long"))})
        sent = sent.select("cell", "part", "block", "q", "most", "within")
        found = index.groupBy("cell", "part", "block").cogroup(sent.groupBy("cell", "part", "block")).applyInArrow(
            _search(cuts, high, k), "q long, distance int, vec_id long")
        if best is not None:
            found = found.union(best.select("q", "distance", "vec_id"))
        order = Window.partitionBy("q").orderBy("distance", "vec_id")
        best = cut(found.distinct().withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k + 1).drop("at"), "best")
        state = best.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
        most = F.when(F.col("n") > k, F.col("far")).otherwise(F.lit(BITS))
        # After all segments at this radius a code not met is at least len(cuts) * (radius + 1) away; one more for each
        # segment probed at the next.
        need = F.least(F.lit(len(cuts)), most + 1 - F.lit(len(cuts) * (radius + 1)))
        pending = asking.join(state, "q", "left")
        pending = pending.withColumns({"most": F.coalesce(most, F.lit(BITS)), "need": F.coalesce(need, F.lit(len(cuts)))}).filter(
            "need > 0").select("q", "most", "need")
        pending = cut(pending, "pending")
        if pending.isEmpty():
            break
    asked = rows.filter("asks").select(F.col("vec_id").alias("query_id"), F.col("code").alias("q")).distinct()
    rank = Window.partitionBy("query_id", "q").orderBy("distance", "vec_id")
    return asked.join(best.hint("merge"), "q").filter("query_id != vec_id").withColumn("rank", F.row_number().over(rank)).filter(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")
