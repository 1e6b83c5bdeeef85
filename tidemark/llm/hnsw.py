"""Approximate nearest neighbours by inner product: one navigable small-world graph per shard, results merged.

Equal vectors are one node. Nodes are dealt to shards of a bounded size by hash. A shard's graph is built in numpy and
kept as flat arrays of neighbour numbers, one per level; searches of many queries run through it side by side. Vectors
get one more component that makes their lengths equal, so that the largest inner product is the nearest in angle and
the graph is one of a metric. Final scores are computed in double precision on the original vectors.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

#: Nodes of a shard at most (about), links per node (twice as many on the lowest level), width of the searches.
SHARD_ROWS, LINKS, BUILD_WIDTH, SEARCH_WIDTH = 8192, 16, 64, 128
#: Queries that travel and search together.
QUERY_BLOCK, SIDE_BY_SIDE = 2048, 256


class Graph:
    """Neighbour arrays over unit-length nodes; -1 is no neighbour."""

    def __init__(self, nodes: np.ndarray, seed: int = 1):
        self.nodes = nodes
        n = len(nodes)
        draw = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log(draw) / math.log(LINKS)).astype(np.int64), 12)
        self.order = np.argsort(-self.level, kind="stable")  # high nodes first: the entry point never changes
        top = int(self.level.max())
        self.links = [np.full((n, LINKS * (2 if lv == 0 else 1)), -1, dtype=np.int32) for lv in range(top + 1)]
        self._build()

    def _build(self) -> None:
        done, n = 1, len(self.order)
        while done < n:
            batch = self.order[done : done + min(SIDE_BY_SIDE, max(1, done))]
            self._insert(batch)
            done += len(batch)

    def _insert(self, batch: np.ndarray) -> None:
        entry = np.full((len(batch), 1), self.order[0])
        among = self.nodes[batch] @ self.nodes[batch].T
        for lv in range(len(self.links) - 1, -1, -1):
            here = self.level[batch] >= lv
            if not here.any():
                entry = self.search_level(self.nodes[batch], entry, 1, lv)[0]
                continue
            found, score = self.search_level(self.nodes[batch], entry, BUILD_WIDTH, lv)
            entry = found[:, :8]
            rows = np.flatnonzero(here)
            # Nodes of one batch do not meet in the graph yet, so they are candidates of each other directly.
            peers = np.broadcast_to(batch[rows], (len(rows), len(rows)))
            peer_score = np.where(peers == batch[rows][:, None], -np.inf, among[np.ix_(rows, rows)]).astype(np.float32)
            ids = np.concatenate([found[rows], peers], axis=1)
            scores = np.concatenate([score[rows], peer_score], axis=1)
            best = np.argsort(-scores, axis=1, kind="stable")[:, : BUILD_WIDTH // 2]
            ids, scores = np.take_along_axis(ids, best, 1), np.take_along_axis(scores, best, 1)
            ids = np.where(np.isfinite(scores), ids, -1)
            chosen = self._diverse(ids, scores, LINKS)
            self.links[lv][batch[rows], :LINKS] = chosen
            self._link_back(lv, batch[rows], chosen)

    def _diverse(self, ids: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
        """Of candidates in falling score, those nearer to the node than to any one chosen before; then the nearest left."""
        rows, width = ids.shape
        vectors = self.nodes[np.maximum(ids, 0)]
        near = np.matmul(vectors, vectors.transpose(0, 2, 1))
        worst = np.full((rows, width), -np.inf, dtype=np.float32)  # closeness to the chosen ones
        taken = np.zeros((rows, width), dtype=bool)
        count = np.zeros(rows, dtype=np.int64)
        for k in range(width):
            take = (ids[:, k] >= 0) & (scores[:, k] > worst[:, k]) & (count < most)
            taken[:, k] = take
            count += take
            worst = np.where(take[:, None], np.maximum(worst, near[:, k, :]), worst)
        rank = np.where(taken, 0, np.where(ids >= 0, 1, 2)) * width + np.arange(width)
        pick = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(ids, pick, 1)
        if out.shape[1] < most:
            out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
        return out

    def _link_back(self, lv: int, sources: np.ndarray, chosen: np.ndarray) -> None:
        table = self.links[lv]
        most = table.shape[1]
        to, who = chosen.reshape(-1), np.repeat(sources, chosen.shape[1])
        to, who = to[to >= 0], who[to >= 0]
        new = ~(table[to] == who[:, None]).any(axis=1)  # two nodes of a batch may have chosen each other
        to, who = to[new], who[new]
        by = np.argsort(to, kind="stable")
        to, who = to[by], who[by]
        target, first, count = np.unique(to, return_index=True, return_counts=True)
        have = (table[target] >= 0).sum(axis=1)
        room = have + count <= most
        for t, f, c, h in zip(target[room], first[room], count[room], have[room], strict=True):
            table[t, h : h + c] = who[f : f + c]
        full = np.flatnonzero(~room)
        for at in range(0, len(full), SIDE_BY_SIDE):
            part = full[at : at + SIDE_BY_SIDE]
            width = most + int(count[part].max())
            ids = np.full((len(part), width), -1, dtype=np.int64)
            ids[:, :most] = table[target[part]]
            for row, k in enumerate(part):
                ids[row, most : most + count[k]] = who[first[k] : first[k] + count[k]]
            scores = np.einsum("rd,rwd->rw", self.nodes[target[part]], self.nodes[np.maximum(ids, 0)])
            scores = np.where(ids >= 0, scores, -np.inf)
            best = np.argsort(-scores, axis=1, kind="stable")
            ids, scores = np.take_along_axis(ids, best, 1), np.take_along_axis(scores, best, 1)
            table[target[part]] = self._diverse(ids, scores, most)

    def search_level(self, queries: np.ndarray, entry: np.ndarray, width: int, lv: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest found for each query (number, score; falling, -1 padded), from its entry points."""
        n, rows = len(self.nodes), np.arange(len(queries))
        table = self.links[lv]
        seen = np.zeros((len(queries), n + 1), dtype=bool)
        seen[:, n] = True
        ids = np.full((len(queries), width), -1, dtype=np.int64)
        scores = np.full((len(queries), width), -np.inf, dtype=np.float32)
        entry = entry[:, :width]
        some = entry >= 0
        first = np.where(some, np.einsum("qd,qed->qe", queries, self.nodes[np.maximum(entry, 0)]), -np.inf)
        ids[:, : entry.shape[1]], scores[:, : entry.shape[1]] = entry, first
        seen[rows[:, None], np.where(some, entry, n)] = True
        opened = np.zeros((len(queries), width), dtype=bool)
        active = rows
        while len(active):
            waiting = np.where(opened[active] | (ids[active] < 0), -np.inf, scores[active])
            best = waiting.argmax(axis=1)
            alive = np.isfinite(waiting[np.arange(len(active)), best])
            active, best = active[alive], best[alive]
            if not len(active):
                break
            opened[active, best] = True
            near = table[ids[active, best]].astype(np.int64)
            near[near < 0] = n
            fresh = ~seen[active[:, None], near]
            seen[active[:, None], near] = True
            near[~fresh] = -1
            got = np.einsum("qd,qmd->qm", queries[active], self.nodes[np.maximum(near, 0)])
            got = np.where(near >= 0, got, -np.inf).astype(np.float32)
            all_scores = np.concatenate([scores[active], got], axis=1)
            keep = np.argpartition(-all_scores, width - 1, axis=1)[:, :width]
            scores[active] = np.take_along_axis(all_scores, keep, 1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], near], axis=1), keep, 1)
            opened[active] = np.take_along_axis(np.concatenate([opened[active], np.zeros(near.shape, dtype=bool)], axis=1), keep, 1)
        order = np.argsort(-scores, axis=1, kind="stable")
        ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
        return np.where(np.isfinite(scores), ids, -1), scores

    def search(self, queries: np.ndarray, width: int) -> np.ndarray:
        """Node numbers near each query, -1 padded."""
        out = []
        for at in range(0, len(queries), SIDE_BY_SIDE):
            part = queries[at : at + SIDE_BY_SIDE]
            entry = np.full((len(part), 1), self.order[0])
            for lv in range(len(self.links) - 1, 0, -1):
                entry = self.search_level(part, entry, 4, lv)[0]
            out.append(self.search_level(part, entry, width, 0)[0])
        return np.concatenate(out) if out else np.zeros((0, width), dtype=np.int64)


def level_lengths(vectors: np.ndarray) -> np.ndarray:
    """The vectors with one more component, scaled so that all have length one; order by inner product is kept."""
    square = (vectors.astype(np.float64) ** 2).sum(axis=1)
    most = square.max()
    extra = np.sqrt(np.maximum(0.0, most - square))
    return (np.concatenate([vectors, extra[:, None]], axis=1) / math.sqrt(most)).astype(np.float32)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, added up from the first component to the last in double precision."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k].astype(np.float64) * b[:, k].astype(np.float64)
    return total


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _build_shard(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    dim = table.column("dim")[0].as_py()
    vectors = _matrix(table.column("vector").combine_chunks(), dim)
    scale = np.abs(vectors).max()
    graph = Graph(level_lengths(vectors / scale))
    members = table.column("members").to_pylist()
    ends = np.cumsum([0, *map(len, members)])
    packed = pickle.dumps({
        "vectors": vectors, "nodes": graph.nodes, "links": graph.links, "order": graph.order[:1],
        "members": np.array([m for ms in members for m in ms], dtype=np.int64), "ends": ends}, protocol=5)
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), "dim": pa.array([dim], pa.int32()),
                     "graph": pa.array([packed], pa.binary())})


def _pack_queries(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    dim = table.column("dim")[0].as_py()
    vectors = _matrix(table.column("vector").combine_chunks(), dim)
    packed = pickle.dumps((table.column("class_id").to_numpy(), vectors), protocol=5)
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int64()), "dim": pa.array([dim], pa.int32()),
                     "queries": pa.array([packed], pa.binary())})


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, queries in zip(batch.column(0), batch.column(1), strict=True):
                held = pickle.loads(packed.as_py())
                classes, vectors = pickle.loads(queries.as_py())
                graph = Graph.__new__(Graph)
                graph.nodes, graph.links, graph.order = held["nodes"], held["links"], held["order"]
                scale = np.abs(vectors).max()
                found = graph.search(np.pad(vectors / scale, ((0, 0), (0, 1))).astype(np.float32), max(SEARCH_WIDTH, 2 * k))
                row, at = np.nonzero(found >= 0)
                node = found[row, at]
                score = inner_products(vectors[row], held["vectors"][node])
                # Each node stands for the smallest ids that share its vector.
                count = held["ends"][node + 1] - held["ends"][node]
                owner = np.repeat(np.arange(len(node)), count)
                within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                ids = held["members"][held["ends"][node][owner] + within]
                row, score = row[owner], score[owner]
                order = np.lexsort((ids, -score, row))
                row, score, ids = row[order], score[order], ids[order]
                start = np.searchsorted(row, np.arange(len(classes)))
                keep = np.arange(len(row)) - start[row] <= k
                yield pa.RecordBatch.from_arrays(
                    [pa.array(classes[row[keep]]), pa.array(ids[keep]), pa.array(score[keep])], names=["class_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: F.Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` (vec_id, embedding) of largest inner product found
    for each row where ``queries`` holds, its own vec_id left out.

    Order: score falling, then vec_id. Fewer than ``k`` candidates are all returned. Rows whose vec_id or embedding is
    null, whose embedding is empty, all zero, or holds a null or a number that is not finite take no part, nor do vectors
    of another length than the query's. Repeated rows (alike in id and vector) count once; other columns are ignored
    whatever their names; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.filter("vec_id IS NOT NULL AND vector IS NOT NULL").filter(fine).withColumn("dim", F.size("vector"))
    rows = rows.withColumn("same", F.xxhash64("vector"))
    # The k + 1 smallest ids of each vector are enough: whichever is the query's own, k are left.
    first = Window.partitionBy("same", "vector").orderBy("vec_id")
    members = rows.dropDuplicates(["vec_id", "vector"]).withColumn("at", F.row_number().over(first)).filter(F.col("at") <= k + 1)
    classes = cut(members.groupBy("same", "vector", "dim").agg(F.array_sort(F.collect_list("vec_id")).alias("members")).withColumn(
        "class_id", F.col("members")[0]), "vector-classes")
    sizes = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}  # one row per vector length
    shards, blocks = F.lit(1), F.lit(1)
    wanted = rows.filter(queries.cast("boolean") if not isinstance(queries, str) else F.expr(queries)).select("vec_id", "same", "vector").distinct()
    asked = classes.select("same", "vector", "dim", "class_id").join(wanted.select("same", "vector").distinct(), ["same", "vector"], "left_semi")
    for dim, count in sizes.items():
        shards = F.when(F.col("dim") == dim, F.lit(-(-count // SHARD_ROWS))).otherwise(shards)
        blocks = F.when(F.col("dim") == dim, F.lit(-(-count // (20 * QUERY_BLOCK)))).otherwise(blocks)
    spread = F.xxhash64("class_id", F.lit(17))
    built = classes.withColumn("shard", F.pmod(spread, shards).cast("long")).select("shard", "dim", "vector", "members")
    built = cut(built.groupBy("shard", "dim").applyInArrow(_build_shard, "shard long, dim int, graph binary"), "graphs")
    blocked = asked.withColumn("block", F.pmod(F.xxhash64("class_id", F.lit(29)), blocks).cast("long")).select("block", "dim", "class_id", "vector")
    blocked = blocked.groupBy("block", "dim").applyInArrow(_pack_queries, "block long, dim int, queries binary")
    # Every block of the stated queries visits every shard.
    visits = built.withColumn("block", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int")))).withColumn("block", F.col("block").cast("long"))
    pairs = visits.join(blocked, ["block", "dim"]).select("graph", "queries")
    found = pairs.mapInArrow(_search(k), "class_id long, vec_id long, score double")
    best = Window.partitionBy("class_id").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k + 1).drop("at")
    asks = wanted.join(classes.select("same", "vector", "class_id"), ["same", "vector"]).select(F.col("vec_id").alias("query_id"), "class_id")
    own = asks.join(top, "class_id").filter("query_id != vec_id")
    rank = Window.partitionBy("query_id", "class_id").orderBy(F.desc("score"), "vec_id")
    return own.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
