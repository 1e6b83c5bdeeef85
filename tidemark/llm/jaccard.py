"""N-gram Jaccard join: blocked sparse product of the document by n-gram incidence matrix.

Equal rows of the matrix (equal shingle sets) are one class. Columns are ordered by how many documents hold them, rare
ones first, taken from counts in a fixed number of buckets over all documents; any order gives the same links, a good
one makes the product sparse. A linked pair must share a column among each row's first ``size - least overlap + 1``, so
the product needs these columns only. It is computed in blocks of neighbouring size bands; a pair is discarded as soon
as its sizes, its positions or the parity bits of its rows show that the overlap stays below the bound. The overlap of
the pairs left is then accumulated over all columns and held against the bound that their sizes give.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shingles import set_hash, shingle_sets
from tidemark.llm.streams import free
from tidemark.session import cut

#: Buckets of the column counts (their size never grows: 2**20 numbers of four bytes) and rows they travel in.
BUCKET_BITS, PARTS = 20, 256
#: Parity bits per row: rows that differ in d columns differ in d bits at most.
PARITY_BITS = 512
#: Times that one row of each block is multiplied with the block before the rest is; any number gives the same groups.
HUB_ROUNDS = 2
#: Texts, and pairs of rows, that a task holds unpacked at once, whatever the batch.
ROWS_AT_ONCE, PAIRS_AT_ONCE = 512, 64
_WORDS = [f"p{i}" for i in range(PARITY_BITS // 64)]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(first, ROWS_AT_ONCE)


def _parity(cells: np.ndarray) -> np.ndarray:
    odd = np.bincount((cells & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _profiles(n: int):
    """Per document its row key, set size, set hash and parity bits; per task the column counts, marked by ``part``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        nothing = None
        for batch in _parts(batches):
            size, key, bits = [], [], []
            for cells in shingle_sets(_texts(batch), n):
                size.append(len(cells))
                key.append(set_hash(cells))
                bits.append(_parity(cells))
                np.add.at(counts, (cells >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
            bits = np.array(bits, dtype=np.int64).reshape(len(size), len(_WORDS))
            nothing = pa.nulls(len(size), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(key, pa.int64()),
                 *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(len(_WORDS))), nothing, pa.nulls(len(size), pa.binary())],
                names=["doc_id", "row_key", "n", "key", *_WORDS, "part", "counts"])
        if nothing is not None:
            longs = [pa.nulls(PARTS, pa.int64())] * (4 + len(_WORDS))
            parts = [part.tobytes() for part in counts.reshape(PARTS, -1)]
            yield pa.RecordBatch.from_arrays(
                [*longs, pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())],
                names=["doc_id", "row_key", "n", "key", *_WORDS, "part", "counts"])

    return run


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = np.frombuffer(counts, dtype=np.int64)
            total[part] = total[part] + counts if part in total else counts
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "counts"])


def _column_counts(profiles: DataFrame) -> np.ndarray:
    parts = profiles.filter("part IS NOT NULL").select("part", "counts").repartition(16, "part")
    out = np.zeros((PARTS, (1 << BUCKET_BITS) // PARTS), dtype=np.int64)
    for row in parts.mapInArrow(_sum_counts, "part int, counts binary").collect():  # always PARTS rows, 8 MB in all
        out[row["part"]] = np.frombuffer(row["counts"], dtype=np.int64)
    return out.reshape(-1).clip(max=2**31 - 1).astype(np.int32)


def _least(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with any partner."""
    return -(-percent * n // 100)


def _least_as_smaller(n: int, percent: int) -> int:
    """Least overlap with a partner of its own size or more."""
    return -(-2 * percent * n // (100 + percent))


def _prefixes(n: int, percent: int, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = counts.value
        for batch in _parts(batches):
            column, key, size, pos = [], [], [], []
            for cells in shingle_sets(_texts(batch), n):
                m = len(cells)
                if m == 0 or (_least(m, percent) == m and 100 * m // percent == m):
                    continue  # nothing but an equal set can reach the bound
                first = m - _least(m, percent) + 1
                rank = np.lexsort((cells, order[(cells >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]))[:first]
                column.append(cells[rank].view(np.int64))
                key.append(np.full(first, set_hash(cells)))
                size.append(np.full(first, m, dtype=np.int32))
                pos.append(np.arange(first, dtype=np.int32))
            if column:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (column, key, size, pos)], names=["col", "key", "n", "pos"])

    return run


def _packed(cells: np.ndarray) -> bytes:
    """Five bytes of each hash: two different shingles of a pair of long texts meet in them once in millions of pairs."""
    low = np.sort(cells & np.uint64((1 << 40) - 1))
    return np.ascontiguousarray(low.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 5)
    return out.view(np.uint64).reshape(-1)


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            keys, cells = [], []
            for row in shingle_sets(_texts(batch), n):
                keys.append(set_hash(row))
                cells.append(_packed(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(cells, pa.binary()), batch.column(1)], names=["key", "cells", "members"])

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for first in range(0, batch.num_rows, PAIRS_AT_ONCE):
                part = batch.slice(first, PAIRS_AT_ONCE)
                for a, b in zip(part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True):
                    a, b = _unpacked(a), _unpacked(b)
                    shared = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append((100 + percent) * shared >= percent * (len(a) + len(b)))
            yield batch.select([0, 1, 2, 3]).filter(pa.array(keep, pa.bool_()))

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, text): rows alike in doc_id and text have one key."""
    text, doc = F.col("text").cast("string"), F.col("doc_id").cast("long")
    return docs.select(doc.alias("doc_id"), F.xxhash64(doc, doc.isNull(), text, text.isNull()).alias("row_key"), text.alias("text"))


def profile(docs: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """Rows (doc_id, row_key, n, key, parity words) of all documents, and the column counts."""
    schema = "doc_id long, row_key long, n long, key long, " + ", ".join(f"{w} long" for w in _WORDS) + ", part int, counts binary"
    table = cut(_keyed(docs).mapInArrow(_profiles(n), schema), "profiles")
    return table.filter("part IS NULL").drop("part", "counts"), _column_counts(table)


def _entries(docs: DataFrame, counts: np.ndarray, n: int, percent: int) -> DataFrame:
    """(col, key, n, pos): prefix columns that several sets hold, one row per set that holds them."""
    held = docs.sparkSession.sparkContext.broadcast(counts)
    # Dealt by column once: the columns that several sets hold and their entries come from one exchange, as long as both
    # sides of the join ask for the same fields of it.
    entries = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(
        _prefixes(n, percent, held), "col long, key long, n int, pos int").repartition("col")
    shared = entries.groupBy("col").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.max("n").alias("n"), F.max("pos").alias("pos"))
    shared = shared.filter("lo != hi AND n > pos").select("col")
    # Copies of a text give equal entries; one of each is left.
    return cut(entries.join(shared, "col").groupBy("col", "key").agg(F.min("n").alias("n"), F.min("pos").alias("pos")), "entries")


def _bits(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("key").agg(*(F.min(w).alias(w) for w in _WORDS))


def _band(percent: int) -> F.Column:
    """Linked sets are in one band of sizes or in neighbouring ones."""
    width = math.log(100 / percent) * 1.000001 if percent < 100 else 1.0
    return F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("int")


def _reaches(overlap: F.Column, percent: int) -> F.Column:
    return F.lit(100 + percent) * overlap >= F.lit(percent) * (F.col("n_a") + F.col("n_b"))


def _parities_allow(percent: int) -> F.Column:
    apart = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in _WORDS[1:]),
                F.bit_count(F.col("p0_a").bitwiseXOR(F.col("p0_b"))))
    return F.lit(100 + percent) * (F.col("n_a") + F.col("n_b") - apart) >= F.lit(2 * percent) * (F.col("n_a") + F.col("n_b"))


def _with_prev(entries: DataFrame) -> DataFrame:
    return entries.withColumn("prev", F.lag("col").over(Window.partitionBy("key").orderBy("pos")))


def _as_smaller(percent: int) -> F.Column:
    """Entries by which a set meets one of its own size or more."""
    return F.col("pos") < F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / F.lit(100 + percent)) + 1


def _named(rows: DataFrame, on: list[str], side: str) -> DataFrame:
    return rows.select(*on, *(F.col(c).alias(f"{c}_{side}") for c in rows.columns if c not in on))


def _product(left: DataFrame, right: DataFrame, on: list[str], percent: int) -> DataFrame:
    """Pairs of entries in one block that the bounds leave, each pair at one of its columns."""
    keep = (
        ((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("key_a") < F.col("key_b"))))
        & (F.lit(100) * F.col("n_a") >= F.lit(percent) * F.col("n_b"))
        & _reaches(F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")), percent)
        & _parities_allow(percent))
    # Where both have the same column just before, the pair is found there already.
    found_before = F.coalesce(F.col("prev_a") == F.col("prev_b"), F.lit(False))
    return _named(left, on, "a").join(_named(right, on, "b"), on).filter(keep & ~found_before)


def candidates(docs: DataFrame, profiles: DataFrame, counts: np.ndarray, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) of set keys that the size-derived bounds do not rule out; a has the smaller set."""
    entries = _entries(docs, counts, n, percent).join(_bits(profiles), "key").withColumn("band", _band(percent))
    entries = _with_prev(entries)
    left = entries.filter(_as_smaller(percent)).withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    product = _product(left, entries, ["col", "band"], percent)
    return product.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).distinct()


def _cells(docs: DataFrame, profiles: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(key, cells, members) of the sets ``wanted`` (key): all their columns, and the rows that have each set."""
    # One document of each wanted set; the key is computed again from its text, so a doc_id may be shared or null.
    holders = profiles.join(wanted, "key").groupBy("key").agg(F.min("row_key").alias("row_key"), F.count(F.lit(1)).alias("members"))
    texts = _keyed(docs).select("row_key", "text").join(holders.drop("key").dropDuplicates(["row_key"]), "row_key").select("text", "members")
    return texts.mapInArrow(_sets(n), "key long, cells binary, members long").groupBy("key").agg(
        F.first("cells").alias("cells"), F.first("members").alias("members"))


def _verified(pairs: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    both = pairs.join(cells.toDF("a", "ca", "in_a"), "a").join(cells.toDF("b", "cb", "in_b"), "b")
    return both.select("a", "b", "in_a", "in_b", "ca", "cb").mapInArrow(
        _linked(percent), "a long, b long, in_a long, in_b long")


def links(docs: DataFrame, profiles: DataFrame, counts: np.ndarray, n: int, percent: int) -> DataFrame:
    """(a, b, in_a, in_b): set keys of different sets whose Jaccard similarity is ``percent`` or more, each pair once, and
    the rows that have each set."""
    pairs = cut(candidates(docs, profiles, counts, n, percent), "pairs")
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    return cut(_verified(pairs, _cells(docs, profiles, wanted, n), percent), "jaccard-links")


def _in_components(entries: DataFrame, member: DataFrame | None) -> DataFrame:
    if member is None:
        return entries.withColumn("comp", F.col("key"))
    known = member.select(F.col("node").alias("key"), F.col("component").alias("comp"))
    return entries.join(known, "key", "left").withColumn("comp", F.coalesce("comp", "key"))


def _hub_pairs(entries: DataFrame, bits: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b) of one set of each block with all sets of the block that are not in its component yet.

    As many rows as entries at most, whatever a block's size. The first ``turn`` picks the set in which the block's column
    has the fewest rarer ones before it: of near copies that with the fewest changes, which most others are linked with.
    Later ones pick other sets.
    """
    picked = F.struct(*([] if turn else ["pos"]), F.xxhash64("key", F.lit(turn)))
    rows = entries.withColumn("block", F.explode(F.array(_band(percent), _band(percent) + 1)))
    hubs = rows.groupBy("col", "block").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"),
        F.min_by(F.struct("key", "n", "pos", "comp"), picked).alias("hub"))
    hubs = hubs.filter("lo != hi").select("col", "block", *(F.col(f"hub.{c}").alias(f"{c}_b") for c in ("key", "n", "pos", "comp")))
    rows = rows.select("col", "block", *(F.col(c).alias(f"{c}_a") for c in ("key", "n", "pos", "comp")))
    met = rows.join(hubs, ["col", "block"]).filter(
        (F.col("comp_a") != F.col("comp_b"))
        & (F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b"))
        & _reaches(F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")), percent))
    met = met.groupBy(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).agg(
        F.min(F.least("n_a", "n_b")).alias("n_a"), F.min(F.greatest("n_a", "n_b")).alias("n_b"))
    for side in ("a", "b"):
        met = met.join(bits.select(F.col("key").alias(side), *(F.col(w).alias(f"{w}_{side}") for w in _WORDS)), side)
    return met.filter(_parities_allow(percent)).select("a", "b")


def _pairs_across(entries: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) that the bounds leave and that are of two components.

    In each block the sets of its largest component meet only sets of others, so a block that one component fills
    costs nothing and one that it nearly fills costs its size times the sets beside it.
    """
    rows = _with_prev(entries).withColumn("band", _band(percent)).withColumn("block", F.explode(F.array("band", F.col("band") + 1)))
    sizes = rows.groupBy("col", "block", "comp").agg(F.count(F.lit(1)).alias("sets"))
    blocks = sizes.groupBy("col", "block").agg(F.max_by("comp", F.struct("sets", "comp")).alias("largest"), F.count(F.lit(1)).alias("comps"))
    rows = rows.join(blocks.filter("comps > 1").drop("comps"), ["col", "block"]).join(bits, "key")
    rows = cut(rows.withColumn("within", F.col("comp") == F.col("largest")).drop("largest"), "across")
    left = rows.filter(_as_smaller(percent)).drop("band").withColumn(
        "within", F.explode(F.when(F.col("within"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    product = _product(left, rows.filter("block = band").drop("band"), ["col", "block", "within"], percent)
    return product.filter("comp_a != comp_b").select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).distinct()


def connected(docs: DataFrame, profiles: DataFrame, counts: np.ndarray, n: int, percent: int) -> DataFrame:
    """(node, component): set keys that are linked with others, by what ``links`` would give, but without making every
    link inside a component.

    First each block's columns are multiplied with one of its rows, ``HUB_ROUNDS`` times; the components of the links so
    found take in most of a group of near copies. Then the product is made of all pairs across components, so no link
    between two components is missed.
    """
    entries, bits = _entries(docs, counts, n, percent), _bits(profiles)
    cells = cut(_cells(docs, profiles, entries.select("key").distinct(), n), "cells")
    member = None
    for turn in range(HUB_ROUNDS + 1):
        rows = _in_components(entries, member)
        pairs = _hub_pairs(rows, bits, percent, turn) if turn < HUB_ROUNDS else _pairs_across(rows, bits, percent)
        found = _verified(cut(pairs, "pairs"), cells, percent).select("a", "b")
        if member is not None:
            found = found.union(member.select(F.col("node").alias("a"), F.col("component").alias("b")))
        member = components(found)
    return member


def _component_ids(rows: DataFrame, member: DataFrame) -> DataFrame:
    """(key, component_id, members) of all sets that are not empty."""
    classes = rows.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("members"))
    whole = member.join(classes.select(F.col("key").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("whole"))
    member = member.join(whole, "component").select(F.col("node").alias("key"), "whole")
    return classes.join(member, "key", "left").select("key", F.coalesce("whole", "least").alias("component_id"), "members")


def jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Documents joined by the Jaccard similarity of their ``n``-word shingle sets: ``100 * shared >= percent * union``.

    ``docs`` needs doc_id and text; other columns are ignored, whatever their names. One row per row of ``docs``:
    doc_id, n_shingles (set size), component_id (smallest doc_id reachable over links, itself included), n_links (rows it
    is linked with), row_key (equal for rows alike in doc_id and text).

    Null, empty and blank texts have empty sets and are linked with nothing: n_shingles 0, component_id the own doc_id.
    Rows with equal sets are linked, so repeated rows are. A null doc_id never names a component; a component without any
    other has component_id null. An empty table gives no rows. Texts may be of any length.
    """
    rows, counts = profile(docs, n)
    found = links(docs, rows, counts, n, percent)
    beside = found.select(F.col("a").alias("key"), F.col("in_b").alias("n")).union(found.select("b", "in_a")).groupBy("key").agg(
        F.sum("n").alias("others"))
    classes = _component_ids(rows, components(found)).join(beside, "key", "left").select(
        "key", "component_id", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    filled = rows.filter("n > 0").select("doc_id", "row_key", "n", "key").join(classes, "key").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links", "row_key")
    return filled.union(rows.filter("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), "row_key"))


def groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, component_id, row_key) of the rows that have words, as ``jaccard_join`` gives them, from ``connected``."""
    rows, counts = profile(docs, n)
    classes = _component_ids(rows, connected(docs, rows, counts, n, percent))
    return rows.filter("n > 0").select("doc_id", "row_key", "key").join(classes, "key").select("doc_id", "component_id", "row_key")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of linked ones stays, that with the smallest doc_id (null last); columns are kept.

    Rows of a group with a null doc_id only are told apart by their row key. Documents without words are in no group, so
    all of them stay, repeated ones too. Of rows alike in doc_id and text one stays. An empty table gives no rows; other
    columns may have any name.
    """
    grouped = groups(docs, n, percent)
    alone = grouped.filter("component_id IS NOT NULL").filter("doc_id = component_id").groupBy("component_id").agg(
        F.min("row_key").alias("row_key")).select("row_key")
    unnamed = grouped.filter("component_id IS NULL").select("row_key")
    text, doc = F.col("text").cast("string"), F.col("doc_id").cast("long")
    key = free("__row_key", docs.columns)
    keyed = docs.withColumn(key, F.xxhash64(doc, doc.isNull(), text, text.isNull()))
    words = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    stay = alone.union(unnamed).distinct().select(F.col("row_key").alias(key))
    kept = keyed.filter(words).join(stay, key).dropDuplicates([key])
    return kept.select(*docs.columns).union(docs.filter(~words))
