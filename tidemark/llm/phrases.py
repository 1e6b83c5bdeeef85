"""Phrases whose words stand together oftener than their parts suggest, counted in suffix subtrees by word prefix.

The suffixes of a text, at its words, form a tree; only its first four levels are wanted. The tree is partitioned vertically:
words are gathered into cells, cells into groups whose suffixes fit a memory budget, and the suffixes of a cell too large for
it are told apart by their following words as well. Each group's subtree is built by a task of its own from the sorted
suffixes, and the count of a node is the total of the leaves below it. Levels are read as far as they can matter: words
first, then pairs of frequent words, then up to four words whose neighbours are frequent pairs; whatever holds an infrequent
part is infrequent itself.

Texts are lower-cased (A-Z only), cut into pieces at ``[.,;:!?]`` and line ends, and pieces into words at spaces and tabs.
Words are numbered by a 64-bit hash of language and word. A null text has no words, a null lang is ``und``; equal phrases of
two languages are two phrases; repeated rows count again; an empty table gives no rows. Only text and lang are read, so other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shingles import mix
from tidemark.session import cut

#: Fewest occurrences of a phrase, most words, percentage at which a longer phrase replaces its parts, phrases reported a language.
LEAST, DEPTH, PERCENT, TOP, SCALE = 30, 4, 80, 2000, 2_000_000
#: Suffixes of one group, cells that words are gathered into, bytes of text counted together, bytes hashed at once.
GROUP_SUFFIXES, CELLS, PACK, CHUNK = 1 << 20, 1 << 16, 1 << 23, 1 << 18
#: Bytes of text whose words one task counts; rows unpacked at once.
WORDS_BYTES, ROWS = 1 << 26, 512
#: Bits of the filters sent to every task; a fuller filter lets more through and changes no result.
FILTER_BITS = 1 << 27

_BASE = 0x9E3779B97F4A7C15
_FOLD = np.uint64(0x9FB21C651E98DF25)
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[0x41:0x5B] += np.uint64(32)
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\n\v\f\r")] = True
_SPACE = _BREAK.copy()
_SPACE[list(b" \t")] = True

_WORDS = "key int, lang string, ids binary, n binary, sizes binary, words binary"
_FOUND = "id long, lang string, word string, f long"
_PACKED = "key int, ids binary, columns binary, n binary"


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse, grown when a word is longer than a chunk."""

    up, down = _powers(_BASE, CHUNK + 1), _powers(pow(_BASE, -1, 1 << 64), CHUNK + 1)

    @classmethod
    def of(cls, count: int) -> tuple[np.ndarray, np.ndarray]:
        if count > len(cls.up):
            cls.up, cls.down = _powers(_BASE, count), _powers(pow(_BASE, -1, 1 << 64), count)
        return cls.up, cls.down


def _chunks(texts: list[bytes]) -> Iterator[tuple[bytes, list[int], int]]:
    """(bytes, lengths of the texts in it, first text); a long text comes in several, cut between words."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < CHUNK):
            size += len(texts[end]) + 1
            end += 1
        if end == at + 1 and len(texts[at]) > CHUNK:
            data, low = texts[at], 0
            while low < len(data):
                high = min(low + CHUNK, len(data))
                while high < len(data) and not _SPACE[data[high]]:
                    high += 1
                yield data[low:high], [high - low], at
                low = high
        else:
            yield b"\n".join(texts[at:end]), [len(t) + 1 for t in texts[at:end]], at
        at = end


def _words_of(texts: list[bytes], salts: np.ndarray) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, number, piece, text, start, end) of the words of some texts, chunk by chunk; pieces are numbered on."""
    pieces, before = 0, -1
    for data, sizes, first in _chunks(texts):
        raw = np.frombuffer(data, dtype=np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[raw], [True])).view(np.int8)))
        start, end = edge[::2], edge[1::2]
        up, down = _Powers.of(len(raw) + 1)
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_LOWER[raw] * up[: len(raw)], out=total[1:])
        text = first + np.searchsorted(np.cumsum(sizes), start, side="right")
        number = mix(mix((total[end] - total[start]) * down[start]) + salts[text])
        number[number == 0] = 1
        breaks = np.cumsum(_BREAK[raw])
        # A chunk that goes on with the same long text goes on with its piece.
        pieces += first != before
        yield data, number, pieces + (breaks[start] if len(start) else start), text, start, end
        pieces += int(breaks[-1]) if len(breaks) else 0
        before = first


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, list[bytes]]]:
    """(lang, salt, text) of enough rows to count together."""
    langs, salts, texts, size = [], [], [], 0
    parts = (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS))
    for part in parts:
        for lang, salt, text in zip(*(part.column(i).to_pylist() for i in (0, 1)), part.column(2).cast(pa.binary()).to_pylist(), strict=True):
            langs.append(lang)
            salts.append(salt)
            texts.append(text or b"")
            size += len(texts[-1])
            if size >= PACK:
                yield langs, np.array(salts, np.int64).view(np.uint64), texts
                langs, salts, texts, size = [], [], [], 0
    if texts:
        yield langs, np.array(salts, np.int64).view(np.uint64), texts


def _planes(values: np.ndarray) -> bytes:
    """The four lowest bytes of numbers, plane by plane, so that equal high bytes pack well."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _count_words(parts: int):
    """A mapper from texts to the counts of their words, packed by part and language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, salts, texts in _filled(batches):
            names, lang_of = np.unique(langs, return_inverse=True)
            numbers, counts, places, words = [], [], [], []
            for data, number, _, text, start, end in _words_of(texts, salts):
                own, first, n = np.unique(number, return_index=True, return_counts=True)
                numbers.append(own)
                counts.append(n)
                places.append(lang_of[text[first]])
                words += [data[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
            number = np.concatenate(numbers) if numbers else np.zeros(0, np.uint64)
            out: dict[str, list] = {name.split()[0]: [] for name in _WORDS.split(", ")}
            if len(number):
                own, first, of = np.unique(number, return_index=True, return_inverse=True)
                n = np.zeros(len(own), np.int64)
                np.add.at(n, of, np.concatenate(counts))
                lang = np.concatenate(places)[first]
                part = (own % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((lang, part))
                edge = np.flatnonzero(np.diff(part[order] * len(names) + lang[order]))
                for picked in np.split(order, edge + 1):
                    held = [words[i].lower() for i in first[picked].tolist()]
                    out["key"].append(int(part[picked[0]]))
                    out["lang"].append(str(names[lang[picked[0]]]))
                    out["ids"].append(own[picked].tobytes())
                    out["n"].append(_planes(n[picked]))
                    out["sizes"].append(_planes(np.array([len(w) for w in held])))
                    out["words"].append(b"".join(held))
            kinds = {"key": pa.int32(), "lang": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()], names=list(out))

    return count


def _frequent_words(least: int):
    """A reducer of a part's words to those frequent, and a row without number for the occurrences of each language."""

    def reduce(table: pa.Table) -> pa.Table:
        langs, data = table["lang"].to_pylist(), table["words"].to_pylist()
        ids = [np.frombuffer(x, np.uint64) for x in table["ids"].to_pylist()]
        counts = [_unplaned(x).astype(np.int64) for x in table["n"].to_pylist()]
        sizes = [_unplaned(x).astype(np.int64) for x in table["sizes"].to_pylist()]
        row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        place = np.concatenate([np.cumsum(s) - s for s in sizes])
        size, n = np.concatenate(sizes), np.concatenate(counts)
        own, first, of = np.unique(np.concatenate(ids), return_index=True, return_inverse=True)
        f = np.zeros(len(own), np.int64)
        np.add.at(f, of, n)
        kept = f >= least
        totals: dict[str, int] = {}
        for lang, x in zip(langs, counts, strict=True):
            totals[lang] = totals.get(lang, 0) + int(x.sum())
        at = first[kept]
        words = [data[r][p : p + s].decode("utf-8", "replace") for r, p, s in zip(row[at].tolist(), place[at].tolist(), size[at].tolist(), strict=True)]
        none = [None] * len(totals)
        return pa.table({
            "id": pa.array([*own[kept].view(np.int64).tolist(), *none], pa.int64()), "lang": [*[langs[r] for r in row[at].tolist()], *totals],
            "word": pa.array([*words, *none], pa.string()), "f": pa.array([*f[kept].tolist(), *totals.values()], pa.int64())})

    return reduce


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _FOLD + b)


def _in_filter(bits: np.ndarray, number: np.ndarray) -> np.ndarray:
    slot = number % np.uint64(FILTER_BITS)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _totals(columns: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of some columns, in order, with the total of ``n`` (rows, without it) of each."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    if not len(order):
        return columns, np.zeros(0, np.int64)
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    first = np.flatnonzero(new)
    total = np.diff(np.append(first, len(order))) if n is None else np.add.reduceat(n[order], first)
    return [c[first] for c in columns], total


class _Partition:
    """Which group a suffix belongs to: cells in order until the budget is full; a larger cell has groups of its own."""

    def __init__(self, loads: dict[int, int]):
        self.first, self.groups = np.zeros(CELLS, np.int32), np.ones(CELLS, np.int32)
        group, filled = 0, 0
        for cell in range(CELLS):
            load = loads.get(cell, 0)
            if filled and filled + load > GROUP_SUFFIXES:
                group, filled = group + 1, 0
            self.first[cell] = group
            filled += load
            if load > GROUP_SUFFIXES:
                self.groups[cell] = -(-load // GROUP_SUFFIXES)
                group, filled = group + int(self.groups[cell]), 0

    def of(self, words: list[np.ndarray]) -> np.ndarray:
        """Groups of suffixes that begin with some words; a prefix of that many words lies in one group."""
        cell = (words[0] % np.uint64(CELLS)).astype(np.int64)
        whole = words[0]
        for w in words[1:]:
            whole = _pair(whole, w)
        return self.first[cell] + (mix(whole) % self.groups[cell].astype(np.uint64)).astype(np.int32)


def _pack_suffixes(partition: _Partition, suffixes: Callable) -> Callable:
    """A mapper from texts to the suffixes that ``suffixes`` finds in their words, counted and packed by group."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, salts, texts in _filled(batches):
            found = [(number, piece) for _, number, piece, *_ in _words_of(texts, salts)]
            number, piece = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.uint64) for i in (0, 1))
            columns, n = _totals(suffixes(number, piece))
            group = partition.of(columns[:3])
            order = np.argsort(group, kind="stable")
            out: dict[str, list] = {name.split()[0]: [] for name in _PACKED.split(", ")}
            for picked in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else []:
                ids, codes = np.unique(np.concatenate([c[picked] for c in columns]), return_inverse=True)
                out["key"].append(int(group[picked[0]]))
                out["ids"].append(ids.tobytes())
                out["columns"].append(_planes(codes))
                out["n"].append(_planes(n[picked]))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if k == "key" else pa.binary()) for k, v in out.items()], names=list(out))

    return pack


def _subtree(depths: tuple[int, ...], least: int):
    """A reducer of a group's suffixes to the frequent nodes of its subtree at some depths: (p, f)."""

    def build(table: pa.Table) -> pa.Table:
        blobs = list(zip(*(table[c].to_pylist() for c in ("ids", "columns", "n")), strict=True))
        width = depths[-1]
        unpacked = [np.frombuffer(i, np.uint64)[_unplaned(c)].reshape(width, -1) for i, c, _ in blobs]
        leaves, n = _totals([np.concatenate([u[k] for u in unpacked]) for k in range(width)],
                            np.concatenate([_unplaned(x).astype(np.int64) for _, _, x in blobs]))
        phrases, counts = [], []
        for depth in depths:
            # Leaves are in order, so a node's are side by side; a suffix that ends before a depth has no node there.
            nodes, f = _totals(leaves[:depth], n)
            kept = (f >= least) & (nodes[-1] != 0)
            phrases += np.stack([c[kept].view(np.int64) for c in nodes], axis=1).tolist()
            counts += f[kept].tolist()
        return pa.table({"p": pa.array(phrases, pa.list_(pa.int64())), "f": pa.array(counts, pa.int64())})

    return build


def _pairs(known: Callable[[], np.ndarray]):
    """Suffixes of two words, both in the filter of frequent words."""

    def find(number: np.ndarray, piece: np.ndarray) -> list[np.ndarray]:
        seen = _in_filter(known(), number)
        at = np.flatnonzero(seen[:-1] & seen[1:] & (piece[1:] == piece[:-1]))
        return [number[at], number[at + 1]]

    return find


def _longer(known: Callable[[], np.ndarray]):
    """Suffixes of three or four words whose neighbours are in the filter of frequent pairs; 0 for a missing fourth."""

    def find(number: np.ndarray, piece: np.ndarray) -> list[np.ndarray]:
        if len(number) < 3:
            return [np.zeros(0, np.uint64)] * DEPTH
        joined = (piece[1:] == piece[:-1]) & _in_filter(known(), _pair(number[:-1], number[1:]))
        at = np.flatnonzero(joined[:-1] & joined[1:])
        fourth = np.zeros(len(at), np.uint64)
        more = at + 2 < len(joined)
        more[more] = joined[at[more] + 2]
        fourth[more] = number[at[more] + 3]
        return [number[at], number[at + 1], number[at + 2], fourth]

    return find


def _filter_of(numbers: DataFrame) -> np.ndarray:
    """The filter of some 64-bit numbers (column ``number``), made where they are: at most FILTER_BITS bits come here."""
    # Unsigned remainders of signed numbers, as a power of two allows.
    slot = F.col("number").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = numbers.select(F.shiftright(slot, 6).alias("at"), F.expr("shiftleft(1L, CAST(number & 63 AS INT))").alias("bit"))
    found = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bits


def _loads(counts: DataFrame) -> dict[int, int]:
    """Suffixes of each cell, by the counts ``f`` of prefixes ``p``; CELLS rows at most."""
    cell = F.element_at("p", 1).bitwiseAND(F.lit(CELLS - 1)).alias("cell")
    return {r.cell: int(r.load) for r in counts.groupBy(cell).agg(F.sum(F.col("f").cast("decimal(38,0)")).alias("load")).collect()}


def _pair_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = batch.column(0).flatten().to_numpy().view(np.uint64)
        number = _pair(flat[::2], flat[1::2]).view(np.int64) if len(flat) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(number)], names=["number"])


def counted(df: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): words (id, lang, word, f) and, with null id, the occurrences of each language; phrases (p, f) of 1 to DEPTH ids."""
    spark = df.sparkSession
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    rows = df.select(lang.alias("lang"), F.xxhash64(lang).alias("salt"), "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    words = rows.mapInArrow(_count_words(max(1, -(-size // WORDS_BYTES))), _WORDS)
    words = cut(words.groupBy("key").applyInArrow(_frequent_words(least), _FOUND), "words")
    frequent = words.filter("id IS NOT NULL")
    single = frequent.select(F.array("id").alias("p"), "f")
    known = spark.sparkContext.broadcast(_filter_of(frequent.select(F.col("id").alias("number"))))
    partition = _Partition(_loads(single))
    suffixes = rows.mapInArrow(_pack_suffixes(partition, _pairs(lambda: known.value)), _PACKED)
    pairs = cut(suffixes.groupBy("key").applyInArrow(_subtree((2,), least), "p array<long>, f long"), "pairs")
    known.unpersist()
    joined = spark.sparkContext.broadcast(_filter_of(pairs.select("p").mapInArrow(_pair_numbers, "number long")))
    partition = _Partition(_loads(pairs))
    suffixes = rows.mapInArrow(_pack_suffixes(partition, _longer(lambda: joined.value)), _PACKED)
    longer = cut(suffixes.groupBy("key").applyInArrow(_subtree((3, DEPTH), least), "p array<long>, f long"), "longer")
    joined.unpersist()
    return words, single.unionByName(pairs).unionByName(longer)


def collocations(df: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``df`` (text, lang) -> each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    a is the phrase's count, l and r those of its parts at the cut with the lowest score (the first such), score
    floor(SCALE * a / (l + r)), n the word occurrences of the language. A phrase inside a longer one that occurs PERCENT % as
    often or more is left out. Order: score and a descending, then phrase by its bytes. Odd cases: see the module's docstring.
    """
    words, counts = counted(df, least)
    candidates = counts.filter(F.size("p") > 1).withColumnRenamed("f", "a")
    # Parts of a frequent phrase are frequent, so their counts are here.
    cuts = candidates.select("p", "a", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cuts = cuts.select("p", "a", "k", F.expr("slice(p, 1, k)").alias("head"), F.expr("slice(p, k + 1, size(p) - k)").alias("tail"))
    cuts = cuts.join(counts.select(F.col("p").alias("head"), F.col("f").alias("l")), "head")
    cuts = cuts.join(counts.select(F.col("p").alias("tail"), F.col("f").alias("r")), "tail")
    score = F.expr(f"CAST({SCALE} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + r)")
    scored = cuts.withColumn("score", score).groupBy("p", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inner = candidates.filter(F.size("p") > 2).select("a", F.explode(F.expr(
        "flatten(transform(sequence(2, size(p) - 1), n -> transform(sequence(1, size(p) - n + 1), i -> slice(p, i, n))))")).alias("p"))
    covered = inner.groupBy("p").agg(F.max("a").alias("longer"))
    left = scored.join(covered, "p", "left").filter(F.expr(f"longer IS NULL OR 100 * longer < {PERCENT} * a"))
    named = words.filter("id IS NOT NULL").select("id", "lang", "word")
    left = left.select("p", "a", "best.l", "best.r", "best.score", F.element_at("p", 1).alias("id")).join(named.drop("word"), "id").drop("id")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = left.withColumn("rank", F.rank().over(best)).filter(F.col("rank") <= top).drop("rank")
    spelled = first.select("lang", "p", "a", "l", "r", "score", F.posexplode("p").alias("at", "id")).join(named.drop("lang"), "id")
    spelled = spelled.groupBy("lang", "p", "a", "l", "r", "score").agg(F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelled.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    total = words.filter("id IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
