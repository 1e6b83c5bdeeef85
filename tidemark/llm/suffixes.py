"""Byte strings that occur again, found by suffix arrays over the repeated parts of a corpus.

Every string of ``LENGTH`` bytes has an anchor, the smallest hash of its ``GRAM``-byte grams, so equal strings have equal
anchors. Neighbouring strings with one anchor form a run. Runs meet by anchor; a run whose bytes occur earlier is repeated
whole and is not looked at again, the earliest copy of each distinct run goes on if its anchor occurs elsewhere. Those runs
are laid end to end, a bounded number of bytes at a time, and their suffixes are sorted in two stages: those smaller than
their successors directly, the others by scanning the buckets of first bytes in order. Adjacent common prefixes then say
which strings are equal, and all but the earliest of each are removed.

Positions are ordered by (doc_id, start). Rows are told apart by doc_id and a 64-bit hash of the text: rows alike in both
have the same result, and strings at the same doc_id and start are not earlier than each other. A null doc_id counts as the
smallest number, a null text as empty; texts below ``LENGTH`` bytes lose nothing; an empty table gives no rows. Only the
columns doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shingles import mix
from tidemark.session import cut

LENGTH, GRAM = 100, 32
#: Bytes of text whose runs one task sorts; bytes hashed at once; bytes whose runs are packed together.
PART_BYTES, CHUNK, PACK = 1 << 24, 1 << 18, 1 << 23
#: Bytes whose suffixes are sorted at once; rows unpacked at once.
SORT_BYTES, ROWS = 1 << 21, 512
#: Strings of a run at most; a longer one is cut, which changes no result.
MOST_IN_RUN = 256
#: An anchor of more runs than this is hot: its strings are dealt one by one. Hot anchors sent to every task, and the share
#: of documents that their counts are estimated from (any estimate gives the same rows).
HOT_RUNS, MOST_HOT, SAMPLE = 250_000, 1 << 20, 16

_FIRST = -(1 << 63)
_BASE = 0x9E3779B97F4A7C15
_ANCHOR, _STRING, _SINGLE = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)
_LOW = np.uint64((1 << 40) - 1)
_SYMBOL = np.arange(1, 257, dtype=np.uint64)

_PACKED = "key int, doc binary, tag binary, row binary, start binary, n binary, anchor binary, digest binary"
_FOUND = "doc long, tag long, start int, n int, key int, anchor long"
_CARRIED = "key int, doc binary, tag binary, start binary, n binary, anchor binary, data binary"
_SPANS = "doc long, tag long, start int, n int"


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, CHUNK + LENGTH + 1)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), CHUNK + LENGTH + 1)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def _runs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start in raw, strings, twice, anchor, digest) of the runs of texts that lie at [starts, ends) of ``raw``.

    Only a run that holds its anchor's gram twice can hold a string twice.
    """
    if len(raw) < LENGTH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),) + (np.zeros(0, np.uint64),) * 2
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_SYMBOL[raw] * _UP[: len(raw)], out=total[1:])
    grams = mix((total[GRAM:] - total[:-GRAM]) * _DOWN[: len(raw) - GRAM + 1])
    width = LENGTH - GRAM + 1
    least = _sliding_least(grams, width)
    edge = np.ones(len(least), dtype=bool)
    edge[1:] = least[1:] != least[:-1]
    edge[starts[starts < len(least)]] = True
    at = np.flatnonzero(edge)
    until = np.append(at[1:], len(least))
    text = np.searchsorted(starts, at, side="right") - 1
    until = np.minimum(until, ends[text] - LENGTH + 1)
    kept = until > at
    at, until, text = at[kept], until[kept], text[kept]
    anchor = mix(least[at] ^ _ANCHOR)
    # Grams that equal the anchor: those of the first string, then those that come in at the end of each further one.
    seen = np.zeros(len(at), dtype=np.int64)
    for j in range(width):
        seen += grams[at + j] == least[at]
    entering = np.cumsum(grams[width - 1 :] == least)
    twice = seen + entering[until - 1] - entering[at] > 1
    single = np.zeros(len(at), dtype=bool)
    if len(hot):
        single = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor
    width = np.where(single, 1, MOST_IN_RUN)
    pieces = -(-(until - at) // width)
    if len(pieces) and pieces.max() > 1:
        of = np.repeat(np.arange(len(at)), pieces)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = at[of] + nth * width[of]
        until, text, anchor, single, width, twice = until[of], text[of], anchor[of], single[of], width[of], twice[of]
        until = np.minimum(until, at + width)
    n = until - at
    digest = mix(((total[until + LENGTH - 1] - total[at]) * _DOWN[at]) ^ _STRING) + n.astype(np.uint64)
    anchor[single] = mix(digest[single] ^ _SINGLE)
    return text, at, n, twice, anchor, digest


def _chunks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(raw, first row, starts, ends, offset of each piece in its text): whole texts together, long ones in overlapping pieces."""
    held: list[bytes] = []
    size = first = 0

    def packed(parts: list[bytes], row: int, shift: int) -> tuple:
        ends = np.cumsum([len(p) for p in parts])
        rows = np.arange(row, row + len(parts))
        return np.frombuffer(b"".join(parts), np.uint8), rows, ends - [len(p) for p in parts], ends, np.full(len(parts), shift)

    for row, text in enumerate(texts):
        if held and size + len(text) > CHUNK:
            yield packed(held, first, 0)
            held, size = [], 0
        if len(text) > CHUNK:
            for at in range(0, len(text) - LENGTH + 1, CHUNK):
                yield packed([text[at : at + CHUNK + LENGTH - 1]], row, at)
            continue
        if not held:
            first = row
        held.append(text)
        size += len(text)
    if held:
        yield packed(held, first, 0)


def _runs_of(texts: list[bytes], hot: np.ndarray) -> list[np.ndarray]:
    """Row, start, strings, whether one may occur twice, anchor and digest of all runs of some texts."""
    found = []
    for raw, rows, starts, ends, shift in _chunks(texts):
        # An empty text shares its start with the next one, which must win.
        full = ends > starts
        if not full.any():
            continue
        text, at, *rest = _runs(raw, starts[full], ends[full], hot)
        found.append((rows[full][text], at - starts[full][text] + shift[full][text], *rest))
    kinds = (np.int64, np.int64, np.int64, bool, np.uint64, np.uint64)
    return [np.concatenate([f[i] for f in found]) if found else np.zeros(0, k) for i, k in enumerate(kinds)]


def _bytes_of(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(doc, tag, text) of enough rows to pack together."""
    docs, tags, texts, size = [], [], [], 0
    parts = (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS))
    for part in parts:
        for doc, tag, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), _bytes_of(part.column(2)), strict=True):
            docs.append(doc)
            tags.append(tag)
            texts.append(text)
            size += len(text)
            if size >= PACK:
                yield np.array(docs, np.int64), np.array(tags, np.int64), texts
                docs, tags, texts, size = [], [], [], 0
    if texts:
        yield np.array(docs, np.int64), np.array(tags, np.int64), texts


def _planes(values: np.ndarray, width: int) -> bytes:
    """The lowest bytes of numbers, plane by plane, so that equal high bytes pack well."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplaned(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def _copies(values: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by values and position, whether a row in that order has an equal one at an earlier position)."""
    order = np.lexsort((start, doc, *values))
    new = np.ones(len(order), dtype=bool)
    for v in values:
        v = v[order]
        new[1:] &= v[1:] == v[:-1]
    new[1:] = ~new[1:]
    new[:1] = True
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    ahead = order[head]
    return order, (doc[order] != doc[ahead]) | (start[order] != start[ahead])


def _pack_runs(parts: int, hot: np.ndarray):
    """A mapper from texts to their runs, packed by part; a run with an earlier copy beside it goes to a part below zero."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, tag, texts in _filled(batches):
            row, start, n, twice, anchor, digest = _runs_of(texts, hot)
            key = (((anchor >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)).astype(np.int64)
            order, again = _copies([digest, anchor], doc[row], start)
            key[order[again]] = -1 - (mix(doc[row[order[again]]].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((row, key))
            bounds = np.flatnonzero(np.diff(key[order], prepend=key[order[0]] - 1)) if len(order) else order
            out: dict[str, list] = {name.split()[0]: [] for name in _PACKED.split(", ")}
            for picked in np.split(order, bounds[1:]) if len(order) else []:
                used, at = np.unique(row[picked], return_inverse=True)
                out["key"].append(int(key[picked[0]]))
                out["doc"].append(doc[used].tobytes())
                out["tag"].append(tag[used].tobytes())
                out["row"].append(_planes(np.diff(at, prepend=0), 4))
                out["start"].append(_planes(start[picked], 4))
                out["n"].append(_planes(2 * n[picked] + twice[picked], 2))
                seen = key[picked[0]] >= 0
                out["anchor"].append(_planes(anchor[picked] & _LOW, 5) if seen else b"")
                out["digest"].append(digest[picked].tobytes() if seen else b"")
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.int32() if k == "key" else pa.binary()) for k, v in out.items()], names=list(out))

    return pack


def _meet(table: pa.Table) -> pa.Table:
    """Runs of one part: those with an earlier copy, and the earliest of each distinct run whose anchor occurs again."""
    key = table["key"][0].as_py()
    cells = {name: table[name].to_pylist() for name in table.column_names}
    row = [np.cumsum(_unplaned(x, 4).astype(np.int64)) for x in cells["row"]]
    doc, tag = (np.concatenate([np.frombuffer(d, np.int64)[r] for d, r in zip(cells[c], row, strict=True)]) for c in ("doc", "tag"))
    start = np.concatenate([_unplaned(x, 4) for x in cells["start"]]).astype(np.int64)
    n = np.concatenate([_unplaned(x, 2) for x in cells["n"]]).astype(np.int64)
    n, twice = n >> 1, n & 1 == 1
    if key < 0:
        again, first, anchor = np.arange(len(doc)), np.zeros(0, np.int64), np.zeros(len(doc), np.int64)
    else:
        anchor = np.concatenate([_unplaned(x, 5) for x in cells["anchor"]])
        digest = np.concatenate([np.frombuffer(x, np.uint64) for x in cells["digest"]])
        order, copied = _copies([digest, anchor], doc, start)
        _, of, count = np.unique(anchor[order], return_inverse=True, return_counts=True)
        again, first = order[copied], order[~copied & ((count[of] > 1) | twice[order])]
        anchor = anchor.astype(np.int64)
    both = np.concatenate([again, first])
    none = np.arange(len(both)) < len(again)
    return pa.table({
        "doc": doc[both], "tag": tag[both], "start": pa.array(start[both], pa.int32()), "n": pa.array(n[both], pa.int32()),
        "key": pa.array(np.full(len(both), key), pa.int32(), mask=none), "anchor": pa.array(anchor[both], pa.int64(), mask=none)})


def _pack_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, tag, text) with the text packed, as it is exchanged."""
    codec = pa.Codec("zstd", 3)
    for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
        texts = _bytes_of(batch.column(2))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary()),
             pa.array([len(t) for t in texts], pa.int64())], names=["doc", "tag", "packed", "size"])


def _unpacked(packed: bytes, size: int, codec: pa.Codec) -> bytes:
    return codec.decompress(packed, size, asbytes=True) if size else b""


def _fields(column: pa.ListArray, row: int) -> dict[str, np.ndarray]:
    value = column[row].values
    if value is None:
        return {}
    return {f.name: value.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(value.type)}


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs asked for, packed by part."""
    codec = pa.Codec("zstd", 3)
    for batch in batches:
        got: dict[int, list[tuple]] = {}
        docs, tags, packed, sizes = (batch.column(i).to_pylist() for i in range(4))
        for row, (doc, tag, data, size) in enumerate(zip(docs, tags, packed, sizes, strict=True)):
            text = _unpacked(data, size, codec)
            f = _fields(batch.column(4), row)
            for start, n, key, anchor in zip(*(f[c].tolist() for c in ("start", "n", "key", "anchor")), strict=True):
                got.setdefault(key, []).append((doc, tag, start, n, anchor, text[start : start + n + LENGTH - 1]))
        names = [name.split()[0] for name in _CARRIED.split(", ")]
        cells: list[list] = [[] for _ in names]
        for key, rows in got.items():
            cells[0].append(key)
            for i in range(5):
                cells[i + 1].append(np.array([r[i] for r in rows], np.int64).tobytes())
            data = b"".join(r[5] for r in rows)
            cells[6].append(codec.compress(data, asbytes=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(cells)], names=names)


def _order_directly(picked: np.ndarray, words: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Positions by the first LENGTH bytes after them, eight at a time; equal strings are not compared further."""
    order = picked[np.argsort(words[picked])]
    new = np.concatenate(([True], words[order[1:]] != words[order[:-1]]))
    group = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    live = np.arange(len(order))
    for depth in range(8, LENGTH, 8):
        # Live: places in the order whose group has several members that are not all the same string.
        g = group[live]
        head = np.concatenate(([True], g[1:] != g[:-1]))[: len(g)]
        first = np.flatnonzero(head)
        of = np.cumsum(head) - 1
        d = digest[order[live]]
        mixed = np.logical_or.reduceat(d != d[first[of]], first) if len(first) else np.zeros(0, bool)
        live = live[mixed[of]] if len(of) else live
        if not len(live):
            break
        g, at = group[live], order[live]
        word = words[at + depth]
        by = np.lexsort((word, g))
        order[live], word = at[by], word[by]
        # Group numbers stay in order: the place at which a group begins.
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (word[1:] != word[:-1])))
        group[live] = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
    return order


def sorted_suffixes(raw: np.ndarray) -> np.ndarray:
    """Positions of ``raw`` ordered by the bytes after them, to a depth of LENGTH at least, in two stages."""
    count = len(raw)
    if not count:
        return np.zeros(0, np.int64)
    padded = np.concatenate((raw, np.zeros(2 * LENGTH + 16, np.uint8)))
    words = np.zeros(count + LENGTH + 8, np.uint64)
    for j in range(8):
        words |= padded[j : j + len(words)].astype(np.uint64) << np.uint64(56 - 8 * j)
    # A suffix is smaller than its successor if the next byte that differs is larger; at the end nothing follows.
    differs = np.append(raw[1:] != raw[:-1], True)
    nearest = np.minimum.accumulate(np.where(differs, np.arange(count), count)[::-1])[::-1]
    rises = np.append(raw[1:] > raw[:-1], False)[nearest]
    direct = np.flatnonzero(rises)
    # One number for LENGTH bytes, by doubling; only equality of it is used.
    digest, done = words[: count + LENGTH].copy(), 8
    while done < LENGTH:
        step = min(done, LENGTH - done)
        shifted = np.zeros_like(digest)
        shifted[:-step] = digest[step:]
        digest = mix(digest ^ _STRING) * _SINGLE + shifted
        done += step
    direct = _order_directly(direct, words, digest) if len(direct) else direct
    symbol = raw[direct]
    ends = np.searchsorted(symbol, np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    pending[raw[-1]].append(np.array([count - 1]))
    out = []
    for c in range(256):
        induced, new = pending[c], pending[c]
        while new:
            before = np.concatenate(new) - 1
            before = before[before >= 0]
            before = before[raw[before] == c]
            new = [before] if len(before) else []
            induced = induced + new
        bucket = np.concatenate([*induced, direct[ends[c] : ends[c + 1]]])
        pending[c] = []
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[raw[before] > c]
        by = np.argsort(raw[before], kind="stable")
        before = before[by]
        last = raw[before]
        cuts = np.flatnonzero(last[1:] != last[:-1]) + 1
        for piece in np.split(before, cuts) if len(before) else []:
            pending[raw[piece[0]]].append(piece)
    return np.concatenate(out).astype(np.int64)


def _same_as_previous(raw: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether the common prefix of a place in the order and the place before it has LENGTH bytes or more."""
    same = np.zeros(len(order), dtype=bool)
    live = np.arange(1, len(order))
    padded = np.concatenate((raw, np.zeros(16, np.uint8)))
    words = np.zeros(len(raw), np.uint64)
    for j in range(8):
        words |= padded[j : j + len(raw)].astype(np.uint64) << np.uint64(56 - 8 * j)
    for depth in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        live = live[words[order[live] + depth] == words[order[live - 1] + depth]]
    same[live] = True
    return same


def _removed(raw: np.ndarray, begin: np.ndarray, n: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For every string of the runs that lie at ``begin`` of ``raw``, in order: whether it occurs at an earlier position."""
    of = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    at = begin[of] + nth
    _, number = np.unique(doc, return_inverse=True)
    position = (number[of].astype(np.int64) << 32) + start[of] + nth
    string = np.full(len(raw), -1)
    string[at] = np.arange(len(at))
    order = sorted_suffixes(raw)
    order = order[string[order] >= 0]
    new = np.flatnonzero(~_same_as_previous(raw, order))
    held = position[string[order]]
    least = np.repeat(np.minimum.reduceat(held, new), np.diff(np.append(new, len(held))))
    out = np.zeros(len(at), dtype=bool)
    out[string[order]] = held > least
    return out


def _sets(anchor: np.ndarray, begin: np.ndarray, n: np.ndarray, raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(run, first string, strings) sets to sort together: whole anchors, or the strings of one large anchor by their hash."""
    size = n + LENGTH - 1
    total = np.cumsum(size)
    heads = np.flatnonzero(np.diff(anchor, prepend=anchor[0] - 1))
    tails = np.append(heads[1:], len(anchor))
    low = 0
    zero = np.zeros(len(n), np.int64)
    for i, (head, tail) in enumerate(zip(heads.tolist(), tails.tolist(), strict=True)):
        before = total[head - 1] if head else 0
        own = total[tail - 1] - before
        if head > low and total[tail - 1] - (total[low - 1] if low else 0) > SORT_BYTES:
            yield np.arange(low, head), zero[low:head], n[low:head]
            low = head
        if own > SORT_BYTES:
            slices = -(-int(own) // SORT_BYTES) * LENGTH // 2
            for run, nth in _by_string(np.arange(head, tail), begin, n, raw, slices):
                yield run, nth, np.ones(len(run), np.int64)
            low = tail
    if low < len(anchor):
        yield np.arange(low, len(anchor)), zero[low:], n[low:]


def _gathered(raw: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``raw`` end to end, and where each begins there."""
    at = np.cumsum(length) - length
    return raw[np.repeat(begin - at, length) + np.arange(int(length.sum()))], at


def _by_string(runs: np.ndarray, begin: np.ndarray, n: np.ndarray, raw: np.ndarray, slices: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(run, string) of each slice of the strings of some runs; equal strings are in one slice."""
    of = np.repeat(runs, n[runs])
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n[runs]) - n[runs], n[runs])
    slots = []
    bounds = np.flatnonzero(np.diff(np.cumsum(n[runs] + LENGTH - 1) // SORT_BYTES)) + 1
    for some in np.split(runs, bounds):
        own, at = _gathered(raw, begin[some], n[some] + LENGTH - 1)
        digest, done = own.astype(np.uint64) + np.uint64(1), 1
        while done < LENGTH:
            step = min(done, LENGTH - done)
            shifted = np.zeros_like(digest)
            shifted[:-step] = digest[step:]
            digest = mix(digest ^ _STRING) * _SINGLE + shifted
            done += step
        place = np.repeat(at - (np.cumsum(n[some]) - n[some]), n[some]) + np.arange(int(n[some].sum()))
        slots.append((mix(digest[place]) % np.uint64(slices)).astype(np.int32))
    slot = np.concatenate(slots)
    order = np.argsort(slot, kind="stable")
    for picked in np.split(order, np.flatnonzero(np.diff(slot[order])) + 1):
        yield of[picked], nth[picked]


def _sort_part(table: pa.Table) -> pa.Table:
    """Stretches of strings that occur at an earlier position, of the runs of one part."""
    codec = pa.Codec("zstd", 3)
    cells = {name: table[name].to_pylist() for name in table.column_names}
    doc, tag, start, n, anchor = (np.concatenate([np.frombuffer(x, np.int64) for x in cells[c]]) for c in ("doc", "tag", "start", "n", "anchor"))
    data = []
    for count, packed in zip(cells["n"], cells["data"], strict=True):
        count = np.frombuffer(count, np.int64)
        data.append(codec.decompress(packed, int(count.sum()) + len(count) * (LENGTH - 1), asbytes=True))
    raw = np.frombuffer(b"".join(data), np.uint8)
    del data, cells
    size = n + LENGTH - 1
    begin = np.cumsum(size) - size
    order = np.lexsort((begin, anchor))
    begin, doc, tag, start, n, anchor = (x[order] for x in (begin, doc, tag, start, n, anchor))
    spans = []
    for run, nth, count in _sets(anchor, begin, n, raw):
        own, at = _gathered(raw, begin[run] + nth, count + LENGTH - 1)
        gone = _removed(own, at, count, doc[run], start[run] + nth)
        of = np.repeat(np.arange(len(run)), count)
        edge = np.ones(len(gone), dtype=bool)
        edge[1:] = (gone[1:] != gone[:-1]) | (of[1:] != of[:-1])
        head = np.flatnonzero(edge)
        width = np.diff(np.append(head, len(gone)))
        head, width = head[gone[head]], width[gone[head]]
        first = head - (np.cumsum(count) - count)[of[head]]
        owner = run[of[head]]
        spans.append((doc[owner], tag[owner], start[owner] + nth[of[head]] + first, width))
    doc, tag, start, n = (np.concatenate(x) for x in zip(*spans, strict=True))
    return pa.table({"doc": doc, "tag": tag, "start": pa.array(start, pa.int32()), "n": pa.array(n, pa.int32())})


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and the digest of what stays of each text."""
    codec = pa.Codec("zstd", 3)
    for batch in batches:
        ids, packed, sizes = (batch.column(i).to_pylist() for i in range(3))
        lost, count, digests = [], [], []
        for row, (data, size) in enumerate(zip(packed, sizes, strict=True)):
            text = _unpacked(data, size, codec)
            f = _fields(batch.column(3), row)
            if not f or not len(f["start"]):
                lost.append(0)
                count.append(0)
                digests.append(hashlib.sha256(text).hexdigest())
                continue
            depth = np.zeros(size + 1, np.int64)
            np.add.at(depth, f["start"], 1)
            np.add.at(depth, f["start"] + f["n"] + LENGTH - 1, -1)
            gone = np.cumsum(depth[:-1]) > 0
            lost.append(int(gone.sum()))
            count.append(int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)))
            digests.append(hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(lost, pa.int64()), pa.array(count, pa.int64()),
             pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _hot_anchors(rows: DataFrame, size: int) -> np.ndarray:
    """Anchors of more runs than one task should see, by a share of the documents; at most MOST_HOT."""
    least = max(HOT_RUNS, size // GRAM // MOST_HOT) // SAMPLE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in _filled(batches):
            anchor, n = np.unique(_runs_of(texts, np.zeros(0, np.uint64))[4], return_counts=True)
            # An anchor seen once among eight megabytes of text cannot be hot where it is seen no oftener elsewhere.
            yield pa.RecordBatch.from_arrays([pa.array(anchor[n > 1].astype(np.int64)), pa.array(n[n > 1])], names=["anchor", "n"])

    picked = rows.filter(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE)) == 0)
    counts = picked.mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    most = counts.filter(F.col("n") > max(least, 1)).orderBy(F.desc("n"), "anchor").limit(MOST_HOT).select("anchor").collect()
    return np.sort(np.array([r.anchor for r in most], np.int64).view(np.uint64))


def repeated(df: DataFrame) -> DataFrame:
    """(doc, tag, start, n) of stretches of n strings from ``start`` on that all occur at an earlier position."""
    spark = df.sparkSession
    rows = _rows(df)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // PART_BYTES))
    hot = _hot_anchors(rows, size) if size // GRAM > HOT_RUNS else np.zeros(0, np.uint64)
    runs = rows.mapInArrow(_pack_runs(parts, hot), _PACKED)
    found = cut(runs.groupBy("key").applyInArrow(_meet, _FOUND), "runs")
    wanted = found.filter("anchor IS NOT NULL").groupBy("doc", "tag").agg(
        F.collect_list(F.struct("start", "n", "key", "anchor")).alias("runs"))
    asked = _packed(df).join(wanted, ["doc", "tag"]).select("doc", "tag", "packed", "size", "runs")
    carried = asked.mapInArrow(_carry, _CARRIED)
    later = carried.groupBy("key").applyInArrow(_sort_part, _SPANS)
    return found.filter("anchor IS NULL").select("doc", "tag", "start", "n").unionByName(later)


def _rows(df: DataFrame) -> DataFrame:
    return df.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("doc"), F.xxhash64("text").alias("tag"), F.col("text"))


def _packed(df: DataFrame) -> DataFrame:
    return _rows(df).mapInArrow(_pack_text, "doc long, tag long, packed binary, size long")


def without_repeats(df: DataFrame) -> DataFrame:
    """``df`` (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    A byte goes if a string of ``LENGTH`` bytes that covers it occurs at an earlier position as well, in this text or in
    another; strings are those of the input, not of what is left. The odd cases are those of the module's docstring.
    """
    spans = repeated(df).groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    joined = _packed(df).join(spans, ["doc", "tag"], "left")
    ids = F.when(F.col("doc") != _FIRST, F.col("doc")).alias("doc_id")
    kept = joined.select(ids, "packed", "size", "spans")
    return kept.mapInArrow(_cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
