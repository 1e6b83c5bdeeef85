"""Word shingles of whole texts as 64-bit numbers, computed in numpy over the raw bytes.

Words are runs of anything but ASCII white space (0x20, 0x09-0x0D); A-Z are lower-cased, nothing else. A text's set is the
distinct hashes of its ``n``-word shingles; a text of fewer words is one shingle of its whole word sequence; a null or
blank text has the empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FOLD = 0x9FB21C651E98DF25
_MASK = (1 << 64) - 1
#: Bytes hashed at once; a longer text is cut at white space.
CHUNK = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[0x41:0x5B] += np.uint64(32)


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Table:
    """Powers of the base and of its inverse modulo 2**64, grown when a chunk is longer."""

    up = _powers(_BASE, CHUNK + 1)
    down = _powers(pow(_BASE, -1, 1 << 64), CHUNK + 1)

    @classmethod
    def of(cls, count: int) -> tuple[np.ndarray, np.ndarray]:
        if count > len(cls.up):
            cls.up, cls.down = _powers(_BASE, count), _powers(pow(_BASE, -1, 1 << 64), count)
        return cls.up, cls.down


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all others."""
    h = (h ^ (h >> np.uint64(30))) * _MIX_A
    h = (h ^ (h >> np.uint64(27))) * _MIX_B
    return h ^ (h >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a piece of text."""
    raw = np.frombuffer(data, dtype=np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[raw], [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = _Table.of(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_LOWER[raw] * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * down[start]), start


def pieces(data: bytes) -> Iterator[bytes]:
    """Cuts at white space after about a chunk each; a word is never cut."""
    at = 0
    while len(data) - at > CHUNK:
        end = at + CHUNK
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def words_of(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, word hashes, words per text) for runs of whole texts."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < CHUNK):
            size += len(texts[end]) + 1
            end += 1
        if end == at + 1 and len(texts[at]) > CHUNK:
            parts = [word_hashes(piece)[0] for piece in pieces(texts[at])]
            hashes = np.concatenate(parts)
            yield at, hashes, np.array([len(hashes)])
        else:
            hashes, start = word_hashes(b"\n".join(texts[at:end]))
            bounds = np.cumsum([len(t) + 1 for t in texts[at:end]])
            yield at, hashes, np.diff(np.searchsorted(start, bounds, side="left"), prepend=0)
        at = end


def _fold(hashes: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(first), n, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(_FOLD) + hashes[first + k]
    return mix(out)


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order."""
    for _, hashes, counts in words_of(texts):
        ends = np.cumsum(counts)
        full = np.zeros(0, dtype=np.uint64)
        if len(hashes) >= n:
            full = _fold(hashes, np.arange(len(hashes) - n + 1), n)
        for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
            first = end - count
            if count >= n:
                yield np.unique(full[first : end - n + 1])
            elif count:
                yield _fold(hashes, np.array([first]), count)
            else:
                yield np.zeros(0, dtype=np.uint64)


def set_hash(shingles: np.ndarray) -> int:
    """One signed 64-bit number for a whole set; equal sets have equal numbers."""
    with np.errstate(over="ignore"):
        total = int(shingles.sum(dtype=np.uint64)) ^ (len(shingles) * _BASE & _MASK)
        crossed = int(np.bitwise_xor.reduce(mix(shingles ^ np.uint64(_BASE)), initial=np.uint64(0)))
    out = (total * _FOLD + crossed) & _MASK
    return out - (1 << 64) if out >> 63 else out
