"""Byte-pair encoding by a tokenization automaton.

The automaton reads tokens and accepts exactly the token sequences that the merges can produce. It starts as one state
with an arc for every base symbol. The gadget of a merge (u, v) -> uv splits the state that u leads to: the copy that u
leads to from now on lacks the arc v, and every state with an arc u gets an arc uv to where v led before. All arcs with
one label lead to one state, so the tables are small: per label its target and left part, per state the state it was
copied from and the label it lost. Each text has one accepted path; a word is encoded by following longest arcs first
and stepping back where the table has no arc. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries kept of words already encoded and of arcs already looked up, per Python worker.
KEPT = 500_000
#: Longer words are encoded but not kept.
KEPT_CHARS = 64
#: Stands for the end of a word on its last byte's symbol.
_END = "</w>"
_LAST = 0x10000
_NEVER = 1 << 30


def _pattern(letters: str, numbers: str, spaces: str) -> re.Pattern:
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+")


#: The pre-split for texts of code points below 256, which most are.
_LATIN = _pattern(r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0")


@functools.cache
def _words() -> re.Pattern:
    """The pre-split for any text: runs of letters, single numbers, runs of anything else but white space."""
    ranges: dict[str, list[list[int]]] = {"L": [], "N": []}
    for c in range(sys.maxunicode + 1):
        found = ranges.get(unicodedata.category(chr(c))[0])
        if found is not None:
            if found and found[-1][1] == c - 1:
                found[-1][1] = c
            else:
                found.append([c, c])
    letters, numbers = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges[kind]) for kind in "LN")
    return _pattern(letters, numbers, r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000")


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0x100
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class Automaton:
    """Tables compiled from a vocabulary and its merges, in merge order."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        size = max(vocab.values()) + 1
        self.left, self.born = np.full(size, -1, dtype=np.int32).tolist(), [0] * size
        self.target, self.live = [0] * size, [True] * size
        self.parent, self.lost, self.made = [-1], [-1], [0]
        self._losses: dict[int, dict[int, int]] = {}
        self._held = 0
        results = {u + v for u, v in merges}
        if len(results) != len(merges):
            raise ValueError("two merges give one token")
        for name in results:
            self.live[vocab[name]] = False
        for at, (u, v) in enumerate(merges, 1):
            self._merge(vocab[u], vocab[v], vocab[u + v], at)

    def _merge(self, u: int, v: int, uv: int, at: int) -> None:
        state = self.target[u]
        if not (self.live[u] and self.live[v] and self._has(state, v)):
            return  # u is never followed by v, so the merge never applies
        self.left[uv], self.born[uv], self.live[uv] = u, at, True
        self.target[uv] = self.target[v]
        self.parent.append(state)
        self.lost.append(v)
        self.made.append(at)
        self.target[u] = len(self.parent) - 1

    def _has(self, state: int, label: int) -> bool:
        while label >= 0:
            while self.made[state] > self.born[label]:  # copies made since the label came have what their origin has, but for one
                if self.lost[state] == label:
                    return False
                state = self.parent[state]
            label = self.left[label]
        return True

    def arc(self, state: int, label: int) -> bool:
        """Whether ``label`` may follow in ``state``: a state has it if, when the label came, it had the left part."""
        lost, at = self._losses.get(state) or self._lost_by(state), _NEVER - 1
        while label >= 0:
            if lost.get(label, _NEVER) <= at:
                return False
            at, label = self.born[label], self.left[label]
        return True

    def _lost_by(self, state: int) -> dict[int, int]:
        """Labels that a state or one it was copied from lost, and when."""
        lost, at = {-1: 0}, state
        while at > 0:
            lost[self.lost[at]] = self.made[at]
            at = self.parent[at]
        if self._held + len(lost) > KEPT:
            self._losses.clear()
            self._held = 0
        self._held += len(lost)
        self._losses[state] = lost
        return lost


class Tokenizer:
    """Encoder and decoder of one vocabulary file whose words end in a marker and whose bytes are symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != _END:
            raise ValueError(f"{path}: not a merge vocabulary with word ends")
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # A merge's left part never ends a word, so plain concatenation names the result.
        self.automaton = Automaton(vocab, merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for name, at in [*vocab.items(), *self.special.items()]:
            self.labels[at] = name
        self._at_special = re.compile("|".join(re.escape(s) for s in self.special)) if self.special else None
        self._symbols = _byte_symbols()
        self._spelled: dict[str, int] = {}
        for name, at in vocab.items():
            if self.automaton.live[at]:
                spelled = name[: -len(_END) - 1] + chr(_LAST + ord(name[-len(_END) - 1])) if name.endswith(_END) else name
                self._spelled[spelled] = at
                for k in range(1, len(spelled)):
                    self._spelled.setdefault(spelled[:k], -1)
        self._known: dict[str, bytes] = {}

    def word_ids(self, word: str) -> list[int]:
        """Labels along the one accepted path of a word."""
        symbols = self._symbols
        spelled = "".join([symbols[b] for b in word.encode("utf-8")])
        spelled = spelled[:-1] + chr(_LAST + ord(spelled[-1]))
        names, arc, target, end = self._spelled, self.automaton.arc, self.automaton.target, len(spelled)

        def steps(at: int) -> list[tuple[int, int]]:
            out, k = [], at + 1
            while k <= end and (label := names.get(spelled[at:k])) is not None:
                if label >= 0:
                    out.append((label, k))
                k += 1
            return out

        path, state, open_, dead = [], 0, [steps(0)], set()
        while True:
            if open_[-1]:
                label, at = open_[-1].pop()
                if not arc(state, label):
                    continue
                if at == end:
                    return [*path, label]
                if (at, target[label]) not in dead:
                    dead.add((at, target[label]))  # entered once; coming back means that it led nowhere
                    path.append(label)
                    open_.append(steps(at))
                    state = target[label]
            else:
                open_.pop()
                path.pop()
                state = target[path[-1]] if path else 0

    def _plain(self, text: str) -> list[bytes]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            # Case is folded character by character, so a final sigma is not told apart.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            words = _words().findall(text.lower())
        else:
            words = _LATIN.findall(text.lower())
        known = self._known
        out = [known.get(word) for word in words]
        if None in out:
            if len(known) > KEPT:
                known.clear()
            for at, word in enumerate(words):
                if out[at] is None:
                    ids = known.get(word)
                    if ids is None:
                        ids = np.array(self.word_ids(word), dtype=np.int32).tobytes()
                        if len(word) <= KEPT_CHARS:
                            known[word] = ids
                    out[at] = ids
        return out

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a text; special tokens written out in it stand for themselves."""
        if self._at_special is None or "<" not in text:
            return np.frombuffer(b"".join(self._plain(text)), dtype=np.int32)
        out, at = [], 0
        for found in self._at_special.finditer(text):
            out += self._plain(text[at : found.start()])
            out.append(np.int32(self.special[found[0]]).tobytes())
            at = found.end()
        return np.frombuffer(b"".join([*out, *self._plain(text[at:])]), dtype=np.int32)

    def decode(self, ids) -> str:
        """Labels of the ids, joined by spaces as the vocabulary file names no decoder."""
        labels = self.labels
        return " ".join([labels[i] for i in ids])


@functools.cache
def tokenizer(path: str) -> Tokenizer:
    """The compiled tokenizer of a file, once per Python worker."""
    return Tokenizer(path)


def _batches(path: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(path)
        for batch in batches:
            texts = batch.column(0)
            step = 256  # rows held at once, whatever the batch
            for first in range(0, batch.num_rows, step):
                ids = [model.encode(t or "") for t in texts.slice(first, step).to_pylist()]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.concatenate([np.zeros(0, dtype=np.int32), *ids])
                columns = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if decoded:
                    columns.append(pa.array([model.decode(x.tolist()) for x in ids], pa.string()))
                rest = batch.slice(first, step)
                yield pa.RecordBatch.from_arrays([*rest.columns[1:], *columns], names=[*rest.schema.names[1:], "ids", "decoded"][: len(columns) + rest.num_columns - 1])

    return run


def encode(docs: DataFrame, path: str, decoded: bool = False, beside: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, columns ``beside``, ids array<int>), and with ``decoded`` the text that the ids stand for, one row per row
    of ``docs``.

    ``path`` names a vocabulary file that every executor has. Whole texts are encoded; null and empty texts have no ids
    and decode to the empty text. Texts of any length and repeated rows are encoded alike; a null doc_id stays null; an
    empty table gives no rows; other columns are ignored whatever their names.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), "doc_id", *beside)
    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", *beside))
    return rows.mapInArrow(_batches(path, decoded), f"{kept}, ids array<int>" + ", decoded string" * decoded)


def digests(docs: DataFrame, path: str, beside: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, columns ``beside``): the encoding as ``encode`` gives it, in digest form."""
    return encode(docs, path, decoded=True, beside=beside).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"), *beside)
