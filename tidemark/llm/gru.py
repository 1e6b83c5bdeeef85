"""Language-model scores: a gated recurrent network over words with a class-factored softmax, in numpy.

Counts of all training tokens give the vocabulary, the classes, the starting biases and the probabilities of words
outside the vocabulary. The network is trained by truncated backpropagation on all training documents: every task
trains on its own documents from common weights, and the weights are averaged by tokens, round by round. A pass over
the documents is cut into more rounds as the corpus grows, so more input is also learned from one after the other. A
document is scored window by window with the state carried on, so its log-likelihood is that of the whole text.

Texts are hashed once for the counts and once for their vocabulary numbers, which are stored; passes and scoring read
those. Documents stand side by side, and where one has ended the next takes its place.

Words are runs of anything but ASCII white space with A-Z lower-cased, known by a 64-bit hash; each document ends in one
end token.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shingles import words_of
from tidemark.llm.streams import added, free, parts_of
from tidemark.session import cut

#: Words of the vocabulary, words of a class, width of the state.
VOCABULARY, CLASS, WIDTH = 1024, 32, 16
#: Most frequent words whose counts go to every task (a fixed 4 MB); counts of the others are joined.
HEAD = 1 << 18
#: Leading bits by which a hash's place in the head is found.
BITS = 18
#: Passes over all training documents, and tokens from which a pass is cut: one more round each time they double.
ROUNDS, CUT_FROM = 2, 1 << 20
#: Tokens of a window, documents trained (at least, and at most where there are many) and scored side by side, step size.
WINDOW, TRAIN_SIDE, MOST_SIDE, SCORE_SIDE, RATE = 32, 32, 256, 512, 0.01
#: Windows that a task's training is left with before more documents stand side by side, and tokens laid side by side at once.
STEPS, POOL = 512, 1 << 22
#: Tokens whose softmax is taken at once.
SPAN = 2048
OTHER, END = 0, 1
#: The end token's hash; a word that shared it would be one in 2**64.
END_HASH = np.uint64(0x5851F42D4C957F2D)


@dataclass
class Words:
    """Corpus counts in fixed size: the head's sorted hashes, counts and vocabulary numbers, and totals."""

    hashes: np.ndarray
    counts: np.ndarray
    number: np.ndarray
    total: int
    distinct: int
    vocabulary_counts: np.ndarray

    @property
    def outside(self) -> tuple[int, int]:
        """Tokens and distinct words outside the vocabulary."""
        return self.total - int(self.vocabulary_counts[END:].sum()), self.distinct - int((self.vocabulary_counts[END:] > 0).sum())

    @cached_property
    def first(self) -> np.ndarray:
        """Place of the first of the sorted hashes that has each value, or a larger one, of the leading bits."""
        return np.searchsorted(self.hashes, np.arange(1 << BITS, dtype=np.uint64) << np.uint64(64 - BITS))

    def place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(in the head, place there) of each hash; any place if it isn't."""
        if not len(self.hashes):
            return np.zeros(len(hashes), dtype=bool), np.zeros(len(hashes), dtype=np.int64)
        last = len(self.hashes) - 1
        at = np.minimum(self.first[hashes >> np.uint64(64 - BITS)], last)
        left = np.flatnonzero(self.hashes[at] < hashes)
        while len(left):
            left = left[at[left] < last]
            at[left] += 1
            left = left[self.hashes[at[left]] < hashes[left]]
        return self.hashes[at] == hashes, at

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(in the head, count, vocabulary number) of each hash."""
        known, at = self.place(hashes)
        if not len(self.hashes):
            return known, np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=np.int32)
        return known, np.where(known, self.counts[at], 0), np.where(known, self.number[at], OTHER)


class Network:
    """Weights as one flat array with named views; classes 0 and 1 are the single tokens other and end."""

    def __init__(self, counts: np.ndarray, seed: int = 3):
        self.words, self.rooms = len(counts), {}
        self.classes = 2 + -(-(self.words - 2) // CLASS)
        self.shapes = {
            "x": (self.words, 3 * WIDTH), "u": (WIDTH, 3 * WIDTH), "bu": (3 * WIDTH,), "wc": (WIDTH, self.classes), "bc": (self.classes,),
            "wo": (max(0, self.classes - 2), WIDTH, CLASS), "bo": (max(0, self.classes - 2), CLASS)}
        self.size = sum(math.prod(s) for s in self.shapes.values())
        flat = np.zeros(self.size, dtype=np.float32)
        rng = np.random.default_rng(seed)
        view = self.views(flat)
        for name in ("x", "u"):
            view[name][...] = rng.normal(0, 0.3 if name == "x" else 0.25, self.shapes[name])
        padded = np.full((max(0, self.classes - 2)) * CLASS, 1e-9)
        padded[: self.words - 2] = counts[2:] + 0.5
        view["bo"][...] = np.log(padded).reshape(-1, CLASS)
        mass = np.concatenate([counts[:2] + 0.5, padded.reshape(-1, CLASS).sum(axis=1)])
        view["bc"][...] = np.log(mass / mass.sum())
        self.set(flat)

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            out[name] = flat[at : at + math.prod(shape)].reshape(shape)
            at += math.prod(shape)
        return out

    def room(self, name: str, *shape: int) -> np.ndarray:
        """An array to write to; the memory is that of the last array of this name."""
        size = math.prod(shape)
        if name not in self.rooms or len(self.rooms[name]) < size:
            self.rooms[name] = np.empty(size, dtype=np.float32)
        return self.rooms[name][:size].reshape(shape)

    def set(self, flat: np.ndarray) -> None:
        self.flat = np.array(flat, dtype=np.float32)
        self.w = self.views(self.flat)

    def run(self, inputs: np.ndarray, state: np.ndarray, keep: bool = False):
        """States after each step of ``inputs`` (steps, rows); with ``keep`` also what the way back needs."""
        states, held = self.forward(inputs, state.T, keep)
        after = states[1:, :WIDTH].transpose(0, 2, 1).copy()
        return after, after[-1], held

    def forward(self, inputs: np.ndarray, state: np.ndarray, keep: bool = False):
        """States before and after each step (steps + 1, width + 1, rows): a unit's values for all rows stand side by side.

        The last unit is 1, for the biases. What is returned is overwritten by the next call.
        """
        x = self.w["x"].T.copy()
        u = np.concatenate([self.w["u"], self.w["bu"][None]]).T.copy()
        # The gates' logistic function is taken from tanh, which needs half of its argument.
        x[: 2 * WIDTH] *= 0.5
        u[: 2 * WIDTH] *= 0.5
        steps, rows = inputs.shape
        states = self.room("states", steps + 1, WIDTH + 1, rows)
        states[0, :WIDTH] = state
        states[:, WIDTH] = 1
        gates = self.room("gates", steps if keep else 1, 3 * WIDTH, rows)
        pulls = self.room("pulls", steps if keep else 1, 3 * WIDTH, rows)
        part = self.room("part", WIDTH, rows)
        for t in range(steps):
            gx, gh = (gates[t], pulls[t]) if keep else (gates[0], pulls[0])
            np.take(x, inputs[t], axis=1, out=gx, mode="clip")
            np.matmul(u, states[t], out=gh)
            gate, new = gx[: 2 * WIDTH], gx[2 * WIDTH :]
            gate += gh[: 2 * WIDTH]
            np.tanh(gate, out=gate)
            gate *= 0.5
            gate += 0.5
            np.multiply(gate[WIDTH:], gh[2 * WIDTH :], out=part)
            new += part
            np.tanh(new, out=new)
            np.subtract(states[t, :WIDTH], new, out=part)
            part *= gate[:WIDTH]
            np.add(new, part, out=states[t + 1, :WIDTH])
        return states, (states, gates, pulls) if keep else None

    def log_probability(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None):
        """ln P of each target after each state (flat rows); with ``grads`` their gradients are added there and returned."""
        out, back = self.softmax(np.ascontiguousarray(states.T), targets, grads)
        return out, None if back is None else back.T

    def softmax(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None, some: np.ndarray | None = None):
        """``log_probability`` for states (width, tokens), at the places ``some`` only; elsewhere all is 0."""
        w = self.w
        which = np.where(targets < 2, targets, (targets - 2) // CLASS + 2)[slice(None) if some is None else some].astype(np.int16)
        order = np.argsort(which, kind="stable")
        which = which[order]
        order = order if some is None else some[order]
        target = targets[order]
        count, first = len(order), int(np.searchsorted(which, 2))
        held = self.room("held", WIDTH + 1, count)
        np.take(states, order, axis=1, out=held[:WIDTH], mode="clip")
        held[WIDTH] = 1
        largest = float(np.abs(held).max(initial=0))
        ln = np.empty(count, dtype=np.float32)
        # The last column stands for places that are not among ``some``.
        back = None if grads is None else self.room("back", WIDTH, count + 1)
        weights, safe = _shifted(w["wc"], w["bc"], largest)
        for at in range(0, count, SPAN):
            to = slice(at, min(at + SPAN, count))
            part = np.matmul(weights.T, held[:, to], out=self.room("logits", self.classes, to.stop - at))
            spot = which[to].astype(np.int64) * (to.stop - at) + np.arange(to.stop - at)
            own = np.take(part.reshape(-1), spot)
            ln[to] = own - _normalise(part, safe, grads is not None)
            if grads is not None:
                part.reshape(-1)[spot] -= 1
                found = held[:, to] @ part.T
                grads["wc"] += found[:WIDTH]
                grads["bc"] += found[WIDTH]
                np.matmul(w["wc"], part, out=back[:, to])
        if first < count:
            inner, target = held[:, first:], (target[first:] - 2) % CLASS
            bounds = [0, *(np.flatnonzero(np.diff(which[first:])) + 1).tolist(), count - first]
            groups = [(int(which[first + a]) - 2, slice(a, b)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            weights, safe = _shifted(w["wo"], w["bo"], largest)
            words = self.room("words", CLASS, count - first)
            for c, at in groups:
                np.matmul(weights[c].T, inner[:, at], out=words[:, at])
            spot = target.astype(np.int64) * (count - first) + np.arange(count - first)
            ln[first:] += np.take(words.reshape(-1), spot)
            for at in range(0, count - first, SPAN):
                ln[first + at : first + at + SPAN] -= _normalise(words[:, at : at + SPAN], safe, grads is not None)
            if grads is not None:
                words.reshape(-1)[spot] -= 1
                found = np.zeros_like(weights)
                for c, at in groups:
                    np.matmul(inner[:, at], words[:, at].T, out=found[c])
                    back[:, first + at.start : first + at.stop] += w["wo"][c] @ words[:, at]
                grads["wo"] += found[:, :WIDTH]
                grads["bo"] += found[:, WIDTH]
        out = np.zeros(len(targets), dtype=np.float32)
        out[order] = ln
        if grads is None:
            return out, None
        back[:, count] = 0
        place = np.full(len(targets), count)
        place[order] = np.arange(count)
        return out, np.take(back, place, axis=1, out=self.room("full", WIDTH, len(targets)), mode="clip")

    def backward(self, inputs: np.ndarray, held: tuple, back: np.ndarray, grads: dict) -> None:
        """Add the gradients of the window's recurrent weights; nothing goes back past its start."""
        self.back_through(inputs, held, np.ascontiguousarray(back.transpose(0, 2, 1)), grads)

    def back_through(self, inputs: np.ndarray, held: tuple, back: np.ndarray, grads: dict) -> None:
        """``backward`` for gradients of the states as (steps, width, rows)."""
        states, gates, pulls = held
        u = self.w["u"]
        steps, rows = inputs.shape
        # Of z, of r, of the state's pull at the new value, of the new value.
        ways = self.room("ways", steps, 4 * WIDTH, rows)
        d, part = self.room("d", WIDTH, rows), self.room("part", WIDTH, rows)
        later, more = self.room("later", WIDTH, rows), self.room("more", WIDTH, rows)
        later.fill(0)
        found, total = (np.zeros((WIDTH + 1, 3 * WIDTH), dtype=np.float32) for _ in range(2))
        for t in range(steps - 1, -1, -1):
            gate, way, state = gates[t], ways[t], states[t]
            z, r, new = gate[:WIDTH], gate[WIDTH : 2 * WIDTH], gate[2 * WIDTH :]
            dgh, dz, dr, dp, dn = way[: 3 * WIDTH], way[:WIDTH], way[WIDTH : 2 * WIDTH], way[2 * WIDTH : 3 * WIDTH], way[3 * WIDTH :]
            np.add(back[t], later, out=d)
            np.multiply(d, z, out=later)
            d -= later
            np.subtract(state[:WIDTH], new, out=dz)
            dz *= z
            dz *= d
            np.multiply(new, new, out=dn)
            dn *= d
            np.subtract(d, dn, out=dn)
            np.multiply(dn, r, out=dp)
            np.multiply(dp, pulls[t, 2 * WIDTH :], out=dr)
            np.multiply(dr, r, out=part)
            dr -= part
            total += np.matmul(state, dgh.T, out=found)
            later += np.matmul(u, dgh, out=more)
        grads["u"] += total[:WIDTH]
        grads["bu"] += total[WIDTH]
        laid = self.room("laid", 3 * WIDTH, steps, rows)
        laid[: 2 * WIDTH] = ways[:, : 2 * WIDTH].transpose(1, 0, 2)
        laid[2 * WIDTH :] = ways[:, 3 * WIDTH :].transpose(1, 0, 2)
        laid = laid.reshape(3 * WIDTH, -1)
        # The window's tokens sorted by word, so that each word's gradients are added up at once; the rest is OTHER's.
        word = inputs.reshape(-1).astype(np.uint16 if self.words <= 1 << 16 else np.int64)
        order = np.argsort(word, kind="stable")
        order = order[np.searchsorted(word[order], OTHER + 1) :]
        rest = laid.sum(axis=1)
        if len(order):
            word = word[order]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
            by_word = np.take(laid, order, axis=1, out=self.room("by_word", 3 * WIDTH, len(order)), mode="clip")
            sums = np.add.reduceat(by_word, starts, axis=1)
            grads["x"][word[starts]] += sums.T
            rest -= sums.sum(axis=1)
        grads["x"][OTHER] += rest


def _shifted(weights: np.ndarray, bias: np.ndarray, largest: float) -> tuple[np.ndarray, bool]:
    """Weights (..., width, choices) with their bias as a last row, less the largest logit that states up to ``largest`` can give.

    Then no exponent overflows; true if none of the sums of exponents can vanish either.
    """
    spread = largest * np.abs(weights).sum(axis=-2)
    most, least = (bias + spread).max(axis=-1, initial=-np.inf), (bias - spread).max(axis=-1, initial=-np.inf)
    return np.concatenate([weights, (bias - most[..., None])[..., None, :]], axis=-2), bool((most - least < 60).all())


def _normalise(logits: np.ndarray, safe: bool, back: bool) -> np.ndarray:
    """ln of the sum of exponents over axis 0; with ``back``, ``logits`` become the softmax."""
    top = 0
    if not safe:
        top = logits.max(axis=0)
        logits -= top
    np.exp(logits, out=logits)
    total = logits.sum(axis=0)
    if back:
        logits *= 1 / total
    return np.log(total) + top


def _rows_for(lengths: np.ndarray, least: int, most: int) -> int:
    """Documents side by side: as many as keep their places filled while the longest runs, and leave ``STEPS`` windows."""
    total = int(lengths.sum())
    return min(most, max(least, min(total // int(lengths.max()), total // (WINDOW * STEPS))))


def _windows(docs: list[np.ndarray], rows: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Windows of ``rows`` documents side by side, longest first; where one has ended, the next takes its place.

    Each is (documents, places in the window before or -1 at a document's start, inputs, targets, valid), the last three
    (steps, rows): what stands after a document's end is not valid.
    """
    lengths = np.array([len(d) for d in docs])
    order = np.argsort(-lengths, kind="stable")
    # Every document stands behind an end token, its first input.
    laid = np.full(int(lengths.sum()) + len(docs), END, dtype=np.int32)
    start = np.cumsum(lengths + 1) - lengths - 1
    text = np.ones(len(laid), dtype=bool)
    text[start] = False
    laid[text] = np.concatenate(docs)
    doc, waiting = order[:rows], rows
    at, before = start[doc], np.full(len(doc), -1)
    while len(doc):
        left = start[doc] + lengths[doc] - at
        steps = min(WINDOW, int(left.max()))
        valid = np.arange(steps)[:, None] < left
        place = np.minimum(at + np.arange(steps)[:, None], len(laid) - 2)
        yield doc, before, laid[place], np.where(valid, laid[place + 1], OTHER), valid
        before = np.arange(len(doc))
        at = at + steps
        ended = np.flatnonzero(left <= steps)
        if len(ended):
            new = order[waiting : waiting + len(ended)]
            waiting += len(new)
            doc = doc.copy()
            doc[ended[: len(new)]], at[ended[: len(new)]], before[ended[: len(new)]] = new, start[new], -1
            if len(new) < len(ended):
                doc, at, before = (np.delete(x, ended[len(new) :]) for x in (doc, at, before))


def _carried(state: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The states (width, rows) that documents go on with; 0 where one starts."""
    return np.where(before >= 0, state[:, before], np.float32(0))


def _laid(net: Network, states: np.ndarray) -> np.ndarray:
    """States (steps, width, rows) as (width, tokens)."""
    steps, _, rows = states.shape
    out = net.room("after", WIDTH, steps, rows)
    out[...] = states[:, :WIDTH].transpose(1, 0, 2)
    return out.reshape(WIDTH, -1)


def train_on(net: Network, docs: list[np.ndarray]) -> int:
    """One pass of truncated backpropagation over documents of vocabulary numbers; the tokens it saw."""
    moment, square, step, seen = np.zeros_like(net.flat), np.zeros_like(net.flat), 0, 0
    flat, part = np.empty_like(net.flat), np.empty_like(net.flat)
    grads = net.views(flat)
    docs = [d for d in docs if len(d)]
    if not docs:
        return 0
    state = np.zeros((WIDTH, 1), dtype=np.float32)
    for _, before, inputs, targets, valid in _windows(docs, _rows_for(np.array([len(d) for d in docs]), TRAIN_SIDE, MOST_SIDE)):
        flat.fill(0)
        states, held = net.forward(inputs, _carried(state, before), keep=True)
        state = states[-1, :WIDTH]
        some = None if valid.all() else np.flatnonzero(valid.reshape(-1))
        after = _laid(net, states[1:])
        _, back = net.softmax(after, targets.reshape(-1), grads, some)
        net.back_through(inputs, held, back.reshape(WIDTH, *valid.shape).transpose(1, 0, 2), grads)
        tokens = int(valid.sum())
        step += 1
        seen += tokens
        flat *= 1 / tokens
        moment *= 0.9
        np.multiply(flat, 0.1, out=part)
        moment += part
        square *= 0.999
        np.multiply(flat, flat, out=part)
        part *= 0.001
        square += part
        np.multiply(square, 1 / (1 - 0.999**step), out=part)
        np.sqrt(part, out=part)
        part += 1e-6
        np.divide(moment, part, out=part)
        part *= RATE / (1 - 0.9**step)
        net.flat -= part
    return seen


def log_likelihoods(net: Network, docs: list[np.ndarray]) -> np.ndarray:
    """ln P of each document, its state carried from window to window."""
    out = np.zeros(len(docs))
    state = np.zeros((WIDTH, 1), dtype=np.float32)
    if not sum(map(len, docs)):
        return out
    for doc, before, inputs, targets, valid in _windows(docs, _rows_for(np.array([len(d) for d in docs]), SCORE_SIDE, SCORE_SIDE)):
        states, _ = net.forward(inputs, _carried(state, before))
        state = states[-1, :WIDTH]
        after = _laid(net, states[1:])
        found, _ = net.softmax(after, targets.reshape(-1), None, None if valid.all() else np.flatnonzero(valid.reshape(-1)))
        out[doc] += found.reshape(valid.shape).sum(axis=0, dtype=np.float64)
    return out


def _hashed(texts: list) -> Iterator[np.ndarray]:
    """Word hashes of each text, the end token last."""
    for _, hashes, counts in words_of([t or b"" for t in texts]):
        for part in np.split(hashes, np.cumsum(counts)[:-1]):
            yield np.append(part, END_HASH)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 2048):
            texts = batch.column(0).slice(first, 2048).cast(pa.binary()).to_pylist()
            found, count = np.unique(np.concatenate(list(_hashed(texts))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(count)], names=["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): counts of all tokens of ``docs`` (text)."""
    return cut(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count_words, "word long, n long").groupBy("word").agg(
        F.sum("n").alias("n")), "word-counts")


def corpus_words(counts: DataFrame) -> Words:
    """The fixed-size part of the counts: head, vocabulary and totals."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    head = counts.orderBy(F.desc("n"), "word").limit(HEAD).toArrow()
    hashes = head.column("word").to_numpy().astype(np.int64).view(np.uint64)
    n = head.column("n").to_numpy().astype(np.int64)
    word = hashes != END_HASH
    chosen = np.flatnonzero(word)[: VOCABULARY - 2]
    number = np.zeros(len(n), dtype=np.int32)
    number[~word] = END
    number[chosen] = np.arange(len(chosen)) + 2
    inside = np.concatenate([[0, n[~word].sum()], n[chosen]]).astype(np.int64)
    inside[OTHER] = total["n"] - inside.sum()
    order = np.argsort(hashes)
    return Words(hashes[order], n[order], number[order], total["n"], total["v"], inside)


def _number(words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = words.value
        logs = np.log10(held.counts + 1.0)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                found = list(_hashed(part.column(0).cast(pa.binary()).to_pylist()))
                lengths = np.array([len(h) for h in found])
                start = np.cumsum(lengths) - lengths
                hashes = np.concatenate(found)
                known, at = held.place(hashes)
                number, log = np.zeros(len(hashes), dtype=np.uint16), np.zeros(len(hashes))
                number[known], log[known] = held.number[at[known]], logs[at[known]]
                other = number == OTHER
                sums = [np.add.reduceat(x, start) for x in (known.astype(np.int64), log, np.where(other, log, 0), other.astype(np.int64))]
                rest = np.flatnonzero(~known)
                tail, doc = hashes[rest], np.repeat(np.arange(len(found)), lengths)[rest]
                order = np.lexsort((tail, doc))
                tail, doc = tail[order], doc[order]
                new = np.flatnonzero(np.concatenate([[True], (tail[1:] != tail[:-1]) | (doc[1:] != doc[:-1])])[: len(tail)])
                ends = pa.array(np.searchsorted(doc[new], np.arange(len(found) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(lengths), *(pa.array(x) for x in sums),
                     pa.array([n.tobytes() for n in np.split(number, start[1:])], pa.binary()),
                     pa.ListArray.from_arrays(ends, pa.array(tail[new].view(np.int64))),
                     pa.ListArray.from_arrays(ends, pa.array(np.diff(np.append(new, len(tail)))))],
                    names=[*part.schema.names[1:], "n_tokens", "head_known", "head_sum", "head_outside", "n_outside", "numbers", "tail", "tail_n"])

    return run


def numbered(docs: DataFrame, words) -> DataFrame:
    """Vocabulary numbers of each text of ``docs`` (text first, other columns are kept), and what it has in the head and beyond."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[1:])
    return cut(docs.mapInArrow(
        _number(words),
        f"{kept}{', ' * bool(kept)}n_tokens long, head_known long, head_sum double, head_outside double, n_outside long, numbers binary,"
        " tail array<long>, tail_n array<long>"), "numbered")


def _read(numbers: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(n, dtype=np.uint16) for n in numbers.to_pylist()]


def _train(words, weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(words.value.vocabulary_counts)
        net.set(weights)
        total, seen, waiting, tokens = np.zeros(net.size + 1), 0, [], 0
        for batch in batches:
            for doc in _read(batch.column(0)):
                waiting.append(doc)
                tokens += len(doc)
                if tokens >= 2 * POOL:
                    seen += train_on(net, waiting)
                    waiting, tokens = [], 0
        seen += train_on(net, waiting)
        if seen:
            total[:-1], total[-1] = net.flat * np.float64(seen), seen
            yield parts_of(total)

    return run


def slices(tokens: int) -> int:
    """Rounds of averaging that a pass over so many tokens is cut into; grows by doublings, since each reads the table."""
    return 1 + max(0, (tokens // CUT_FROM).bit_length())


def sliced(docs: DataFrame, count: int) -> list[DataFrame]:
    """``docs`` cut into ``count`` parts by place in its partition, so copies of a text are spread over all."""
    name = free("slice", docs.columns)
    rows = docs.withColumn(name, F.pmod(F.monotonically_increasing_id(), F.lit(count)))
    return [rows.filter(F.col(name) == k).drop(name) for k in range(count)]


def fit(docs: DataFrame, words) -> np.ndarray:
    """Weights of the network after the passes over all of ``docs`` (text); ``words`` is the broadcast of the counts."""
    return fit_numbers(numbered(docs.select(F.col("text").cast("string").alias("text")), words).select("numbers"), words)


def fit_numbers(docs: DataFrame, words) -> np.ndarray:
    """``fit`` for documents as vocabulary numbers. Each task of a round gets about ``POOL`` tokens, more tasks as they grow."""
    net = Network(words.value.vocabulary_counts)
    count = slices(words.value.total)
    tasks = max(1, -(-words.value.total // (count * POOL)))
    for _ in range(ROUNDS):
        for part in sliced(docs, count):
            total = added(part.repartition(tasks).mapInArrow(_train(words, net.flat), "part int, data binary"))
            if len(total):
                net.set(total[:-1] / total[-1])
    return net.flat


def _score(words, weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(words.value.vocabulary_counts)
        net.set(weights.value)
        for batch in batches:
            docs = _read(batch.column(0))
            pool = (np.cumsum([len(d) for d in docs]) - 1) // POOL
            found = [log_likelihoods(net, docs[a:b]) for a, b in itertools.pairwise([0, *(np.flatnonzero(np.diff(pool)) + 1).tolist(), len(docs)])]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(found))], names=[*batch.schema.names[1:], "ln_model"])

    return run


def score(docs: DataFrame, train: F.Column) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text), learned from the rows where ``train`` holds.

    Columns: doc_id, trained, n_tokens, n_known, train_tokens, base_score, score. base_score is the log10 probability of
    the tokens under add-one counts; score that of the whole text under the network, where a word outside the vocabulary
    is the token ``other`` times its add-one share among such words.

    A null text is empty: one end token. Texts of any length are scored whole. Repeated rows get the same scores; a null
    doc_id stays null; a null ``train`` is false; without any training row the network has its starting weights and all
    counts are 0; an empty table gives no rows. Other columns are ignored whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("trained"))
    learned = rows.filter("trained")
    counts = word_counts(learned)
    words = spark.sparkContext.broadcast(corpus_words(counts))
    rows = numbered(rows.select("text", "doc_id", "trained", F.monotonically_increasing_id().alias("row_id")), words)
    weights = spark.sparkContext.broadcast(fit_numbers(rows.filter("trained").select("numbers"), words))
    total, distinct = words.value.total, words.value.distinct
    outside, outside_distinct = words.value.outside
    scored = rows.select("numbers", *(c for c in rows.columns if c not in ("numbers", "tail", "tail_n")))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scored.schema.fields[1:])
    scored = cut(scored.mapInArrow(_score(words, weights), f"{kept}, ln_model double"), "scored")
    tail = rows.select("row_id", F.inline(F.arrays_zip(F.col("tail").alias("word"), F.col("tail_n").alias("times"))))
    tail = tail.join(counts.withColumnRenamed("n", "c"), "word").groupBy("row_id").agg(
        F.sum("times").alias("tail_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("tail_sum"))
    both = scored.join(tail, "row_id", "left").fillna({"tail_known": 0, "tail_sum": 0.0})
    base = F.col("head_sum") + F.col("tail_sum") - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))
    model = (F.col("ln_model") / F.lit(math.log(10)) + F.col("head_outside") + F.col("tail_sum")
             - F.col("n_outside") * F.lit(math.log10(outside + outside_distinct + 1)))
    return both.select("doc_id", "trained", "n_tokens", (F.col("head_known") + F.col("tail_known")).alias("n_known"),
                       F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), model.alias("score"))
