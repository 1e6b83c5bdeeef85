"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its hashed 1- to 4-byte subwords, classified by one linear layer. Both are
trained by stochastic gradient descent in numpy on a bounded sample of labelled texts. A part of the sample is held
back to calibrate the scores (one temperature).

The softmax only tells the learned labels apart, so a prediction is rejected by another figure: how likely the text's
subwords are among those of the predicted label, in standard deviations from what texts of that label have. The bound
costs a stated share of the held-back texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Rows of the embedding table, its width, and the lengths of subwords in bytes.
BUCKET_BITS, WIDTH, LENGTHS = 15, 16, (1, 2, 3, 4)
#: Bound of the training sample: this many labelled texts of each label, of this many labels at most.
SAMPLE_PER_LABEL, MOST_LABELS = 400, 200
#: Share of the sample that calibrates.
CALIBRATE_EVERY = 4
EPOCHS, BATCH, RATE = 6, 32, 0.5
#: Share of rightly labelled texts that rejection may cost, the least deviation that is rejected, and the count that a
#: subword not seen under a label has.
FALSE_REJECTS, LEAST_DEVIATION, UNSEEN = 0.005, 5.0, 0.05
#: A mean of embeddings is short and a subword's share of a text small, so their steps are scaled up.
LAYER_STEP, EMBED_STEP = 8, 4
CHUNK = 1 << 18

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[0x41:0x5B] += 32
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32
_MULTIPLY = np.uint32(0x9E3779B1)


def subwords(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, start) of the subwords of each length; none spans more than the blank at its ends."""
    raw = _FOLD[np.frombuffer(data, dtype=np.uint8)]
    letter = raw != 32
    for n in LENGTHS:
        if len(raw) < n:
            continue
        code = np.full(len(raw) - n + 1, n, dtype=np.uint32)
        keep = np.ones(len(raw) - n + 1, dtype=bool)
        for k in range(n):
            code = (code + raw[k : len(raw) - n + 1 + k]) * _MULTIPLY
            if 0 < k < n - 1 or n == 1:
                keep &= letter[k : len(raw) - n + 1 + k]
        if n > 1:
            keep &= letter[: len(raw) - n + 1] | letter[n - 1 :]
        start = np.flatnonzero(keep)
        code = code[start]
        yield ((code ^ (code >> np.uint32(15))) * _MULTIPLY) >> np.uint32(32 - BUCKET_BITS), start


@dataclass
class Model:
    """Labels, per bucket the score of each label (embedding times layer) and its ln probability under each label, biases.

    ``usual`` has for each label the mean ln probability of its texts, its variance over texts and that of a subword;
    a text whose deviation from it is below ``reject_below`` is rejected.
    """

    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    usual: np.ndarray
    temperature: float = 1.0
    reject_below: float = -np.inf

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores before calibration, mean ln probabilities, number of subwords) of whole texts, read piece by piece."""
        out = np.zeros((len(texts), self.table.shape[1]))
        seen = np.zeros(len(texts))
        pieces, owner, size = [], [], 0

        def flush() -> None:
            if not pieces:
                return
            ends = np.cumsum([len(p) + 1 for p in pieces])
            for bucket, start in subwords(b" ".join(pieces)):
                edge = np.searchsorted(start, np.concatenate(([0], ends)))
                count = np.diff(edge)
                some = np.flatnonzero(count)
                if len(some):
                    sums = np.add.reduceat(self.table[bucket], edge[some], axis=0)
                    np.add.at(out, np.array(owner)[some], sums)
                    np.add.at(seen, np.array(owner)[some], count[some])
            pieces.clear()
            owner.clear()

        for at, text in enumerate(texts):
            for first in range(0, len(text), CHUNK):
                piece = text[first : first + CHUNK]
                pieces.append(piece)
                owner.append(at)
                size += len(piece)
                if size >= CHUNK:
                    flush()
                    size = 0
        flush()
        out /= np.maximum(seen, 1)[:, None]
        return out[:, : len(self.labels)] + self.bias, out[:, len(self.labels) :], seen

    def deviation(self, label: np.ndarray, likely: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Standard deviations by which each text is likelier than texts of its label are; a short text varies more."""
        mean, between, within = self.usual[:, label]
        return (likely[np.arange(len(label)), label] - mean) / np.sqrt(between + within / np.maximum(seen, 1))

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Label number, calibrated probability and whether it is rejected, of each text."""
        logits, likely, seen = self.read(texts)
        p = _softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best], self.deviation(best, likely, seen) < self.reject_below


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = [bucket for first in range(0, len(text), CHUNK) for bucket, _ in subwords(text[first : first + CHUNK])]
    bucket, count = np.unique(np.concatenate(found) if found else np.zeros(0, dtype=np.uint32), return_counts=True)
    return bucket.astype(np.int64), (count / max(1, count.sum())).astype(np.float32)


def _usual(likely: np.ndarray, seen: np.ndarray, y: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per label the mean ln probability of its texts, its variance over texts and that of one subword."""
    log = np.log((counts + UNSEEN) / (counts + UNSEEN).sum(axis=0))
    share = counts / np.maximum(counts.sum(axis=0), 1e-9)
    # Subwords of all lengths overlap, so a text has fewer free ones than it has subwords.
    within = len(LENGTHS) ** 2 * ((share * log * log).sum(axis=0) - (share * log).sum(axis=0) ** 2)
    out = np.zeros((3, counts.shape[1]))
    for label in range(counts.shape[1]):
        mine = (y == label) & (seen > 0)
        if mine.any():
            own = likely[mine, label]
            mean = np.average(own, weights=seen[mine])
            out[:2, label] = mean, np.average((own - mean) ** 2, weights=seen[mine])
    out[1] += 1e-3
    out[2] = np.maximum(within, 1e-3)
    return out


def train(texts: list[bytes], labels: list[str], false_rejects: float = FALSE_REJECTS, seed: int = 7) -> Model:
    """Fit on labelled texts, given in an order that has nothing to do with their labels.

    ``false_rejects`` is the share of rightly labelled calibration texts that rejection may cost.
    """
    names = sorted(set(labels))
    y = np.array([names.index(x) for x in labels], dtype=np.int64)
    rows = [_counted(t) for t in texts]
    held = np.arange(len(rows)) % CALIBRATE_EVERY == CALIBRATE_EVERY - 1
    fit = np.flatnonzero(~held) if (~held).any() else np.arange(len(rows))
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (1 << BUCKET_BITS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, len(names)), dtype=np.float32), np.zeros(len(names), dtype=np.float32)
    steps, step = EPOCHS * max(1, -(-len(fit) // BATCH)), 0
    for _ in range(EPOCHS):
        rng.shuffle(fit)
        for first in range(0, len(fit), BATCH):
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            batch = [i for i in fit[first : first + BATCH] if len(rows[i][0])]
            if not batch:
                continue
            bucket = np.concatenate([rows[i][0] for i in batch])
            share = np.concatenate([rows[i][1] for i in batch])
            edge = np.concatenate(([0], np.cumsum([len(rows[i][0]) for i in batch])[:-1]))
            mean = np.add.reduceat(embed[bucket] * share[:, None], edge, axis=0)
            error = _softmax(mean @ layer + bias)
            error[np.arange(len(batch)), y[batch]] -= 1
            back = error @ layer.T
            layer -= rate * LAYER_STEP * (mean.T @ error) / len(batch)
            bias -= rate * error.mean(axis=0)
            owner = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
            np.subtract.at(embed, bucket, rate * EMBED_STEP * share[:, None] * back[owner])
    counts = np.zeros((1 << BUCKET_BITS, len(names)), dtype=np.float32)
    for i in fit:
        np.add.at(counts, (rows[i][0], y[i]), rows[i][1])
    # Each text counts once, however long, in units of its label's subwords to a text.
    length = [sum(len(b) for b, _ in subwords(texts[i][:CHUNK])) for i in fit]
    counts *= np.bincount(y[fit], weights=length, minlength=len(names)) / np.maximum(np.bincount(y[fit], minlength=len(names)), 1)
    log = np.log((counts + UNSEEN) / (counts + UNSEEN).sum(axis=0)) if len(names) else counts
    model = Model(names, np.concatenate([embed @ layer, log.astype(np.float32)], axis=1), bias, np.zeros((3, len(names))))
    check = np.flatnonzero(held) if held.any() else fit
    if len(check):
        logits, likely, seen = model.read([texts[i] for i in check])
        model.temperature = min(
            (2.0 ** (k / 4) for k in range(-16, 17)),
            key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(check)), y[check]] + 1e-12).sum())
        best = logits.argmax(axis=1)
        right = (best == y[check]) & (seen > 0)
        model.usual = _usual(likely, seen, np.where(right, y[check], -1), counts)
        # A label without a calibration text has no usual figure: nothing of it is rejected.
        model.usual[0, np.bincount(y[check][right], minlength=len(names)) == 0] = -np.inf
        found = np.sort(model.deviation(best, likely, seen)[right])
        if len(found):
            model.reject_below = min(-LEAST_DEVIATION, float(found[int(false_rejects * len(found))]))
    return model


def training_sample(docs: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> list:
    """At most ``per_label`` different texts of each label, those with the smallest hashes, in hash order.

    Labels are the ``MOST_LABELS`` with the most texts. Only texts whose hash is in the first 2 * ``per_label`` expected of
    their label are ranked, so no task gets more of a label, and copies of a text count once.
    """
    text = F.col("text").cast("string")
    labelled = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select(
        F.col("lang").cast("string").alias("lang"), F.xxhash64(text).alias("h"), text.alias("text"))
    sizes = labelled.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = F.broadcast(sizes.orderBy(F.desc("n"), "lang").limit(MOST_LABELS))  # MOST_LABELS rows
    place = F.col("h") / F.lit(float(1 << 64)) + 0.5
    near = labelled.join(sizes, "lang").filter(place * F.col("n") <= 2 * per_label).select("lang", "h", "text").distinct()
    first = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("k") <= per_label)
    return first.orderBy("h", "lang", "text").collect()


def fit(docs: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Model:
    """A model of the labels in ``docs`` (text, lang); rows without either are not learned from."""
    rows = training_sample(docs, per_label)
    return train([r["text"].encode() for r in rows], [r["lang"] for r in rows])


def _scored(model, at: int, first_kept: int):
    """A mapper of rows whose text is in column ``at``, whether it has a letter in column 0; kept columns come after those."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.value
        names = pa.array([*held.labels, UNKNOWN], pa.string())
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                texts = [t or b"" for t in part.column(at).cast(pa.binary()).to_pylist()]
                known = np.array(part.column(0).to_pylist(), dtype=bool)
                if held.labels:
                    best, score, odd = held.predict(texts)
                else:
                    best, score, known, odd = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts)), known & False, known
                best, score = np.where(known, best, len(held.labels)), np.where(known, score, 0.0)
                rejected = ~known | odd
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[first_kept:], names.take(pa.array(best)), pa.array(score), pa.array(rejected)],
                    names=[*part.schema.names[first_kept:], "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred, score (calibrated probability, 0 to 1) and rejected.

    A null text and one without any letter get ``und``, score 0 and are rejected; so does every text if the model has
    seen no label. A text unlike those that the predicted label was learned from is rejected too. Whole texts are read, however long. Only the column ``text`` is an input of a prediction, so repeated rows get
    the same result; a column of ``keep`` may be null; columns named as the new ones give way to them.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score", "rejected")]
    whole = F.col(text).cast("string")
    known = F.coalesce(whole.rlike(r"\p{L}"), F.lit(False)).alias("__known")
    # A text that is kept goes to Python once, as itself.
    once = text in keep and docs.schema[text].dataType.simpleString() == "string"
    rows = docs.select(known, *keep) if once else docs.select(known, whole.alias("__text"), *keep)
    at, first_kept = (1 + keep.index(text), 1) if once else (1, 2)
    held = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[first_kept:])
    return rows.mapInArrow(_scored(held, at, first_kept), f"{kinds}{', ' * bool(kinds)}lang_pred string, score double, rejected boolean")


def fold(docs: DataFrame, parts: int) -> F.Column:
    """crc32 of doc_id as text, modulo ``parts``; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def predictions(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of all documents, learned from those outside fold 1 of 3."""
    model = fit(docs.filter(fold(docs, 3) != 1))
    return identify(docs.select("doc_id", "text", (fold(docs, 3) == 1).alias("held_out")), model, ["doc_id", "held_out"])


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is recognised; those rejected go. Columns are kept."""
    model = fit(docs.filter(fold(docs, 3) != 1))
    names = [f"c{i}" for i in range(len(docs.columns))]
    return identify(docs.toDF(*names), model, names, names[docs.columns.index("text")]).filter(~F.col("rejected")).select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
