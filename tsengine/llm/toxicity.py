"""Toxicity classifier: a linear model on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams (of `SIZES` bytes, A-Z lower-cased, white space runs as they are) it holds,
hashed to `BUCKETS` slots. For each slot, the log ratio of its smoothed rates in toxic and other fitted documents scales
the feature; a logistic regression on the scaled features gives the margin. N-grams whose ratio cannot be told from
chance get no weight, so scoring looks at a small part of a text's n-grams.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .sampling import FIT_ROWS, fit_sample, held_out, sigmoid, temperature
from .staging import arrow_map

SIZES, BUCKETS = (4, 5, 6), 1 << 20
#: Slots with a weight: all whose log-likelihood ratio between the two classes is larger.
GAIN = 6


def ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all n-grams, and the text of each."""
    data, offsets = tx.flat(column)
    data, rows = tx.LOWER[data], tx.row_of(offsets)
    left = offsets[1:][rows] - np.arange(len(data)) if len(data) else np.zeros(0, np.int64)
    window = np.zeros(len(data), tx.U)
    slots, texts = [], []
    for k in range(max(SIZES)):
        window[: max(len(data) - k, 0)] |= data[k:].astype(tx.U) << tx.U(8 * k)
        if k + 1 in SIZES:
            at = np.flatnonzero(left > k)
            slots.append((tx.mix(window[at] + tx.U((k + 1) << 56)) % tx.U(BUCKETS)).astype(np.int32))
            texts.append(rows[at].astype(np.int32))
    return np.concatenate(slots), np.concatenate(texts)


def present(slots: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct slots, by text and slot where they are few, else in no order."""
    key = texts.astype(np.int64) * BUCKETS + slots
    key = np.unique(key) if len(key) < 65_536 else pd.unique(key)
    return (key % BUCKETS).astype(np.int32), (key // BUCKETS).astype(np.int32)


def _counter(batches):
    counts = np.zeros((2, BUCKETS), np.int64)
    seen = np.zeros(2, np.int64)
    for batch in batches:
        for piece in tx.slices(batch, "text", 1 << 20):
            y = piece.column("y").to_numpy()
            slots, texts = present(*ngrams(piece.column("text")))
            for c in (0, 1):
                counts[c] += np.bincount(slots[y[texts] == c], minlength=BUCKETS)
                seen[c] += (y == c).sum()
    some = np.flatnonzero(counts.any(axis=0))
    slot = np.append(some, -1).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.append(counts[0][some], seen[0])), pa.array(np.append(counts[1][some], seen[1]))], ["slot", "n0", "n1"])


def _finder(slots):
    """The chosen slots that each fitted text holds."""

    def run(batches):
        place = np.full(BUCKETS, -1, np.int32)
        place[slots] = np.arange(len(slots))
        for batch in batches:
            for piece in tx.slices(batch, "text", 1 << 20):
                found, texts = ngrams(piece.column("text"))
                hit = place[found] >= 0
                found, texts = present(found[hit], texts[hit])
                order = np.lexsort((found, texts))
                found, texts = found[order], texts[order]
                at = np.searchsorted(texts, np.arange(piece.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("y").cast(pa.int32()), pa.ListArray.from_arrays(pa.array(at), pa.array(place[found]))], ["doc_id", "y", "x"])

    return run


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    t: float = 1.0

    def score(self, column: pa.Array) -> np.ndarray:
        slots, texts = ngrams(column)
        hit = self.weight[slots] != 0
        slots, texts = present(slots[hit], texts[hit])
        return sigmoid((self.bias + np.bincount(texts, self.weight[slots], len(column))) / self.t)


def choose(n0: np.ndarray, n1: np.ndarray, d0: int, d1: int, least: float = GAIN) -> tuple[np.ndarray, np.ndarray]:
    """The slots that tell the classes apart, the best first, and their log-count ratios."""
    p, q = (n1 + 1) / (d1 + 2), (n0 + 1) / (d0 + 2)
    ratio = np.log(p / (1 - p)) - np.log(q / (1 - q))
    pooled = (n0 + n1 + 1) / (d0 + d1 + 2)
    part = lambda n, d, r: n * np.log(np.maximum(r, 1e-12) / pooled) + (d - n) * np.log(np.maximum(1 - r, 1e-12) / (1 - np.minimum(pooled, 1 - 1e-9)))
    gain = part(n1, d1, n1 / max(d1, 1)) + part(n0, d0, n0 / max(d0, 1))
    order = np.argsort(-gain, kind="stable")
    order = order[gain[order] > least]
    return order, ratio[order]


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, epochs: int = 30, decay: float = 1e-4, gain: float = GAIN) -> Model:
    """Fitted on at most rows labelled documents that are not held out. The driver gets BUCKETS counts at most.

    Without toxic examples every score is about 0, and without others about 1.
    """
    sample = fit_sample(docs, labels, "toxic", rows)
    counts = arrow_map(sample, _counter, "slot int, n0 long, n1 long").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    n = np.zeros((2, BUCKETS + 1), np.int64)
    n[:, counts["slot"].to_numpy()] = counts[["n0", "n1"]].to_numpy().T
    (d0, d1), n = n[:, -1], n[:, :-1]
    weight = np.zeros(BUCKETS, np.float32)
    if not d0 or not d1:
        return Model(weight, 20.0 if d1 else -20.0)
    slots, ratio = choose(n[0], n[1], d0, d1, gain)
    # slots of all texts stay as Arrow sent them, one after the other; texts are taken by id
    found = arrow_map(sample, _finder(slots), "doc_id long, y int, x array<int>").toArrow()
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")
    y, lists = found.column("y").to_numpy()[order], found.column("x").combine_chunks()
    del counts, found
    x, at = lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
    start, length = at[:-1][order], np.diff(at)[order]
    apart = np.random.default_rng(4).random(len(y)) < 0.2 if len(y) >= 50 else np.zeros(len(y), bool)
    use = np.flatnonzero(~apart)

    def held(part):
        """The chosen slots of some texts, and the text of each."""
        size = length[part]
        own = np.repeat(start[part] - np.concatenate([np.zeros(min(len(part), 1), np.int64), np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return x[own], np.repeat(np.arange(len(part)), size)

    def margins(w, b, part):
        f, who = held(part)
        return b + np.bincount(who, ratio[f] * w[f], len(part))

    w, b = np.full(len(slots), 0.1), float(np.log(d1 / d0))
    rng, g2, step = np.random.default_rng(6), np.full(len(slots) + 1, 1e-3), 0.2
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(use), max(1, len(use) // 64)):
            f, who = held(part)
            error = (sigmoid(b + np.bincount(who, ratio[f] * w[f], len(part))) - y[part]) / len(part)
            grad = np.append(np.bincount(f, error[who] * ratio[f], len(slots)) + decay * w, error.sum())
            g2 += grad * grad
            move = step * grad / np.sqrt(g2)
            w, b = w - move[:-1], b - move[-1]
    weight[slots] = ratio * w
    return Model(weight, float(b), temperature(margins(w, b, np.flatnonzero(apart)), y[apart]))


def _scorer(model):
    def run(batches):
        for batch in batches:
            for piece in tx.slices(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(model.value.score(piece.column("text")))], ["doc_id", "score"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.5, rows: int = FIT_ROWS, gain: float = GAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs.

    Scores depend on the text alone; texts shorter than an n-gram, null and empty ones get the model's base rate.
    Without a toxic example to learn from every score is about 0, without any other about 1. Labels other than 0 and 1,
    and labels of held-out or null ids, are not learnt from; of repeated labels the larger counts. A row with a null id is
    held out. Other columns are ignored, repeated rows are scored one by one. N-grams whose log-likelihood ratio is gain
    or less get no weight.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows, gain=gain))
    scored = arrow_map(docs, _scorer(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
