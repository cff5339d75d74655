"""Quality classifier: random-indexing vectors, pooled per document, under a two-layer network.

Tokens are runs of letters and digits or runs of punctuation, hashed to `BUCKETS` slots (a bounded vocabulary). A slot's
index vector is sparse and random; its context vector is the sum, over the whole corpus, of the index vectors of its
neighbours. Each Spark task sums its own documents' contexts and the sums are added slot by slot, so the table that is
broadcast for scoring has `BUCKETS * DIM` numbers whatever the corpus. A document is the pooled vectors of its tokens.
The network is fitted in numpy on a bounded sample of labelled rows, a part of which sets the temperature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .sampling import FIT_ROWS, fit_sample, held_out, sigmoid, temperature
from .staging import arrow_map

BUCKETS, DIM, NONZERO, REACH = 1 << 14, 64, 4, 2
_rng = np.random.default_rng(5)
PLACE = _rng.integers(0, DIM, (BUCKETS, NONZERO))
SIGN = _rng.choice(np.array([-1, 1], np.int8), (BUCKETS, NONZERO))
INDEX = np.zeros((BUCKETS, DIM), np.float32)
np.add.at(INDEX, (np.arange(BUCKETS)[:, None], PLACE), SIGN)
PUNCT = ~tx.ALNUM & ~tx.SPACE
#: Bytes of text taken at a time: pooling holds several vectors for each distinct token, and every sum of contexts costs
#: a whole table.
POOL_BYTES, CONTEXT_BYTES = 1 << 17, 1 << 19


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the tokens in order, and the rows' offsets into them."""
    data, offsets = tx.flat(column)
    parts = [tx.spans(data, offsets, inside) for inside in (tx.ALNUM & ~tx.SPACE, PUNCT)]
    starts = np.concatenate([p[0] for p in parts])
    order = np.argsort(starts, kind="stable")
    ends = np.concatenate([p[1] for p in parts])[order]
    slots = (tx.span_hashes(data, starts[order], ends) % tx.U(BUCKETS)).astype(np.int64)
    return slots, parts[0][2] + parts[1][2]


def _contexts(batches):
    total = np.zeros(BUCKETS * DIM)
    for batch in batches:
        for piece in tx.slices(batch, "text", CONTEXT_BYTES):
            slots, offsets = tokens(piece.column("text"))
            rows = tx.row_of(offsets)
            for gap in range(1, REACH + 1):
                if len(slots) <= gap:
                    continue
                pair = np.flatnonzero(rows[gap:] == rows[:-gap])
                a, b = slots[pair], slots[pair + gap]
                for x, y in ((a, b), (b, a)):
                    total += np.bincount((x[:, None] * DIM + PLACE[y]).ravel(), SIGN[y].ravel(), BUCKETS * DIM)
    table = total.astype(np.int64).reshape(BUCKETS, DIM)
    used = np.flatnonzero(table.any(axis=1))
    values = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * DIM), pa.array(table[used].ravel()))
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), values], ["slot", "v"])


def context_table(docs: DataFrame) -> np.ndarray:
    """Unit context vectors of all slots, from every document. What reaches the driver is BUCKETS rows at most."""
    parts = arrow_map(docs.select("text"), _contexts, "slot int, v array<long>")
    sums = parts.groupBy("slot").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(DIM)]).alias("v")).toPandas()
    table = np.zeros((BUCKETS, DIM), np.float32)
    if len(sums):
        v = np.vstack(sums["v"].to_numpy()).astype(float)
        table[sums["slot"].to_numpy()] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1)
    return table


def pooled(column: pa.Array, contexts: np.ndarray) -> np.ndarray:
    """A row of features for each text: mean index and context vectors of its tokens, of its distinct ones, and sizes."""
    slots, offsets = tokens(column)
    rows = len(offsets) - 1
    key, times = np.unique(tx.row_of(offsets) * BUCKETS + slots, return_counts=True)
    slot, at = key % BUCKETS, np.searchsorted(key // BUCKETS, np.arange(rows + 1))
    n, m = np.diff(offsets), np.diff(at)
    some = np.flatnonzero(m)
    sums = np.zeros((rows, 3 * DIM), np.float32)
    if len(some):
        index, weight = INDEX[slot], times.astype(np.float32)[:, None]
        for k, values in enumerate((index * weight, contexts[slot] * weight, index)):
            sums[some, k * DIM : (k + 1) * DIM] = np.add.reduceat(values, at[:-1][some], axis=0)
    sums[:, : 2 * DIM] /= np.maximum(n, 1)[:, None]
    sums[:, 2 * DIM :] /= np.maximum(m, 1)[:, None]
    return np.hstack([sums, np.log1p(n)[:, None], np.log1p(m)[:, None], (m / np.maximum(n, 1))[:, None]])


FEATURES = 3 * DIM + 3


@dataclass
class Model:
    contexts: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    t: float = 1.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x) / self.t)


def fit(x: np.ndarray, y: np.ndarray, contexts: np.ndarray, hidden: int = 32, epochs: int = 40, decay: float = 1e-3) -> Model:
    """Adam on four fifths of the rows, the temperature on the rest. Without both labels the score is their mean."""
    rng = np.random.default_rng(3)
    d = x.shape[1]
    model = Model(contexts, x.mean(axis=0) if len(x) else np.zeros(d), x.std(axis=0) + 1e-6 if len(x) else np.ones(d), rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), np.zeros(hidden), 0.0)
    if len(y) == 0 or y.min() == y.max():
        model.b2 = 0.0 if len(y) == 0 else 20.0 * (2 * float(y[0]) - 1)
        return model
    apart = rng.random(len(y)) < 0.2 if len(y) >= 50 else np.zeros(len(y), bool)
    z, t = np.clip((x[~apart] - model.mean) / model.scale, -8, 8), y[~apart].astype(float)
    p = [model.w1, model.b1, model.w2, np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(t)), max(1, len(t) // 64)):
            step += 1
            h = np.tanh(z[rows] @ p[0] + p[1])
            g = (sigmoid(h @ p[2] + p[3]) - t[rows]) / len(rows)
            back = g[:, None] * p[2] * (1 - h * h)
            grads = [z[rows].T @ back + decay * p[0], back.sum(axis=0), h.T @ g + decay * p[2], g.sum(keepdims=True)]
            for k, grad in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                p[k] -= 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = p[0], p[1], p[2], float(p[3][0])
    model.t = temperature(model.margin(x[apart]), y[apart])
    return model


def _featurizer(contexts):
    def run(batches):
        for batch in batches:
            for piece in tx.slices(batch, "text", POOL_BYTES):
                x = pooled(piece.column("text"), contexts.value)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES), pa.array(x.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("y").cast(pa.int32()), values], ["doc_id", "y", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Context vectors from all of docs, the network from at most rows labelled documents that are not held out."""
    spark = docs.sparkSession
    contexts = context_table(docs)
    sample = arrow_map(fit_sample(docs, labels, "quality", rows), _featurizer(spark.sparkContext.broadcast(contexts)), "doc_id long, y int, x array<float>").toPandas().sort_values("doc_id", kind="stable")
    x = np.vstack(sample["x"].to_numpy()).astype(float) if len(sample) else np.zeros((0, FEATURES))
    return fit(x, sample["y"].to_numpy(), contexts)


def _scorer(model):
    def run(batches):
        for batch in batches:
            for piece in tx.slices(batch, "text", POOL_BYTES):
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(model.value.score(pooled(piece.column("text"), model.value.contexts)))], ["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.3, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs.

    Scores depend on the text alone; null and empty texts have the features of no token and get a score too. Labels
    other than 0 and 1, and labels of held-out or null ids, are not learnt from; of repeated labels the larger counts.
    A row with a null id is held out. Other columns are ignored, repeated rows are scored one by one. Without labels
    every score is 0.5, with labels of one kind about that label.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))
    scored = arrow_map(docs, _scorer(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def _keeper(model, cut: float, text_col: str):
    def run(batches):
        for batch in batches:
            for piece in tx.slices(batch, text_col, POOL_BYTES):
                yield piece.filter(pa.array(model.value.score(pooled(piece.column(text_col), model.value.contexts)) >= cut))

    return run


def keep_quality(docs: DataFrame, labels: DataFrame, cut: float = 0.3, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose texts score at least cut (`quality_scores` says how)."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(named, labels, rows))
    return arrow_map(docs, _keeper(model, cut, text_col), docs.schema)
