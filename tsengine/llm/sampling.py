"""Bounded samples of labelled rows, drawn alike at every size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows a classifier is fitted on at most: those with the smallest hashes of their ids. The bound keeps what the driver
#: holds and what is broadcast (ids and labels of the sample) the same at every size of the corpus.
FIT_ROWS = 16_384


def held_out(doc_id):
    """Whether a row's labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, text and y of at most so many labelled rows that are not held out; the sample's ids are broadcast."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")


def temperature(margin: np.ndarray, y: np.ndarray) -> float:
    """The divisor of margins that makes sigmoid(margin / t) likeliest on rows not used for fitting."""
    if len(y) == 0 or y.min() == y.max():
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [np.mean(np.logaddexp(0, np.where(y > 0, -margin, margin) / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
