"""Licence scan: a trained paragraph classifier whose predictions templates confirm.

A paragraph is a line of text. Its features are its distinct words and word pairs, hashed to `BUCKETS` slots and scaled
to unit length; a sparse multinomial logistic regression over them names one of the licence families or "unknown". It is
trained on the families' notices (`licence_texts.py`) and on variants of them with words dropped and foreign words
around them, short ones as they are; the unknown class is trained on paragraphs of the corpus itself (a sample bounded
by `FIT_PARAGRAPHS`) and on paragraphs that merely speak of licences. A temperature, set on other paragraphs of the
corpus and other variants, calibrates the probabilities, so that "unknown" wins where no family is likely. A predicted
family is confirmed if enough of the word pairs of one of its templates stand in the paragraph, or enough of the
paragraph's in a template, or if its words are those of a short notice: a heading, an SPDX identifier, "All rights
reserved.".
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .licence_texts import NOTICES, TEMPLATES, UNKNOWN
from .staging import arrow_map

BUCKETS = 1 << 15
#: Paragraphs of the corpus that the unknown class is fitted on at most: those with the smallest hashes of their
#: texts, among those of at most FIT_BYTES bytes. As many again set the temperature.
FIT_PARAGRAPHS, FIT_BYTES = 4096, 2000
#: The least probability of a family, and the least share of word pairs for its confirmation.
LIKELY, CONFIRMED = 0.5, 0.6
FAMILIES = list(TEMPLATES)
CLASSES = [*FAMILIES, "unknown"]
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def line_offsets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all lines (their newline included), and the rows' offsets into the lines; an empty text is one line."""
    ends = np.flatnonzero(data == 10) + 1
    ends = ends[~np.isin(ends, offsets[1:])] if len(ends) else ends
    starts = np.sort(np.concatenate([offsets[:-1], ends]), kind="stable")
    own = np.concatenate([[0], np.cumsum(1 + np.diff(np.searchsorted(ends, offsets, "left")))])
    return np.append(starts, len(data)), own


def features(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the words and word pairs of each line, and the line of each."""
    line = tx.row_of(rows)
    pair = np.flatnonzero(line[1:] == line[:-1]) if len(line) else np.zeros(0, np.int64)
    pairs = tx.mix(words[pair] * tx.U(3) + words[pair + 1]) if len(pair) else words[:0]
    slots = np.concatenate([words, pairs]) % tx.U(BUCKETS)
    return slots.astype(np.int64), np.concatenate([line, line[pair]])


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots, line and value of the features of single-line texts."""
    data, offsets = tx.flat(pa.array(texts, pa.string()))
    slots, line = features(*tx.words(data, offsets, tx.ALNUM & ~tx.SPACE))
    key = np.unique(line * BUCKETS + slots)
    line, slots = key // BUCKETS, key % BUCKETS
    return slots, line, 1 / np.sqrt(np.maximum(np.bincount(line, minlength=len(texts)), 1))[line]


def word_list(text: str) -> list[str]:
    data, offsets = tx.flat(pa.array([text], pa.string()))
    starts, ends, _ = tx.spans(data, offsets, tx.ALNUM & ~tx.SPACE)
    low = tx.LOWER[data].tobytes()
    return [low[a:b].decode(errors="replace") for a, b in zip(starts, ends, strict=True)]


def pairs_of(words: list[str]) -> set:
    return set(zip(words, words[1:], strict=False)) or {tuple(words)}


_TEMPLATE_PAIRS = {f: [pairs_of(word_list(t)) for t in texts] for f, texts in TEMPLATES.items()}
_NOTICE_WORDS = {f: {tuple(word_list(t)) for t in texts} for f, texts in NOTICES.items()}


def template_share(words: list[str], family: str) -> float:
    """The largest share of word pairs held in common with a template of the family, of either's pairs; 1 for a notice."""
    if tuple(words) in _NOTICE_WORDS[family]:
        return 1.0
    own = pairs_of(words)
    return max((len(own & t) / min(len(own), len(t)) if min(len(own), len(t)) >= 3 else float(own == t) for t in _TEMPLATE_PAIRS[family]), default=0.0)


def speaks_for_none(text: str) -> bool:
    """Whether no family's templates or notices would confirm the paragraph."""
    words = word_list(text)
    return all(template_share(words, f) < CONFIRMED for f in FAMILIES)


def variants(corpus: list[str], seed: int, times: int) -> tuple[list[str], np.ndarray]:
    """Training paragraphs and their classes."""
    rng = np.random.default_rng(seed)
    foreign = [w for t in corpus[:512] for w in t.split()][:4096] or ["word"]
    texts, y = [], []
    for k, family in enumerate(FAMILIES):
        for t in TEMPLATES[family]:
            words = t.split()
            for v in range(times):
                kept = words if v == 0 else [w for w in words if rng.random() > 0.12 * rng.random()]
                if v % 3 == 1:
                    extra = [str(foreign[i]) for i in rng.integers(0, len(foreign), rng.integers(1, 8))]
                    kept = [*extra, *kept] if v % 2 else [*kept, *extra]
                texts.append(" ".join(kept))
                y.append(k)
        for t in NOTICES[family] * times:
            texts.append(t)
            y.append(k)
    plain = [t for t in corpus if speaks_for_none(t)]
    shuffled = [" ".join(rng.permutation(t.split()).tolist()[: int(rng.integers(3, 9))]) for ts in TEMPLATES.values() for t in ts for _ in range(times // 4)]
    for t in [*plain, *UNKNOWN * max(1, times // 2), *shuffled, ""]:
        texts.append(t)
        y.append(len(FAMILIES))
    return texts, np.array(y)


@dataclass
class Model:
    weight: np.ndarray
    bias: np.ndarray
    t: float = 1.0

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        z = margins / self.t
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def margins(self, slots: np.ndarray, line: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Lines must be ascending."""
        out = np.tile(self.bias, (n, 1))
        at = np.flatnonzero(np.diff(line, prepend=-1))
        if len(at):
            out[line[at]] += np.add.reduceat(self.weight[slots] * value[:, None], at, axis=0)
        return out


def fit(corpus: list[str], epochs: int = 12) -> Model:
    """Adagrad on variants of the templates and half the corpus's paragraphs, with a sparsifying shrinkage at the end.

    The other half is never fitted on and sets the temperature. Paragraphs are taken as they come, so they should be in
    no order that tells them apart.
    """
    half = (len(corpus) + 1) // 2
    texts, y = variants(corpus[:half], 1, 24)
    slots, line, value = vectors(texts)
    at = np.searchsorted(line, np.arange(len(texts) + 1))
    k, rng = len(CLASSES), np.random.default_rng(2)
    model = Model(np.zeros((BUCKETS, k), np.float32), np.zeros(k, np.float32))
    g2, gb = np.full((BUCKETS, k), 1e-2, np.float32), np.full(k, 1e-2, np.float32)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 128)):
            rows = np.sort(rows)
            size = at[rows + 1] - at[rows]
            own = np.repeat(at[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
            who = np.repeat(np.arange(len(rows)), size)
            p = model.probabilities(model.margins(slots[own], who, value[own], len(rows)))
            p[np.arange(len(rows)), y[rows]] -= 1
            used, where = np.unique(slots[own], return_inverse=True)
            grad = np.zeros((len(used), k), np.float32)
            np.add.at(grad, where, p[who] * value[own][:, None] / len(rows))
            g2[used] += grad * grad
            model.weight[used] -= 0.5 * grad / np.sqrt(g2[used])
            b = p.mean(axis=0)
            gb += b * b
            model.bias -= 0.5 * b / np.sqrt(gb)
    model.weight[np.abs(model.weight) < 1e-3] = 0
    texts, y = variants(corpus[half:], 9, 8)
    margins = model.margins(*vectors(texts), len(texts))
    grid = np.exp(np.linspace(np.log(0.1), np.log(10), 81))
    loss = []
    for t in grid:
        z = margins / t
        loss.append(np.mean(np.logaddexp.reduce(z, axis=1) - z[np.arange(len(y)), y]))
    model.t = float(grid[int(np.argmin(loss))])
    return model


def corpus_paragraphs(docs: DataFrame, limit: int = 2 * FIT_PARAGRAPHS) -> list[str]:
    """At most limit distinct paragraphs of 1 to FIT_BYTES bytes, from all documents, chosen by their hashes alone."""
    lines = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))
    lines = lines.where(F.octet_length("line").between(1, FIT_BYTES)).select("line", F.xxhash64("line").alias("h"))
    last = lines.select("h").distinct().orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    if last is None:
        return []
    return [r["line"] for r in lines.where(F.col("h") <= last).groupBy("h").agg(F.min("line").alias("line")).orderBy("h").collect()]


def scan(column: pa.Array, model: Model):
    """(row, paragraph, start byte, end byte, family, probability, share) of confirmed paragraphs, and paragraphs of each row."""
    data, offsets = tx.flat(column)
    at, own = line_offsets(data, offsets)
    words, rows = tx.words(data, at, tx.ALNUM & ~tx.SPACE)
    slots, line = features(words, rows)
    key = np.sort(line * BUCKETS + slots)
    key = key[np.diff(key, prepend=-1) != 0]
    line, slots = key // BUCKETS, key % BUCKETS
    n = len(at) - 1
    value = (1 / np.sqrt(np.maximum(np.bincount(line, minlength=n), 1)))[line].astype(np.float32)
    p = model.probabilities(model.margins(slots, line, value, n))
    best = p[:, :-1].argmax(axis=1)
    found = []
    for k in np.flatnonzero(p[np.arange(n), best] >= LIKELY):
        text = data[at[k] : at[k + 1]].tobytes().decode(errors="replace").rstrip("\n")
        family = FAMILIES[best[k]]
        share = template_share(word_list(text), family)
        if share >= CONFIRMED:
            row = int(np.searchsorted(own, k, "right")) - 1
            found.append((row, int(k - own[row]), int(at[k] - offsets[row]), int(at[k + 1] - offsets[row]), family, float(p[k, best[k]]), share))
    return found, np.diff(own)


FOUND = pa.list_(pa.struct([("paragraph", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("share", pa.float64())]))
ROWS = "doc_id long, n_paragraphs long, found array<struct<paragraph long, start long, stop long, family string, probability double, share double>>"


def _scanner(model):
    def run(batches):
        for batch in batches:
            for piece in tx.slices(batch, "text", 1 << 20):
                hits, counts = scan(piece.column("text"), model.value)
                lists: list[list] = [[] for _ in range(piece.num_rows)]
                for row, *rest in hits:
                    lists[row].append(dict(zip(("paragraph", "start", "stop", "family", "probability", "share"), rest, strict=True)))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(lists, FOUND)], ["doc_id", "n_paragraphs", "found"])

    return run


def scan_licences(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_paragraphs and found (paragraph, byte range, family, probability, share) of every row of docs.

    Null and empty texts are one empty paragraph and hold no licence; a newline at the end of a text opens no other. Of
    families equally likely the first in the order of FAMILIES is predicted. Rows with null or repeated ids are scanned
    one by one. Other columns are ignored. Without a model one is fitted, its unknown class on docs.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = model or fit(corpus_paragraphs(texts))
    return arrow_map(texts, _scanner(docs.sparkSession.sparkContext.broadcast(model)), ROWS)


def licence_summary(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_paragraphs, n_licensed and families (distinct, ascending, joined by commas)."""
    out = scan_licences(docs)
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"]))), ",")
    return out.select("doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_licensed"), families.alias("families"))
