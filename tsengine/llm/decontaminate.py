"""Benchmark decontamination by SimHash fingerprints of item-sized windows, confirmed by weighted shingle similarity.

An item contaminates a document if some window of as many words as the item has (the whole document, if it is shorter)
has a weighted similarity of at least `SIMILARITY` with it: the shared weight over the united weight of both multisets
of five-word shingles, a shingle weighing the bytes of its words.

1. Items of as many shingles form a size. Windows of a size are fingerprinted: a 64-bit SimHash of the window's weighted
   shingles, slid along by prefix sums. A window without any shingle of the size's items has a similarity of 0 with all
   of them, so such windows are left out beforehand, without loss (`Index.known` tells which sizes hold a shingle).
2. Multi-index: fingerprints are cut into `BLOCKS` blocks. Two fingerprints within `RADIUS` bits agree in some block but
   for `RADIUS // BLOCKS` bits, so for each block a table lists, for every value, the items that come so close. Looking a
   window's blocks up yields every item of its size within the radius; whole fingerprints then tell which are.
3. What is within the radius is confirmed on the multisets themselves. A pair at the similarity bound differs in about
   10 of 64 bits; that it differs in more than `RADIUS` has a probability of a few in a million.

Documents are read once for each block of `ITEM_BYTES` of benchmark text; a block's index is broadcast, which bounds
what is broadcast whatever the benchmark's size. There is no shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .staging import arrow_map

U = np.uint64
WORDS, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 23, 8
ITEM_BYTES = 8 << 20
#: Pairs of windows and items that are looked up at a time.
CHUNK = 1 << 14
_BITS = np.arange(64, dtype=U)


def parse(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, word sizes in bytes and the rows' offsets; words are runs of letters, digits and non-ASCII bytes."""
    data, offsets = tx.flat(column)
    starts, ends, rows = tx.spans(data, offsets, tx.ALNUM & ~tx.SPACE)
    return tx.span_hashes(tx.LOWER[data], starts, ends), ends - starts, rows


def weighted(words: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles, their weights and the rows' offsets into them."""
    shingles, at = tx.shingles(words, offsets, size)
    done = np.concatenate([[0], np.cumsum(sizes)])
    rows = tx.row_of(at)
    first = offsets[:-1][rows] + np.arange(len(shingles)) - at[:-1][rows]
    return shingles, done[np.minimum(first + size, offsets[1:][rows])] - done[first], at


def simhash(shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of the windows of n shingles that begin at starts."""
    sums = np.zeros((len(shingles) + 1, 64), np.int64)
    signs = ((shingles[:, None] >> _BITS) & U(1)).astype(np.int64) * 2 - 1
    np.cumsum(signs * weights[:, None], axis=0, out=sums[1:])
    positive = sums[np.minimum(starts + n, len(shingles))] - sums[starts] > 0
    return np.packbits(positive, axis=1, bitorder="little").view(U).ravel()


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Shared over united weight of two multisets of shingles."""
    values, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    ca = np.bincount(where[: len(a)], wa, len(values))
    cb = np.bincount(where[len(a) :], wb, len(values))
    return float(np.minimum(ca, cb).sum() / max(np.maximum(ca, cb).sum(), 1))


class MultiIndex:
    """Fingerprints by blocks: for each block and value, those that differ from it in RADIUS // BLOCKS bits at most."""

    def __init__(self, prints: np.ndarray):
        self.prints, self.tables = prints, None

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (place in prints, place in the index) of fingerprints within the radius, by the former."""
        width = 64 // BLOCKS
        if self.tables is None:  # made where they are used, they are not sent
            values, low = np.arange(1 << width, dtype=U), U((1 << width) - 1)
            self.tables = [np.bitwise_count(values[:, None] ^ ((self.prints >> U(b * width)) & low)) <= RADIUS // BLOCKS for b in range(BLOCKS)]
        found = np.zeros((len(prints), len(self.prints)), bool)
        for b, table in enumerate(self.tables):
            found |= table[((prints >> U(b * width)) & U((1 << width) - 1)).astype(np.int64)]
        window, item = np.nonzero(found)
        near = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
        return window[near], item[near]


class Size:
    """The items of one number of shingles, and their fingerprints."""

    def __init__(self, n: int, items: list[int], shingles: list, weights: list):
        self.n, self.items = n, items
        self.shingles, self.weights = [shingles[k] for k in items], [weights[k] for k in items]
        self.index = MultiIndex(np.concatenate([simhash(x, w, np.zeros(1, np.int64), n) for x, w in zip(self.shingles, self.weights, strict=True)]))

    def best(self, shingles: np.ndarray, weights: np.ndarray, hits: np.ndarray) -> dict[int, tuple[float, int]]:
        """Similarity and start of the most similar window (the first of equals) of each item that one is similar to.

        hits are the places of shingles that items of this size hold.
        """
        n = min(self.n, len(shingles))
        last = len(shingles) - n
        # starts of windows of n shingles that hold a hit, as a union of ranges
        edge = np.zeros(last + 2, np.int64)
        np.add.at(edge, np.clip(hits - n + 1, 0, last), 1)
        np.add.at(edge, np.minimum(hits, last) + 1, -1)
        starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        found: dict[int, tuple[float, int]] = {}
        size = max(CHUNK // len(self.items), 1)
        for k in range(0, len(starts), size):
            part = starts[k : k + size]
            for run in np.split(part, np.flatnonzero(np.diff(part) > n) + 1):
                base, end = run[0], run[-1] + n
                prints = simhash(shingles[base:end], weights[base:end], run - base, n)
                for w, j in zip(*(x.tolist() for x in self.index.within(prints)), strict=True):
                    s = int(run[w])
                    value = similarity(shingles[s : s + n], weights[s : s + n], self.shingles[j], self.weights[j])
                    if value >= SIMILARITY and value > found.get(j, (0.0, 0))[0]:
                        found[j] = (value, s)
        return found


class Index:
    """A block of the benchmark: items by size, and for shingles of each number of words the sizes that hold them."""

    def __init__(self, item_ids: list, texts: list):
        words, sizes, rows = parse(pa.array(texts, pa.string()))
        shingles, weights, at = weighted(words, sizes, rows)
        self.ids, self.n_words = item_ids, np.diff(rows)
        own = [shingles[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        weight = [weights[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        members = defaultdict(list)
        for k, x in enumerate(own):
            if len(x):
                members[min(int(self.n_words[k]), WORDS), len(x)].append(k)
        self.by_width: dict[int, tuple] = {}
        for width in sorted({w for w, _ in members}):
            groups = [Size(n, members[w, n], own, weight) for w, n in sorted(members) if w == width]
            pairs = np.unique(np.concatenate([np.stack([np.concatenate(g.shingles), np.full(sum(map(len, g.shingles)), k, U)]) for k, g in enumerate(groups)], axis=1), axis=1)
            known, first = np.unique(pairs[0], return_index=True)
            maybe = np.zeros(1 << 20, bool)
            maybe[(known & U(0xFFFFF)).astype(np.int64)] = True
            self.by_width[width] = (groups, known, np.append(first, pairs.shape[1]), pairs[1].astype(np.int64), maybe)

    def find(self, column: pa.Array):
        """(row, item, start word, words, similarity) of each contaminated row and item; the most similar window."""
        words, sizes, rows = parse(column)
        for width, (groups, known, first, group_of, maybe) in self.by_width.items():
            shingles, weights, at = weighted(words, sizes, rows, width)
            place = np.flatnonzero(maybe[(shingles & U(0xFFFFF)).astype(np.int64)])
            slot = np.minimum(np.searchsorted(known, shingles[place]), len(known) - 1)
            ok = known[slot] == shingles[place]
            # a document of fewer words has one odd shingle, which belongs to items of its width alone
            ok &= np.diff(rows)[np.searchsorted(at, place, "right") - 1] >= width
            place, slot = place[ok], slot[ok]
            times = first[slot + 1] - first[slot]
            place = np.repeat(place, times)
            group = group_of[np.repeat(first[slot] - np.cumsum(times) + times, times) + np.arange(times.sum())]
            row = np.searchsorted(at, place, "right") - 1
            order = np.lexsort((place, group, row))
            place, group, row = place[order], group[order], row[order]
            cuts = np.flatnonzero((np.diff(row) != 0) | (np.diff(group) != 0)) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(place)), strict=True) if len(place) else ():
                r, size = int(row[a]), groups[group[a]]
                for j, (value, start) in sorted(size.best(shingles[at[r] : at[r + 1]], weights[at[r] : at[r + 1]], place[a:b] - at[r]).items()):
                    item = size.items[j]
                    yield r, item, start, min(int(self.n_words[item]), int(rows[r + 1] - rows[r])), value


def _finder(index):
    def run(batches):
        for batch in batches:
            for piece in tx.slices(batch, "text"):
                doc_ids = piece.column("doc_id").to_pylist()
                items = defaultdict(list)
                for r, j, start, n, value in index.value.find(piece.column("text")):
                    items[r].append({"item_id": index.value.ids[j], "start_word": start, "n_words": n, "similarity": value})
                rows = [items.get(r, []) for r in range(piece.num_rows)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(rows, MATCHES)], ["doc_id", "matches"])

    return run


MATCHES = pa.list_(pa.struct([("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())]))
MATCH_ROWS = "doc_id long, matches array<struct<item_id long, start_word long, n_words long, similarity double>>"


def indexes(benchmark: DataFrame) -> list:
    """Broadcast indexes of the benchmark's blocks; at least one, maybe empty."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // ITEM_BYTES) or 1
    out = []
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        out.append(spark.sparkContext.broadcast(Index([r["item_id"] for r in rows], [r["text"] for r in rows])))
    return out


def find_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and matches (item_id, start_word, n_words, similarity) of every row of docs, once per benchmark block.

    Texts are taken whole, A-Z lower-cased. Null and empty texts match nothing, items without words match nothing, items
    of fewer than five words are one shingle and match where they stand in full. Rows repeated under one id and items
    repeated are matched one by one. Of an item's windows in a text the most similar one is given, of equally similar
    ones the first. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return reduce(DataFrame.unionByName, [arrow_map(texts, _finder(index), MATCH_ROWS) for index in indexes(benchmark)])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items and item_ids (ascending, of all blocks).

    Rows under one id, or without an id, are one document here: it has the items of all of them.
    """
    # ids and the few matches are shuffled, never texts; a document has a row for each block of the benchmark
    found = find_matches(docs, benchmark).groupBy("doc_id").agg(F.flatten(F.collect_list("matches")).alias("matches"))
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"))


def _cleaner(index):
    def run(batches):
        for batch in batches:
            for piece in tx.slices(batch, "text"):
                bad = {r for r, *_ in index.value.find(piece.column("text"))}
                yield piece.filter(pa.array([r not in bad for r in range(piece.num_rows)]))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that no item contaminates."""
    for index in indexes(benchmark):
        docs = arrow_map(docs, _cleaner(index), docs.schema)
    return docs
