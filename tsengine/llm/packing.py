"""Variable-capacity best-fit packing of documents into training sequences.

Documents are measured in token ids with an end id. What exceeds the largest permitted length is cut into full pieces,
each a sequence of its own, and a rest. Pieces are packed by decreasing length into the open bin they fill best; if none
has room, a bin is opened. What a sequence of length c costs is `overhead + c + c * c / attention`: its own overhead, a
share for each token, padding included, and a share for each pair of tokens, equal to the tokens' at c = attention. So a
long bin pays only where pieces need it or fill what shorter ones would waste.

Which length to open is optimised for all permitted lengths jointly: a policy names, for pieces of each class (those
that a permitted length is the shortest for), the length to open. Every policy that opens one length for all that fits
it is packed, the cheapest is improved class by class until no change of one class is cheaper, and what it packs is
kept. At last each bin is downsized to the shortest permitted length that holds its contents.

Only ids and token counts are shuffled: they are dealt by a hash into groups of about `window` documents, so bins don't
depend on how the input is divided, and memory is bounded by `TASK_WINDOWS` windows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from . import tokens
from .staging import arrow_map, stage

CAPACITIES, OVERHEAD, ATTENTION, WINDOW, TASK_WINDOWS = (512, 1024, 2048, 4096, 8192), 32, 24_576, 8192, 4
PACKED = "doc_id long, piece int, start long, length long, bin_id long, bin_size int, bin_offset int"


def sequence_cost(sizes: np.ndarray, overhead: float = OVERHEAD, attention: float = ATTENTION) -> np.ndarray:
    """What sequences of these lengths cost, in tokens."""
    return overhead + sizes + sizes.astype(float) ** 2 / attention


def fill_bins(ordered: list[int], opened: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The bin and the offset in it of each piece, and the bins' contents; pieces come by decreasing length.

    Each goes to the open bin with the least room that holds it; opened has the length to open for each of them.
    """
    bins, offsets, fill = [], [], []
    room: dict[int, list[int]] = {}
    free = 0  # bit r is set if an open bin has room for r
    for n, size in zip(ordered, opened, strict=True):
        fits = free >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free &= ~(1 << r)
        else:
            r, b = size, len(fill)
            fill.append(0)
        bins.append(b)
        offsets.append(fill[b])
        fill[b] += n
        if r > n:
            room.setdefault(r - n, []).append(b)
            free |= 1 << (r - n)
    return bins, offsets, fill


def best_fit(lengths: np.ndarray, capacities: Sequence[int] = CAPACITIES, overhead: float = OVERHEAD, attention: float = ATTENTION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin, the offset in it and the bin's size of each piece; pieces are 1 to max(capacities) long."""
    sizes = np.array(sorted(set(capacities)), np.int64)
    if not len(lengths):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(-lengths, kind="stable")
    ordered, kind = lengths[order].tolist(), np.searchsorted(sizes, lengths[order])
    classes = sorted(set(kind.tolist()))
    packed: dict[tuple, tuple] = {}

    def pack(policy):
        if policy not in packed:
            bins, offsets, fill = fill_bins(ordered, sizes[np.array(policy)][kind].tolist())
            own = sizes[np.searchsorted(sizes, fill)]
            packed[policy] = (float(sequence_cost(own, overhead, attention).sum()), bins, offsets, own)
        return packed[policy][0]

    every = range(len(sizes))
    best = min((tuple(max(k, least) for k in every) for least in every), key=pack)
    better = True
    while better:
        better = False
        for k in classes:
            for other in range(k, len(sizes)):
                changed = (*best[:k], other, *best[k + 1 :])
                if pack(changed) < pack(best):
                    best, better = changed, True
    _, bins, offsets, own = packed[best]
    out = np.zeros((3, len(lengths)), np.int64)
    out[0, order], out[1, order], out[2, order] = bins, offsets, own[np.array(bins)]
    return out[0], out[1], out[2]


def cut(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, number, start and length of each piece."""
    n = np.maximum(1, -(-lengths // most))
    row = np.repeat(np.arange(len(lengths)), n)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, piece, piece * most, np.minimum(most, lengths[row] - piece * most)


def _measurer(name: str):
    def run(batches):
        for piece in tx.gathered(batches, "text", tokens.TEXT_BYTES // 2):
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(tokens.count(piece.column("text"), name) + 1)], ["doc_id", "n"])

    return run


def _packer(capacities: tuple[int, ...], overhead: float, attention: float, most: int):
    def packed(ids: list, lengths: list, window: int) -> pa.RecordBatch:
        row, piece, start, n = cut(np.concatenate(lengths), max(capacities))
        bins, offsets, sizes = best_fit(n, capacities, overhead, attention)
        doc_ids = pa.concat_arrays(ids).take(pa.array(row))
        base = (TaskContext.get().partitionId() << 40) + (window << 24)
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(n), pa.array(base + bins), pa.array(sizes.astype(np.int32)), pa.array(offsets.astype(np.int32))], ["doc_id", "piece", "start", "length", "bin_id", "bin_size", "bin_offset"])

    def run(batches):
        ids, lengths, held, window = [], [], 0, 0
        for batch in batches:
            ids.append(batch.column("doc_id"))
            lengths.append(batch.column("n").to_numpy())
            held += batch.num_rows
            if held >= most:
                yield packed(ids, lengths, window)
                ids, lengths, held, window = [], [], 0, window + 1
        if held:
            yield packed(ids, lengths, window)

    return run


def pack_documents(docs: DataFrame, name: str = "word_bpe_49k.json", capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD, attention: float = ATTENTION, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, bin_id, bin_size and bin_offset.

    The piece holds the document's ids from start on (ids of the text, then the end id) and stands at bin_offset of the
    sequence bin_id, of length bin_size. Every row of docs is packed: null and empty texts as an end id alone, rows with
    null or repeated ids by themselves. Other columns are ignored. Documents are packed together in groups of about
    window, however docs is divided; a larger window packs more tightly and takes more time and memory in a task.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    measured = stage(arrow_map(texts, _measurer(name), "doc_id long, n long", encodes=True), "measured")
    groups = max(1, -(-measured.count() // window))
    # rows without an id are dealt by their length
    dealt = measured.repartition(groups, F.xxhash64("doc_id", "n")).sortWithinPartitions("n", "doc_id")
    return arrow_map(dealt, _packer(tuple(capacities), overhead, attention, TASK_WINDOWS * window), PACKED)
