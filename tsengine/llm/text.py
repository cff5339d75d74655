"""Texts of Arrow batches as flat numpy arrays: bytes, words and their hashes, without a Python object for each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Characters of words where punctuation separates: ASCII letters and digits, and every byte of other characters.
ALNUM = np.array([chr(i).isalnum() if i < 128 else True for i in range(256)])
_BYTE = np.random.default_rng(20_240_229).integers(1, 2**64, 256, dtype=np.uint64) | U(1)
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about max_bytes of text; a longer text is a piece of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, begin = np.cumsum(sizes, dtype=np.int64), 0
    while begin < batch.num_rows:
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + max_bytes, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def gathered(batches, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Pieces of about max_bytes of text, of one batch or several; a longer text is a piece of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for piece in slices(batch, column, max_bytes):
            n = pc.sum(pc.binary_length(piece.column(column))).as_py() or 0
            if held and size + n > max_bytes:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
            held.append(piece)
            size += n
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its rows' offsets into them; null is empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes for which inside[byte] holds, and the rows' offsets into the runs."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    hit = inside[data]
    begin, end = hit.copy(), hit.copy()
    begin[1:] &= ~hit[:-1]
    end[:-1] &= ~hit[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    begin[cut] = hit[cut]
    end[cut - 1] = hit[cut - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever the span stands."""
    n = len(data)
    if len(_powers[0]) < n + 1:
        size = max(n + 1, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    total = np.zeros(n + 1, U)
    np.cumsum(_BYTE[data] * _powers[0][:n], out=total[1:])
    own = (total[ends] - total[starts]) * _powers[1][starts]
    if n > 8 << 20:  # powers for a very long text are not kept
        _powers[:] = [np.ones(1, U), np.ones(1, U)]
    return mix(own + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words and the rows' offsets into them."""
    starts, ends, rows = spans(data, offsets, inside)
    return span_hashes(LOWER[data], starts, ends), rows


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each element, from the rows' offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def shingles(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of size words, and the rows' offsets into them.

    A row with fewer words than size, but any, has one: its whole sequence. A row without words has none.
    """
    counts = np.diff(offsets)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    out_offsets = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(offsets[:-1] - out_offsets[:-1], n) + np.arange(out_offsets[-1])
    width = np.repeat(np.minimum(counts, size), n)
    out = np.zeros(len(first), U)
    last = max(len(hashes) - 1, 0)
    for k in range(size):
        term = mix(hashes[np.minimum(first + k, last)] + U((k + 1) * 0x632BE59BD9B4E019 % 2**64)) if len(hashes) else out
        out = np.where(k < width, out * U(0x100000001B3) + term, out)
    return mix(out + width.astype(U)), out_offsets


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, sorted, and the rows' offsets into them."""
    rows = row_of(offsets)
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[new], np.searchsorted(rows[new], np.arange(len(offsets)))
