"""Canonical length-limited Huffman codes over numpy arrays."""

from __future__ import annotations

import numpy as np

#: The longest code, and for more ids than it has codes the shortest length that has enough.
MAX_BITS = 16


def longest_code(n: int) -> int:
    """The most bits of a code of n ids."""
    return max(MAX_BITS, (n - 1).bit_length())


#: Ids between two bit-offset checkpoints; each such stretch is decoded by itself, all of them in step.
STRIDE = 256


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Optimal code lengths of at most limit bits (package-merge; `longest_code` by default); 0 for absent ids."""
    lengths = np.zeros(len(counts), np.uint8)
    ids = np.flatnonzero(counts)
    n = len(ids)
    if n <= 1:
        lengths[ids] = 1
        return lengths
    limit = limit or longest_code(n)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit codes of {limit} bits")
    ids = ids[np.argsort(counts[ids], kind="stable")]
    leaves = counts[ids].astype(np.float64)
    levels, merged = [], leaves
    levels.append(np.arange(1, n + 1))
    for _ in range(limit - 1):
        m = len(merged) // 2 * 2
        packages = merged[:m:2] + merged[1:m:2]
        both = np.concatenate([leaves, packages])
        order = np.argsort(both, kind="stable")
        merged = both[order]
        levels.append(np.cumsum(order < n))
    own, take = np.zeros(n, np.int64), 2 * n - 2
    for level in reversed(levels):
        a = int(level[take - 1]) if take else 0
        own[:a] += 1
        take = 2 * (take - a)
    lengths[ids] = own
    return lengths


def codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each id, by length and then by id."""
    out = np.zeros(len(lengths), np.uint32)
    code = 0
    for bits in range(1, int(lengths.max(initial=0)) + 1):
        ids = np.flatnonzero(lengths == bits)
        out[ids] = code + np.arange(len(ids))
        code = (code + len(ids)) << 1
    return out


def tables(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id and the length of the code that each window of the longest code's bits (MAX_BITS at least) starts with."""
    bits = max(MAX_BITS, int(lengths.max(initial=0)))
    symbol, size = np.zeros(1 << bits, np.uint32), np.zeros(1 << bits, np.uint8)
    code = codes(lengths)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    width = (1 << (bits - lengths[order].astype(np.int64))).astype(np.int64)
    end = int(width.sum())
    assert not len(order) or int(code[order[0]]) == 0
    symbol[:end] = np.repeat(order, width)
    size[:end] = np.repeat(lengths[order], width)
    size[end:] = 1
    return symbol, size


def pack(ids: np.ndarray, lengths: np.ndarray, code: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids as bits, most significant first, in whole 32-bit words; the bit offsets of every STRIDE-th id."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    at = ends - n
    shifted = code[ids].astype(np.uint64) << (64 - (at & 31) - n).astype(np.uint64)
    word = at >> 5
    size = int((ends[-1] + 31) >> 5) if len(ids) else 0
    # bits of a word don't overlap, so their sum is exact in double precision
    total = np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), size + 1)
    total[: size + 1] += np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), size + 1)[: size + 1]
    return total[:size].astype(">u4").tobytes(), at[::STRIDE].astype(np.uint64)


def unpack(payloads: list[bytes], checkpoints: list[np.ndarray], sizes: np.ndarray, symbol: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ids of independent blocks one after another; all stretches between checkpoints advance together."""
    if not len(sizes) or not sizes.sum():
        return np.zeros(0, np.uint32)
    words = np.frombuffer(b"".join(payloads), ">u4").astype(np.uint64)
    words = np.concatenate([words, np.zeros(2, np.uint64)])
    pairs = (words[:-1] << np.uint64(32)) | words[1:]
    base = np.cumsum([0] + [len(p) // 4 for p in payloads[:-1]]) * 32
    at = np.concatenate([c.astype(np.int64) + b for c, b in zip(checkpoints, base, strict=True)])
    own = np.concatenate([np.minimum(STRIDE, n - np.arange(len(c)) * STRIDE) for c, n in zip(checkpoints, sizes, strict=True)])
    out = np.empty((len(at), STRIDE), np.uint32)
    last, rest = len(pairs) - 1, np.uint64(65 - len(symbol).bit_length())
    for k in range(STRIDE):
        window = (pairs[np.minimum(at >> 5, last)] << (at & 31).astype(np.uint64)) >> rest
        window = window.astype(np.int64)
        out[:, k] = symbol[window]
        at += size[window]
    return out[np.arange(STRIDE) < own[:, None]]
