"""Content-defined anchors of fixed-length windows of bytes.

Of all k-grams that lie in a window of `LENGTH` bytes, the one with the least hash (the leftmost of equals) is the
window's anchor. It depends on the window's bytes alone, so equal windows have equal anchors at equal places, in
whatever document they stand. Neighbouring windows mostly share their anchor; a maximal run of windows with the same
anchor is one entry here, and its context is the bytes its windows cover, fewer than twice LENGTH.
"""

from __future__ import annotations

import numpy as np

from . import text as tx

U = np.uint64
LENGTH, GRAM = 100, 24
REACH = LENGTH - GRAM + 1  # k-grams in a window


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, U)
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(U).ravel()
    out = np.zeros(n, U)
    for k in range(0, GRAM, 8):
        out = (out ^ eight[k : k + n]) * U(0x9E3779B97F4A7C15)
        out ^= out >> U(29)
    return tx.mix(out)


def window_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the LENGTH bytes from each start on, independent of the hashes of spans."""
    if not len(starts):
        return np.zeros(0, U)
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(U).ravel()
    out = np.full(len(starts), U(LENGTH))
    for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        out = (out ^ eight[starts + k]) * U(0xC2B2AE3D27D4EB4F)
        out ^= out >> U(31)
    return tx.mix(out)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, anchor position, first and last window start (positions in data), and gram hash of each run of windows."""
    n = len(data) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, np.zeros(0, U)
    grams = gram_hashes(data)
    least = (grams & U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U)
    size = 1
    while size * 2 <= REACH:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    rest = REACH - size
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    at = (least[:n] & U(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(n, bool)
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes >= LENGTH)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, offsets[:-1][long], 1)
    np.add.at(edge, offsets[1:][long] - LENGTH + 1, -1)
    valid = np.cumsum(edge[:n]) > 0
    new = valid.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    new[offsets[:-1][long]] = True
    first = np.flatnonzero(new)
    stop = np.append(first[1:], n)
    # a run ends where the next begins or its document's last window stands
    row = np.searchsorted(offsets, first, "right") - 1
    last = np.minimum(stop - 1, offsets[1:][row] - LENGTH)
    return row, at[first], first, last, grams[at[first]]
