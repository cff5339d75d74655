"""Deep-shallow sorting of suffixes.

Shallow: a multikey quicksort over 8-byte words, all segments partitioned about their pivots in the same numpy pass, down
to `SHALLOW` bytes. Deep: what then still shares its prefix is ordered by blind tries, which branch on single bytes, skip
the rest, and compare a new suffix with one stored suffix only.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 16


def multikey_quicksort(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order by words[0], then words[1], ..., and the starts of the runs that agree in all of them."""
    n = len(words[0])
    order = np.arange(n)
    starts = np.zeros(min(n, 1), np.int64)
    for word in words:
        done = np.zeros(0, np.int64)  # starts of segments equal in this word
        while len(starts):
            sizes = _ends(starts, done, n) - starts
            single = sizes == 1
            done = np.concatenate([done, starts[single]])
            starts, sizes = starts[~single], sizes[~single]
            if not len(starts):
                break
            at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            segment = np.repeat(np.arange(len(starts)), sizes)
            value = word[order[at]]
            a, b, c = (word[order[p]] for p in (starts, starts + sizes // 2, starts + sizes - 1))
            pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[segment]
            side = segment * 3 + (value >= pivot) + (value > pivot)
            moved = np.argsort(side, kind="stable")
            order[at] = order[at][moved]
            counts = np.bincount(side, minlength=3 * len(starts)).reshape(-1, 3)
            first = starts[:, None] + np.cumsum(counts, axis=1) - counts
            done = np.concatenate([done, first[:, 1]])  # a pivot is in every segment
            rest = np.concatenate([first[:, 0][counts[:, 0] > 0], first[:, 2][counts[:, 2] > 0]])
            starts = np.sort(rest)
        starts = np.sort(done)
    return order, starts


def _ends(starts: np.ndarray, done: np.ndarray, n: int) -> np.ndarray:
    every = np.sort(np.concatenate([starts, done, [n]]))
    return every[np.searchsorted(every, starts, "right")]


class BlindTrie:
    """Strings of at most width bytes as integers, padded on the right; equal strings share a leaf."""

    def __init__(self, width: int):
        self.width, self.root = width, None

    def _byte(self, value: int, depth: int) -> int:
        return (value >> (8 * (self.width - 1 - depth))) & 255

    def add(self, value: int, item: int) -> None:
        if self.root is None:
            self.root = [self.width, value, [item]]
            return
        node, path = self.root, []
        while node[0] < self.width:  # an inner node: [depth, branches]
            path.append(node)
            node = node[1].get(self._byte(value, node[0])) or next(iter(node[1].values()))
        common = self.width - ((node[1] ^ value).bit_length() + 7) // 8
        if common >= self.width:
            node[2].append(item)
            return
        parent, below = None, self.root
        for step in path:
            if step[0] >= common:
                below = step
                break
            parent = step
            below = step[1].get(self._byte(value, step[0]))
        if below is not None and below[0] == common and below[0] < self.width:
            below[1][self._byte(value, common)] = [self.width, value, [item]]
            return
        # below may be a leaf, or an inner node deeper than the common prefix
        sample = node[1]
        inner = [common, {self._byte(sample, common): below, self._byte(value, common): [self.width, value, [item]]}]
        if parent is None:
            self.root = inner
        else:
            parent[1][self._byte(value, parent[0])] = inner

    def sorted(self):
        """(item, length of the common prefix with the item before it) in order."""
        stack, common = [(self.root, 0)], 0
        while stack:
            node, common = stack.pop()
            if node[0] >= self.width:
                for item in node[2]:
                    yield item, common
                    common = self.width
            else:
                branches = sorted(node[1].items(), reverse=True)
                for k, (_, child) in enumerate(branches):
                    stack.append((child, node[0] if k + 1 < len(branches) else common))


def deep_shallow(key: np.ndarray, strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of strings within equal keys, and each one's common prefix with the one before it (0 at a new key).

    Strings of less than width bytes count as followed by zero bytes; callers bound what they compare by the lengths.
    """
    n = len(strings)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = np.frombuffer(b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings), ">u8").reshape(n, SHALLOW // 8).astype(np.uint64)
    order, starts = multikey_quicksort([key, *head.T])
    common = np.zeros(n, np.int64)
    # neighbours in different runs differ in the key or in the first SHALLOW bytes
    at = starts[1:]
    same = key[order[at]] == key[order[at - 1]]
    for k in range(SHALLOW // 8):
        differ = head[order[at], k] ^ head[order[at - 1], k]
        exact = np.zeros(len(at), np.int64)
        for byte in range(8):
            exact += (differ >> np.uint64(8 * (7 - byte))) == 0
        common[at] += np.where(same, exact, 0)
        same = same & (differ == 0)
    ends = np.append(starts[1:], n)
    for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
        trie, members = BlindTrie(width), order[a:b].tolist()
        for m in members:
            trie.add(int.from_bytes(strings[m].ljust(width, b"\0"), "big"), m)
        first = common[a]
        for k, (item, shared) in enumerate(trie.sorted()):
            order[a + k] = item
            common[a + k] = shared
        common[a] = first
    return order, common
