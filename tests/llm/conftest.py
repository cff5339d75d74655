import re
from collections import Counter

import pytest

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lower(text) -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def shingle_set(text, size):
    words = WORD.findall(lower(text))
    return frozenset() if not words else frozenset([tuple(words)]) if len(words) < size else frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def near_components(rows, size, num, den):
    """The smallest id reachable of each id, by comparing every pair that shares a shingle."""
    sets = {i: shingle_set(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen: dict = {}
    for i, own in sets.items():
        shared = Counter(j for s in own for j in seen.get(s, ()))
        for j, n in shared.items():
            if den * n >= num * (len(own) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for s in own:
            seen.setdefault(s, []).append(i)
    return {i: root(i) for i in sets}


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty and long texts, ties, repeated rows."""
    return [(1, "Same text here"), (2, "same TEXT here"), (2, "same TEXT here"), (3, None), (4, ""), (None, "lost its id"), (None, None), (5, "w" * 70_000), (6, " ".join(f"word{k}" for k in range(9000))), (7, "\n\n"), (8, "ünï çödé ✓")]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows, with columns whose names operators might use themselves."""
    names = ["lang", "source", "digest", "key", "run", "rep", "kept", "n", "a", "b", "comp", "label", "y"]
    extra = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([(i, t, *["x"] * len(names)) for i, t in odd_rows], f"doc_id long, text string, {extra}")


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
