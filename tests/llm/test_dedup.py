"""Exact, near, line and suffix deduplication against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import lower, near_components, shingle_set

from tsengine.llm import near_dedup, suffix_dedup
from tsengine.llm.anchors import LENGTH, anchors
from tsengine.llm.components import connected_components, joined_components
from tsengine.llm.exact_dedup import drop_exact_duplicates, exact_groups
from tsengine.llm.line_dedup import BUCKET, apply_bitmaps, line_bitmaps
from tsengine.llm.near_dedup import SET_BITS, SKETCH_BITS, Plan, _sets, _summaries, allowed_set_bits, drop_near_duplicates, estimate, near_groups
from tsengine.llm.suffix_dedup import merge, remove_repeats
from tsengine.llm.suffix_sort import deep_shallow, multikey_quicksort


def test_exact(spark, odd_docs, odd_rows, empty_docs):
    got = exact_groups(odd_docs).collect()
    assert len(got) == len(odd_rows)
    by = {(r["doc_id"], r["text_sha256"]): r for r in got}
    key = lambda t: hashlib.sha256(lower(t)).hexdigest()
    assert (by[1, key("same text here")]["keep_id"], by[1, key("same text here")]["group_size"], by[1, key("same text here")]["kept"]) == (2, 3, False)
    assert by[2, key("same text here")]["kept"]
    assert (by[3, key("")]["keep_id"], by[3, key("")]["group_size"]) == (4, 3)
    assert by[None, key("lost its id")]["kept"]
    assert not by[None, key("")]["kept"]
    assert exact_groups(empty_docs).count() == 0
    kept = drop_exact_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "2", "4", "5", "6", "7", "8", "None"]


def test_exact_first(spark):
    docs = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(40)], "doc_id long, text string")
    assert {(r["keep_id"], r["group_size"]) for r in exact_groups(docs, keep="first").collect()} == {(0, 20), (1, 20)}


def test_components(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    got = {r["node"]: r["comp"] for r in connected_components(chain).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {90: 90, 95: 90, 100: 90}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_joined_components(spark):
    links = lambda rows: spark.createDataFrame(rows, "a long, b long")
    first = [(5, 6), (7, 8), (1, 2), (30, 31)]
    comps = connected_components(links(first))
    more = [(6, 8), (9, 10), (10, 2), (30, 31), (40, 40)]
    expected = {r["node"]: r["comp"] for r in connected_components(links(first + more)).collect()}
    assert {r["node"]: r["comp"] for r in joined_components(comps, links(more)).collect()} == expected
    assert joined_components(comps, links([(5, 6)])).count() == comps.count()


@pytest.mark.parametrize("plan", [Plan(3, 85, 100), Plan()])
def test_sketches(plan):
    """Bounds that true links pass, for pairs of known similarity."""
    rng = np.random.default_rng(1)
    for size in (20, 200, 3000):
        for shared in (1.0, 0.97, 0.92, 0.6):
            base = rng.integers(1, 2**63, 2 * size, dtype=np.uint64)
            a, b = base[:size], np.concatenate([base[: int(size * shared)], base[size : 2 * size - int(size * shared)]])
            similarity = int(size * shared) / (2 * size - int(size * shared))
            sketch, keys = _summaries(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, size, 2 * size]), plan)
            bits = np.bitwise_count((sketch[0] ^ sketch[1]).view(np.uint64))
            few, many = int(bits[: SKETCH_BITS // 64].sum()), int(bits[SKETCH_BITS // 64 :].sum())
            assert keys.shape == (2, plan.bands)
            assert abs(estimate(np.array(few), plan.samples) - similarity) < 0.2
            if similarity >= plan.num / plan.den:
                assert few <= plan.most_bits
                assert many <= allowed_set_bits(np.array(2 * size), plan)
                assert (keys[0] == keys[1]).any()
            elif similarity < 0.5 and size >= 200:
                assert many > allowed_set_bits(np.array(2 * size), plan)
    assert SET_BITS % 64 == 0


def near_rows(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for family in range(6):
        base = rng.choices(words, k=rng.choice([2, 6, 40, 150]))
        for _ in range(rng.choice([2, 15, 40])):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 20))):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows), " ".join(own).upper() if rng.random() < 0.2 else "\t".join(own)))
    rows += [(len(rows) + k, t) for k, t in enumerate(["", None, " \n ", "a b", "a b", "A  B", "a b c"])]
    rng.shuffle(rows)
    return rows


def test_near(spark, monkeypatch):
    rows = near_rows(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = near_components(rows, 3, 85, 100)
    monkeypatch.setattr("tsengine.llm.near_dedup.BLOCK", 8)
    got = near_groups(docs, Plan(3, 85, 100)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) and r["n_shingles"] == len(shingle_set(dict(rows)[r["doc_id"]], 3)) for r in got)


def test_spanning():
    """As many pairs as components joined, the fewest bits first."""
    a, b, bits = np.array([1, 1, 2, 5, 5]), np.array([2, 3, 3, 6, 7]), np.array([5, 1, 2, 9, 3])
    assert near_dedup.spanning(a, b, bits, a, b).tolist() == [1, 2, 4, 3]
    assert near_dedup.spanning(a, b, bits, np.array([1, 1, 2, 5, 5]), np.array([2, 2, 2, 6, 6])).tolist() == [1, 4]


def test_near_grows_linearly(spark, monkeypatch):
    """One group of near copies, and of four times the members: pairs to confirm in proportion to them, no link lost."""
    rng, confirmed = random.Random(8), []
    confirm = near_dedup._confirm
    monkeypatch.setattr(near_dedup, "_confirm", lambda pairs, *rest: (confirmed.append(pairs.count()), confirm(pairs, *rest))[1])
    words = [f"w{k}" for k in range(5000)]
    base = rng.choices(words, k=120)
    for n in (400, 1600):
        rows = [(k, " ".join(rng.choice(words) if rng.random() < 0.03 else w for w in base)) for k in range(n)]
        confirmed.clear()
        got = near_groups(spark.createDataFrame(rows, "doc_id long, text string"), Plan()).collect()
        assert sum(confirmed) < 2 * n
        assert {r["doc_id"]: r["component_id"] for r in got} == near_components(rows, 5, 80, 100)


def test_near_odd(spark, odd_docs, odd_rows, empty_docs):
    got = near_groups(odd_docs, Plan(3, 85, 100)).collect()
    assert len(got) == len(odd_rows)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (3, 3), (4, 4), (None, None), (5, 5), (6, 6), (7, 7), (8, 8)}
    assert near_groups(empty_docs).count() == 0
    kept = drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "5", "6", "7", "8", "None", "None"]


def test_lines(spark, odd_docs, odd_rows, empty_docs):
    common, short = "A line of more than twenty characters", "short line"
    rows = [(1, f"{common}\nx\n{common}"), (2, f"  {common.upper()}\t\n{short}"), (3, f"{common}\r\n{common}\n"), (4, short), (5, None), (6, "only in one document\nonly in one document, thrice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = apply_bitmaps(docs, line_bitmaps(docs))
    assert {r["doc_id"]: (r["kept_text"], r["n_lines"], r["n_dropped"]) for r in out.collect()} == {
        1: ("x", 3, 2),
        2: (short, 2, 1),
        3: (f"{common}\r\n{common}\n", 3, 0),
        4: (short, 1, 0),
        5: ("", 1, 0),
        6: (rows[5][1], 2, 0),
    }
    first = apply_bitmaps(docs, line_bitmaps(docs, keep="first"))
    assert {r["doc_id"]: r["n_dropped"] for r in first.collect()} == {1: 0, 2: 1, 3: 2, 4: 0, 5: 0, 6: 0}
    odd = apply_bitmaps(odd_docs, line_bitmaps(odd_docs))
    assert odd.count() == len(odd_rows)
    assert set(odd_docs.columns) < set(odd.columns)
    assert apply_bitmaps(empty_docs, line_bitmaps(empty_docs)).count() == 0


def test_many_lines(spark):
    """More lines than a bitmap's bucket holds."""
    line = lambda k: f"number {k} of many different lines"
    n = BUCKET + 50
    text = "\n".join(line(k) for k in range(n))
    rare = {0, 7, 8, BUCKET - 1, BUCKET, BUCKET + 1, n - 1}
    docs = spark.createDataFrame([(1, text), (2, "\n".join(line(k) for k in rare)), (3, "\n".join(line(k) for k in rare))], "doc_id long, text string")
    out = apply_bitmaps(docs, line_bitmaps(docs)).where("doc_id = 1").first()
    assert out["n_dropped"] == len(rare)
    assert out["kept_text"] == "\n".join(line(k) for k in range(n) if k not in rare)


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        marks = np.zeros(len(raw) + 1, int)
        for k in range(len(raw) - length + 1):
            if raw[k : k + length] in seen:
                marks[k] += 1
                marks[k + length] -= 1
            seen.add(raw[k : k + length])
        gone = np.cumsum(marks)[: len(raw)] > 0
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out[doc_id] = (len(raw), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("few", "many"), [(32, 256), (1, 2)])
def test_repeats(spark, monkeypatch, few, many):
    monkeypatch.setattr(suffix_dedup, "FEW", few)
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    rng = random.Random(few)
    parts = ["".join(rng.choices("abcdé ", k=k)) for k in (60, 99, 100, 101, 130, 250, 400)] + ["a" * 300, "ab" * 120]
    rows = []
    for k in range(120):
        pieces = [rng.choice([rng.choice(parts)[rng.randrange(30) :], "".join(rng.choices("abcd ", k=rng.randrange(80)))]) for _ in range(rng.randrange(6))]
        rows.append((k, "".join(pieces) if k % 40 else None))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(docs).collect()}
    assert got == brute_repeats(rows)


def test_repeats_of_short_lines(spark):
    """Documents of 35 to 50 byte lines: what two contexts share must count as their bytes, not as their padding."""
    rng = random.Random(7)
    lines = ["".join(rng.choices("abcdefgh ", k=rng.randrange(35, 51))) for _ in range(8)]
    rows = [(k, "\n".join(rng.choices(lines, k=rng.choice([2, 3, 3, 3, 4])))) for k in range(300)]
    x, y, g = "x" * 3 + lines[0][:37], "y" * 3 + lines[1][:37], "G" + lines[2][:29]
    rows += [(1000, x + g + lines[3][:40]), (1001, lines[4][:40] + g + y), (1002, x + g + y)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(docs).collect()}
    assert got == brute_repeats(rows)


def test_repeats_odd(spark, odd_docs, odd_rows, empty_docs):
    got = remove_repeats(odd_docs, keep_text=True).collect()
    assert len(got) == len(odd_rows)
    assert {r["doc_id"]: r["n_removed"] for r in got}[5] == 70_000 - 1
    assert remove_repeats(empty_docs).count() == 0
    rows = [(1, "x" * 150), (1, "x" * 150), (1, "y" * 130), (None, "y" * 140), (3, "y" * 100)]
    out = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in out) == [("1", 130, 130), ("1", 150, 149), ("1", 150, 149), ("3", 100, 100), ("None", 140, 139)]


def test_anchors_depend_on_windows_alone():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 3000, dtype=np.uint8)
    text = np.concatenate([data[:700], data[:700], data[700:]])
    row, at, first, last, h = anchors(text, np.array([0, 700, 1400, len(text)]))
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
    valid = [k for a, b in ((0, 700), (700, 1400), (1400, len(text))) for k in range(a, b - LENGTH + 1)]
    assert covered.tolist() == valid
    anchor_of = {k: m - k for m, a, b in zip(at, first, last, strict=True) for k in range(a, b + 1)}
    assert all(anchor_of[k] == anchor_of[k + 700] for k in range(600))


def test_deep_shallow():
    rng = random.Random(4)
    for _ in range(60):
        n, width = rng.randrange(50), 40
        strings = [(rng.choice(["", "x" * 15, "y" * 20, "ab" * 9]) + "".join(rng.choices("ab", k=rng.randrange(20)))).encode()[:width] for _ in range(n)]
        keys = np.array([rng.randrange(3) for _ in range(n)], np.uint64)
        order, common = deep_shallow(keys, strings, width)
        got = [(int(keys[k]), strings[k].ljust(width, b"\0")) for k in order]
        assert got == sorted((int(k), s.ljust(width, b"\0")) for k, s in zip(keys, strings, strict=True))
        for k in range(1, n):
            same = next((j for j in range(width) if got[k][1][j] != got[k - 1][1][j]), width)
            assert common[k] == (same if got[k][0] == got[k - 1][0] else 0)
    order, starts = multikey_quicksort([np.array([3, 1, 2, 1], np.uint64)])
    assert (order[starts].tolist()[1:], len(starts)) == ([2, 0], 3)


def test_merge_spans():
    row, a, b = merge(np.array([1, 0, 0, 0, 1]), np.array([5, 3, 0, 10, 0]), np.array([9, 6, 3, 12, 5]))
    assert list(zip(row.tolist(), a.tolist(), b.tolist(), strict=True)) == [(0, 0, 6), (0, 10, 12), (1, 0, 9)]


def test_sets_match_python():
    texts = ["A b  c\td", "a b", "", None, "é É x y z", "one"]
    for size in (3, 5):
        _, offsets = _sets(pa.array(texts), size)
        assert np.diff(offsets).tolist() == [len(shingle_set(t, size)) for t in texts]
