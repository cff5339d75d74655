"""Token output, packing, decontamination, classifiers, the licence scan and the pipeline."""

import itertools
import random
import re
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tsengine.llm import decontaminate, huffman, license_scan, packing, quality, staging, token_output, tokens, toxicity
from tsengine.llm.sampling import fit_sample, held_out, temperature
from tsengine.llm.staging import new_path

NAME = "word_bpe_49k.json"


def reference_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.tokenizer_path(NAME))
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_tokens_match_whole_texts():
    texts = ["a <|endoftext|>b  c d e İstanbul ΣΑΣ. é é ́x it's 'S don'T \t\n x", None, "", "   ", "日本語 ١٢٣ 🎉🎉", "a b", "word " * 300]
    ids, offsets = tokens.encode(pa.array(texts), NAME)
    expected = reference_ids(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == expected
    assert tokens.count(pa.array(texts), NAME).tolist() == [len(x) for x in expected]


def test_tasks_that_do_not_encode_forget_the_tokenizer():
    tokens.count(pa.array(["some words"]), NAME)
    assert list(staging._tidy(lambda batches: batches, True)([1])) == [1] and NAME in tokens._open
    assert list(staging._tidy(lambda batches: batches, False)([1])) == [1] and not tokens._open


def test_staged_files_start_no_processes(spark):
    # files of the checked local file system, which starts a process for each, have checksums beside them
    staged = staging.stage(spark.range(0, 100, 1, 4), "test-stage")
    folder = Path(staged.inputFiles()[0].removeprefix("file:")).parent
    assert staged.count() == 100 and len(list(folder.glob("part-*"))) == 4 and not list(folder.glob(".*.crc"))


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    docs = spark.range(0, 200, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('long text ', 10000)").alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    found = staging.arrow_map(docs, sizes, "n long, bytes long").collect()
    assert sum(r["n"] for r in found) == 200 and max(r["bytes"] for r in found) < 5 << 20


@pytest.mark.parametrize("stage", ["contexts", "scores"])
def test_quality_holds_little_memory(stage):
    rng = np.random.default_rng(1)
    texts = pa.array([" ".join(f"w{k}" for k in rng.integers(0, 50_000, 400)) for _ in range(2000)])
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(2000)), texts], ["doc_id", "text"])
    contexts = np.ones((quality.BUCKETS, quality.DIM), np.float32)
    model = quality.fit(np.zeros((0, quality.FEATURES)), np.zeros(0), contexts)
    run = quality._contexts if stage == "contexts" else quality._scorer(type("Broadcast", (), {"value": model}))
    tracemalloc.start()
    rows = sum(out.num_rows for out in run([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 1900 and peak < 64 << 20


@pytest.mark.parametrize(("symbols", "n"), [(1, 10), (2, 100), (300, 5000), (40_000, 200_000), (200_000, 400_000)])
def test_huffman_round_trip(symbols, n):
    ids = (np.random.default_rng(symbols).zipf(1.3, n) % symbols).astype(np.uint32) if symbols < 65_536 else np.random.default_rng(1).integers(0, symbols, n).astype(np.uint32)
    lengths = huffman.code_lengths(np.bincount(ids))
    used = lengths[lengths > 0].astype(float)
    assert (2.0**-used).sum() <= 1 + 1e-12 and lengths.max() <= huffman.longest_code(len(used))
    assert symbols < 65_536 or lengths.max() > huffman.MAX_BITS
    code, (symbol, size) = huffman.codes(lengths), huffman.tables(lengths)
    blocks = [ids[k : k + 999] for k in range(0, n, 999)]
    packed = [huffman.pack(b, lengths, code) for b in blocks]
    assert (huffman.unpack([p[0] for p in packed], [p[1] for p in packed], np.array([len(b) for b in blocks]), symbol, size) == ids).all()


def test_huffman_is_optimal_and_limited():
    counts = np.array([2**k for k in range(24)])
    lengths = huffman.code_lengths(counts)
    assert lengths.max() == huffman.MAX_BITS
    counts = np.array([45, 13, 12, 16, 9, 5, 0])
    assert huffman.code_lengths(counts).tolist() == [1, 3, 3, 3, 4, 4, 0]
    assert huffman.code_lengths(np.zeros(3, int)).tolist() == [0, 0, 0]


def test_token_files(spark, odd_docs, odd_rows, empty_docs, monkeypatch):
    monkeypatch.setattr(token_output, "BLOCK_IDS", 64)
    path = new_path(spark, "test-tokens")
    token_output.write_tokens(odd_docs, path)
    got = token_output.read_tokens(spark, path).collect()
    expected = Counter((str(i), tuple([*ids, 1])) for (i, _), ids in zip(odd_rows, reference_ids([t for _, t in odd_rows]), strict=True))
    assert Counter((str(r["doc_id"]), tuple(r["ids"])) for r in got) == expected
    rows = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in rows] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in rows])[:-1]]).tolist()
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    trip = token_output.round_trip(odd_docs).collect()
    assert {(r["doc_id"], r["ids_crc32"]) for r in trip} == {(r["doc_id"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in got}
    assert token_output.round_trip(empty_docs).count() == 0


def test_best_fit():
    rng = random.Random(1)
    for capacities in ((8,), (4, 8, 16), (5, 7, 100)):
        lengths = np.array([rng.randrange(1, max(capacities) + 1) for _ in range(300)])
        bins, offsets, sizes = packing.best_fit(lengths, capacities, 1)
        for b in set(bins.tolist()):
            own = np.flatnonzero(bins == b)
            order = own[np.argsort(offsets[own])]
            assert offsets[order].tolist() == (np.cumsum(lengths[order]) - lengths[order]).tolist()
            fill = lengths[own].sum()
            assert sizes[own[0]] == min(c for c in capacities if c >= fill)
    # each piece takes the fullest open bin that has room, as a plain search does
    lengths = np.array(sorted((rng.randrange(1, 20) for _ in range(200)), reverse=True))
    bins, _, _ = packing.best_fit(lengths, (20,), 0)
    assert len(set(bins.tolist())) == len(plain_bins(lengths.tolist(), [20] * 200))
    assert packing.best_fit(np.zeros(0, np.int64))[0].tolist() == []


def plain_bins(ordered, opened):
    """What the bins hold, by a plain search."""
    bins = []
    for n, size in zip(ordered, opened, strict=True):
        fits = [b for b in bins if b[1] >= n]
        if fits:
            b = min(fits, key=lambda b: b[1])
        else:
            bins.append(b := [0, size])
        b[0], b[1] = b[0] + n, b[1] - n
    return [b[0] for b in bins]


def all_partitions(items):
    if not items:
        yield []
        return
    for rest in all_partitions(items[1:]):
        yield [[items[0]], *rest]
        for k in range(len(rest)):
            yield [*rest[:k], [items[0], *rest[k]], *rest[k + 1 :]]


def bins_cost(fills, capacities, overhead, attention):
    return sum(float(packing.sequence_cost(np.array([min(c for c in capacities if c >= f)]), overhead, attention)[0]) for f in fills)


def chosen_cost(lengths, capacities, overhead, attention):
    bins, _, sizes = packing.best_fit(lengths, capacities, overhead, attention)
    return float(packing.sequence_cost(np.array([sizes[bins == b][0] for b in set(bins.tolist())]), overhead, attention).sum())


def test_joint_cost_against_all_policies_and_partitions():
    """Over several lengths, the cost is that of the best policies found by trying all, and near that of all partitions."""
    rng = random.Random(2)
    worst = 1.0
    for capacities, overhead, attention in (((4, 8, 16), 1, 16), ((5, 7, 20), 0.5, 40), ((8, 16, 32, 64), 4, 1000)):
        for _ in range(6):
            lengths = np.array(sorted((rng.randrange(1, capacities[-1] + 1) for _ in range(60)), reverse=True))
            kinds = [next(k for k, c in enumerate(capacities) if c >= n) for n in lengths.tolist()]
            policies = itertools.product(*[range(k, len(capacities)) for k in range(len(capacities))])
            least = min(bins_cost(plain_bins(lengths.tolist(), [capacities[p[k]] for k in kinds]), capacities, overhead, attention) for p in policies)
            worst = max(worst, chosen_cost(lengths, capacities, overhead, attention) / least)
            few = lengths[:: len(lengths) // 7][:7]
            best = min(bins_cost(fills, capacities, overhead, attention) for parts in all_partitions(few.tolist()) if max(fills := [sum(p) for p in parts]) <= capacities[-1])
            assert chosen_cost(few, capacities, overhead, attention) <= 1.2 * best
    assert worst < 1.01
    # short lengths are opened where they cost less, long ones where overhead outweighs pairs of tokens
    short = np.full(100, 120)
    assert set(packing.best_fit(short, (128, 4096), 0, 1000)[2].tolist()) == {128}
    assert set(packing.best_fit(short, (128, 4096), 1000, 10**9)[2].tolist()) >= {4096}


def test_bins_do_not_depend_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = [sorted((r["doc_id"], r["piece"], r["bin_size"], r["bin_offset"]) for r in packing.pack_documents(docs.repartition(n)).collect()) for n in (1, 13)]
    assert found[0] == found[1]


def test_packing(spark, odd_docs, odd_rows, empty_docs):
    got = packing.pack_documents(odd_docs, capacities=(64, 256)).collect()
    totals = Counter()
    for r in got:
        totals[str(r["doc_id"])] += r["length"]
    expected = Counter()
    for (i, _), ids in zip(odd_rows, reference_ids([t for _, t in odd_rows]), strict=True):
        expected[str(i)] += len(ids) + 1
    assert totals == expected
    fill = Counter()
    for r in got:
        fill[r["bin_id"], r["bin_size"]] += r["length"]
    assert all(n <= size for (_, size), n in fill.items())
    assert packing.pack_documents(empty_docs).count() == 0


ITEM_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def item_words(text):
    return [w.lower() if w.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in ITEM_WORD.findall((text or "").encode())]


def item_shingles(words):
    return [tuple(words)] if 0 < len(words) < 5 else [tuple(words[k : k + 5]) for k in range(len(words) - 4)]


def brute_matches(docs, items):
    weight = lambda s: sum(map(len, s))
    out = {}
    for doc_id, text in docs:
        words = item_words(text)
        for item_id, item in items:
            wanted = item_words(item)
            own, n = Counter(item_shingles(wanted)), len(wanted)
            for start in range(max(1, len(words) - n + 1)) if n else ():
                window = words[start : start + n]
                if n < 5 and window != wanted:
                    continue
                there = Counter(item_shingles(window))
                every = set(own) | set(there)
                low = sum(weight(s) * min(own[s], there[s]) for s in every)
                high = sum(weight(s) * max(own[s], there[s]) for s in every)
                if high and low / high >= decontaminate.SIMILARITY:
                    out.setdefault(doc_id, set()).add(item_id)
    return out


def test_decontamination(spark, monkeypatch, odd_docs, odd_rows, empty_docs):
    rng = random.Random(1)
    vocabulary = [f"W{k}" for k in range(30)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 4, 5, 6, 12, 30])))) for k in range(20)] + [(99, ""), (100, "!!"), (101, None)]
    docs = []
    for k in range(150):
        words = rng.choices(vocabulary, k=rng.randrange(40))
        if rng.random() < 0.7:
            passage = (rng.choice(items)[1] or "").split()
            if passage and rng.random() < 0.5:
                passage[rng.randrange(len(passage))] = "zz"
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
        docs.append((k, ", ".join(words)))
    expected = brute_matches(docs, items)
    frame, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: set(r["item_ids"]) for r in decontaminate.contaminated(frame, benchmark).collect()}
    assert {k: v for k, v in got.items() if v} == expected
    assert len(got) == len(docs)
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(frame, benchmark).collect()}
    assert kept == {k for k, _ in docs} - set(expected)
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 300)  # several blocks of items
    assert {r["doc_id"]: set(r["item_ids"]) for r in decontaminate.contaminated(frame, benchmark).where("contaminated").collect()} == expected
    assert decontaminate.contaminated(odd_docs, benchmark).count() == len({str(i) for i, _ in odd_rows})
    assert decontaminate.drop_contaminated(odd_docs, benchmark).columns == odd_docs.columns
    assert decontaminate.contaminated(empty_docs, benchmark).count() == 0
    assert decontaminate.contaminated(frame, benchmark.where("false")).where("contaminated").count() == 0


def test_fingerprint_index_finds_the_whole_radius():
    rng = np.random.default_rng(0)
    own = rng.integers(0, 2**63, dtype=np.uint64)
    prints = []
    for bits in range(40):
        flip = np.uint64(sum(1 << int(b) for b in rng.choice(64, bits, replace=False)))
        prints.append(own ^ flip)
    others = rng.integers(0, 2**63, 50, dtype=np.uint64)
    window, item = decontaminate.MultiIndex(np.append(own, others)).within(np.array(prints))
    near = lambda x, y: int(x ^ y).bit_count() <= decontaminate.RADIUS
    assert set(zip(window.tolist(), item.tolist(), strict=True)) == {(k, j) for k, x in enumerate(prints) for j, y in enumerate([own, *others]) if near(x, y)}
    assert window[item == 0].tolist() == list(range(decontaminate.RADIUS + 1))


def test_fingerprints_alone_find_the_items(monkeypatch):
    """Candidates come from the index of fingerprints: without it, nothing is found."""
    items = ["one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen sixteen"]
    index = decontaminate.Index([1, 2], items)
    text = pa.array(["zero " + " ".join(items) + " end", "one two three four five and no more than that"])
    assert [(r, index.ids[j], start, n, value) for r, j, start, n, value in index.find(text)] == [(0, 1, 1, 8, 1.0), (0, 2, 9, 8, 1.0)]
    monkeypatch.setattr(decontaminate, "RADIUS", -1)
    assert list(decontaminate.Index([1, 2], items).find(text)) == []


def classified(spark, scores, folder, label, cut):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = scores(docs, labels)
    rows = out.join(labels, "doc_id").where("held_out").select("score", "predicted", label).collect()
    assert out.count() == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut) for r in rows)
    return np.mean([r["predicted"] == r[label] for r in rows])


def test_quality_on_held_out(spark):
    assert classified(spark, quality.quality_scores, "/root/testdata/sf0.01", "quality", 0.3) >= 0.93


def test_toxicity_on_held_out(spark):
    assert classified(spark, toxicity.toxicity_scores, "/root/testdata/sf0.01", "toxic", 0.5) >= 0.9


def test_every_telling_slot_is_kept():
    n1 = np.append(np.full(9000, 100), np.zeros(1000, int))
    slots, ratio = toxicity.choose(np.zeros(10_000, int), n1, 1000, 1000)
    assert sorted(slots.tolist()) == list(range(9000))
    assert (ratio > 0).all()


@pytest.mark.parametrize(("scores", "label"), [(quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_classifiers_on_odd_rows(spark, scores, label, odd_docs, odd_rows, empty_docs):
    labels = spark.createDataFrame([(k, k % 2, None if k == 3 else k % 2) for k in range(9)] + [(None, 1, 1), (1, 1, 1), (2, 7, 7)], "doc_id long, quality int, toxic int")
    out = scores(odd_docs, labels).collect()
    assert len(out) == len(odd_rows)
    assert all(0 <= r["score"] <= 1 for r in out)
    unlabelled = scores(odd_docs, labels.where("false")).collect()
    assert len(unlabelled) == len(odd_rows)
    assert all(r["score"] < 0.01 and not r["predicted"] if label == "toxic" else r["score"] == 0.5 for r in unlabelled)
    renamed = odd_docs.select(F.col("doc_id").alias("n"), F.col("text").alias("body"), F.col("n").alias("doc_id"))
    assert [r["score"] for r in scores(renamed, labels, id_col="n", text_col="body").collect()] == [r["score"] for r in out]
    assert scores(empty_docs, labels).count() == 0


@pytest.mark.parametrize("size", range(7))
def test_toxicity_of_tiny_texts(spark, size):
    """A partition with one text shorter than an n-gram, or hardly longer."""
    for text in ("abcdefg"[:size], None, "\n" * size):
        found = toxicity.present(*toxicity.ngrams(pa.array([text], pa.string())))[0]
        assert len(found) == len({(text or "")[a : a + k] for k in toxicity.SIZES for a in range(len(text or "") - k + 1)})
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(k, "abcdefg"[:size]) for k in (1, 2, 3)], "doc_id long, text string").repartition(3)
    assert toxicity.toxicity_scores(docs, labels).where("score between 0 and 1").count() == 3


def test_long_texts(spark):
    """Texts longer than the pieces in which workers take them, beside short ones, in operators with Python workers."""
    from tsengine.llm.near_dedup import Plan, near_groups
    from tsengine.llm.suffix_dedup import remove_repeats

    rng = random.Random(3)
    long = " ".join(f"{rng.randrange(10**9)}" for _ in range(280_000))
    passage = long[1_500_000:1_502_000]
    docs = spark.createDataFrame([(1, "ab"), (2, long), (3, passage), (4, "xy")], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    for scores in (quality.quality_scores, toxicity.toxicity_scores):
        assert scores(docs, labels).where("score between 0 and 1").count() == 4
    assert {r["doc_id"]: r["n_shingles"] for r in near_groups(docs, Plan(3, 85, 100)).collect()} == {1: 1, 2: 279_998, 3: len(passage.split()) - 2, 4: 1}
    item = spark.createDataFrame([(7, " ".join(long[1_800_000:1_800_500].split()[1:-1]))], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.contaminated(docs, item).where("contaminated").collect()] == [2]
    assert {r["doc_id"]: r["n_removed"] for r in remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 2000, 4: 0}
    assert license_scan.scan_licences(docs).count() == 4
    huge = spark.createDataFrame([(1, "ab"), (2, "word " * 3_600_000), (3, "xy")], "doc_id long, text string").coalesce(1)
    packed = packing.pack_documents(huge).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    trip = {r["doc_id"]: r["n_tokens"] for r in token_output.round_trip(huge).collect()}
    assert {r["doc_id"]: r["n"] for r in packed} == trip
    assert trip[2] >= 3_600_000


def test_labels_of_held_out_rows_are_not_learnt(spark):
    labels = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    used = {r["doc_id"] for r in fit_sample(docs, labels, "quality", 50).collect()}
    assert len(used) == 50
    assert all(zlib.crc32(str(k).encode()) % 5 for k in used)
    marks = {r["id"]: r["h"] for r in spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()}
    assert marks == {k: zlib.crc32(str(k).encode()) % 5 == 0 for k in range(50)}


def test_temperature():
    rng = np.random.default_rng(0)
    margin = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-margin))).astype(int)
    assert 0.8 < temperature(margin, y) < 1.25
    assert 4 < temperature(margin * 5, y) < 6.3


@pytest.fixture(scope="module")
def licence_model():
    rng = random.Random(0)
    words = "the of and a in that have it for not on with he as you do at this but his by from they we say her she or an will".split()
    return license_scan.fit([" ".join(rng.choices(words, k=rng.randrange(3, 30))) for _ in range(300)], epochs=6)


def test_licences(licence_model):
    texts = ["he said\nReleased under the MIT License.\nshe said", "Copyright 2020 Someone. Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "the license of the driver was in the car", "", None, "a version of the public record\n\n"]
    found, counts = license_scan.scan(pa.array(texts), licence_model)
    assert [(row, paragraph, family) for row, paragraph, _, _, family, *_ in found] == [(0, 1, "MIT"), (1, 0, "Apache-2.0"), (2, 0, "GPL"), (3, 0, "CC-BY-NC")]
    assert counts.tolist() == [3, 1, 1, 1, 1, 1, 1, 2]
    row, _, start, stop, *_ = found[0]
    assert texts[row].encode()[start:stop].decode() == "Released under the MIT License.\n"


def test_licence_temperature_is_set_on_paragraphs_apart(monkeypatch):
    used, variants = [], license_scan.variants
    monkeypatch.setattr(license_scan, "variants", lambda corpus, *rest: used.append(set(corpus)) or variants(corpus, *rest))
    corpus = [f"paragraph number {k} of some corpus" for k in range(101)]
    license_scan.fit(corpus, epochs=1)
    fitted, apart = used
    assert not fitted & apart
    assert fitted | apart == set(corpus)


def test_short_notices(spark, licence_model):
    """Every heading, SPDX identifier and short notice alone, in comment signs or not; and lines that merely hold one."""
    for model in (licence_model, license_scan.fit(license_scan.corpus_paragraphs(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))):
        wanted = [(t, f) for f, texts in license_scan.NOTICES.items() for t in texts]
        for form in ("{}", "// {}\r", "# {}"):
            found, _ = license_scan.scan(pa.array([form.format(t) for t, _ in wanted]), model)
            assert [(row, family) for row, _, _, _, family, *_ in found] == [(k, f) for k, (_, f) in enumerate(wanted)]
        others = ["all rights reserved seats were taken", "she has a license", "mit", "a public license", "SPDX-License-Identifier: Nonsense-1.0", "rights reserved", "reserved"]
        assert license_scan.scan(pa.array(others), model)[0] == []


def test_licence_lines_of_documents(spark):
    """The licence lines of the test documents, found by looking for them as they stand."""
    known = {"This work is licensed under the GNU General Public License, version 3.": "GPL", "All rights reserved.": "proprietary", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    expected = {(r["doc_id"], k, known[line]) for r in docs.collect() for k, line in enumerate((r["text"] or "").split("\n")) if line in known}
    assert {f for _, _, f in expected} == set(known.values())
    got = {(r["doc_id"], x["paragraph"], x["family"]) for r in license_scan.scan_licences(docs).collect() for x in r["found"]}
    assert got == expected


def test_licence_rows(spark, odd_docs, odd_rows, empty_docs, licence_model):
    assert license_scan.scan_licences(odd_docs, licence_model).count() == len(odd_rows)
    assert license_scan.scan_licences(empty_docs, licence_model).count() == 0
    assert license_scan.corpus_paragraphs(empty_docs) == []
    assert license_scan.corpus_paragraphs(odd_docs, 2)


def test_pipeline(spark, sf):
    import corpus_pipeline
    from conftest import lower, near_components

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "decontaminate", "pack"]
    steps = dict(corpus_pipeline.STAGES)
    everything = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"]: r["text"] for r in steps["exact"](spark, docs, sf).collect()}
    last = {}
    for i, t in sorted(everything.items()):
        last[lower(t)] = i
    assert set(kept) == set(last.values())
    near = {r["doc_id"] for r in steps["near"](spark, docs, sf).collect()}
    assert near == {i for i, c in near_components(list(everything.items()), 5, 80, 100).items() if i == c}
    clean = steps["decontaminate"](spark, docs, sf)
    assert clean.columns == docs.columns
    assert 0 < clean.count() < docs.count()
    good = steps["quality"](spark, docs, sf)
    assert good.columns == docs.columns and good.count() < docs.count()
    out = corpus_pipeline.run(spark, sf)
    ids = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    assert ids <= set(kept) & {r["doc_id"] for r in good.collect()}


def test_pipeline_stages_on_odd_rows(spark, odd_docs, odd_rows, empty_docs, tmp_path):
    """Stages keep the columns; nulls, ties, repeated rows and empty tables pass through all of them."""
    import corpus_pipeline

    rows = {"labels": spark.createDataFrame([(k, k % 2, 0) for k in range(9)], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([(1, "word7 word8 word9 word10 word11 word12"), (2, None)], "item_id long, text string")}
    for name, table in rows.items():
        table.write.parquet(f"{tmp_path}/odd/{name}.parquet")
        table.where("false").write.parquet(f"{tmp_path}/none/{name}.parquet")
    odd_docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    empty_docs.write.parquet(f"{tmp_path}/none/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (odd_docs, empty_docs):
            for folder in ("odd", "none"):
                out = stage(spark, docs, f"{tmp_path}/{folder}")
                assert out.columns == docs.columns
                assert out.count() <= docs.count(), name
    dropped = {r["doc_id"] for r in odd_docs.collect()} - {r["doc_id"] for r in corpus_pipeline.decontaminate(spark, odd_docs, f"{tmp_path}/odd").collect()}
    assert dropped == {6}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()} <= {i for i, _ in odd_rows}
