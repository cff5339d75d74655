"""Near-duplicate groups by MinHash bands and odd sketches, every link confirmed on full shingle sets.

1. One Arrow pass makes, for each document, a fingerprint of its shingle set, the keys of its MinHash bands and an odd
   sketch: every MinHash sample flips one bit of a `SKETCH_BITS` bitmap, so the XOR of two sketches has at most as many
   set bits as the samples that differ, and for similar sets hardly fewer. A larger one folds all shingles of the set.
2. Documents with equal sets form classes; only class representatives go on.
3. Star pairs: each band's bucket pairs its members with its smallest member. The pairs whose sketches could belong to
   similar sets (bounds that a true link fails with probability `MISS`) are confirmed on the full sets of their texts.
4. Buckets whose members then lie in one component are settled, as further links inside could not change it. In the
   rest, pairs across components are compared by sketch within tasks, in blocks of bounded size, and of the pairs that
   pass, a task emits a spanning forest of its components only, the fewest differing bits first. So the pairs to confirm
   are in proportion to the members. Blocks are first compared with themselves; in buckets of several blocks, what the
   largest component does not hold is then compared with all blocks.
5. Where all of a forest is confirmed, its bucket is settled. Only the buckets in which a pair was refuted are compared
   once more, and there every pair across components that was not confirmed or refuted before is. No bucket is capped.

Bands are chosen so that a pair at the threshold shares no bucket with a probability of at most `MISS`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .components import connected_components, joined_components
from .staging import arrow_map, discard, stage

U = np.uint64
SKETCH_BITS = 512
#: Bits of a second sketch, of all shingles of a set.
SET_BITS = 2048
MISS = 1e-7
#: Rows whose bitmaps are counted at a time.
FOLD = 512
#: Members of a block of a bucket: a task compares two such blocks at a time.
BLOCK = 512
#: Ids of texts to confirm that are broadcast at most; more of them are joined by a shuffle.
BROADCAST_IDS = 1 << 20


@dataclass(frozen=True)
class Plan:
    """words per shingle; similarity num/den; bands of rows samples each; the most sketch bits in which links differ."""

    words: int = 5
    num: int = 80
    den: int = 100
    rows: int = 5

    @property
    def bands(self) -> int:
        return math.ceil(math.log(MISS) / math.log(1 - (self.num / self.den) ** self.rows))

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def most_bits(self) -> int:
        """Differing samples flip two bits at most; so many differ in a pair at the threshold with probability MISS."""
        k, p = self.samples, 1 - self.num / self.den
        tail, x = 0.0, k
        while x > 0:
            tail += math.exp(math.lgamma(k + 1) - math.lgamma(x + 1) - math.lgamma(k - x + 1) + x * math.log(p) + (k - x) * math.log(1 - p))
            if tail > MISS:
                break
            x -= 1
        return 2 * x


def estimate(bits: np.ndarray, samples: int) -> np.ndarray:
    """The similarity that an odd sketch's XOR count stands for."""
    full = np.minimum(bits / SKETCH_BITS, 0.4999)
    return 1 + SKETCH_BITS / (4 * samples) * np.log(1 - 2 * full)


#: Standard deviations that a set sketch's count may lie above its mean: a probability of about MISS.
SIGMAS = 5.3


def allowed_set_bits(total, plan: Plan, f=np):
    """The most bits in which the set sketches of a link differ, for sets of total shingles together.

    A link's sets differ in at most (den - num) / (den + num) of their shingles, and each flips one bit, so their number
    is a bound; where many shingles share bits, mean and variance of the odd bits give a lower one. f is numpy, or
    pyspark.sql.functions for columns.
    """
    power = f.power if f is np else f.pow
    lit = (lambda x: x) if f is np else f.lit
    least = f.minimum if f is np else f.least
    most = f.maximum if f is np else f.greatest
    differ = f.floor(total * (plan.den - plan.num) / (plan.den + plan.num))
    two, four = power(lit(1 - 2 / SET_BITS), differ), power(lit(1 - 4 / SET_BITS), differ)
    variance = SET_BITS / 4 * (1 - four) + SET_BITS**2 / 4 * (four - two * two)
    return least(differ * 1.0, SET_BITS / 2 * (1 - two) + SIGMAS * f.sqrt(most(variance, lit(1.0))) + 2)


def _sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = tx.flat(column)
    return tx.distinct(*tx.shingles(*tx.words(data, offsets, ~tx.SPACE), words))


def _fold(values: np.ndarray, rows: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Parity bitmaps of each row's values; rows are ascending."""
    out = np.zeros((n, bits // 64), np.int64)
    cuts = np.searchsorted(rows, np.arange(0, n + FOLD, FOLD))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        m = min(FOLD, n - k * FOLD)
        flips = np.bincount((values[a:b] % U(bits)).astype(np.int64) + (rows[a:b] - k * FOLD) * bits, minlength=m * bits).reshape(m, bits) & 1
        out[k * FOLD : k * FOLD + m] = np.packbits(flips.astype(np.uint8), axis=1, bitorder="little").view(np.int64)
    return out


def _summaries(values: np.ndarray, offsets: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Sketches (rows x SKETCH_WORDS, of samples and then of the set) and band keys (rows x bands) of non-empty sets."""
    rng = np.random.default_rng(11)
    odd, xor = rng.integers(1, 2**64, plan.samples, dtype=U) | U(1), rng.integers(1, 2**64, plan.samples, dtype=U)
    n = len(offsets) - 1
    least = np.empty((plan.samples, n), U)
    for j in range(plan.samples):
        least[j] = np.minimum.reduceat((values ^ xor[j]) * odd[j], offsets[:-1])
    least = tx.mix(least + np.arange(plan.samples, dtype=U)[:, None] * U(0x9E3779B97F4A7C15))
    sketches = np.hstack([_fold(least.T.ravel(), np.repeat(np.arange(n), plan.samples), n, SKETCH_BITS), _fold(tx.mix(values + U(9)), tx.row_of(offsets), n, SET_BITS)])
    keys = np.full((plan.bands, n), U(3))
    for r in range(plan.rows):
        keys = tx.mix(keys * U(0x100000001B3) + least[r :: plan.rows])
    return sketches, keys.T


SAMPLE_WORDS = SKETCH_BITS // 64
SKETCH_WORDS = (SKETCH_BITS + SET_BITS) // 64
SIGNATURE = "doc_id long, n_shingles long, h1 long, h2 long, sketch array<long>, bands array<long>"


def _signer(plan: Plan):
    def run(batches):
        for batch in batches:
            for piece in tx.slices(batch, "text"):
                values, offsets = _sets(piece.column("text"), plan.words)
                n, some = np.diff(offsets), np.flatnonzero(np.diff(offsets))
                h1, h2 = np.zeros(len(n), U), np.zeros(len(n), U)
                sketches, keys = np.zeros((0, SKETCH_WORDS), np.int64), np.zeros((0, plan.bands), U)
                if len(some):
                    at = offsets[:-1][some]
                    h1[some], h2[some] = np.add.reduceat(tx.mix(values + U(1)), at), np.add.reduceat(tx.mix(values ^ U(0xABCDEF)), at)
                    sketches, keys = _summaries(values, np.append(at, len(values)), plan)
                lists = []
                for width, flat in ((SKETCH_WORDS, sketches), (plan.bands, keys)):
                    at = np.zeros(len(n) + 1, np.int32)
                    np.cumsum((n > 0) * width, out=at[1:])
                    lists.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.ascontiguousarray(flat).ravel().view(np.int64))))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), *lists], ["doc_id", "n_shingles", "h1", "h2", "sketch", "bands"])

    return run


def _confirmer(plan: Plan):
    """Pairs with both texts in; out come the pairs with den * |A and B| >= num * |A or B|, on full sets."""

    def run(batches):
        for batch in batches:
            for piece in tx.slices(batch, "text_a", 1 << 20):
                for part in tx.slices(piece, "text_b", 1 << 20):
                    (va, oa), (vb, ob) = (_sets(part.column(c), plan.words) for c in ("text_a", "text_b"))
                    both, rows = np.concatenate([va, vb]), np.concatenate([tx.row_of(oa), tx.row_of(ob)])
                    order = np.lexsort((both, rows))
                    both, rows = both[order], rows[order]
                    same = (both[1:] == both[:-1]) & (rows[1:] == rows[:-1])
                    shared = np.bincount(rows[1:][same], minlength=part.num_rows)
                    union = np.diff(oa) + np.diff(ob) - shared
                    ok = (plan.den * shared >= plan.num * union) & (union > 0)
                    yield part.select(["a", "b"]).filter(pa.array(ok))

    return run


def _confirm(pairs: DataFrame, texts: DataFrame, plan: Plan, name: str) -> DataFrame:
    """The staged pairs that are links. Only texts that a pair names go through the joins."""
    nodes = stage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "nodes")
    few = nodes.count() <= BROADCAST_IDS
    named = texts.join(F.broadcast(nodes) if few else nodes, F.col("doc_id") == F.col("id"), "left_semi")
    joined = pairs.join(named.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(named.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    links = stage(arrow_map(joined.select("a", "b", "text_a", "text_b"), _confirmer(plan), "a long, b long").distinct(), name)
    discard(texts.sparkSession, nodes)
    return links


def spanning(a: np.ndarray, b: np.ndarray, bits: np.ndarray, comp_a: np.ndarray, comp_b: np.ndarray) -> np.ndarray:
    """Pairs that span the components which all pairs together would join, the fewest bits first."""
    nodes, where = np.unique(np.concatenate([comp_a, comp_b]), return_inverse=True)
    x, y = where[: len(a)].tolist(), where[len(a) :].tolist()
    parent, left, out = list(range(len(nodes))), len(nodes) - 1, []

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for k in np.lexsort((b, a, bits)).tolist():
        p, q = root(x[k]), root(y[k])
        if p != q:
            parent[p] = q
            out.append(k)
            left -= 1
            if not left:
                break
    return np.array(out, np.int64)


def _crosser(plan: Plan, forest: bool):
    """Rows of one (bucket, block pair) follow each other; out come pairs across components that sketches allow.

    A pair of a bucket is compared in just one block pair: within block i in (i, i) and across in (i, j). With forest,
    only pairs that span what all of them would join come out.
    """

    def compare(t: pa.Table):
        cols = {c: t.column(c).to_numpy() for c in ("key", "rep", "comp", "pivot", "block", "i", "j", "n_shingles")}
        sketch = np.vstack(t.column("sketch").to_numpy(zero_copy_only=False)).view(U)
        rep, comp, pivot = cols["rep"], cols["comp"], cols["pivot"][0]
        left = np.flatnonzero(cols["block"] == cols["i"])
        right = left if cols["i"][0] == cols["j"][0] else np.flatnonzero(cols["block"] == cols["j"])
        found: list[tuple] = []
        for k in left:
            if rep[k] == pivot:  # star pairs are settled
                continue
            near = (comp[right] != comp[k]) & (rep[right] != pivot)
            if right is left:
                near &= rep[right] > rep[k]
            near = right[near]
            near = near[np.bitwise_count(sketch[near, :SAMPLE_WORDS] ^ sketch[k, :SAMPLE_WORDS]).sum(axis=1) <= plan.most_bits]
            bits = np.bitwise_count(sketch[near, SAMPLE_WORDS:] ^ sketch[k, SAMPLE_WORDS:]).sum(axis=1)
            ok = bits <= allowed_set_bits(cols["n_shingles"][near] + cols["n_shingles"][k], plan)
            if ok.any():
                found.append((np.full(ok.sum(), k), near[ok], bits[ok]))
        if not found:
            return
        x, y, bits = (np.concatenate(part) for part in zip(*found, strict=True))
        if forest:
            s = spanning(np.minimum(rep[x], rep[y]), np.maximum(rep[x], rep[y]), bits, comp[x], comp[y])
            x, y = x[s], y[s]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), cols["key"][0])), pa.array(np.minimum(rep[x], rep[y])), pa.array(np.maximum(rep[x], rep[y]))], ["key", "a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            key = np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for begin, end in zip([0, *cuts[:-1]], cuts, strict=False) if len(cuts) else ():
                yield from compare(t.slice(begin, end - begin))
            held = t.slice(cuts[-1]) if len(cuts) else t
        if held is not None and held.num_rows:
            yield from compare(held)

    return run


def _crossed(members: DataFrame, sketches: DataFrame, plan: Plan, forest: bool, within: bool) -> DataFrame:
    """Staged key, a and b of the pairs that members (key, rep, comp, pivot, n) of open buckets give.

    within compares each block with itself only. Otherwise the members of a bucket's largest component are blocks that
    meet all other blocks, but not each other.
    """
    h = F.xxhash64("rep")
    if within:
        dealt = members.withColumn("block", F.pmod(h, F.ceil(F.col("n") / BLOCK)).cast("int")).withColumns({"i": F.col("block"), "j": F.col("block")})
    else:
        sizes = _merged(members, ["key", "comp"], "rep", [(F.count, "rep", "size")])
        # by a second, constant key, so that the join deals both sides anew and can split a hot bucket
        major = sizes.groupBy("key", F.shiftright(F.pmod(F.xxhash64("comp"), F.lit(64)).cast("int"), 6).alias("run")).agg(F.max(F.struct("size", "comp")).alias("m"), F.sum("size").alias("all"))
        major = major.select("key", F.col("m.comp").alias("major"), F.greatest(F.ceil((F.col("all") - F.col("m.size")) / BLOCK), F.lit(1)).cast("int").alias("rest_blocks"), F.ceil(F.col("m.size") / BLOCK).cast("int").alias("major_blocks"))
        own = members.join(major, "key").withColumn("is_major", F.col("comp") == F.col("major"))
        own = own.withColumn("block", F.when(F.col("is_major"), F.col("rest_blocks") + F.pmod(h, F.col("major_blocks"))).otherwise(F.pmod(h, F.col("rest_blocks"))).cast("int"))
        last = F.col("rest_blocks") + F.when(F.col("is_major"), F.lit(0)).otherwise(F.col("major_blocks")) - 1
        dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), last))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    rows = dealt.join(sketches, "rep").select("key", "i", "j", "block", "rep", "comp", "pivot", "n_shingles", "sketch")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return stage(arrow_map(rows, _crosser(plan, forest), "key long, a long, b long"), "crossed")


def _merged(df: DataFrame, key: list[str], member: str, aggs: list) -> DataFrame:
    """Aggregates of each key, merged in two levels; what joins them with their rows can still split a hot key."""
    first = df.groupBy(*key, F.pmod(F.xxhash64(member), F.lit(64)).cast("int").alias("run")).agg(*[f(c).alias(o) for f, c, o in aggs])
    second = {F.min: F.min, F.max: F.max, F.count: F.sum}
    return first.groupBy(*key, F.shiftright("run", 6).alias("run")).agg(*[second[f](o).alias(o) for f, _, o in aggs]).drop("run")


def near_groups(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id and kept.

    component_id is the smallest id of the documents reachable over links, itself included; kept tells whether it is
    the document's own. Texts without words (null and empty too) have no shingles and are linked with nothing, nor is a
    row with a null id, whose component_id is null. Rows repeated under one id are one document with the links of all.
    Texts are taken whole, A-Z lower-cased, words being runs without ASCII white space. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stage(arrow_map(texts, _signer(plan), SIGNATURE), "signatures")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    classes = stage(_merged(some, ["n_shingles", "h1", "h2"], "doc_id", [(F.min, "doc_id", "rep")]), "classes")
    reps = stage(some.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "n_shingles", "sketch", "bands").dropDuplicates(["rep"]), "representatives")

    posted = reps.select("rep", F.posexplode("bands").alias("band", "hash")).select("rep", F.xxhash64("band", "hash").alias("key"))
    buckets = _merged(posted, ["key"], "rep", [(F.min, "rep", "pivot"), (F.count, "rep", "n")]).where("n > 1")
    posted = stage(posted.join(buckets, "key"), "buckets")
    sketches = reps.select("rep", "sketch", "n_shingles")
    stars = posted.where("rep > pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    stars = stars.join(sketches.toDF("a", "sa", "na"), "a").join(sketches.toDF("b", "sb", "nb"), "b")
    bits = [F.aggregate(F.slice(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), at + 1, n), F.lit(0), lambda s, x: s + x) for at, n in ((0, SAMPLE_WORDS), (SAMPLE_WORDS, SKETCH_WORDS - SAMPLE_WORDS))]
    stars = stars.where((bits[0] <= plan.most_bits) & (bits[1] <= allowed_set_bits(F.col("na") + F.col("nb"), plan, F)))
    comps = connected_components(_confirm(stage(stars.select("a", "b"), "stars"), texts, plan, "links"))

    def confirm(pairs):
        """Take the links among pairs into the components."""
        nonlocal comps
        comps = joined_components(comps, _confirm(pairs.select("a", "b").distinct(), texts, plan, "links"))

    def across(pairs):
        """The pairs that join two components."""
        ends = [comps.select(F.col("node").alias(x), F.col("comp").alias(f"comp_{x}")) for x in ("a", "b")]
        out = pairs.join(ends[0], "a", "left").join(ends[1], "b", "left")
        return out.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select(*pairs.columns)

    def open_members(buckets):
        """Members, with their components, of the buckets that hold several components."""
        labelled = stage(buckets.join(comps.select(F.col("node").alias("rep"), "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "labelled")
        open_keys = _merged(labelled, ["key"], "rep", [(F.min, "comp", "c0"), (F.max, "comp", "c1")]).where("c0 < c1").select("key")
        return labelled.join(open_keys, "key")

    tried = _crossed(open_members(posted.where("n > 2")), sketches, plan, True, True)
    confirm(tried)
    large = posted.where(F.col("n") > BLOCK)
    if large.limit(1).count():
        more = _crossed(open_members(large), sketches, plan, True, False)
        confirm(more)
        tried = tried.unionByName(more)
    # pairs still across components were refuted; what their buckets' forests may have hidden is confirmed in full
    refuted = stage(across(tried).distinct(), "refuted")
    if refuted.limit(1).count():
        more = _crossed(open_members(posted.join(refuted.select("key").distinct(), "key", "left_semi")), sketches, plan, False, False)
        confirm(more.join(refuted.select("a", "b").distinct(), ["a", "b"], "left_anti"))

    owned = classes.join(comps.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("n_shingles", "h1", "h2", F.coalesce("comp", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "h1", "h2").join(owned, ["n_shingles", "h1", "h2"], "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one document of each group, with all their columns."""
    gone = near_groups(docs, plan, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias("__gone_id"))
    return docs.join(gone, docs[id_col] == gone["__gone_id"], "left_anti")
