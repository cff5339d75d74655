"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only.

Every document gets a 256-bit digest of its normalised text and a second, independent 64-bit check with the text's
length. What one input partition holds is a run.

1. Each partition sorts its run by digest and merges equal entries as it streams through it (a partial sort aggregate),
   so a digest that a third of all documents share leaves any partition as one entry.
2. Binomial rounds: the runs whose numbers agree without their lowest `ROUND_BITS` bits become one run. As a run of the
   whole corpus would fit no machine, a run is cut into `2 ** SLICE_BITS` slices by the leading bits of its digests;
   the partners exchange slices (an exchange by run number and slice), sort them and merge them in order. A sort
   aggregate streams over the sorted slice, holding one entry at a time, and keeps of each digest the retained id and
   the group's size. After `ROUNDS` rounds one run is left, in slices.

Entries merge only if digest, check and length agree, so every level verifies what it merges. An entry enters a merge at
most once for each of the `2 ** ROUND_BITS` partners, whatever its group's size; no task ever sees a group's members.

The retained id is the largest of the group by default (`keep="last"`), or the smallest (`keep="first"`).
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage

#: Bits of the run number merged in a round (8 partners), rounds (512 runs at first; further partitions share numbers),
#: and bits of the digest that cut a run into slices.
ROUND_BITS = 3
ROUNDS = 3
SLICE_BITS = 16


def lower_ascii(text):
    """The column with A-Z lower-cased and nothing else changed; null becomes the empty string."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, check and n_bytes of every row; works on whole texts, null counts as empty."""
    return docs.select(F.col(id_col).alias("doc_id"), lower_ascii(F.col(text_col)).alias("norm")).select(
        "doc_id", F.unhex(F.sha2("norm", 256)).alias("digest"), F.xxhash64(F.lit(1), "norm").alias("check"), F.octet_length("norm").alias("n_bytes")
    )


def _merge(level: DataFrame, order: list[str], entry, size) -> DataFrame:
    """One entry per key of a sorted level. A struct as the entry's buffer makes the aggregate sort-based and streaming."""
    return level.groupBy(*order).agg(entry.alias("entry"), F.sum(size).alias("group_size"))


def tree_merge(table: DataFrame, keep: str = "last") -> DataFrame:
    """One row per distinct text: digest, check, n_bytes, run (0), keep_id and group_size."""
    pick = F.max if keep == "last" else F.min
    order = ["run", "slice", "digest", "check", "n_bytes"]
    runs = table.withColumns({"run": F.spark_partition_id() % (1 << (ROUND_BITS * ROUNDS)), "slice": F.conv(F.hex(F.substring("digest", 1, SLICE_BITS // 8)), 16, 10).cast("int")})
    # a null id never outranks another, whichever is kept
    rank = F.struct(F.col("doc_id").isNull() if keep == "first" else F.col("doc_id").isNotNull(), F.col("doc_id").alias("id"))
    # the first round's exchange follows the partial aggregate, which merges within partitions
    level = _merge(runs.withColumn("run", F.shiftright("run", ROUND_BITS)), order, pick(rank), F.lit(1))
    for _ in range(ROUNDS - 1):
        level = level.withColumn("run", F.shiftright("run", ROUND_BITS)).repartition("run", "slice").sortWithinPartitions(*order)
        level = _merge(level, order, pick("entry"), F.col("group_size"))
    return level.select("digest", "check", "n_bytes", "run", F.col("entry.id").alias("keep_id"), "group_size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "last") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and text_sha256 (of the normalised text).

    Null and empty texts are one group. A null id never outranks another; where a whole group has null ids its keep_id
    is null and all its rows are kept. Rows repeated under one id are one document: they share its fate and each counts
    in group_size. Other columns of docs are ignored, whatever their names.
    """
    table = stage(digests(docs, id_col, text_col), "digests")
    groups = tree_merge(table, keep)
    # the merged level is partitioned by run and slice; joining without them makes Spark deal both sides anew, so that
    # adaptive execution can split a digest that many documents share
    joined = table.join(groups.drop("run"), ["digest", "check", "n_bytes"], "left")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "last") -> DataFrame:
    """The rows of docs that stay, with all their columns; the anti-join with those that go shuffles docs once.

    Rows of different texts under one id, or without an id, are judged each by its own text.
    """
    gone = exact_groups(docs, id_col, text_col, keep).where(~F.col("kept")).select(F.col("doc_id").alias("__gone_id"), F.col("text_sha256").alias("__gone_text"))
    marked = docs.withColumn("__text", F.sha2(lower_ascii(F.col(text_col)), 256))
    same = marked[id_col].eqNullSafe(gone["__gone_id"]) & (marked["__text"] == gone["__gone_text"])
    return marked.join(gone, same, "left_anti").drop("__text")
