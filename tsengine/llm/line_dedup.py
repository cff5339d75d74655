"""Line deduplication in DataFrame operations only; its result is a bitmap of lines per document, not text.

A line's key is the line stripped of ASCII white space and lower-cased (A-Z). Keys of at least `min_chars` code points
that occur in at least `min_docs` documents are repeated; all their lines go, except those in one document.

1. The lines' hashes (two of 64 bits), documents and positions are range-partitioned by hash and document and sorted by
   hash, document and position within partitions. As the document is part of the range key, a line that a third of all
   documents hold spreads over as many partitions as it needs. A window streams over that order, without another
   exchange or sort, and marks the first occurrence of each hash in each document.
2. First occurrences are summed, each partition's share of a hash before any exchange, to the number of its documents
   and the one that keeps its lines. A partition thus sends one row for each of its hashes.
3. The entries of repeated hashes, but for the keepers', become bitmaps of 32,768 bits (`bitmap_construct_agg`), one row
   for each document and bucket, cut after the last byte that is set.

Texts are read to hash lines and to apply bitmaps. Up to the bitmaps only hashes, ids, positions and bitmaps are
shuffled; `apply_bitmaps` then joins the texts with them, which shuffles texts once unless the bitmaps are small enough
for adaptive execution to broadcast them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exact_dedup import lower_ascii
from .staging import stage

SPACE = " \t\n\x0b\f\r"
BUCKET = 32_768


def line_key(line):
    """The column's lines as keys."""
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def split_lines(text):
    """The column's texts as arrays of lines; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashes(key) -> list:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")]


def sorted_runs(docs: DataFrame, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """h1, h2, doc_id, pos and first of each line with a key of at least min_chars code points.

    Rows are in runs by hash, document and position; first tells the first of a document's lines with that hash.
    """
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(split_lines(F.col(text_col))).alias("pos", "line"))
    lines = lines.select("doc_id", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    lines = stage(lines.select(*hashes(F.col("key")), "doc_id", "pos"), "lines")
    ranged = lines.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    # the range partitioning by hash and document is what the window needs, and so is the order
    in_doc = Window.partitionBy("h1", "h2", "doc_id").orderBy("pos")
    return stage(ranged.select("*", (F.row_number().over(in_doc) == 1).alias("first")), "runs")


def repeated_keys(runs: DataFrame, min_docs: int = 3, keep: str = "last") -> DataFrame:
    """h1, h2 and keeper of each key that occurs in enough documents."""
    pick = F.max if keep == "last" else F.min
    # two levels, so that a join of the result with the runs deals both sides anew and can split a hot hash
    first = runs.where("first").groupBy("h1", "h2", F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int").alias("run")).agg(F.count(F.lit(1)).alias("n"), pick("doc_id").alias("keeper"))
    both = first.groupBy("h1", "h2", F.shiftright("run", 6).alias("run")).agg(F.sum("n").alias("n"), pick("keeper").alias("keeper"))
    return both.where(F.col("n") >= min_docs).select("h1", "h2", "keeper")


def line_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, keep: str = "last", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and drops of each document that loses lines: an array of (bucket, bits), by bucket.

    Bit p % 32768 of bucket p div 32768 + 1 is set if line p goes. Documents without a row keep every line, and what
    follows a bitmap's last set byte is left out. Rows under one id (or without an id) are one document: their lines
    count once and share a bitmap, so ids should be unique. A null id never keeps a line that another document holds.
    """
    runs = sorted_runs(docs, min_chars, id_col, text_col)
    gone = runs.join(repeated_keys(runs, min_docs, keep), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    gone = gone.select("doc_id", (F.col("pos") + 1).cast("long").alias("p"))
    bits = gone.groupBy("doc_id", F.expr("bitmap_bucket_number(p)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"), F.max(F.expr("bitmap_bit_position(p)")).alias("top"))
    bits = bits.select("doc_id", F.struct("bucket", F.expr("substring(bits, 1, cast(top div 8 as int) + 1)").alias("bits")).alias("b"))
    return bits.groupBy("doc_id").agg(F.array_sort(F.collect_list("b")).alias("drops"))


def _dropped(drops, index):
    """Whether the bit of a line's index is set; a constant time look-up for each line."""
    bits = F.element_at(F.filter(drops, lambda b: b["bucket"] == (F.floor(index / BUCKET) + 1)), 1)["bits"]
    byte = F.conv(F.hex(F.substring(bits, F.floor(index % BUCKET / 8).cast("int") + 1, F.lit(1))), 16, 10)
    return F.coalesce(F.try_mod(F.floor(F.try_divide(byte.cast("int"), F.pow(F.lit(2), index % 8))), F.lit(2)), F.lit(0)) == 1


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with kept_text, n_lines (before dropping) and n_dropped added, for every row of docs."""
    bitmaps = bitmaps.select(F.col("doc_id").alias("__bits_id"), F.col("drops").alias("__drops"))
    joined = docs.join(bitmaps, docs[id_col].eqNullSafe(bitmaps["__bits_id"]), "left").withColumn("__lines", split_lines(F.col(text_col)))
    kept = F.when(F.col("__drops").isNull(), F.col("__lines")).otherwise(F.filter("__lines", lambda _, i: ~_dropped(F.col("__drops"), i)))
    out = joined.withColumn("__kept", kept)
    return out.withColumns({"kept_text": F.array_join("__kept", "\n"), "n_lines": F.size("__lines").cast("long"), "n_dropped": (F.size("__lines") - F.size("__kept")).cast("long")}).drop("__bits_id", "__drops", "__lines", "__kept")
