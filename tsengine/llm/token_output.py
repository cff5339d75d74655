"""Token ids in a compressed file format, and back.

A dataset is a folder with `codebook` (one row: the code lengths of all ids and the end id) and `blocks` (Parquet, one
row per block). Ids have canonical Huffman codes of at most 16 bits (more only if over 65,536 ids occur), made from counts over the whole corpus. A block
holds whole documents (about `BLOCK_IDS` ids, or one longer document) and is decoded by itself: its bits, the bit offset
of every 256th id, its documents' ids and sizes, its part and the ids before it in the part. Parts are ranges of
ascending document ids. Blocks are written by Spark's commit protocol to any store that Spark can write.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from . import tokens
from .huffman import code_lengths, codes, pack, tables, unpack
from .staging import arrow_map, discard, new_path, stage

BLOCK_IDS = 1 << 16
BLOCKS = "part int, block int, before long, doc_ids array<long>, sizes array<long>, bits binary, checkpoints binary"


def _encoder(name: str, end_id: int):
    def run(batches):
        for piece in tx.gathered(batches, "text", tokens.TEXT_BYTES):
            ids, offsets = tokens.encode(piece.column("text"), name)
            rows = np.arange(1, len(offsets))
            ids, offsets = np.insert(ids, offsets[1:], np.uint32(end_id)), offsets + np.arange(len(offsets))
            wide = np.uint32 if len(ids) and ids.max() > 0xFFFF else np.uint16
            raw = ids.astype("<u2" if wide is np.uint16 else "<u4")
            data = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((offsets * raw.itemsize).astype(np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.full(len(rows), raw.itemsize, np.int32)), data], ["doc_id", "width", "ids"])

    return run


def _ids(batch: pa.RecordBatch):
    """The ids of each row of a token table."""
    for width, raw in zip(batch.column("width").to_pylist(), batch.column("ids"), strict=True):
        yield np.frombuffer(raw.as_buffer(), "<u2" if width == 2 else "<u4").astype(np.uint32)


def _counter(batches):
    counts = np.zeros(0, np.int64)
    for batch in batches:
        if batch.num_rows:
            new = np.bincount(np.concatenate(list(_ids(batch))))
            if len(new) > len(counts):
                counts, new = new.astype(np.int64), counts
            counts[: len(new)] += new
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["id", "n"])


def token_table(docs: DataFrame, name: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, and each text's ids with the end id as little-endian integers of width bytes."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(texts, _encoder(name, end_id), "doc_id long, width int, ids binary", encodes=True)


def _blocks(lengths):
    def run(batches):
        size = lengths.value
        code, part, block, before = codes(size), TaskContext.get().partitionId(), 0, 0
        held, doc_ids, n = [], [], 0

        def flush():
            bits, at = pack(np.concatenate(held), size, code)
            one = lambda v, kind=None: pa.array([v], kind)
            return pa.RecordBatch.from_arrays([one(part, pa.int32()), one(block, pa.int32()), one(before, pa.int64()), one(doc_ids, pa.list_(pa.int64())), one([len(x) for x in held], pa.list_(pa.int64())), one(bits), one(at.astype("<u8").tobytes())], ["part", "block", "before", "doc_ids", "sizes", "bits", "checkpoints"])

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), _ids(batch), strict=True):
                if n and n + len(ids) > BLOCK_IDS:
                    yield flush()
                    block, before, held, doc_ids, n = block + 1, before + n, [], [], 0
                held.append(ids)
                doc_ids.append(doc_id)
                n += len(ids)
        if held:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, name: str = "word_bpe_49k.json", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text (null: empty) and write the dataset at path, documents in ascending order of their ids.

    Null ids come first; rows repeated under one id are written one after another, by their ids. The driver gets one
    count for each id of the vocabulary at most.
    """
    spark = docs.sparkSession
    table = stage(token_table(docs, name, end_id, id_col, text_col), "tokens")
    counts = arrow_map(table.select("width", "ids"), _counter, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    all_counts = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, np.int64)
    all_counts[counts["id"].to_numpy()] = counts["n"].to_numpy()
    lengths = code_lengths(all_counts)
    spark.createDataFrame([(bytearray(lengths.tobytes()), end_id)], "lengths binary, end_id int").coalesce(1).write.parquet(f"{path}/codebook")
    ordered = table.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    arrow_map(ordered, _blocks(spark.sparkContext.broadcast(lengths)), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    discard(spark, table)


def _reader(lengths, starts, each: Callable[[np.ndarray], int] | None):
    def run(batches):
        symbol, size = tables(lengths.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 32):
                part = batch.slice(k, 32)
                sizes = [np.array(x, np.int64) for x in part.column("sizes").to_pylist()]
                totals = np.array([x.sum() for x in sizes])
                points = [np.frombuffer(x, "<u8") for x in part.column("checkpoints").to_pylist()]
                ids = unpack(part.column("bits").to_pylist(), points, totals, symbol, size)
                flat = np.concatenate(sizes)
                ends = np.cumsum(flat)
                base = [starts.value[p] + b for p, b in zip(part.column("part").to_pylist(), part.column("before").to_pylist(), strict=True)]
                at = np.concatenate([b + np.cumsum(x) - x for b, x in zip(base, sizes, strict=True)])
                doc_ids = pa.array([d for x in part.column("doc_ids").to_pylist() for d in x], pa.int64())
                parts = [ids[e - n : e] for e, n in zip(ends.tolist(), flat.tolist(), strict=True)]
                last = pa.array([each(x) for x in parts], pa.int64()) if each else pa.array([x.tolist() for x in parts], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(at), pa.array(flat), last], ["doc_id", "start", "n_tokens", "ids"])

    return run


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def read_tokens(spark: SparkSession, path: str, each: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of each document of a dataset.

    With each, a function of a document's ids, the last column holds its results instead of the ids. The driver gets one
    total for each part.
    """
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/codebook").first()["lengths"]), np.uint8)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = blocks.select("part", (F.col("before") + F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).groupBy("part").agg(F.max("n").alias("n")).orderBy("part").collect()
    starts, done = {}, 0
    for row in totals:
        starts[row["part"]], done = done, done + row["n"]
    context = spark.sparkContext
    kind = "long" if each else "array<long>"
    return arrow_map(blocks, _reader(context.broadcast(lengths), context.broadcast(starts), each), f"doc_id long, start long, n_tokens long, ids {kind}")


def round_trip(docs: DataFrame, name: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    """Write docs' ids to a dataset in the shared folder and read it back: doc_id, start, n_tokens, ids_crc32."""
    path = new_path(docs.sparkSession, "token-files")
    write_tokens(docs, path, name, end_id)
    return read_tokens(docs.sparkSession, path, crc32).withColumnRenamed("ids", "ids_crc32")
