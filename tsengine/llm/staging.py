"""Intermediate tables in the folder that driver and executors share.

A table written through Spark's commit protocol survives the loss of executors, cuts the lineage and, unlike
`checkpoint()`, computes its input once. The folder is the session's `spark.checkpoint.dir`; only where that is unset
(tests, a single machine) a folder of our own is used.
"""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship
from . import tokens

LOCAL_FOLDER = "/tmp/checkpoints/tsengine"


def shared_folder(spark: SparkSession) -> str:
    """The shared folder's URI; refuses to guess one when the session runs on a cluster."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return LOCAL_FOLDER


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is deleted when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


#: Hadoop's checked local files start a process (chmod) for every file and for its checksum. Until it runs its program,
#: it counts with all of the executor's memory once more. Plain ones start none; other file systems don't look at this.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back with the same schema."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**PLAIN_FILES, compression="zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = jvm.org.apache.hadoop.fs.Path(file)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _trim() -> None:
    """Give memory that is free but held back to the system: idle workers keep what their last task needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _tidy(function, encodes: bool):
    def run(batches):
        if not encodes:
            tokens.forget()
        try:
            yield from function(batches)
        finally:
            _trim()

    return run


#: Rows of a batch that goes to a worker, where the session leaves Spark's default: texts of kilobytes then make batches
#: of megabytes, of which JVM and worker hold several. Long texts are bounded by their bytes.
BATCH_ROWS, BATCH_SETTING = "2000", "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES, BYTES_SETTING = str(4 << 20), "spark.sql.execution.arrow.maxBytesPerBatch"


def arrow_map(df: DataFrame, function, schema, encodes: bool = False) -> DataFrame:
    """mapInArrow whose workers can import this package.

    Only a function that encodes keeps its worker's tokenizer; the next task of another kind forgets it.
    """
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(BATCH_SETTING) == "10000":
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    if spark.conf.get(BYTES_SETTING, None) is None:
        spark.conf.set(BYTES_SETTING, BATCH_BYTES)
    return df.mapInArrow(_tidy(function, encodes), schema)
