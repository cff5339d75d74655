"""Folders for intermediate tables that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

LOCAL_FOLDER = "/tmp/checkpoints/tsengine"


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only on a single machine, where it is unset, a folder of our own."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return LOCAL_FOLDER


def file_system(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is deleted when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    target, files = file_system(spark, path)
    files.deleteOnExit(target)
    return path


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below a path; none if it does not exist."""
    target, files = file_system(spark, path)
    if not files.exists(target):
        return []
    return sorted(x.getPath().getName() for x in files.listStatus(target) if x.isDirectory())


def delete(spark: SparkSession, path: str) -> None:
    target, files = file_system(spark, path)
    files.delete(target, True)
