"""The corpus pipeline: documents that the quality classifier keeps, deduplicated, decontaminated and packed.

Each stage takes the session, the documents that its predecessor kept and the folder of the other tables, works on all
of them, and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tsengine.llm.decontaminate import drop_contaminated
from tsengine.llm.exact_dedup import drop_exact_duplicates
from tsengine.llm.near_dedup import Plan, drop_near_duplicates
from tsengine.llm.packing import pack_documents
from tsengine.llm.quality import keep_quality
from tsengine.llm.staging import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.3; the classifier learns from the labels of documents that are not held out."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), cut=0.3)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the one with the largest id."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of five-word shingles."""
    return drop_near_duplicates(docs, Plan(words=5, num=80, den=100))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window is similar to a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of the permitted lengths."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("pack", pack)]

#: A trained classifier and hashed candidates are not for SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
