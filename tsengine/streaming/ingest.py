"""Continuous ingest and downsampling with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import labels_key
from ..sources.exposition import parse_lines
from ..sources.json_writes import REQUEST, samples
from ..sources.scrape import LANDED, landed_samples, scrape_stream
from ..sources.store import Store


def stream_text(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of samples from exposition text that lands in a folder."""
    return parse_lines(spark.readStream.text(folder))


def stream_json(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of samples from files of JSON write requests."""
    return samples(spark.readStream.schema(REQUEST).json(folder))


def stream_landed(spark: SparkSession, folder: str, prefix: str = "") -> DataFrame:
    """A stream of samples from pages that scrapers land."""
    return landed_samples(spark.readStream.schema(LANDED).json(folder), prefix)


def stream_scraped(spark: SparkSession, config: str) -> DataFrame:
    """A stream of samples from the targets of a scrape configuration, each job's at its interval."""
    return landed_samples(scrape_stream(spark, config))


def into_store(stream: DataFrame, store: Store, checkpoint: str, every: str = "5 seconds", once: bool = False) -> StreamingQuery:
    """Append a stream to a store, one write per micro-batch; a batch written twice has the same number and counts once.

    A micro-batch is kept while it is written, so that its source (a scraped target, say) is read once.
    """

    def write(df: DataFrame, k: int) -> None:
        df.persist()
        try:
            store.write(df, k)
        finally:
            df.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def first_writes(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """The stream without repeated (series, time) pairs, the first kept; state is dropped as the watermark passes."""
    keyed = stream.withColumns({"labels_key": labels_key(F.col("name"), F.col("labels")), "event_time": F.timestamp_seconds("ts")})
    return keyed.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(["labels_key", "ts"])


def downsampled(stream: DataFrame, keys: list[str], interval: int, lateness: str = "1 hour") -> DataFrame:
    """avg, min, max and count per series and whole stretch of time, each sent once, when the watermark has passed it."""
    timed = stream.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", lateness)
    out = timed.groupBy(F.window("event_time", f"{interval} seconds").alias("w"), *[f"`{k}`" for k in keys])
    out = out.agg(F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").cast("double").alias("count"))
    return out.select(*[f"`{k}`" for k in keys], F.unix_timestamp("w.start").alias("ts"), "avg", "min", "max", "count")
