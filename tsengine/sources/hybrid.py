"""Hot samples (a bounded, recent DataFrame, cached or not) over a cold store; where both have a sample, the hot one's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import MapSource, label_column
from .store import BUCKET, Store


class HybridSource:
    """Two sources as one: metrics and labels of either, samples of both, the hot one's where times are equal."""

    def __init__(self, cold: MapSource, hot: MapSource):
        self.cold, self.hot = cold, hot

    def names(self) -> list[str]:
        return sorted({*self.cold.names(), *self.hot.names()})

    def labels_of(self, name: str) -> list[str]:
        return sorted({*self.cold.labels_of(name), *self.hot.labels_of(name)})

    def scan(self, name: str, low: int | None, high: int | None, labels: list[str], matchers: tuple = ()) -> DataFrame:
        parts = [s.scan(name, low, high, labels, matchers).withColumn("__rank", F.lit(k)) for k, s in enumerate((self.cold, self.hot))]
        columns = [f"`{label_column(x)}`" for x in labels]
        return parts[0].unionByName(parts[1]).groupBy(*columns, "ts").agg(F.max_by("value", "__rank").alias("value"))

    def evicted(self, cutoff: int, bucket_size: int = 3600) -> HybridSource:
        """Without the hot samples of buckets before the cutoff's; labels of the hot metrics stay known."""
        for name in self.hot.names():
            self.hot.labels_of(name)
        kept = self.hot.df.where(F.floor(F.col("ts") / bucket_size) >= cutoff // bucket_size)
        return HybridSource(self.cold, MapSource(kept, self.hot.bucket_size, dict(self.hot._labels), self.hot.names()))


def in_memory(samples: DataFrame) -> MapSource:
    """Samples (name, labels, ts, value) kept by Spark's cache."""
    return MapSource(samples.cache())


def on_disk(spark: SparkSession, path: str, bucket_size: int = BUCKET, keep_seconds: int = 0, now: int | None = None) -> Store:
    """A store; with keep_seconds, what is older than that before now is deleted first."""
    store = Store(spark, path, bucket_size)
    if keep_seconds and now is not None:
        store.expire(now, keep_seconds)
    return store


def partitioned(spark: SparkSession, path: str, parts: int, bucket_size: int = BUCKET) -> Store:
    """A store whose series are dealt by their ids into so many parts, each a file of every bucket."""
    return Store(spark, path, bucket_size, parts)


def hybrid(store: Store, hot: DataFrame) -> HybridSource:
    return HybridSource(store.source(), MapSource(hot))
