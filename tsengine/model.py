"""Labelled samples: their columns, canonical keys, and builders for the driver's tables.

A sample has a metric name, labels, a time in Unix seconds and a double value. Inside plans every label is a column of
its own (`label_columns`), so that filters on labels reach the Parquet scan and grouping needs no maps. A source whose
label names are open keeps a MAP column and is widened with the names that a query touches.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = "l_"
SAMPLE_SCHEMA = "name string, labels map<string,string>, ts long, value double"


def label_column(label: str) -> str:
    """The name of a label's column inside plans."""
    return PREFIX + label


def col(label: str) -> Column:
    return F.col(f"`{label_column(label)}`")


def labels_key(name: Column, labels: Column) -> Column:
    """name{k="v",...} with labels in order: the identity of a series with a label map."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), F.regexp_replace(e["value"], r'(["\\])', r"\\$1"), F.lit('"')))
    return F.concat(name, F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def series_id(name: Column, pairs: Column) -> Column:
    """A 64-bit id of a series from its sorted label pairs; a store's table of series tells ids apart."""
    return F.xxhash64(name, pairs)


@dataclass
class Metric:
    """One metric's samples with its labels as columns named after them."""

    df: DataFrame
    labels: list[str]

    def wide(self) -> DataFrame:
        return self.df.select(*[F.col(f"`{x}`").alias(label_column(x)) for x in self.labels], "ts", "value")


@dataclass
class TableSource:
    """Metrics that are DataFrames with known labels, each read only by queries that name it."""

    metrics: dict[str, Metric] = field(default_factory=dict)

    def names(self) -> list[str]:
        return sorted(self.metrics)

    def labels_of(self, name: str) -> list[str]:
        return self.metrics[name].labels

    def scan(self, name: str, low: int | None, high: int | None, labels: list[str], matchers: tuple = ()) -> DataFrame:
        """Label columns, ts and value; a source may use matchers to read less, callers filter all the same."""
        df = self.metrics[name].wide()
        return df.select(*[label_column(x) for x in labels if x in self.metrics[name].labels], "ts", "value").where(between(F.col("ts"), low, high))


@dataclass
class MapSource:
    """Samples of any metrics with a label map, maybe partitioned by bucket (the start of a stretch of bucket_size)."""

    df: DataFrame
    bucket_size: int | None = None
    _labels: dict[str, list[str]] = field(default_factory=dict)
    _names: list[str] | None = None

    def names(self) -> list[str]:
        """Names of all metrics: one small job, its result kept."""
        if self._names is None:
            self._names = sorted(r[0] for r in self.df.select("name").distinct().collect())
        return self._names

    def labels_of(self, name: str) -> list[str]:
        """The metric's label names: one small job, its result kept."""
        if name not in self._labels:
            rows = self.df.where(F.col("name") == name).select(F.explode(F.map_keys("labels")).alias("k")).distinct().collect()
            self._labels[name] = sorted(r["k"] for r in rows)
        return self._labels[name]

    def scan(self, name: str, low: int | None, high: int | None, labels: list[str], matchers: tuple = ()) -> DataFrame:
        df = self.df.where(F.col("name") == name).where(between(F.col("ts"), low, high))
        if self.bucket_size:  # partitions are pruned by the bucket, never by a filter on ts
            floor = lambda x: None if x is None else x // self.bucket_size * self.bucket_size
            df = df.where(between(F.col("bucket"), floor(low), floor(high)))
        return df.select(*[F.element_at("labels", x).alias(label_column(x)) for x in labels], "ts", "value")


def between(column: Column, low: int | None, high: int | None) -> Column:
    """Inclusive bounds; None is unbounded."""
    out = F.lit(True)
    if low is not None:
        out &= column >= F.lit(int(low))
    if high is not None:
        out &= column <= F.lit(int(high))
    return out


def first_write(df: DataFrame, labels: list[str], order: Column) -> DataFrame:
    """One sample for each series and time: the one written first."""
    return df.groupBy(*[f"`{x}`" for x in labels], "ts").agg(F.min_by("value", order).alias("value"))


def event_value(spark: SparkSession, sf_dir: str) -> Metric:
    """Values of events by type and user; no two events of a series share a second unless ids decide."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.col("user_id").cast("string").alias("user_id"), F.unix_timestamp("ts").alias("ts"), "value", "event_id")
    return Metric(first_write(df, ["event_type", "user_id"], F.col("event_id")), ["event_type", "user_id"])


def event_total(spark: SparkSession, sf_dir: str, day: int = 86_400) -> Metric:
    """A counter of events by type: counts of seconds, summed within days on top of the days before.

    So the running sum orders a day's seconds in a task, and the days themselves, never all of a type's seconds.
    """
    from pyspark.sql import Window

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.unix_timestamp("ts").alias("ts"))
    seconds = events.groupBy("event_type", "ts").agg(F.count(F.lit(1)).alias("n")).withColumn("day", F.floor(F.col("ts") / day))
    days = events.groupBy("event_type", F.floor(F.col("ts") / day).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("event_type").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    days = days.select("event_type", "day", F.coalesce(earlier, F.lit(0)).alias("before"))
    total = F.sum("n").over(Window.partitionBy("event_type", "day").orderBy("ts")) + F.col("before")
    return Metric(seconds.join(days, ["event_type", "day"]).select("event_type", "ts", total.cast("double").alias("value")), ["event_type"])


def order_totalprice(spark: SparkSession, sf_dir: str) -> Metric:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.unix_timestamp("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"), "o_orderkey")
    return Metric(first_write(df, ["status", "priority"], F.col("o_orderkey")), ["status", "priority"])


def line_quantity(spark: SparkSession, sf_dir: str) -> Metric:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"), F.unix_timestamp("l_shipdate").alias("ts"), F.col("l_quantity").alias("value"), "l_orderkey", "l_linenumber")
    return Metric(first_write(df, ["returnflag", "linestatus"], F.struct("l_orderkey", "l_linenumber")), ["returnflag", "linestatus"])


def driver_tables(spark: SparkSession, sf_dir: str) -> TableSource:
    """The metrics made of the driver's tables; plans read only what a query names."""
    builders = {"event_value": event_value, "event_total": event_total, "order_totalprice": order_totalprice, "line_quantity": line_quantity}
    return TableSource(_Lazy({k: (lambda f=f: f(spark, sf_dir)) for k, f in builders.items()}))


class _Lazy(dict):
    """Metrics built when first asked for."""

    def __init__(self, makers: dict):
        super().__init__(makers)

    def __getitem__(self, key):
        value = super().__getitem__(key)
        if not isinstance(value, Metric):
            value = value()
            self[key] = value
        return value
