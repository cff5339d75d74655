"""Downsampling: avg, min, max and count of each series in whole stretches of time, and which level answers a query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATISTICS = ("avg", "min", "max", "count")


@dataclass(frozen=True)
class Level:
    """Samples of one interval (0: raw), kept for retention seconds (0: for ever)."""

    name: str
    interval: int
    retention: int = 0

    def __post_init__(self):
        if not self.name or self.interval < 0 or self.retention < 0:
            raise ValueError("a level needs a name, an interval and a retention")


LEVELS = (Level("raw", 0, 2 * 86_400), Level("1m", 60, 30 * 86_400), Level("1h", 3600, 3 * 365 * 86_400))


def downsample(samples: DataFrame, interval: int, keys: list[str]) -> DataFrame:
    """keys, ts (the stretch's start), avg, min, max and count (a double) of each stretch."""
    start = (F.floor(F.col("ts") / F.lit(interval)) * interval).cast("long")
    quoted = [f"`{k}`" for k in keys]
    return samples.groupBy(*quoted, start.alias("bucket")).agg(F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").cast("double").alias("count")).withColumnRenamed("bucket", "ts")


def coarser(level: DataFrame, interval: int, keys: list[str]) -> DataFrame:
    """A downsampled level downsampled again: averages weigh by their counts."""
    start = (F.floor(F.col("ts") / F.lit(interval)) * interval).cast("long")
    quoted = [f"`{k}`" for k in keys]
    out = level.groupBy(*quoted, start.alias("bucket")).agg(F.sum(F.col("avg") * F.col("count")).alias("s"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("count").alias("count"))
    return out.select(*quoted, F.col("bucket").alias("ts"), (F.col("s") / F.col("count")).alias("avg"), "min", "max", "count")


def as_metrics(level: DataFrame, name: str = "name") -> DataFrame:
    """One sample per statistic, the metric's name ending in _avg, _min, _max or _count."""
    keys = [c for c in level.columns if c not in (*STATISTICS, "ts", name)]
    long = level.unpivot([name, *keys, "ts"], list(STATISTICS), "statistic", "value")
    return long.withColumn(name, F.concat_ws("_", F.col(name), F.col("statistic"))).drop("statistic")


def level_for(start: int, now: int, step: int = 0, levels: tuple[Level, ...] = LEVELS) -> Level:
    """The finest level that still holds start; coarser if the step allows no more than one sample in each."""
    held = [x for x in levels if not x.retention or now - start <= x.retention] or [max(levels, key=lambda x: x.retention or float("inf"))]
    fine = min(held, key=lambda x: x.interval)
    fits = [x for x in held if x.interval <= step]
    return max(fits, key=lambda x: x.interval) if step and fits else fine
