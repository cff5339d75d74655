"""Selectors: label and time filters, the latest sample, and samples resampled to a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import col, label_column
from ..plans.syntax import Matcher
from .ranges import with_neighbour
from .vector import Vector


def matches(matcher: Matcher, known: bool) -> Column:
    """Whether a label matches; an absent label is the empty string. Patterns must match the whole value."""
    value = F.coalesce(col(matcher.label), F.lit("")) if known else F.lit("")
    if matcher.op in ("=", "!="):
        # a plain comparison reaches the Parquet scan where the value can't be absent
        equal = col(matcher.label) == matcher.value if known and matcher.value and matcher.op == "=" else value == F.lit(matcher.value)
        return equal if matcher.op == "=" else ~equal
    hit = value.rlike(f"^(?:{matcher.value})$")
    return hit if matcher.op == "=~" else ~hit


def select(source, name: str, matchers: tuple[Matcher, ...], low: int | None, high: int | None, shift: int = 0) -> Vector:
    """A metric's raw samples with ts in [low, high], moved later by shift seconds; t is ts."""
    labels = source.labels_of(name)
    df = source.scan(name, None if low is None else low - shift, None if high is None else high - shift, labels, matchers)
    for m in matchers:
        df = df.where(matches(m, m.label in labels))
    moved = df.withColumn("ts", F.col("ts") + F.lit(shift)) if shift else df
    return Vector(moved.withColumn("t", F.col("ts")), tuple(labels), name)


def latest(v: Vector, at: int, shift: int = 0) -> Vector:
    """Each series' last sample, however old, evaluated at a time; ts is the sample's own."""
    # a series without labels is a group all the same, so that no sample means no row
    df = v.df.groupBy(*(v.columns or [F.lit(0).alias("__all")])).agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value")).drop("__all")
    return Vector(df.withColumns({"ts": F.col("ts") - F.lit(shift), "t": F.lit(int(at)).cast("long")}), v.labels, v.name)


def resample(v: Vector, start: int, end: int, step: int) -> Vector:
    """At start, start + step, ... up to end: the last sample not older than a tenth more than a step.

    A sample holds from its time until the next one's, so it is expanded to the grid points it covers (two at most);
    no grid is joined.
    """
    last = F.least(F.col("ts") + F.lit(int(step * 1.1)), F.coalesce(F.col("next") - 1, F.lit(end)), F.lit(end))
    first_k, last_k = F.greatest(F.ceil((F.col("ts") - start) / F.lit(float(step))), F.lit(0)), F.floor((F.col("last") - start) / F.lit(float(step)))
    df = with_neighbour(v.df, v.columns, end - start + step, {"ts": "next"}, after=True).withColumn("last", last).withColumns({"a": first_k.cast("long"), "b": last_k.cast("long")})
    df = df.where("b >= a").withColumn("k", F.explode(F.sequence("a", "b"))).withColumn("t", F.lit(start) + F.col("k") * step)
    return Vector(df.select(*v.columns, F.col("t").cast("long").alias("t"), F.col("t").cast("long").alias("ts"), "value"), v.labels, v.name)


def spread(v: Vector, start: int, end: int, step: int) -> Vector:
    """One value per series at every grid point, for operands fixed in time by @."""
    df = v.df.withColumn("t", F.explode(F.sequence(F.lit(start), F.lit(end), F.lit(step)))).withColumn("ts", F.col("t"))
    return Vector(df, v.labels, v.name)


def matrix_columns(df: DataFrame, labels: tuple[str, ...]) -> list[Column]:
    return [F.col(f"`{label_column(x)}`").alias(x) for x in labels]
