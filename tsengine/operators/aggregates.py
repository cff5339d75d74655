"""Aggregations across series, by group and evaluation time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..model import col, label_column
from .ranges import floor_quantile, number_max, number_min
from .vector import Vector

PLAIN = {
    "sum": lambda: F.sum("value"),
    "avg": lambda: F.avg("value"),
    "min": lambda: number_min(F.col("value")),
    "max": lambda: number_max(F.col("value")),
    "count": lambda: F.count("value").cast("double"),
    "stddev": lambda: F.stddev_pop("value"),
    "stdvar": lambda: F.var_pop("value"),
    "group": lambda: F.lit(1.0),
}


def grouped(v: Vector, labels: tuple[str, ...], without: bool) -> tuple[str, ...]:
    """The labels of the groups; labels that no series has don't make a group different."""
    return tuple(x for x in v.labels if x not in labels) if without else tuple(x for x in labels if x in v.labels)


def aggregate(v: Vector, op: str, labels: tuple[str, ...], without: bool, parameter=None) -> Vector:
    """One value for each group and evaluation time; it is shown at its latest sample's time."""
    by = grouped(v, labels, without)
    columns = [f"`{label_column(x)}`" for x in by]
    if op in ("topk", "bottomk"):
        return ranked(v, by, int(parameter), op == "topk")
    if op == "count_values":
        return count_values(v, by, str(parameter))
    if op == "quantile":
        if not 0 <= parameter <= 1:
            return Vector(v.df.where(F.lit(False)).select(*columns, "t", "ts", "value"), by)
        return Vector(floor_quantile(v.df, [*columns, "t"], parameter), by)
    value = PLAIN[op]()
    return Vector(v.df.groupBy(*columns, "t").agg(F.max("ts").alias("ts"), value.alias("value")), by)


def ranked(v: Vector, by: tuple[str, ...], k: int, largest: bool) -> Vector:
    """The k series of each group with the largest (smallest) last values, with all their samples; ties go by labels."""
    columns = v.columns
    last = v.df.groupBy(*columns).agg(F.max_by("value", "t").alias("last"))
    order = F.col("last").desc() if largest else F.col("last").asc()
    # NaN is neither large nor small
    w = Window.partitionBy(*([f"`{label_column(x)}`" for x in by] or [F.lit(0)])).orderBy(F.isnan("last"), order, *[F.asc_nulls_first(c) for c in columns])
    best = last.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(k, 0)).drop("rank", "last")
    if not columns:
        return v if k > 0 else Vector(v.df.where(F.lit(False)), v.labels, v.name)
    condition = F.lit(True)
    for c in columns:
        condition &= F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return Vector(v.df.alias("l").join(best.alias("r"), condition, "left_semi"), v.labels, v.name)


def decimal(value):
    """A value as text with six decimals."""
    return F.when(F.isnan(value), F.lit("NaN")).otherwise(F.format_string("%.6f", value))


def count_values(v: Vector, by: tuple[str, ...], label: str) -> Vector:
    """How many series of each group have each value (as text with six decimals) last."""
    last = v.df.groupBy(*v.columns).agg(F.max_by("value", "t").alias("value"), F.max("t").alias("t"), F.max("ts").alias("ts"))
    label = label or "value"
    keys = [col(x).alias(label_column(x)) for x in by if x != label]
    rows = last.select(*keys, decimal(F.col("value")).alias(label_column(label)), "t", "ts")
    labels = tuple(x for x in by if x != label) + (label,)
    out = rows.groupBy(*[f"`{label_column(x)}`" for x in labels]).agg(F.max("t").alias("t"), F.max("ts").alias("ts"), F.count(F.lit(1)).cast("double").alias("value"))
    return Vector(out, labels)
