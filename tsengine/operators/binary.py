"""Operators between vectors and numbers: arithmetic, comparisons and set operations with label matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import label_column
from ..plans.syntax import COMPARISONS, Matching
from .vector import ARITHMETIC, COMPARE, Vector, same


def number_by_number(op: str, a: float, b: float, bool_: bool) -> float:
    """Both operands known: the result, with IEEE division."""
    if op in COMPARISONS:
        return float({"==": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op])
    try:
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: __import__("math").fmod(a, b), "^": lambda: float(a**b)}[op]()
    except ZeroDivisionError:
        return float("nan") if op == "%" or a == 0 or a != a else float("inf") * (1 if a > 0 else -1)
    except (ValueError, OverflowError):
        return float("nan") if op == "%" else float("inf")


def with_number(v: Vector, op: str, number: float, bool_: bool, swapped: bool) -> Vector:
    """A vector and a number; a comparison keeps the samples for which it holds, or gives 0 and 1 with bool."""
    a, b = F.col("value"), F.lit(float(number))
    a, b = (b, a) if swapped else (a, b)
    if op not in COMPARISONS:
        return v.with_value(ARITHMETIC[op](a, b))
    holds = COMPARE[op](a, b)
    return v.with_value(holds.cast("double")) if bool_ else Vector(v.df.where(holds), v.labels, v.name)


def _matched(left: Vector, right: Vector, m: Matching) -> list[str]:
    every = list(dict.fromkeys([*left.labels, *right.labels]))
    return [x for x in m.labels if x in every] if m.on else [x for x in every if x not in m.labels]


def set_operation(left: Vector, right: Vector, op: str, m: Matching) -> Vector:
    """and, unless and or; the latter adds the right side's samples that match none on the left."""
    labels = _matched(left, right, m)
    if op in ("and", "unless"):
        joined = left.df.alias("l").join(right.df.alias("r"), same(left, right, labels), "left_semi" if op == "and" else "left_anti")
        return Vector(joined, left.labels, left.name)
    rest = right.df.alias("l").join(left.df.alias("r"), same(right, left, labels), "left_anti")
    every = tuple(dict.fromkeys([*left.labels, *right.labels]))
    keep = lambda v, df: df.select(*[F.col(f"`{label_column(x)}`") if x in v.labels else F.lit(None).cast("string").alias(label_column(x)) for x in every], "t", "ts", "value")
    return Vector(keep(left, left.df).unionByName(keep(right, rest)), every, left.name if left.name == right.name else None)


def _unique(v: Vector, labels: list[str]) -> Vector:
    """One sample for each match group and time; a second one is an error when the query runs."""
    columns = [f"`{label_column(x)}`" for x in labels if x in v.labels]
    others = [x for x in v.labels if x not in labels]
    value = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("several series match on the side that must have one")).cast("double")).otherwise(F.first("value"))
    df = v.df.groupBy(*columns, "t").agg(value.alias("value"), F.max("ts").alias("ts"), *[F.first(f"`{label_column(x)}`").alias(label_column(x)) for x in others])
    return Vector(df, v.labels, v.name)


def between_vectors(left: Vector, right: Vector, op: str, bool_: bool, m: Matching) -> Vector:
    """Arithmetic or comparison of samples whose matching labels and times agree.

    One to one, results have the matching labels; with group_left (or right) the many side's and those included.
    """
    labels = _matched(left, right, m)
    swap = m.many == "right"
    many, one = (right, left) if swap else (left, right)
    one = _unique(one, labels)
    many = many if m.many else _unique(many, labels)
    joined = many.df.alias("l").join(one.df.alias("r"), same(many, one, labels))
    a, b = F.col("l.value"), F.col("r.value")
    a, b = (b, a) if swap else (a, b)
    holds: Column | None = COMPARE[op](a, b) if op in COMPARISONS else None
    value = a if holds is not None and not bool_ else holds.cast("double") if holds is not None else ARITHMETIC[op](a, b)
    if holds is not None and not bool_:
        joined = joined.where(holds)
    keep = holds is not None and not bool_
    out = list(many.labels) if m.many or keep else [x for x in labels if x in many.labels or x in one.labels]
    columns = []
    for x in dict.fromkeys([*out, *m.include]):
        side = "r" if x in m.include and x in one.labels else "l" if x in many.labels else "r" if x in one.labels else None
        columns.append((x, F.col(f"{side}.`{label_column(x)}`") if side else F.lit(None).cast("string")))
    df = joined.select(*[c.alias(label_column(x)) for x, c in columns], F.col("l.t").alias("t"), F.greatest("l.ts", "r.ts").alias("ts"), value.alias("value"))
    return Vector(df, tuple(x for x, _ in columns), left.name if keep and not m.many else None)
