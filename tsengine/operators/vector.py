"""The value of an expression: a DataFrame of labelled samples on a set of evaluation times."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import col, label_column


@dataclass(frozen=True)
class Vector:
    """df has one column per label, t (evaluation time), ts (the time shown) and value; name is the metric's, if kept."""

    df: DataFrame
    labels: tuple[str, ...]
    name: str | None = None

    @property
    def columns(self) -> list[str]:
        return [f"`{label_column(x)}`" for x in self.labels]

    def with_value(self, value: Column) -> Vector:
        """The same samples with another value; what is no longer the metric loses its name."""
        return replace(self, df=self.df.withColumn("value", value), name=None)


def divide(a: Column, b: Column) -> Column:
    """IEEE division: a zero divisor gives an infinity or NaN instead of an error."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    return F.when(b == 0, F.when(F.isnan(a) | (a == 0), nan).when(a > 0, inf).otherwise(-inf)).otherwise(F.try_divide(a, b))


def modulo(a: Column, b: Column) -> Column:
    """The remainder with the dividend's sign; NaN for a zero divisor."""
    return F.when(b == 0, F.lit(float("nan"))).otherwise(F.try_mod(a, b))


ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide, "%": modulo, "^": lambda a, b: F.pow(a, b)}
# Spark holds NaN equal to itself and above all numbers; no comparison with NaN holds here, but for !=
_NUMBERS = lambda a, b: ~F.isnan(a) & ~F.isnan(b)
COMPARE = {
    "==": lambda a, b: _NUMBERS(a, b) & (a == b),
    "!=": lambda a, b: ~_NUMBERS(a, b) | (a != b),
    ">": lambda a, b: _NUMBERS(a, b) & (a > b),
    "<": lambda a, b: _NUMBERS(a, b) & (a < b),
    ">=": lambda a, b: _NUMBERS(a, b) & (a >= b),
    "<=": lambda a, b: _NUMBERS(a, b) & (a <= b),
}


def same(left: Vector, right: Vector, labels: list[str]) -> Column:
    """Label by label equality of two aliased frames l and r, absent labels being equal, at the same evaluation time."""
    out = F.col("l.t") == F.col("r.t")
    for x in labels:
        a = F.col(f"l.`{label_column(x)}`") if x in left.labels else F.lit(None).cast("string")
        b = F.col(f"r.`{label_column(x)}`") if x in right.labels else F.lit(None).cast("string")
        out &= a.eqNullSafe(b)
    return out


__all__ = ["ARITHMETIC", "COMPARE", "Vector", "col", "divide", "modulo", "same"]
