"""Compiles a syntax tree to vectors, for one of three ways to evaluate.

An instant query has one evaluation time and shows samples at their own times. A range query with a step above 1
evaluates on a grid; without one it takes raw samples as they are, aggregates them at equal times, and applies functions
of a range to all of it. Whatever a query's form, operands are evaluated before what is around them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import functions as F

from ..operators import aggregates, binary, ranges, selectors
from ..operators.vector import Vector
from . import syntax as S


class QueryError(ValueError):
    """A query that parses but can't be evaluated."""


@dataclass(frozen=True)
class Times:
    """When to evaluate: an instant (start = end, step None), raw samples (step 0) or a grid."""

    start: int
    end: int
    step: int | None = None

    @property
    def instant(self) -> bool:
        return self.step is None

    @property
    def grid(self) -> bool:
        return bool(self.step)


DEFAULT_SUBQUERY_STEP = 60


def compile_query(source, tree, times: Times) -> Vector | float:
    return _Compiler(source).evaluate(tree, times)


class _Compiler:
    def __init__(self, source):
        self.source = source

    def evaluate(self, node, times: Times) -> Vector | float:
        kind = type(node)
        if kind is S.Number:
            return node.value
        if kind is S.Text:
            raise QueryError("a text is only a parameter")
        if kind is S.Negate:
            value = self.evaluate(node.of, times)
            return value.with_value(-F.col("value")) if isinstance(value, Vector) else -value
        if kind is S.Binary:
            return self.binary(node, times)
        if kind is S.Aggregate:
            return self.aggregate(node, times)
        if kind is S.Call:
            return self.call(node, times)
        if kind is S.Selector:
            return self.selector(node, times)
        if kind is S.Subquery:
            raise QueryError("a subquery needs a function of a range around it")
        raise QueryError(f"unknown expression {node!r}")

    def vector(self, node, times: Times) -> Vector:
        value = self.evaluate(node, times)
        if not isinstance(value, Vector):
            raise QueryError(f"expected a vector instead of the number {value:g}")
        return value

    def fixed(self, at, times: Times) -> int:
        return times.start if at == "start" else times.end if at == "end" else int(at)

    def named(self, node: S.Selector) -> list[str]:
        """Metrics that a selector names; without a name, all that have its labels."""
        if node.name is not None:
            return [node.name] if node.name in self.source.names() else []
        patterns = [m for m in node.matchers if m.label == "__name__"]
        return [n for n in self.source.names() if all(_name_matches(m, n) for m in patterns)]

    def raw(self, node: S.Selector, low: int | None, high: int | None) -> Vector:
        """Samples of all metrics selected; several metrics have their names as the label __name__."""
        names = self.named(node)
        own = tuple(m for m in node.matchers if m.label != "__name__")
        parts = [selectors.select(self.source, n, own, low, high, node.offset) for n in names]
        if node.name is not None and parts:
            return parts[0]
        spark_empty = self.source_session().createDataFrame([], "t long, ts long, value double")
        if not parts:
            return Vector(spark_empty, (), node.name)
        labels = tuple(dict.fromkeys(["__name__", *(x for p in parts for x in p.labels)]))
        frames = []
        for p in parts:
            columns = [F.lit(p.name) if x == "__name__" else F.col(f"`{selectors.label_column(x)}`") if x in p.labels else F.lit(None).cast("string") for x in labels]
            frames.append(p.df.select(*[c.alias(selectors.label_column(x)) for c, x in zip(columns, labels, strict=True)], "t", "ts", "value"))
        df = frames[0]
        for f in frames[1:]:
            df = df.unionByName(f)
        return Vector(df, labels, None)

    def source_session(self):
        from pyspark.sql import SparkSession

        return SparkSession.getActiveSession()

    def selector(self, node: S.Selector, times: Times) -> Vector:
        if node.window is not None:
            if times.grid or node.at is not None and not times.instant:
                raise QueryError("a range needs a function around it")
            end = times.end if node.at is None else self.fixed(node.at, times)
            return self.raw(node, end - node.window, end)
        if node.at is not None:
            at = self.fixed(node.at, times)
            value = selectors.latest(self.raw(node, None, at), at, node.offset)
            if times.instant:
                return value
            moved = Vector(value.df.withColumns({"t": F.lit(times.start).cast("long"), "ts": F.lit(times.start).cast("long")}), value.labels, value.name)
            return selectors.spread(moved, times.start, times.end, times.step or max(1, times.end - times.start))
        if times.instant:
            return selectors.latest(self.raw(node, 0, times.end), times.end, node.offset)
        if times.grid and times.step > 1:
            return selectors.resample(self.raw(node, times.start - int(times.step * 1.1), times.end), times.start, times.end, times.step)
        return self.raw(node, times.start, times.end)

    def call(self, node: S.Call, times: Times) -> Vector:
        if node.name not in ranges.FUNCTIONS:
            raise QueryError(f"unsupported function {node.name}")
        q = None
        args = list(node.args)
        if node.name == "quantile_over_time":
            if len(args) != 2:
                raise QueryError("quantile_over_time takes a number and a range")
            q = self.parameter(args.pop(0), times)
        if len(args) != 1:
            raise QueryError(f"{node.name} takes one range")
        of = args[0]
        if not isinstance(of, (S.Selector, S.Subquery)) or (isinstance(of, S.Selector) and of.window is None and times.grid):
            raise QueryError(f"{node.name} needs a range such as [5m]")
        back = 2 if node.name in ("rate", "irate") else 1
        if of.at is not None:
            at = self.fixed(of.at, times)
            value = self.call(S.Call(node.name, (*node.args[:-1], replace(of, at=None))), Times(at, at))
            if times.instant:
                return value
            moved = Vector(value.df.withColumns({"t": F.lit(times.start).cast("long"), "ts": F.lit(times.start).cast("long")}), value.labels)
            return selectors.spread(moved, times.start, times.end, times.step or max(1, times.end - times.start))
        if not times.instant and not times.grid:  # without a step: one value for the whole range
            samples = self.samples(of, times.start, times.end, times)
            return ranges.whole(samples, node.name, times.end, q, times.end - times.start)
        window = of.window if of.window is not None else times.end
        samples = self.samples(of, times.start - back * window, times.end, times)
        step = times.step or 1
        return ranges.windowed(samples, node.name, window, times.start, times.end, step, q, add_end=times.grid)

    def samples(self, of, low: int, high: int, times: Times) -> Vector:
        """What a range holds: raw samples, or a subquery's values on multiples of its step."""
        if isinstance(of, S.Selector):
            return self.raw(replace(of, window=None), low, high)
        step = of.step or (times.step if times.grid and times.step > 1 else DEFAULT_SUBQUERY_STEP)
        first = -(-(low - of.offset) // step) * step
        last = (high - of.offset) // step * step
        inner = self.vector(of.of, Times(first, max(first, last), step))
        moved = inner.df.withColumns({"ts": F.col("t") + of.offset, "t": F.col("t") + of.offset})
        return Vector(moved, inner.labels)

    def parameter(self, node, times: Times) -> float | str:
        if isinstance(node, S.Text):
            return node.value
        value = self.evaluate(node, times)
        if isinstance(value, Vector):
            raise QueryError("a parameter is a number or a text")
        return value

    def aggregate(self, node: S.Aggregate, times: Times) -> Vector:
        parameter = None
        if node.parameter is not None:
            parameter = self.parameter(node.parameter, times)
            if (node.op == "count_values") != isinstance(parameter, str):
                raise QueryError(f"{node.op} has a parameter of another kind")
        of = self.vector(node.of, times)
        return aggregates.aggregate(of, node.op, node.labels, node.without, parameter)

    def binary(self, node: S.Binary, times: Times) -> Vector | float:
        left, right = self.evaluate(node.left, times), self.evaluate(node.right, times)
        if node.op in S.SETS:
            if not isinstance(left, Vector) or not isinstance(right, Vector):
                raise QueryError(f"{node.op} takes two vectors")
            return binary.set_operation(left, right, node.op, node.matching)
        if isinstance(left, Vector) and isinstance(right, Vector):
            return binary.between_vectors(left, right, node.op, node.bool_, node.matching)
        if isinstance(left, Vector):
            return binary.with_number(left, node.op, right, node.bool_, False)
        if isinstance(right, Vector):
            return binary.with_number(right, node.op, left, node.bool_, True)
        return binary.number_by_number(node.op, left, right, node.bool_)


def _name_matches(m: S.Matcher, name: str) -> bool:
    import re

    hit = name == m.value if m.op in ("=", "!=") else re.fullmatch(m.value, name) is not None
    return hit if m.op in ("=", "=~") else not hit
