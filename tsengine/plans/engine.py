"""The engine: instant and range queries, pipelines and metadata over a source of samples."""

from __future__ import annotations

import re
import time as clock
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pipeline as functions
from ..model import label_column
from ..operators import selectors
from ..operators.vector import Vector
from . import syntax as S
from .compiler import QueryError, Times, compile_query


class Engine:
    """Queries over a source; every result is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, source, allow_code: bool = False):
        self.spark, self.source, self.allow_code = spark, source, allow_code
        self.functions = dict(functions.FUNCTIONS)

    # --- queries

    def instant(self, query: str, time: float | None = None) -> DataFrame:
        """One row per series: its labels (and name, if it is still the metric's), ts and value."""
        at = int(clock.time() if time is None else time)
        return self._shown(compile_query(self.source, S.parse(query), Times(at, at)), at)

    def range(self, query: str, start: int = 0, end: int | None = None, step: int = 0) -> DataFrame:
        """Rows of series over time; a step of 0 or 1 gives samples as they are."""
        end = int(clock.time()) if end is None else int(end)
        if step < 0 or start > end:
            raise QueryError("a range needs start <= end and a step that is not negative")
        tree = S.parse(query)
        return self._shown(compile_query(self.source, tree, Times(int(start), end, int(step) if step > 1 else _raw_step(tree, int(step)))), end)

    def _shown(self, value: Vector | float, at: int) -> DataFrame:
        if not isinstance(value, Vector):
            return self.spark.range(1).select(F.lit(at).cast("long").alias("ts"), F.lit(float(value)).alias("value"))
        name = [F.lit(value.name).alias("name")] if value.name else []
        labels = [F.col(f"`{label_column(x)}`").alias(x) for x in value.labels]
        return value.df.select(*name, *labels, "ts", "value")

    def pipeline(self, stages: list[dict]) -> DataFrame:
        """A range query, the functions of its stage, and those of the stages after it, in order.

        A stage names a built-in function, a registered one, or (type "python") a callable of this session; stages with
        code run only if the engine allows code.
        """
        if not stages or not stages[0].get("query"):
            raise QueryError("the first stage needs a query")
        first = stages[0]
        start, end = int(first.get("start") or 0), int(first.get("end") or 0)
        if not 0 < start < end:
            raise QueryError("the first stage needs 0 < start < end")
        df = self.range(first["query"], start, end, int(first.get("step") or 0))
        for stage in [*(first.get("functions") or []), *stages[1:]]:
            df = self.apply(df, stage)
        return df

    def apply(self, df: DataFrame, stage: dict) -> DataFrame:
        kind = stage.get("type") or "internal"
        if kind not in ("internal", "python"):
            raise QueryError(f"unknown function type {kind!r}")
        name = stage.get("name") or stage.get("function")
        if stage.get("code"):
            if not self.allow_code:
                raise QueryError("stages with code are not allowed here")
            return functions.run_code(df, stage["code"])
        if not name:
            return df
        if name not in self.functions:
            raise QueryError(f"unknown function {name!r}")
        return self.functions[name](df)

    def register(self, name: str, function) -> None:
        """Make a function from DataFrame to DataFrame available to pipelines."""
        self.functions[name] = function

    # --- metadata

    def _series(self, matchers: Iterable[str], start: int | None, end: int | None) -> DataFrame:
        """Distinct series (name and a label map) with a sample in the range that any of the selectors matches."""
        if start is not None and end is None:
            end = int(clock.time())
        if start is not None and end is not None and start > end:
            raise QueryError("start lies after end")
        trees = [S.parse(m) for m in matchers]
        if any(not isinstance(t, S.Selector) for t in trees):
            raise QueryError("only selectors choose series")
        frames = []
        for name in self.source.names():
            own = [t for t in trees if t.name in (None, name)]
            if trees and not own:
                continue
            labels = self.source.labels_of(name)
            df = self._labelled(name, start, end, labels, own)
            if own:
                df = df.where(reduce(lambda a, b: a | b, (_all(t.matchers, labels) for t in own)))
            pairs = [F.struct(F.lit(x).alias("key"), F.col(f"`{label_column(x)}`").alias("value")) for x in labels]
            entries = F.filter(F.array(*pairs), lambda e: e["value"].isNotNull()) if pairs else F.expr("cast(array() as array<struct<key:string,value:string>>)")
            kept = df.select(*[f"`{label_column(x)}`" for x in labels]).distinct()
            frames.append(kept.select(F.lit(name).alias("name"), F.map_from_entries(entries).alias("labels")))
        if not frames:
            return self.spark.createDataFrame([], "name string, labels map<string,string>")
        return reduce(DataFrame.unionByName, frames)

    def _labelled(self, name: str, start: int | None, end: int | None, labels: list[str], trees: list) -> DataFrame:
        """Label columns of a metric's series; a source with a table of series reads no samples without a range."""
        if hasattr(self.source, "series"):
            own = tuple(m for m in trees[0].matchers if m.label != "__name__") if len(trees) == 1 else ()
            return self.source.series(name, start, end, labels, own)
        return self.source.scan(name, start, end, labels)

    def series(self, matchers: list[str], start: int | None = None, end: int | None = None) -> DataFrame:
        """Series that any selector matches and that have a sample in the range; at least one selector is needed."""
        if not matchers:
            raise QueryError("series need at least one selector")
        return self._series(matchers, start, end)

    def label_names(self, matchers: Iterable[str] = (), start: int | None = None, end: int | None = None, pattern: str = "", limit: int = 0, offset: int = 0) -> DataFrame:
        """Distinct label names in order, __name__ among them."""
        names = self._series(matchers, start, end).select(F.explode(F.array_union(F.array(F.lit("__name__")), F.map_keys("labels"))).alias("label"))
        return _page(names.distinct(), "label", pattern, limit, offset)

    def label_values(self, label: str, matchers: Iterable[str] = (), start: int | None = None, end: int | None = None, pattern: str = "", limit: int = 0, offset: int = 0) -> DataFrame:
        """A label's distinct values in order."""
        value = F.col("name") if label == "__name__" else F.element_at("labels", label)
        values = self._series(matchers, start, end).select(value.alias("value")).where("value is not null")
        return _page(values.distinct(), "value", pattern, limit, offset)

    def series_count(self) -> DataFrame:
        """n_series and n_metrics of the whole source."""
        return self._series((), None, None).agg(F.count(F.lit(1)).alias("n_series"), F.countDistinct("name").alias("n_metrics"))


def _raw_step(tree, step: int) -> int:
    """A step of 0 or 1 means raw samples; with a step of 1, functions of a range are still evaluated every second."""
    return 1 if step == 1 and any(isinstance(n, S.Call) for n in S.walk(tree)) else 0


def _all(matchers, labels: list[str]):
    return reduce(lambda a, b: a & b, (selectors.matches(m, m.label in labels) for m in matchers if m.label != "__name__"), F.lit(True))


def _page(df: DataFrame, column: str, pattern: str, limit: int, offset: int) -> DataFrame:
    """Values that a pattern is found in, in order; limit 0 is none."""
    if pattern:
        re.compile(pattern)
        df = df.where(F.col(column).rlike(pattern))
    df = df.orderBy(column)
    df = df.offset(offset) if offset else df
    return df.limit(limit) if limit else df
