"""Functions over a window of each series, [t - range, t] with both ends, at the points of a grid.

Where a window overlaps few grid points, samples are expanded to the points whose windows hold them and aggregated by
series and point: one hash aggregation, no join, and partial sums before the shuffle. Where it overlaps many (`OVERLAP`),
samples are first aggregated into panes of gcd(range, step) seconds and these into dyadic blocks of panes. A window is a
few blocks (two of each size at most) and the samples at its open end, so the rows to aggregate grow with the logarithm
of range / step. Every block is expanded to the points whose windows it is a largest block of.

Rates of series with labels need a window's first and last sample alone. They follow each series in order of time and
aggregate nothing: two rows a sample at most are sorted, whatever the range and step.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vector import Vector, divide

#: Grid points that a window overlaps from which on panes are used.
OVERLAP = 16
#: Stretches of time that samples of a series without labels are dealt into for what needs their neighbours.
CHUNKS = 1024


def floor_quantile(df: DataFrame, keys: list[str], q: float) -> DataFrame:
    """keys, value (at index floor((n - 1) q) of a group's sorted values, without interpolation) and the largest ts.

    Groups are sorted by Spark, which spills; none is collected into a list.
    """
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    ranked = df.withColumns({"__k": F.row_number().over(group.orderBy("value")), "__n": F.count("value").over(group), "__ts": F.max("ts").over(group)})
    return ranked.where(F.col("__k") == F.floor((F.col("__n") - 1) * F.lit(float(q))) + 1).select(*keys, F.col("__ts").alias("ts"), "value")


def with_neighbour(df: DataFrame, columns: list[str], span: int, names: dict[str, str], after: bool = False) -> DataFrame:
    """df with columns of each sample's neighbour in its series, the one before it or after it, named by names.

    Samples of a series without labels are ordered in chunks of time, in as many tasks; what stands at the chunks' edges
    is one row for each chunk.
    """
    shift = F.lead if after else F.lag
    if columns:
        w = Window.partitionBy(*columns).orderBy("ts")
        return df.withColumns({n: shift(c).over(w) for c, n in names.items()})
    size = max(1, span // CHUNKS)
    chunked = df.withColumn("__chunk", F.floor(F.col("ts") / size))
    pick, edge = (F.min_by, F.min) if after else (F.max_by, F.max)
    edges = chunked.groupBy("__chunk").agg(*[(edge("ts") if c == "ts" else pick(c, "ts")).alias(f"__{n}") for c, n in names.items()])
    over = Window.partitionBy(F.lit(0)).orderBy("__chunk")
    edges = edges.select("__chunk", *[shift(f"__{n}").over(over).alias(f"__{n}") for n in names.values()])
    w = Window.partitionBy("__chunk").orderBy("ts")
    inside = chunked.withColumns({n: shift(c).over(w) for c, n in names.items()}).join(edges, "__chunk")
    return inside.withColumns({n: F.coalesce(n, f"__{n}") for n in names.values()}).select(*df.columns, *names.values())


def number_max(value: Column) -> Column:
    """The maximum without NaN, which Spark orders above all; NaN if there is nothing else."""
    return F.coalesce(F.max(F.when(~F.isnan(value), value)), F.max(value))


def number_min(value: Column) -> Column:
    return F.coalesce(F.min(F.when(~F.isnan(value), value)), F.min(value))


SIMPLE = {
    "sum_over_time": lambda: F.sum("value"),
    "avg_over_time": lambda: F.avg("value"),
    "min_over_time": lambda: number_min(F.col("value")),
    "max_over_time": lambda: number_max(F.col("value")),
    "count_over_time": lambda: F.count("value").cast("double"),
    "stddev_over_time": lambda: F.stddev_pop("value"),
    "stdvar_over_time": lambda: F.var_pop("value"),
}
FUNCTIONS = (*SIMPLE, "quantile_over_time", "rate", "irate")


def aggregate(function: str) -> Column:
    """The function's value over the samples of one window; columns ts, value, and for rates before_ts, before."""
    if function in SIMPLE:
        return SIMPLE[function]()
    last_ts, last = F.max("ts"), F.max_by("value", "ts")
    if function == "irate":
        first_ts, first = F.max_by("before_ts", "ts"), F.max_by("before", "ts")
    else:
        # a window of one sample reaches back to the one before it
        alone = F.count("value") < 2
        first_ts = F.when(alone, F.min_by("before_ts", "ts")).otherwise(F.min("ts"))
        first = F.when(alone, F.min_by("before", "ts")).otherwise(F.min_by("value", "ts"))
    gain = F.when(last - first < 0, last).otherwise(last - first)
    return F.when(last_ts > first_ts, divide(gain, (last_ts - first_ts).cast("double")))


def _no_points() -> Column:
    return F.array().cast("array<long>")


def _between(first: Column, last: Column) -> Column:
    """The numbers from first to last, none if last is smaller."""
    return F.when(last >= first, F.sequence(first, F.greatest(first, last))).otherwise(_no_points())


def _before(df: DataFrame, columns: list[str], span: int) -> DataFrame:
    return with_neighbour(df, columns, span, {"ts": "before_ts", "value": "before"})


def windowed(v: Vector, function: str, window: int, start: int, end: int, step: int, q: float | None = None, add_end: bool = True) -> Vector:
    """The function at start, start + step, ..., and at end too (unless add_end is off).

    v holds the samples from start - window on, for rates from start - 2 window on.
    """
    df, columns = v.df, v.columns
    if function in ("rate", "irate") and columns:
        return Vector(_rates(df, columns, function, window, start, end, step, add_end).withColumn("ts", F.col("t")), v.labels)
    if function in ("rate", "irate"):
        df = _before(df, columns, end - start + 2 * window)
    steps = (end - start) // step
    held = (F.col("ts") <= end) & (F.col("ts") + window >= end)
    odd_end = add_end and (end - start) % step
    if function in PARTS and window // step >= OVERLAP:
        out = _paned(df, columns, function, window, start, step, steps)
        if odd_end:
            last = df.where(held).groupBy(*(columns or [F.lit(0).alias("__all")])).agg(aggregate(function).alias("value"))
            out = out.unionByName(last.select(*columns, F.lit(end).cast("long").alias("t"), "value"))
        out = out.where("value is not null")
        return Vector(out.withColumn("ts", F.col("t")), v.labels)
    first = F.greatest(F.ceil((F.col("ts") - start) / F.lit(float(step))), F.lit(0)).cast("long")
    last = F.least(F.floor((F.col("ts") + window - start) / F.lit(float(step))), F.lit(steps)).cast("long")
    points = F.transform(_between(first, last), lambda k: F.lit(start) + k * step)
    if odd_end:
        points = F.concat(points, F.when(held, F.array(F.lit(end).cast("long"))).otherwise(_no_points()))
    df = df.withColumn("t", F.explode(points))
    if function == "quantile_over_time":
        out = floor_quantile(df, [*columns, "t"], q) if 0 <= q <= 1 else df.where(F.lit(False))
        return Vector(out.select(*columns, "t", "value").where("value is not null").withColumn("ts", F.col("t")), v.labels)
    df = df.groupBy(*columns, "t").agg(aggregate(function).alias("value")).where("value is not null")
    return Vector(df.withColumn("ts", F.col("t")), v.labels)


def _merge_moments(parts: Column) -> Column:
    """n, mean and sum of squared deviations of groups of samples together."""

    def merge(x, y):
        n = x["n"] + y["n"]
        gap = y["mean"] - x["mean"]
        mean = F.when(n == 0, F.lit(0.0)).otherwise(x["mean"] + F.try_divide(gap * y["n"], n))
        return F.struct(n.alias("n"), mean.alias("mean"), (x["m2"] + y["m2"] + F.coalesce(F.try_divide(gap * gap * x["n"] * y["n"], n), F.lit(0.0))).alias("m2"))

    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(parts, zero, merge)


def _moments() -> dict[str, Column]:
    return {"m": F.struct(F.count("value").cast("double").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("m2"))}


def _ends() -> dict[str, Column]:
    """What a rate needs of a stretch: its number of samples, its first and last, and what stood before each."""
    first, last = (lambda c: F.min_by(c, "ts")), (lambda c: F.max_by(c, "ts"))
    return {"n": F.count("value"), "t0": F.min("ts"), "v0": first("value"), "bt0": first("before_ts"), "b0": first("before"), "t1": F.max("ts"), "v1": last("value"), "bt1": last("before_ts"), "b1": last("before")}


def _joined_ends() -> dict[str, Column]:
    return {"n": F.sum("n"), **{c: F.min_by(c, "t0") for c in ("v0", "bt0", "b0")}, **{c: F.max_by(c, "t1") for c in ("v1", "bt1", "b1")}, "t0": F.min("t0"), "t1": F.max("t1")}


def _gain(last_ts: Column, last: Column, first_ts: Column, first: Column) -> Column:
    gain = F.when(last - first < 0, last).otherwise(last - first)
    return F.when(last_ts > first_ts, divide(gain, (last_ts - first_ts).cast("double")))


#: For each function: of samples, the parts of a stretch; of stretches, their parts together; of those, the value.
PARTS = {
    "sum_over_time": (lambda: {"s": F.sum("value")}, lambda: {"s": F.sum("s")}, lambda: F.col("s")),
    "count_over_time": (lambda: {"n": F.count("value")}, lambda: {"n": F.sum("n")}, lambda: F.col("n").cast("double")),
    "avg_over_time": (lambda: {"s": F.sum("value"), "n": F.count("value")}, lambda: {"s": F.sum("s"), "n": F.sum("n")}, lambda: F.col("s") / F.col("n")),
    "min_over_time": (lambda: {"x": number_min(F.col("value"))}, lambda: {"x": number_min(F.col("x"))}, lambda: F.col("x")),
    "max_over_time": (lambda: {"x": number_max(F.col("value"))}, lambda: {"x": number_max(F.col("x"))}, lambda: F.col("x")),
    # a window has a bounded number of blocks
    "stddev_over_time": (_moments, lambda: {"m": _merge_moments(F.collect_list("m"))}, lambda: F.sqrt(F.col("m.m2") / F.col("m.n"))),
    "stdvar_over_time": (_moments, lambda: {"m": _merge_moments(F.collect_list("m"))}, lambda: F.col("m.m2") / F.col("m.n")),
    "irate": (_ends, _joined_ends, lambda: _gain(F.col("t1"), F.col("v1"), F.col("bt1"), F.col("b1"))),
    "rate": (_ends, _joined_ends, lambda: _gain(F.col("t1"), F.col("v1"), F.when(F.col("n") < 2, F.col("bt0")).otherwise(F.col("t0")), F.when(F.col("n") < 2, F.col("b0")).otherwise(F.col("v0")))),
}


def _rates(df: DataFrame, columns: list[str], function: str, window: int, start: int, end: int, step: int, add_end: bool) -> DataFrame:
    """columns, t and value of rates of series with labels, by each series' samples in order of time.

    A sample is the last of the windows at points from its time until the next sample's, and the first of those whose
    start lies after the sample before it. Both stretches are numbers of grid points (end, where it is no other point, is
    the one after them); sorted by where they begin, the newest of each kind hold until the next begins or one ends.
    """
    steps = (end - start) // step
    top = steps + 1 if add_end and (end - start) % step else steps
    w = Window.partitionBy(*columns).orderBy("ts")
    near = df.withColumns({"before_ts": F.lag("ts").over(w), "before": F.lag("value").over(w), "next_ts": F.lead("ts").over(w)})
    number = lambda x: (x - start) / F.lit(float(step))
    begin = lambda x: F.when(x <= end, F.greatest(F.ceil(number(x)).cast("long"), F.lit(0)))
    until = lambda x: F.when(x >= end, F.lit(top)).otherwise(F.floor(number(x))).cast("long")
    gone = F.col("ts") + window
    last = (begin(F.col("ts")), until(F.least(F.col("next_ts") - 1, gone)))  # least leaves nulls out
    ends = F.col("until")
    if function == "irate":
        value = _gain(F.col("ts"), F.col("value"), F.col("before_ts"), F.col("before"))
        out = near.select(*columns, last[0].alias("k"), last[1].alias("until"), value.alias("value"))
    else:
        first = (begin(F.greatest("ts", F.col("before_ts") + window + 1)), until(gone))
        stretch = lambda is_last, at: F.struct(at[0].alias("k"), at[1].alias("until"), F.lit(is_last).alias("is_last"))
        both = near.select(*columns, "ts", "value", "before_ts", "before", F.explode(F.array(stretch(True, last), stretch(False, first))).alias("x"))
        both = both.select(*columns, "x.*", "ts", "value", "before_ts", "before").where("until >= k")
        order = Window.partitionBy(*columns).orderBy("k")
        newest = lambda is_last: F.last(F.when(F.col("is_last") == F.lit(is_last), F.struct("until", "ts", "value", "before_ts", "before")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
        held = both.select(*columns, "k", newest(True).alias("z"), newest(False).alias("a"), F.lead("k").over(order).alias("next"))
        # a window of one sample reaches back to the one before it
        alone = F.col("a.ts") == F.col("z.ts")
        value = _gain(F.col("z.ts"), F.col("z.value"), F.when(alone, F.col("z.before_ts")).otherwise(F.col("a.ts")), F.when(alone, F.col("z.before")).otherwise(F.col("a.value")))
        ends = F.least("until", F.col("next") - 1)
        out = held.where("z is not null and a is not null").select(*columns, "k", "next", F.least("z.until", "a.until").alias("until"), value.alias("value"))
    out = out.withColumn("until", ends).where("until >= k and value is not null").withColumn("k", F.explode(F.sequence("k", "until")))
    return out.select(*columns, F.when(F.col("k") > steps, F.lit(end)).otherwise(F.lit(start) + F.col("k") * step).cast("long").alias("t"), "value")


def _paned(df: DataFrame, columns: list[str], function: str, window: int, start: int, step: int, steps: int) -> DataFrame:
    """columns, t and value at start + k step for k up to steps, by dyadic blocks of panes.

    Pane p holds the samples in (start + (p - 1) g, start + p g]. The window at pane P is the panes P - w + 1 to P, and
    the samples at its open end, t - window. A block of s panes from a on lies in it for P from a + s - 1 to a + w - 1,
    and is one of its largest where the block of twice the size that holds it does not.
    """
    of_samples, together, value = PARTS[function]
    g = math.gcd(window, step)
    w, q = window // g, step // g
    top = w.bit_length() - 1  # the largest blocks have 2 ** top <= w panes
    parts = lambda made: [c.alias(k) for k, c in made.items()]
    pane = F.ceil((F.col("ts") - start) / F.lit(float(g))).cast("long")
    panes = df.groupBy(*columns, pane.alias("pane")).agg(*parts(of_samples()))
    names = [c for c in panes.columns if c not in ("pane", *[x.strip("`") for x in columns])]
    levels = F.transform(F.sequence(F.lit(0), F.lit(top)), lambda j: F.struct(j.alias("level"), F.floor(F.col("pane") / F.pow(F.lit(2.0), j)).cast("long").alias("block")))
    blocks = panes.withColumn("b", F.explode(levels)).groupBy(*columns, "b").agg(*parts(together()))
    size = F.pow(F.lit(2.0), F.col("b.level")).cast("long")
    begin = F.col("b.block") * size
    left = F.col("b.block") % 2 == 0
    low = F.when((F.col("b.level") == top) | left, begin + size - 1).otherwise(begin - size + w)
    high = F.when((F.col("b.level") == top) | ~left, begin + w - 1).otherwise(begin + 2 * size - 2)
    first = F.greatest(F.ceil(low / F.lit(float(q))), F.lit(0)).cast("long")
    last = F.least(F.floor(high / F.lit(float(q))), F.lit(steps)).cast("long")
    inside = blocks.withColumn("k", F.explode(_between(first, last))).select(*columns, (F.lit(start) + F.col("k") * step).alias("t"), *names)
    k = F.col("ts") + window - start
    edge = df.where((k >= 0) & (k <= steps * step) & (k % step == 0)).withColumn("t", F.col("ts") + window)
    edge = edge.groupBy(*columns, "t").agg(*parts(of_samples())).select(*columns, "t", *names)
    return inside.unionByName(edge).groupBy(*columns, "t").agg(*parts(together())).select(*columns, "t", value().alias("value"))


def whole(v: Vector, function: str, at: int, q: float | None = None, span: int = 86_400) -> Vector:
    """The function over all of v's samples, of about span seconds, as one value at a time."""
    df, columns = v.df, v.columns
    if function == "quantile_over_time":
        df = (floor_quantile(df, columns, q) if 0 <= q <= 1 else df.where(F.lit(False))).select(*columns, "value")
    else:
        if function in ("rate", "irate"):
            df = _before(df, columns, span)
        df = df.groupBy(*(columns or [F.lit(0).alias("__all")])).agg(aggregate(function).alias("value")).drop("__all")
    return Vector(df.where("value is not null").withColumns({"t": F.lit(int(at)).cast("long"), "ts": F.lit(int(at)).cast("long")}), v.labels)
