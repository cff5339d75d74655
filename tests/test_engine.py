"""Operators on literal samples with answers worked out by hand, and against brute force."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tsengine.model import Metric, TableSource
from tsengine.operators import ranges
from tsengine.plans.compiler import QueryError
from tsengine.plans.engine import Engine
from tsengine.plans.syntax import QuerySyntaxError


def metric(spark, rows, labels=()):
    schema = "".join(f"`{x}` string, " for x in labels) + "ts long, value double"
    return Metric(spark.createDataFrame(rows, schema), list(labels))


def engine(spark, **metrics):
    return Engine(spark, TableSource(metrics))


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def three(spark):
    data = [("a", "prod", 10, 1.0), ("a", "prod", 20, 2.0), ("b", "prod", 10, 3.0), ("b", "dev", 10, 4.0), ("c", None, 10, 5.0), ("c", None, 20, 7.0)]
    return engine(spark, m=metric(spark, data, ["host", "env"]))


def test_latest_keeps_own_time(three):
    assert rows(three.instant("m", 15), "host", "ts", "value") == [("a", 10, 1.0), ("b", 10, 3.0), ("b", 10, 4.0), ("c", 10, 5.0)]
    got = {(r["host"], r["env"]): (r["ts"], r["value"], r["name"]) for r in three.instant("m", 1000).collect()}
    assert got == {("a", "prod"): (20, 2.0, "m"), ("b", "prod"): (10, 3.0, "m"), ("b", "dev"): (10, 4.0, "m"), ("c", None): (20, 7.0, "m")}


@pytest.mark.parametrize(
    ("matcher", "hosts"),
    [('env="prod"', "ab"), ('env!="prod"', "bc"), ('env=~"d.*|prod"', "abb"), ('env=~"de"', ""), ('env!~"pr.*"', "bc"), ('env=""', "c"), ('env!=""', "abb"), ('nolabel=""', "abbc"), ('nolabel="x"', "")],
)
def test_matchers(three, matcher, hosts):
    assert "".join(sorted(r["host"] for r in three.instant(f"m{{{matcher}}}", 100).collect())) == hosts


def test_grouping_and_missing_labels(three):
    got = {r["env"]: r["value"] for r in three.instant("sum(m) by (env)", 100).collect()}
    assert got == {"prod": 5.0, "dev": 4.0, None: 7.0}
    assert {r["env"]: r["value"] for r in three.instant("sum without (host) (m)", 100).collect()} == got
    assert rows(three.instant("sum(m)", 100), "ts", "value") == [(20, 16.0)]
    assert rows(three.instant("count(m) by (nolabel)", 100), "value") == [(4.0,)]


def test_range_aggregation_per_time(spark):
    e = engine(spark, m=metric(spark, [("a", 0, 1.0), ("a", 10, 2.0), ("b", 10, 3.0), ("b", 20, 4.0)], ["s"]))
    assert rows(e.range("sum(m)", 0, 30), "ts", "value") == [(0, 1.0), (10, 5.0), (20, 4.0)]


def test_spread_and_quantile(spark):
    e = engine(spark, m=metric(spark, [(str(k), 1, float(k)) for k in (1, 2, 3, 4)], ["s"]))
    value = lambda q: e.instant(q, 10).collect()[0]["value"]
    assert value("stdvar(m)") == 1.25
    assert math.isclose(value("stddev(m)"), 1.25**0.5)
    assert value("quantile(0.5, m)") == 2.0
    assert value("quantile(1, m)") == 4.0
    assert e.instant("quantile(1.5, m)", 10).count() == 0
    assert value("group(m)") == 1.0
    assert rows(e.instant("topk(2, m)", 10), "s") == [("3",), ("4",)]
    assert rows(e.instant("bottomk(2, m)", 10), "s") == [("1",), ("2",)]
    assert rows(e.instant("topk(0, m)", 10), "s") == []


def test_topk_ties_and_groups(spark):
    e = engine(spark, m=metric(spark, [(g, s, 1, 5.0) for g in "xy" for s in "abc"], ["g", "s"]))
    assert rows(e.instant("topk(1, m) by (g)", 10), "g", "s") == [("x", "a"), ("y", "a")]
    assert rows(e.range("topk(1, m)", 0, 10), "g", "s") == [("x", "a")]


def test_count_values(spark):
    e = engine(spark, m=metric(spark, [("a", 1, 2.0), ("b", 1, 2.0), ("c", 1, 3.5)], ["s"]))
    assert rows(e.instant('count_values("v", m)', 10), "v", "value") == [("2.000000", 2.0), ("3.500000", 1.0)]


def test_nan_is_no_extreme(spark):
    e = engine(spark, m=metric(spark, [("a", 1, float("nan")), ("b", 1, 2.0)], ["s"]))
    assert e.instant("max(m)", 10).collect()[0]["value"] == 2.0
    assert e.instant("min(m)", 10).collect()[0]["value"] == 2.0


def test_rate_with_reset(spark):
    e = engine(spark, c=metric(spark, [(0, 5.0), (10, 8.0), (20, 2.0), (30, 6.0)]))
    got = rows(e.range("rate(c[20s])", 20, 30, 10), "ts", "value")
    assert [(t, round(v, 9)) for t, v in got] == [(20, 0.1), (30, 0.3)]
    assert [(t, round(v, 9)) for t, v in rows(e.range("irate(c[20s])", 20, 30, 10), "ts", "value")] == [(20, 0.2), (30, 0.4)]


def test_rate_looks_back(spark):
    e = engine(spark, c=metric(spark, [(0, 1.0), (100, 11.0)]))
    assert rows(e.instant("rate(c[50s])", 100), "value") == [(0.1,)]
    assert e.instant("rate(c[49s])", 100).count() == 0


def test_resample_tolerance(spark):
    e = engine(spark, g=metric(spark, [(100, 7.0)]))
    assert rows(e.range("g", 100, 145, 15), "ts", "value") == [(100, 7.0), (115, 7.0)]


def test_grid_has_its_end(spark):
    e = engine(spark, g=metric(spark, [(t, float(t)) for t in range(0, 26)]))
    assert rows(e.range("max_over_time(g[5s])", 0, 25, 10), "ts", "value") == [(0, 0.0), (10, 10.0), (20, 20.0), (25, 25.0)]


def test_function_without_step(spark):
    e = engine(spark, c=metric(spark, [(0, 1.0), (10, 3.0), (20, 5.0)]))
    assert rows(e.range("rate(c[1s])", 0, 20), "ts", "value") == [(20, 0.2)]
    assert rows(e.range("sum_over_time(c[1s])", 0, 20), "ts", "value") == [(20, 9.0)]


def test_arithmetic(spark):
    e = engine(spark, x=metric(spark, [("a", 1, 6.0), ("b", 1, 0.0)], ["s"]), y=metric(spark, [("a", 1, 4.0), ("b", 1, 0.0), ("c", 1, 1.0)], ["s"]))
    value = lambda q: {r["s"]: r["value"] for r in e.instant(q, 10).collect()}
    assert value("x + y") == {"a": 10.0, "b": 0.0}
    assert value("x % 4")["a"] == 2.0
    assert value("2 ^ x")["a"] == 64.0
    assert value("1 / x")["b"] == math.inf
    assert value("-1 / x")["b"] == -math.inf
    assert math.isnan(value("x / y")["b"])
    assert math.isnan(value("x % 0")["a"])
    assert value("x > y") == {"a": 6.0}
    assert value("x > bool y") == {"a": 1.0, "b": 0.0}
    assert value("5 > x") == {"b": 0.0}
    assert value("-x") == {"a": -6.0, "b": -0.0}
    assert value("y unless x") == {"c": 1.0}
    assert value("y and x") == {"a": 4.0, "b": 0.0}
    assert value("x or y") == {"a": 6.0, "b": 0.0, "c": 1.0}
    assert e.instant("1 + 2 * 3", 10).collect()[0]["value"] == 7.0
    assert e.instant("-2 ^ 2", 10).collect()[0]["value"] == 4.0
    assert e.instant("1 / 0", 10).collect()[0]["value"] == math.inf


def test_matching(spark):
    left = metric(spark, [("a", "1", 1, 10.0), ("a", "2", 1, 20.0), ("b", "1", 1, 30.0)], ["job", "cpu"])
    right = metric(spark, [("a", "eu", 1, 10.0), ("b", "us", 1, 3.0)], ["job", "zone"])
    e = engine(spark, l=left, r=right)
    assert rows(e.instant("l / on (job) group_left (zone) r", 10), "job", "cpu", "zone", "value") == [("a", "1", "eu", 1.0), ("a", "2", "eu", 2.0), ("b", "1", "us", 10.0)]
    assert rows(e.instant("r * on (job) group_right l", 10), "job", "cpu", "value") == [("a", "1", 100.0), ("a", "2", 200.0), ("b", "1", 90.0)]
    assert rows(e.instant("sum(l) by (job) - ignoring (zone) r", 10), "job", "value") == [("a", 20.0), ("b", 27.0)]
    assert e.instant("l / r", 10).count() == 0
    with pytest.raises(Exception, match="several series match"):
        e.instant("l / on (job) r", 10).collect()


def test_offset_at_and_subquery(spark):
    e = engine(spark, g=metric(spark, [(t, float(t)) for t in range(0, 101, 10)]))
    assert rows(e.instant("g offset 30s", 100), "ts", "value") == [(70, 70.0)]
    assert rows(e.instant("g @ 45", 100), "ts", "value") == [(40, 40.0)]
    assert rows(e.range("g @ 45", 80, 100, 10), "ts", "value") == [(80, 40.0), (90, 40.0), (100, 40.0)]
    assert rows(e.range("g offset 20s", 80, 100, 10), "ts", "value") == [(80, 60.0), (90, 70.0), (100, 80.0)]
    assert rows(e.instant("sum_over_time(g[20s] offset 10s)", 100), "value") == [(240.0,)]
    assert rows(e.instant("sum_over_time(g[20s] @ 50)", 100), "value") == [(120.0,)]
    assert rows(e.instant("max_over_time(sum_over_time(g[10s])[30s:10s])", 100), "value") == [(190.0,)]


def test_errors(three):
    for query in ("abs(m)", "rate(m)", "sum(1)", '"text"', "m and 1", "m[5m:1m]", "quantile_over_time(m[5m])"):
        with pytest.raises(QueryError):
            three.range(query, 0, 100, 10)
    with pytest.raises(QuerySyntaxError):
        three.instant("", 1)
    with pytest.raises(QueryError):
        three.range("m", 100, 0)
    assert three.instant("nothing", 100).count() == 0
    assert three.range("sum(nothing)", 0, 100).count() == 0


def test_selector_without_name(three):
    assert rows(three.instant('{host="a"}', 100), "__name__", "value") == [("m", 2.0)]


def test_label_values_with_odd_characters(spark):
    e = engine(spark, m=metric(spark, [("x,y=z", 1, 1.0), ("x", 1, 2.0)], ["k"]))
    assert {r["k"]: r["value"] for r in e.instant("sum(m) by (k)", 10).collect()} == {"x,y=z": 1.0, "x": 2.0}


def test_metadata(three):
    assert [r[0] for r in three.label_names().collect()] == ["__name__", "env", "host"]
    assert [r[0] for r in three.label_values("host").collect()] == ["a", "b", "c"]
    assert [r[0] for r in three.label_values("host", limit=1, offset=1).collect()] == ["b"]
    assert [r[0] for r in three.label_values("host", offset=9).collect()] == []
    assert [r[0] for r in three.label_values("__name__", pattern="^m").collect()] == ["m"]
    assert [r[0] for r in three.label_values("host", ['m{env="prod"}']).collect()] == ["a", "b"]
    assert three.series(["m"], 15, 30).count() == 2
    assert three.series(['m{host="a"}', 'm{host="c"}']).count() == 2
    assert tuple(three.series_count().first()) == (4, 1)
    with pytest.raises(QueryError):
        three.series([])
    with pytest.raises(QueryError):
        three.series(["m"], 10, 5)


def test_pipeline(spark):
    e = engine(spark, m=metric(spark, [(t, float(v)) for t, v in ((10, 1), (20, 2), (30, 3), (40, 4), (50, 5))]), r=metric(spark, [(0, 1.0), (10, 6.0), (20, 3.0)]))
    run = lambda *stages, query="m": rows(e.pipeline([{"query": query, "start": 1, "end": 100}, *stages]), "ts", "value")
    assert [v for _, v in run({"function": "moving_average"})] == [1, 2, 2, 3, 4]
    assert run({"function": "double_values"}, {"function": "aggregate_sum"})[-1] == (50, 10.0)
    assert run({"function": "filter_high_values"}) == []
    assert run({"function": "rate_of_change"}, query="r") == [(20, -0.3)]
    assert run({"function": "pass"}) == run()
    e.register("halve", lambda df: df.withColumn("value", df["value"] / 2))
    assert run({"function": "halve", "type": "python"})[0] == (10, 0.5)
    for bad in ([{"query": "m"}], [], [{"query": "m", "start": 5, "end": 2}]):
        with pytest.raises(QueryError):
            e.pipeline(bad)
    for stage in ({"function": "nope"}, {"function": "pass", "type": "ruby"}, {"code": "result = df"}):
        with pytest.raises(QueryError):
            run(stage)
    e.allow_code = True
    assert run({"code": "result = df.where('ts > 40')"}) == [(50, 5.0)]


def brute_windows(points, function, window, start, end, step):
    """The rules of windows on a grid, point by point."""
    out = {}
    grid = list(range(start, end + 1, step))
    grid += [end] if grid[-1] != end else []
    for t in grid:
        inside = [(x, v) for x, v in points if t - window <= x <= t]
        if function == "rate":
            if len(inside) == 1:
                before = [(x, v) for x, v in points if start - 2 * window <= x < inside[0][0]]
                inside = before[-1:] + inside
            if len(inside) > 1:
                (t0, v0), (t1, v1) = inside[0], inside[-1]
                out[t] = (v1 if v1 < v0 else v1 - v0) / (t1 - t0)
        elif function == "irate":
            *_, (t0, v0), (t1, v1) = [(None, None), *([p for p in points if p[0] <= t] if inside else [(None, None)])]
            if t0 is not None:
                out[t] = (v1 if v1 < v0 else v1 - v0) / (t1 - t0)
        elif inside:
            values = [v for _, v in inside]
            out[t] = {"sum_over_time": sum(values), "max_over_time": max(values), "count_over_time": len(values)}[function]
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 120), st.integers(0, 20)), min_size=1, max_size=25, unique_by=lambda x: x[0]), st.sampled_from(["rate", "sum_over_time", "max_over_time", "count_over_time"]), st.integers(1, 40), st.integers(2, 30))
def test_windows_against_brute_force(spark, points, function, window, step):
    points = sorted((t, float(v)) for t, v in points)
    e = engine(spark, m=metric(spark, points))
    got = {r["ts"]: round(r["value"], 9) for r in e.range(f"{function}(m[{window}s])", 10, 100, step).collect()}
    assert got == {t: round(v, 9) for t, v in brute_windows([p for p in points if p[0] <= 100], function, window, 10, 100, step).items()}


@pytest.mark.parametrize("function", ["rate", "irate", "sum_over_time", "avg_over_time", "min_over_time", "max_over_time", "count_over_time", "stddev_over_time", "stdvar_over_time"])
@pytest.mark.parametrize(("window", "step"), [(40, 7), (36, 6), (100, 4), (64, 64)])
def test_panes_equal_expansion(spark, monkeypatch, function, window, step):
    """By panes and by expanding samples, for labelled series and one without labels."""
    rng = random.Random(window)
    rows = [(s, t, float(rng.randrange(50))) for s in "ab" for t in sorted(rng.sample(range(-150, 300), 90))]
    for e in (engine(spark, m=metric(spark, rows, ["s"])), engine(spark, m=metric(spark, [r[1:] for r in rows if r[0] == "a"]))):
        found = []
        for overlap in (1, 10**9):
            monkeypatch.setattr(ranges, "OVERLAP", overlap)
            df = e.range(f"{function}(m[{window}s])", 3, 270, step)
            found.append({tuple(r[c] for c in df.columns if c != "value"): round(r["value"], 6) for r in df.collect()})
        assert found[0] == found[1] and found[0]


def labelled_rates(spark, function, window, step, rng):
    """A rate of three series, with a gap and one sample before it, and what it must be."""
    kept = {"a": sorted(rng.sample(range(-150, 300), 60)), "b": [*sorted(rng.sample(range(-40, 60), 9)), 250], None: [100]}
    points = {s: [(t, float(rng.randrange(50))) for t in times if 3 - 2 * window <= t <= 270] for s, times in kept.items()}
    e = engine(spark, m=metric(spark, [(s, t, v) for s, p in points.items() for t, v in p], ["s"]))
    df = e.range(f"{function}(m[{window}s])", 3, 270, step)
    expected = {(s, t): round(v, 9) for s, p in points.items() for t, v in brute_windows(p, function, window, 3, 270, step).items()}
    return df, expected


@pytest.mark.parametrize("function", ["rate", "irate"])
@pytest.mark.parametrize(("window", "step"), [(40, 7), (36, 6), (150, 4), (5, 89)])
def test_rates_follow_series(spark, function, window, step):
    """They are as by brute force, and aggregate no rows of series and points: that took a task's memory."""
    df, expected = labelled_rates(spark, function, window, step, random.Random(window))
    assert {(r["s"], r["ts"]): round(r["value"], 9) for r in df.collect()} == expected
    assert "Aggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_month_over_minutes(spark):
    """[30d] at steps of 60 s: 43,200 points a sample, by panes."""
    day = 86_400
    e = engine(spark, m=metric(spark, [("a", t, float(t % 1000)) for t in range(0, 31 * day, 3600)] + [("b", 5, 1.0)], ["s"]))
    df = e.range("max_over_time(m[30d])", 30 * day, 31 * day, 60)
    assert df.where("s = 'a'").count() == 1441
    assert {r["value"] for r in df.where("s = 'a'").collect()} == {800.0}
    assert df.where("s = 'b'").count() == 1
    assert e.range("count_over_time(m[30d])", 30 * day, 31 * day, 60).where("s = 'a' and ts = 2592000").first()["value"] == 721.0


def test_neighbours_in_chunks(spark, monkeypatch):
    """A series without labels is ordered in chunks of time; neighbours across chunks, over empty ones too, are the same."""
    monkeypatch.setattr(ranges, "CHUNKS", 7)
    times = [1, 2, 3, 50, 51, 90, 91, 99, 100]
    df = spark.createDataFrame([(t, float(t)) for t in times], "ts long, value double")
    got = {r["ts"]: (r["p"], r["v"]) for r in ranges.with_neighbour(df, [], 100, {"ts": "p", "value": "v"}).collect()}
    assert got == {t: (b, None if b is None else float(b)) for t, b in zip(times, [None, *times], strict=False)}
    after = {r["ts"]: r["n"] for r in ranges.with_neighbour(df, [], 100, {"ts": "n"}, after=True).collect()}
    assert after == dict(zip(times, [*times[1:], None], strict=True))


def test_quantiles_of_equal_values_and_nothing(spark):
    e = engine(spark, m=metric(spark, [("a", t, v) for t, v in ((1, 2.0), (2, 2.0), (3, 5.0))] + [("b", 1, float("nan"))], ["s"]))
    assert rows(e.range("quantile_over_time(0.5, m[1s])", 0, 3), "s", "value")[0] == ("a", 2.0)
    assert e.range("quantile_over_time(2, m[9s])", 0, 3, 2).count() == 0
    assert rows(e.instant('quantile(1, m{s="a"})', 9), "ts", "value") == [(3, 5.0)]
