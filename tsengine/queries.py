"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Metric, TableSource, driver_tables, event_total, event_value
from .operators.downsample import Level, coarser, downsample, level_for
from .plans.engine import Engine

#: The month of the events; its last second is no multiple of any step from its first.
START, END = 1_704_067_200, 1_706_659_199
#: Before and after every order and line.
OLD, NEW = 694_224_000, 1_720_000_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Values to six decimals: sums of doubles depend on their order beyond that."""
    return df.withColumn("value", F.round("value", 6))


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, driver_tables(spark, sf_dir))


# --- SQL of the metrics

_ROUND = "round(value, 6) AS value"
METRICS = {
    "ev": "SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, arg_min(value, event_id) AS value FROM events GROUP BY ALL",
    "et": "SELECT event_type, ts, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY ts) AS DOUBLE) AS value FROM (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) AS ts, count(*) AS n FROM events GROUP BY ALL)",
    "op": "SELECT o_orderstatus AS status, o_orderpriority AS priority, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts, arg_min(o_totalprice, o_orderkey) AS value FROM orders GROUP BY ALL",
    "lq": "SELECT l_returnflag AS returnflag, l_linestatus AS linestatus, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS ts, arg_min(l_quantity, (l_orderkey, l_linenumber)) AS value FROM lineitem GROUP BY ALL",
}
LABELS = {"ev": "event_type, user_id", "et": "event_type", "op": "status, priority", "lq": "returnflag, linestatus"}
NAMES = {"ev": "event_value", "et": "event_total", "op": "order_totalprice", "lq": "line_quantity"}


def with_(*parts: str, **named: str) -> str:
    """A WITH clause of metrics and named queries."""
    every = {p: METRICS[p] for p in parts} | named
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in every.items()) + "\n"


def last(m: str, at: int = NEW, where: str = "true") -> str:
    return f"SELECT {LABELS[m]}, max(ts) AS ts, arg_max(value, ts) AS value FROM {m} WHERE ts BETWEEN 0 AND {at} AND {where} GROUP BY {LABELS[m]}"


def grid(start: int, end: int, step: int, add_end: bool = True) -> str:
    return f"SELECT range AS t FROM range({start}, {end + 1}, {step})" + (f" UNION SELECT {end}" if add_end else "")


def resampled(m: str, start: int, end: int, step: int) -> str:
    """The last sample at most a tenth over a step old, at each grid point."""
    keys = LABELS[m].split(", ")
    on = " AND ".join(f"p.{k} = s.{k}" for k in keys)
    return f"SELECT {', '.join(f'p.{k}' for k in keys)}, p.t AS ts, s.value FROM (SELECT * FROM (SELECT DISTINCT {LABELS[m]} FROM {m}), ({grid(start, end, step, False)})) p ASOF JOIN (SELECT * FROM {m} WHERE ts >= {start - int(step * 1.1)}) s ON {on} AND p.t >= s.ts WHERE p.t - s.ts <= {int(step * 1.1)}"


WINDOW_SQL = {
    "sum": "sum(value)",
    "avg": "avg(value)",
    "min": "min(value)",
    "max": "max(value)",
    "count": "CAST(count(*) AS DOUBLE)",
    "stddev": "stddev_pop(value)",
    "stdvar": "var_pop(value)",
    "quantile": "list_sort(list(value))[CAST(floor((count(value) - 1) * 0.9) AS BIGINT) + 1]",
}
GROUP_SQL = dict(WINDOW_SQL)


def over_time(m: str, f: str, window: int, start: int, end: int, step: int | None, source: str | None = None) -> str:
    """A function over [t - window, t] at each grid point, or at end alone without a step."""
    points = grid(start, end, step) if step else f"SELECT {end} AS t"
    if f in ("rate", "irate"):
        lagged = f"SELECT *, lag(ts) OVER w AS pts, lag(value) OVER w AS pv FROM {source or m} WHERE ts BETWEEN {start - 2 * window} AND {end} WINDOW w AS (PARTITION BY {LABELS[m]} ORDER BY ts)"
        if f == "rate":
            edge = "CASE WHEN count(*) < 2 THEN first(pts ORDER BY ts) ELSE min(ts) END AS t0, CASE WHEN count(*) < 2 THEN first(pv ORDER BY ts) ELSE arg_min(value, ts) END AS v0"
        else:
            edge = "last(pts ORDER BY ts) AS t0, last(pv ORDER BY ts) AS v0"
        inner = f"SELECT {LABELS[m]}, t, max(ts) AS t1, arg_max(value, ts) AS v1, {edge} FROM ({lagged}) JOIN ({points}) ON ts BETWEEN t - {window} AND t GROUP BY {LABELS[m]}, t"
        return f"SELECT {LABELS[m]}, t AS ts, (CASE WHEN v1 < v0 THEN v1 ELSE v1 - v0 END) / (t1 - t0) AS value FROM ({inner}) WHERE t1 > t0"
    return f"SELECT {LABELS[m]}, t AS ts, {WINDOW_SQL[f]} AS value FROM {source or m} JOIN ({points}) ON ts BETWEEN t - {window} AND t GROUP BY {LABELS[m]}, t"


def instant(name: str, query: str, sql: str | None, at: int = NEW) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(engine(spark, sf_dir).instant(query, at))
    if sql:
        SQL[name] = sql


def ranged(name: str, query: str, sql: str | None, start: int = START, end: int = END, step: int = 0) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(engine(spark, sf_dir).range(query, start, end, step))
    if sql:
        SQL[name] = sql


def shown(m: str, body: str, name: bool = True) -> str:
    """Labels, time and rounded value of a body, with the metric's name or without."""
    return (f"SELECT '{NAMES[m]}' AS name, " if name else "SELECT ") + f"{LABELS[m]}, ts, {_ROUND} FROM ({body})"


# --- selectors

instant("instant_select", "event_value", with_("ev") + shown("ev", last("ev")))
instant("instant_eq_matcher", 'event_value{event_type="view"}', with_("ev") + shown("ev", last("ev", where="event_type = 'view'")))
instant("instant_neq_matcher", 'event_value{event_type!="view"}', with_("ev") + shown("ev", last("ev", where="event_type <> 'view'")))
instant("instant_regex_matcher", 'order_totalprice{priority=~"[12]-.*"}', with_("op") + shown("op", last("op", where="regexp_full_match(priority, '[12]-.*')")))
instant("instant_not_regex_matcher", 'order_totalprice{priority!~"[12]-.*",status="O"}', with_("op") + shown("op", last("op", where="NOT regexp_full_match(priority, '[12]-.*') AND status = 'O'")))
ranged("range_raw", "event_value", with_("ev") + shown("ev", f"SELECT * FROM ev WHERE ts BETWEEN {START} AND {END}"))
instant("range_selector_instant", "event_value[1d]", with_("ev") + shown("ev", f"SELECT * FROM ev WHERE ts BETWEEN {END - 86400} AND {END}"), END)
ranged("range_resample_step", "event_value", with_("ev") + shown("ev", resampled("ev", START, END, 3600)), step=3600)

# --- aggregations across series

for _op, _sql in GROUP_SQL.items():
    _call = "quantile(0.9, event_value)" if _op == "quantile" else f"{_op}(event_value)"
    instant(f"agg_{_op}_by", f"{_call} by (event_type)", with_("ev") + f"SELECT event_type, max(ts) AS ts, round({_sql}, 6) AS value FROM ({last('ev')}) GROUP BY event_type")
    # squares of thousands keep within what six decimals can compare
    _of, _in = ("order_totalprice / 1000", "(value / 1000)") if _op.startswith("std") else ("order_totalprice", "value")
    ranged(f"range_agg_{_op}", _call.replace("event_value", _of) + " by (status)", with_("op") + f"SELECT status, ts, round({_sql.replace('value', _in)}, 6) AS value FROM op WHERE ts BETWEEN {OLD} AND {NEW} GROUP BY status, ts", OLD, NEW)
instant("agg_group_by", "group(event_value) by (event_type)", with_("ev") + f"SELECT event_type, max(ts) AS ts, CAST(1 AS DOUBLE) AS value FROM ({last('ev')}) GROUP BY event_type")
instant("agg_count_values_by", 'count_values("price", line_quantity) by (returnflag)', with_("lq") + f"SELECT returnflag, printf('%.6f', value) AS price, max(ts) AS ts, CAST(count(*) AS DOUBLE) AS value FROM ({last('lq')}) GROUP BY ALL")
instant("agg_sum_all", "sum(event_value)", with_("ev") + f"SELECT max(ts) AS ts, round(sum(value), 6) AS value FROM ({last('ev')})")
instant("agg_sum_without", "sum without (user_id) (event_value)", with_("ev") + f"SELECT event_type, max(ts) AS ts, round(sum(value), 6) AS value FROM ({last('ev')}) GROUP BY event_type")
for _op, _dir in (("topk", "DESC"), ("bottomk", "ASC")):
    _rank = f"SELECT *, row_number() OVER (ORDER BY value {_dir}, event_type, user_id) AS r FROM ({last('ev')})"
    instant(f"agg_{_op}", f"{_op}(10, event_value)", with_("ev") + shown("ev", f"SELECT * FROM ({_rank}) WHERE r <= 10"))
instant("agg_topk_by", "topk(3, event_value) by (event_type)", with_("ev") + shown("ev", f"SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, user_id) AS r FROM ({last('ev')}) QUALIFY r <= 3"))

# --- functions over windows

DAY, HOUR = 86_400, 3600
ranged("rate_step", "rate(event_total[6h])", with_("et") + shown("et", over_time("et", "rate", 6 * HOUR, START, END, HOUR), False), step=HOUR)
ranged("rate_step_reset", "rate(event_value[2d])", with_("ev") + shown("ev", over_time("ev", "rate", 2 * DAY, START, END, DAY), False), step=DAY)
ranged("irate_step", "irate(event_value[2d])", with_("ev") + shown("ev", over_time("ev", "irate", 2 * DAY, START, END, DAY), False), step=DAY)
for _op in WINDOW_SQL:
    _call = "quantile_over_time(0.9, event_value[2d])" if _op == "quantile" else f"{_op}_over_time(event_value[2d])"
    ranged(f"{_op}_over_time_step", _call, with_("ev") + shown("ev", over_time("ev", _op, 2 * DAY, START, END, DAY), False), step=DAY)
instant("rate_instant", "rate(event_total[1d])", with_("et") + shown("et", over_time("et", "rate", DAY, END, END, None), False), END)
instant("avg_over_time_instant", "avg_over_time(event_value[7d])", with_("ev") + shown("ev", over_time("ev", "avg", 7 * DAY, END, END, None), False), END)
ranged("rate_whole_range", "rate(event_total[5m])", with_("et") + f"SELECT event_type, {END} AS ts, round((arg_max(value, ts) - arg_min(value, ts)) / (max(ts) - min(ts)), 6) AS value FROM et WHERE ts BETWEEN {START} AND {END} GROUP BY event_type HAVING count(*) > 1")
ranged("nested_sum_rate", "sum(rate(event_value[2d])) by (event_type)", with_("ev", r=over_time("ev", "rate", 2 * DAY, START, END, DAY)) + "SELECT event_type, ts, round(sum(value), 6) AS value FROM r GROUP BY event_type, ts", step=DAY)
ranged("nested_max_avg_over_time", "max(avg_over_time(event_value[2d])) by (event_type)", with_("ev", r=over_time("ev", "avg", 2 * DAY, START, END, DAY)) + "SELECT event_type, ts, round(max(value), 6) AS value FROM r GROUP BY event_type, ts", step=DAY)
instant("nested_topk_sum", "topk(2, sum(event_value) by (event_type))", with_("ev") + f"SELECT event_type, ts, round(value, 6) AS value FROM (SELECT event_type, max(ts) AS ts, sum(value) AS value FROM ({last('ev')}) GROUP BY event_type) ORDER BY value DESC, event_type LIMIT 2")

# --- operators

for _name, _op, _sql in (("add", "+ 5", "value + 5"), ("sub", "- 5", "value - 5"), ("mul", "* 3", "value * 3"), ("div", "/ 7", "value / 7"), ("mod", "% 7", "fmod(value, 7)"), ("pow", "^ 2", "pow(value, 2)")):
    instant(f"bin_{_name}_scalar", f"event_value {_op}", with_("ev") + f"SELECT event_type, user_id, ts, round({_sql}, 6) AS value FROM ({last('ev')})")
_s = f"SELECT event_type, max(ts) AS ts, sum(value) AS s, count(*) AS n FROM ({last('ev')}) GROUP BY event_type"
instant("bin_div_on", "sum(event_value) by (event_type) / on (event_type) count(event_value) by (event_type)", with_("ev") + f"SELECT event_type, ts, round(s / n, 6) AS value FROM ({_s})")
instant("bin_group_left", "event_value / on (event_type) group_left () sum(event_value) by (event_type)", with_("ev", l=last("ev"), g=_s) + "SELECT l.event_type, l.user_id, g.ts, round(l.value / g.s, 6) AS value FROM l JOIN g USING (event_type)")
instant("cmp_filter", "event_value > 100", with_("ev") + shown("ev", f"SELECT * FROM ({last('ev')}) WHERE value > 100"))
instant("cmp_bool", "event_value > bool 100", with_("ev") + f"SELECT event_type, user_id, ts, CAST(value > 100 AS DOUBLE) AS value FROM ({last('ev')})")
_hi, _lo = f"SELECT * FROM ({last('ev')}) WHERE value > 100", f"SELECT * FROM ({last('ev')}) WHERE value < 120"
instant("set_and", "(event_value > 100) and (event_value < 120)", with_("ev") + shown("ev", f"SELECT * FROM ({_hi}) WHERE value < 120"))
instant("set_or", "(event_value > 120) or (event_value < 100)", with_("ev") + shown("ev", f"SELECT * FROM ({last('ev')}) WHERE value > 120 OR value < 100"))
instant("set_unless", "event_value unless (event_value > 100)", with_("ev") + shown("ev", f"SELECT * FROM ({last('ev')}) WHERE NOT value > 100"))
instant("unary_neg", "-event_value", with_("ev") + f"SELECT event_type, user_id, ts, round(-value, 6) AS value FROM ({last('ev')})")
instant("offset_instant", "event_value offset 7d", with_("ev") + shown("ev", last("ev", END - 7 * DAY)), END)
instant("at_modifier", f"event_value @ {START + 15 * DAY}", with_("ev") + shown("ev", last("ev", START + 15 * DAY)), END)
_sub = f"SELECT event_type, t AS ts, (CASE WHEN v1 < v0 THEN v1 ELSE v1 - v0 END) / (t1 - t0) AS value FROM (SELECT event_type, t, max(ts) AS t1, arg_max(value, ts) AS v1, CASE WHEN count(*) < 2 THEN first(pts ORDER BY ts) ELSE min(ts) END AS t0, CASE WHEN count(*) < 2 THEN first(pv ORDER BY ts) ELSE arg_min(value, ts) END AS v0 FROM (SELECT *, lag(ts) OVER w AS pts, lag(value) OVER w AS pv FROM et WHERE ts BETWEEN {{low}} AND {{high}} WINDOW w AS (PARTITION BY event_type ORDER BY ts)) JOIN (SELECT range AS t FROM range({{first}}, {{last}} + 1, {HOUR})) ON ts BETWEEN t - {6 * HOUR} AND t GROUP BY event_type, t) WHERE t1 > t0"
_first, _last = -(-(END - DAY) // HOUR) * HOUR, END // HOUR * HOUR
instant("subquery_avg_rate", "avg_over_time(rate(event_total[6h])[1d:1h])", with_("et", s=_sub.format(low=_first - 12 * HOUR, high=_last, first=_first, last=_last)) + f"SELECT event_type, {END} AS ts, round(avg(value), 6) AS value FROM s WHERE ts BETWEEN {END - DAY} AND {END} GROUP BY event_type", END)

# --- metadata

_PAIRS = {"ev": "event_type, user_id", "et": "event_type", "op": "priority, status", "lq": "linestatus, returnflag"}
_ALL = with_("ev", "et", "op", "lq", series=" UNION ALL ".join(f"SELECT DISTINCT '{NAMES[m]}' AS name, '{NAMES[m]}{{' || {' || chr(44) || '.join(f'''{chr(39)}{k}={chr(34)}{chr(39)} || {k} || {chr(39)}{chr(34)}{chr(39)}''' for k in _PAIRS[m].split(', '))} || '}}' AS series FROM {m}" for m in METRICS))


def _keys(df: DataFrame) -> DataFrame:
    from .model import labels_key

    return df.select("name", labels_key(F.col("name"), F.col("labels")).alias("series"))


QUERIES["label_names"] = lambda spark, sf_dir: engine(spark, sf_dir).label_names()
SQL["label_names"] = "SELECT unnest(['__name__', 'event_type', 'linestatus', 'priority', 'returnflag', 'status', 'user_id']) AS label"
QUERIES["label_values"] = lambda spark, sf_dir: engine(spark, sf_dir).label_values("user_id", ["event_value"])
SQL["label_values"] = "SELECT DISTINCT CAST(user_id AS VARCHAR) AS value FROM events"
QUERIES["label_values_filter_page"] = lambda spark, sf_dir: engine(spark, sf_dir).label_values("user_id", pattern="1[0-4]", limit=20, offset=5)
SQL["label_values_filter_page"] = "SELECT DISTINCT CAST(user_id AS VARCHAR) AS value FROM events WHERE regexp_matches(CAST(user_id AS VARCHAR), '1[0-4]') ORDER BY value LIMIT 20 OFFSET 5"
QUERIES["series_match"] = lambda spark, sf_dir: _keys(engine(spark, sf_dir).series(['order_totalprice{status="O"}', "line_quantity"]))
SQL["series_match"] = _ALL + "SELECT name, series FROM series WHERE name = 'line_quantity' OR (name = 'order_totalprice' AND contains(series, 'status=\"O\"'))"
QUERIES["series_has_data"] = lambda spark, sf_dir: _keys(engine(spark, sf_dir).series(["event_value"], END - DAY, END))
SQL["series_has_data"] = with_("ev") + f"SELECT DISTINCT 'event_value' AS name, 'event_value{{event_type=\"' || event_type || '\",user_id=\"' || user_id || '\"}}' AS series FROM ev WHERE ts BETWEEN {END - DAY} AND {END}"
QUERIES["series_count"] = lambda spark, sf_dir: engine(spark, sf_dir).series_count()
SQL["series_count"] = _ALL + "SELECT count(*) AS n_series, count(DISTINCT name) AS n_metrics FROM series"


# --- pipelines


def _piped(name: str, *functions: str, sql: str, query: str = "event_value", step: int = 0) -> None:
    stages = [{"query": query, "start": START, "end": END, "step": step}, *({"function": f} for f in functions)]
    QUERIES[f"fn_{name}"] = lambda spark, sf_dir: rounded(engine(spark, sf_dir).pipeline(stages))
    SQL[f"fn_{name}"] = with_("ev") + sql


_RAW = f"SELECT * FROM ev WHERE ts BETWEEN {START} AND {END}"
_W = "WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts)"
_piped("pass", "pass", sql=shown("ev", _RAW))
_piped("double_values", "double_values", sql=f"SELECT 'event_value' AS name, event_type, user_id, ts, round(value * 2, 6) AS value FROM ({_RAW})")
_piped("add_label", "add_label", sql=f"SELECT 'event_value' AS name, event_type, user_id, ts, {_ROUND}, 'true' AS processed, 'tsengine' AS processor FROM ({_RAW})")
_piped("filter_high_values", "filter_high_values", sql=shown("ev", f"SELECT *, max(value) OVER (PARTITION BY event_type, user_id) AS m FROM ({_RAW}) QUALIFY m >= 100"))
_piped("aggregate_sum", "aggregate_sum", sql=f"SELECT 'aggregated_sum' AS name, ts, round(sum(value), 6) AS value FROM ({_RAW}) GROUP BY ts")
_piped("moving_average", "moving_average", sql=shown("ev", f"SELECT event_type, user_id, ts, CASE WHEN row_number() OVER w >= 3 THEN avg(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) ELSE value END AS value FROM ({_RAW}) {_W}"))
_piped("rate_of_change", "rate_of_change", sql=shown("ev", f"SELECT event_type, user_id, ts, CASE WHEN n < 2 THEN value ELSE gain / gap END AS value FROM (SELECT *, ts - lag(ts) OVER w AS gap, value - lag(value) OVER w AS gain, count(*) OVER (PARTITION BY event_type, user_id) AS n FROM ({_RAW}) {_W}) WHERE n < 2 OR gap > 0"))


# --- storage and downsampling


def dedupe_first_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a status and priority on one day: the first written stays."""
    return rounded(driver_tables(spark, sf_dir).metrics["order_totalprice"].df)


QUERIES["dedupe_first_write"] = dedupe_first_write
SQL["dedupe_first_write"] = with_("op") + "SELECT status, priority, ts, round(value, 6) AS value FROM op"


def merge_hot_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first writes of orders as the cold store and the last as the hot one, which wins."""
    from .sources.store import merge_hot_cold as merge

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.unix_timestamp("o_orderdate").alias("ts"), "o_orderkey", "o_totalprice")
    cold = orders.groupBy("status", "priority", "ts").agg(F.min_by("o_totalprice", "o_orderkey").alias("value"))
    hot = orders.where("ts >= 900000000").groupBy("status", "priority", "ts").agg(F.max_by("o_totalprice", "o_orderkey").alias("value"))
    return rounded(merge(cold, hot))


QUERIES["merge_hot_cold"] = merge_hot_cold
SQL["merge_hot_cold"] = "WITH o AS (SELECT *, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts FROM orders) SELECT o_orderstatus AS status, o_orderpriority AS priority, ts, round(CASE WHEN ts >= 900000000 THEN arg_max(o_totalprice, o_orderkey) ELSE arg_min(o_totalprice, o_orderkey) END, 6) AS value FROM o GROUP BY o_orderstatus, o_orderpriority, ts"

_STATS = ["avg", "min", "max"]


def _rounded_level(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in _STATS})


QUERIES["downsample_1h"] = lambda spark, sf_dir: _rounded_level(downsample(event_value(spark, sf_dir).df, HOUR, ["event_type", "user_id"]))
SQL["downsample_1h"] = with_("ev") + f"SELECT event_type, user_id, ts // {HOUR} * {HOUR} AS ts, round(avg(value), 6) AS avg, round(min(value), 6) AS min, round(max(value), 6) AS max, CAST(count(*) AS DOUBLE) AS count FROM ev GROUP BY event_type, user_id, ts // {HOUR}"


def downsample_1d_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's step over a month is answered by the daily level, itself made of the hourly one."""
    keys, levels = ["event_type", "user_id"], (Level("raw", 0, 2 * DAY), Level("1h", HOUR, 90 * DAY), Level("1d", DAY))
    hourly = downsample(event_value(spark, sf_dir).df, HOUR, keys)
    made = {"1h": hourly, "1d": coarser(hourly, DAY, keys)}
    level = made[level_for(START, END + 1, DAY, levels).name]
    source = TableSource({"event_value_max": Metric(level.select(*keys, "ts", F.col("max").alias("value")), keys)})
    return rounded(Engine(spark, source).range("max(event_value_max) by (event_type)", START, END, DAY))


QUERIES["downsample_1d_routing"] = downsample_1d_routing
SQL["downsample_1d_routing"] = with_("ev", d=f"SELECT event_type, user_id, ts // {DAY} * {DAY} AS ts, max(value) AS value FROM ev GROUP BY event_type, user_id, ts // {DAY}") + f"SELECT event_type, ts, round(max(value), 6) AS value FROM (SELECT event_type, user_id, g.t AS ts, arg_max(value, ts) AS value FROM d JOIN ({grid(START, END, DAY, False)}) g ON d.ts BETWEEN g.t - {int(DAY * 1.1)} AND g.t GROUP BY ALL) GROUP BY event_type, ts"


def exposition_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as exposition text and parsed again."""
    from .sources.exposition import parse_lines

    ev = event_value(spark, sf_dir).df
    line = F.format_string('event_value{event_type="%s",user_id="%s"} %s %d', "event_type", "user_id", F.col("value").cast("string"), "ts")
    rows = parse_lines(ev.select(line.alias("value")))
    return rounded(rows.select("name", F.element_at("labels", "event_type").alias("event_type"), F.element_at("labels", "user_id").alias("user_id"), "ts", "value"))


QUERIES["exposition_parse"] = exposition_parse
SQL["exposition_parse"] = with_("ev") + shown("ev", "SELECT * FROM ev")


def json_batch_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON write requests, parsed again."""
    from .sources.json_writes import parse_requests

    ev = event_value(spark, sf_dir).df
    body = F.to_json(F.struct(F.lit("event_value").alias("metric"), "value", F.col("ts").alias("timestamp"), F.struct("event_type", "user_id").alias("labels")))
    rows = parse_requests(ev.select(body.alias("value")))
    return rounded(rows.select("name", F.element_at("labels", "event_type").alias("event_type"), F.element_at("labels", "user_id").alias("user_id"), "ts", "value"))


QUERIES["json_batch_write"] = json_batch_write
SQL["json_batch_write"] = SQL["exposition_parse"]


def event_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counter's increase per second, for the flagship query's source alone."""
    return rounded(Engine(spark, TableSource({"event_total": event_total(spark, sf_dir)})).range("sum(rate(event_total[6h]))", START, END, HOUR))


QUERIES["flagship_sum_rate"] = event_rate
SQL["flagship_sum_rate"] = with_("et", r=over_time("et", "rate", 6 * HOUR, START, END, HOUR)) + "SELECT ts, round(sum(value), 6) AS value FROM r GROUP BY ts"
