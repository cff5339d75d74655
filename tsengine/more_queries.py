"""Registered queries over stores, the service, streams and the language itself, and their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Service, result_rows
from .functions.pipeline import per_series
from .model import MapSource, TableSource, driver_tables, event_value, labels_key, order_totalprice
from .operators.downsample import as_metrics, downsample
from .plans import syntax as S
from .plans.durations import automatic_step, format_duration, parse_config_duration, parse_duration, parse_time
from .plans.engine import Engine
from .queries import DAY, END, HOUR, LABELS, METRICS, NEW, QUERIES, SQL, START, engine, grid, instant, last, over_time, ranged, rounded, shown, with_
from .scratch import new_path
from .sources.buffer import WriteBuffer
from .sources.exposition import flat_name, parse_lines
from .sources.hybrid import HybridSource, partitioned
from .sources.scrape import landed_samples, load_config
from .sources.store import Store, in_order
from .streaming.ingest import downsampled, first_writes, into_store, stream_json

MIDDLE = START + 15 * DAY


def query(name: str, sql: str | None):
    """Register a function of (spark, sf_dir) under a name."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(columns: str, rows: list[tuple]) -> str:
    """SQL of literal rows."""
    show = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"CAST({x} AS BIGINT)" if isinstance(x, int) else f"CAST({x!r} AS DOUBLE)"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS t({columns})"


# --- selectors and operators in their other forms

_VIEW = with_("ev") + shown("ev", last("ev", where="event_type = 'view'"))
instant("select_by_name_label", '{__name__="event_value",event_type="view"}', _VIEW)
instant("select_unquoted_value", "event_value{event_type==view}", _VIEW)
instant("select_quoted_name", '{"event_value", event_type="view"}', _VIEW)
instant("select_comment_and_strings", "event_value{event_type='view', user_id=~`1[0-4].*`,} # the rest is no query }", with_("ev") + shown("ev", last("ev", where="event_type = 'view' AND regexp_full_match(user_id, '1[0-4].*')")))
instant("select_names_by_regex", '{__name__=~"event_.*",event_type="view"}', with_("ev", "et") + f"SELECT 'event_value' AS __name__, event_type, user_id, ts, round(value, 6) AS value FROM ({last('ev', where=chr(39).join(('event_type = ', 'view', '')))}) UNION ALL SELECT 'event_total', event_type, NULL, ts, round(value, 6) FROM ({last('et', where=chr(39).join(('event_type = ', 'view', '')))})")
instant("bin_one_to_one", "event_value * event_value", with_("ev") + f"SELECT event_type, user_id, ts, round(value * value, 6) AS value FROM ({last('ev')})")
_BY = f"SELECT status, max(ts) AS ts, sum(value) AS s, max(value) AS m, arg_max(priority, value) AS p FROM ({last('op')}) GROUP BY status"
instant("bin_ignoring", "order_totalprice / ignoring (priority) group_left () sum(order_totalprice) by (status)", with_("op", l=last("op"), g=_BY) + "SELECT l.status, l.priority, g.ts, round(l.value / g.s, 6) AS value FROM l JOIN g USING (status)")
instant("bin_group_right", "sum(order_totalprice) by (status) / on (status) group_right () order_totalprice", with_("op", l=last("op"), g=_BY) + "SELECT l.status, l.priority, g.ts, round(g.s / l.value, 6) AS value FROM l JOIN g USING (status)")
instant("bin_group_left_include", "sum(order_totalprice) by (status) / on (status) group_left (priority) topk(1, order_totalprice) by (status)", with_("op", g=_BY) + "SELECT status, p AS priority, ts, round(s / m, 6) AS value FROM g")
ranged("at_start", "event_value @ start()", with_("ev") + f"SELECT 'event_value' AS name, event_type, user_id, t AS ts, round(value, 6) AS value FROM ({last('ev', MIDDLE)}), ({grid(MIDDLE, END, DAY, False)})", MIDDLE, END, DAY)
ranged("at_end", "event_value @ end()", with_("ev") + f"SELECT 'event_value' AS name, event_type, user_id, t AS ts, round(value, 6) AS value FROM ({last('ev', END)}), ({grid(MIDDLE, END, DAY, False)})", MIDDLE, END, DAY)
ranged("offset_range", "event_value offset 1d", with_("ev") + f"SELECT 'event_value' AS name, event_type, user_id, ts + {DAY} AS ts, round(value, 6) AS value FROM ev WHERE ts BETWEEN {START - DAY} AND {END - DAY}")

# --- long windows over short steps

for _f in ("sum", "avg", "min", "max", "count", "stddev", "stdvar", "rate", "irate"):
    _name = _f if _f in ("rate", "irate") else f"{_f}_over_time"
    ranged(f"{_name}_long_window", f"{_name}(event_value[20d])", with_("ev") + shown("ev", over_time("ev", _f, 20 * DAY, START, END, DAY), False), step=DAY)
ranged("quantile_over_time_whole", "quantile_over_time(0.9, event_value[1d])", with_("ev") + f"SELECT event_type, user_id, {END} AS ts, round(list_sort(list(value))[CAST(floor((count(value) - 1) * 0.9) AS BIGINT) + 1], 6) AS value FROM ev WHERE ts BETWEEN {START} AND {END} GROUP BY event_type, user_id")

# --- stores


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of events and orders with label maps."""
    parts = []
    for name, metric in (("event_value", event_value(spark, sf_dir)), ("order_totalprice", order_totalprice(spark, sf_dir))):
        pairs = [x for label in metric.labels for x in (F.lit(label), F.col(label))]
        parts.append(metric.df.select(F.lit(name).alias("name"), F.create_map(*pairs).alias("labels"), "ts", "value"))
    return parts[0].unionByName(parts[1])


def written(spark: SparkSession, sf_dir: str, bucket: int = 30 * DAY, make=Store) -> Store:
    """A store of two writes: all samples, and then a quarter of them again with other values, which come too late."""
    store = make(spark, new_path(spark, "store"), bucket_size=bucket)
    rows = labelled(spark, sf_dir)
    store.write(rows, 1)
    store.write(rows.where("ts % 4 = 0").withColumn("value", F.col("value") + 1), 2)
    return store


def over_store(name: str, text: str, sql: str, start: int = START, end: int = END, step: int | None = 0) -> None:
    def run(spark, sf_dir):
        e = Engine(spark, written(spark, sf_dir).source())
        return rounded(e.instant(text, end) if step is None else e.range(text, start, end, step))

    query(name, sql)(run)


def with_key(df: DataFrame) -> DataFrame:
    return df.select("name", labels_key(F.col("name"), F.col("labels")).alias("series"))


over_store("store_range", "event_value", SQL["range_raw"])
over_store("store_matcher", 'event_value{event_type="view",user_id=~"1.*"}', with_("ev") + shown("ev", last("ev", where="event_type = 'view' AND regexp_full_match(user_id, '1.*')")), end=NEW, step=None)
over_store("store_sum_rate", "sum(rate(event_value[2d])) by (event_type)", SQL["nested_sum_rate"], step=DAY)
over_store("store_resample", "event_value", SQL["range_resample_step"], step=HOUR)
_EV_KEY = "'event_value{event_type=\"' || event_type || '\",user_id=\"' || user_id || '\"}'"
_OP_KEY = "'order_totalprice{priority=\"' || priority || '\",status=\"' || status || '\"}'"
_SERIES = with_("ev", "op", series=f"SELECT DISTINCT 'event_value' AS name, {_EV_KEY} AS series FROM ev UNION ALL SELECT DISTINCT 'order_totalprice', {_OP_KEY} FROM op")


@query("store_series", with_("ev") + f"SELECT DISTINCT 'event_value' AS name, {_EV_KEY} AS series FROM ev WHERE event_type = 'view' AND ts BETWEEN {MIDDLE} AND {END}")
def store_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_key(Engine(spark, written(spark, sf_dir).source()).series(['event_value{event_type="view"}'], MIDDLE, END))


@query("store_series_count", _SERIES + "SELECT count(*) AS n_series, count(DISTINCT name) AS n_metrics FROM series")
def store_series_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, written(spark, sf_dir).source()).series_count()


@query("store_metric_listing", _SERIES + "SELECT name, count(*) AS n_series FROM series GROUP BY name")
def store_metric_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = written(spark, sf_dir)
    return store.metric_names().join(store.series().groupBy("name").agg(F.count(F.lit(1)).alias("n_series")), "name")


@query("store_index_lookup", _SERIES + "SELECT name, series FROM series WHERE name = 'order_totalprice' AND contains(series, 'status=\"O\"')")
def store_index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir).find_series({"__name__": "order_totalprice", "status": "O"}).select("name", F.col("labels_key").alias("series"))


@query("store_labels_of_ids", _SERIES + "SELECT name, series FROM series WHERE name = 'order_totalprice'")
def store_labels_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = written(spark, sf_dir)
    ids = [r["series"] for r in store.find_series({"__name__": "order_totalprice"}).select("series").collect()]
    return store.labels_for(ids).select("name", F.col("labels_key").alias("series"))


@query("store_postings", with_("ev", "op", s="SELECT 'event_type' AS label, event_type AS value, user_id AS o FROM ev UNION SELECT 'user_id', user_id, event_type FROM ev UNION SELECT 'status', status, priority FROM op UNION SELECT 'priority', priority, status FROM op") + "SELECT label, value, count(*) AS n FROM s GROUP BY label, value")
def store_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir).postings().groupBy("label", "value").agg(F.count(F.lit(1)).alias("n"))


_STORED = with_("ev", "op") + f"SELECT name, series, ts, round(value, 6) AS value FROM (SELECT 'event_value' AS name, {_EV_KEY} AS series, ts, value FROM ev UNION ALL SELECT 'order_totalprice', {_OP_KEY}, ts, value FROM op)"


def stored(store: Store, low: int | None = None, high: int | None = None) -> DataFrame:
    return rounded(store.samples(low, high).select("name", F.col("labels_key").alias("series"), "ts", "value"))


@query("store_scan", _STORED + f" WHERE ts BETWEEN {MIDDLE} AND {END}")
def store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(written(spark, sf_dir), MIDDLE, END)


@query("store_compact", _STORED)
def store_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(written(spark, sf_dir, 365 * DAY).compact(new_path(spark, "compact")))


@query("store_partitioned", _STORED)
def store_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(written(spark, sf_dir, 365 * DAY, lambda s, path, bucket_size: partitioned(s, path, 3, bucket_size)))


@query("store_expire", with_("ev") + f"SELECT 'event_value' AS name, {_EV_KEY} AS series, ts, round(value, 6) AS value FROM ev WHERE ts // {DAY} * {DAY} + {DAY} > {END + 1 - 10 * DAY}")
def store_expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, new_path(spark, "store"), bucket_size=DAY)
    store.write(labelled(spark, sf_dir).where("name = 'event_value'"), 1)
    store.expire(END + 1, 10 * DAY)
    return stored(store)


@query("store_skips_corrupt_files", _STORED)
def store_skips_corrupt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that is no Parquet among a bucket's files is left out."""
    from .scratch import file_system

    store = written(spark, sf_dir, 365 * DAY)
    target, files = file_system(spark, f"{store.path}/samples/seq=2/bucket={START // (365 * DAY) * 365 * DAY}/part-broken.parquet")
    out = files.create(target)
    out.writeBytes("no Parquet at all, however long one looks")
    out.close()
    return stored(Store(spark, store.path, store.bucket_size, skip_corrupt=True))


@query("store_hybrid", with_("ev") + f"SELECT event_type, user_id, ts, round(CASE WHEN ts >= {MIDDLE} THEN value + 1000 ELSE value END, 6) AS value, 'event_value' AS name FROM ev WHERE ts BETWEEN {START} AND {END}")
def store_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month's second half is hot as well, with other values, which win; older hot samples are evicted."""
    store = Store(spark, new_path(spark, "store"))
    rows = labelled(spark, sf_dir).where("name = 'event_value'")
    store.write(rows, 1)
    hot = MapSource(rows.withColumn("value", F.col("value") + 1000))
    return rounded(Engine(spark, HybridSource(store.source(), hot).evicted(MIDDLE)).range("event_value", START, END))


@query("store_first_in_order", with_(e="SELECT event_type, user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, value FROM events", m=f"SELECT *, max(ts) OVER (PARTITION BY event_type, user_id, ts // {DAY} ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e") + "SELECT event_id, ts FROM m WHERE before IS NULL OR ts > before")
def store_first_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each series and day, the events that come after all before them in order of arrival."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit("event_value").alias("name"), F.concat_ws("|", "event_type", "user_id").alias("labels_key"), F.unix_timestamp("ts").alias("ts"), "event_id")
    return in_order(rows, "event_id", DAY).select("event_id", "ts")


# --- the service


def service(spark: SparkSession, sf_dir: str) -> Service:
    return Service(engine(spark, sf_dir))


def result_of(spark: SparkSession, body: str) -> DataFrame:
    """labels (name and labels as k=v), place, ts and v of a JSON answer."""
    rows = []
    for x in json.loads(body)["data"]["result"]:
        key = ",".join(f"{k}={v}" for k, v in sorted(x["metric"].items()))
        rows += [(key, k, p[0], p[1]) for k, p in enumerate(x.get("values") or [x["value"]])]
    return literal(spark, rows, "labels string, place long, ts long, v string")


@query("json_vector", with_("op") + f"SELECT 'status=' || status AS labels, CAST(0 AS BIGINT) AS place, max(ts) AS ts, printf('%.6f', max(value)) AS v FROM ({last('op')}) GROUP BY status")
def json_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_of(spark, service(spark, sf_dir).query("max(order_totalprice) by (status)", NEW)[1])


_MATRIX = with_("ev") + f"SELECT 'event_type=' || event_type AS labels, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS place, ts, printf('%.6f', value) AS v FROM (SELECT event_type, ts, max(value) AS value FROM ev WHERE ts BETWEEN {END - DAY} AND {END} GROUP BY event_type, ts)"


@query("json_matrix_in_order", _MATRIX)
def json_matrix_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_of(spark, service(spark, sf_dir).query_range("max(event_value) by (event_type)", END - DAY, END)[1])


@query("json_result_rows", _MATRIX)
def json_result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without leaving Spark."""
    rows = result_rows(engine(spark, sf_dir).range("max(event_value) by (event_type)", END - DAY, END), True)
    rows = rows.select(F.concat(F.lit("event_type="), F.element_at("metric", "event_type")).alias("labels"), F.posexplode("values").alias("place", "p"))
    return rows.select("labels", F.col("place").cast("long").alias("place"), "p.ts", "p.v")


@query("json_labels", values("value", [(x,) for x in ("__name__", "event_type", "linestatus", "priority", "returnflag", "status", "user_id")]))
def json_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literal(spark, [(x,) for x in json.loads(service(spark, sf_dir).handle("GET", "/api/v1/labels", {})[1])["data"]], "value string")


@query("json_label_values", with_("op") + "SELECT DISTINCT priority AS value FROM op WHERE status = 'O' ORDER BY 1 LIMIT 3 OFFSET 1")
def json_label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = service(spark, sf_dir).handle("GET", "/api/v1/label/priority/values", {"match[]": ['order_totalprice{status="O"}'], "limit": "3", "offset": "1"})[1]
    return literal(spark, [(x,) for x in json.loads(body)["data"]], "value string")


@query("json_series", with_("op") + "SELECT DISTINCT status, priority FROM op WHERE status = 'O'")
def json_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = service(spark, sf_dir).handle("GET", "/api/v1/series", {"match[]": ['order_totalprice{status="O"}']})[1]
    return literal(spark, [(x["status"], x["priority"]) for x in json.loads(body)["data"]], "status string, priority string")


@query("series_from_start_until_now", with_("ev") + f"SELECT DISTINCT 'event_value' AS name, {_EV_KEY} AS series FROM ev WHERE ts >= {END - DAY}")
def series_from_start_until_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_key(engine(spark, sf_dir).series(["event_value"], END - DAY))


_POINTS = [("m", 1.5, 1000, "a"), ("m", 2.5, 1010, "a"), ("m", 7.0, 1000, "b"), ("m", 99.0, 1000, "a"), ("n", -1.0, 1_700_000_000_500, "a")]
_KEPT = [("m", "a", 1000, 1.5), ("m", "a", 1010, 2.5), ("m", "b", 1000, 7.0), ("n", "a", 1_700_000_000, -1.0)]


@query("write_points", values("name, host, ts, value", _KEPT))
def write_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single and batch writes over the service: buffered, flushed by count, first write kept."""
    store = Store(spark, new_path(spark, "store"))
    buffer = WriteBuffer(store, points=2, seconds=60)
    s = Service(Engine(spark, store.source()), buffer)
    bodies = [{"metric": n, "value": v, "timestamp": t, "labels": {"host": h}} for n, v, t, h in _POINTS]
    s.write(json.dumps(bodies[0]))
    s.write_batch(json.dumps([*bodies[1:], {"value": 3}, {"metric": "", "value": 1}]))
    buffer.flush()
    return store.samples().select("name", F.element_at("labels", "host").alias("host"), "ts", "value")


_REQUESTS = [
    ("GET", "/api/v1/query", {"query": "sum(event_value)", "time": "2024-01-20T00:00:00Z"}, 200),
    ("GET", "/api/v1/query", {"query": "sum("}, 400),
    ("GET", "/api/v1/query_range", {"query": "rate(event_value)", "start": str(START), "end": str(END), "step": "1h"}, 400),
    ("GET", "/api/v1/query_range", {"query": "event_value", "start": "9", "end": "5"}, 400),
    ("GET", "/api/v1/query_range", {"query": "abs(event_value)", "start": "5", "end": "9"}, 400),
    ("DELETE", "/api/v1/query", {"query": "event_value"}, 405),
    ("GET", "/api/v1/write", {}, 405),
    ("GET", "/api/v1/nothing", {}, 404),
    ("GET", "/api/v1/series", {}, 400),
    ("GET", "/api/v1/labels", {"start": "never"}, 400),
    ("GET", "/api/v1/query", {"query": "order_totalprice / on () line_quantity"}, 500),
]


@query("service_statuses", values("place, status", [(k, r[3]) for k, r in enumerate(_REQUESTS)]))
def service_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = service(spark, sf_dir)
    return literal(spark, [(k, s.handle(*r[:3])[0]) for k, r in enumerate(_REQUESTS)], "place long, status long")


@query("self_metrics", values("name, value", [("tsengine_instant_queries", 2.0), ("tsengine_instant_errors", 1.0), ("tsengine_range_queries", 1.0), ("tsengine_labels_requests", 1.0)]))
def self_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of requests as exposition text, parsed again."""
    s = service(spark, sf_dir)
    s.query("sum(event_value)", END)
    s.query("sum(", END)
    s.query_range("sum(event_value)", END - DAY, END)
    s.labels(["event_value"])
    rows = parse_lines(literal(spark, [(x,) for x in s.metrics().split("\n")], "value string"))
    return rows.where(F.col("name").rlike("queries|errors|requests")).select("name", "value")


@query("profile_counters", "SELECT CAST(count(*) AS BIGINT) AS rows_read FROM events")
def profile_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a query's scan read, as its profile tells."""
    body = service(spark, sf_dir).query("max(event_value) by (event_type)", NEW, profile=True)[1]
    return literal(spark, [(json.loads(body)["profile"]["rows"],)], "rows_read long")


@query("command_line", with_("op") + f"SELECT 'status=' || status AS labels, CAST(0 AS BIGINT) AS place, max(ts) AS ts, printf('%.6f', max(value)) AS v FROM ({last('op')}) GROUP BY status")
def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .__main__ import run

    return result_of(spark, run(spark, [written(spark, sf_dir, 365 * DAY).path, "query", "max(order_totalprice) by (status)", "--time", str(NEW)]))


@query("command_line_metrics", values("name", [("order_totalprice",)]))
def command_line_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .__main__ import run

    return literal(spark, [(x,) for x in run(spark, [written(spark, sf_dir, 365 * DAY).path, "metrics", "total"]).split("\n")], "name string")


# --- pipelines with functions of one's own

_RAW = f"SELECT * FROM ev WHERE ts BETWEEN {START} AND {END}"
_STAGE = {"query": "event_value", "start": START, "end": END}


@query("fn_registered", with_("ev") + f"SELECT 'event_value' AS name, event_type, user_id, ts, round(value / 2, 6) AS value FROM ({_RAW})")
def fn_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.register("halve", lambda df: df.withColumn("value", F.col("value") / 2))
    return rounded(e.pipeline([_STAGE, {"function": "halve", "type": "python"}]))


@query("fn_per_series", with_("ev") + f"SELECT event_type, user_id, max(ts) AS ts, round(max(value) - min(value), 6) AS value FROM ({_RAW}) GROUP BY event_type, user_id")
def fn_per_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)

    def spread(pdf):
        keys = ["event_type", "user_id"]
        found = pdf.groupby(keys, sort=False, dropna=False).agg(ts=("ts", "max"), high=("value", "max"), low=("value", "min")).reset_index()
        return found.assign(value=found["high"] - found["low"])[[*keys, "ts", "value"]]

    e.register("spread", per_series(spread, "event_type string, user_id string, ts long, value double", many=True))
    return rounded(e.pipeline([_STAGE, {"function": "spread", "type": "python"}]))


@query("fn_code", with_("ev") + shown("ev", f"SELECT * FROM ({_RAW}) WHERE value > 100"))
def fn_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, driver_tables(spark, sf_dir), allow_code=True)
    return rounded(e.pipeline([_STAGE, {"code": "result = input_data.where('value > 100')"}]))


@query("fn_nothing", with_("ev") + shown("ev", _RAW))
def fn_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage that names no function changes nothing."""
    return rounded(engine(spark, sf_dir).pipeline([{**_STAGE, "functions": [{}]}, {}]))


# --- streams


def landed(spark: SparkSession, sf_dir: str, times: int = 1) -> tuple[str, str]:
    """Events as files of JSON write requests, each request so many times; a checkpoint's path beside them."""
    path = new_path(spark, "requests")
    rows = event_value(spark, sf_dir).df.select(F.lit("event_value").alias("metric"), "value", F.col("ts").alias("timestamp"), F.create_map(F.lit("event_type"), "event_type", F.lit("user_id"), "user_id").alias("labels"))
    for _ in range(times):
        rows.write.mode("append").json(path)
    return path, new_path(spark, "checkpoint")


@query("stream_into_store", with_("ev") + f"SELECT 'event_value' AS name, {_EV_KEY} AS series, ts, round(value, 6) AS value FROM ev")
def stream_into_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request twice, in micro-batches: each sample is stored once."""
    path, checkpoint = landed(spark, sf_dir, 2)
    store = Store(spark, new_path(spark, "store"))
    into_store(stream_json(spark, path), store, checkpoint, once=True).awaitTermination()
    return stored(store)


def streamed(frame: DataFrame, checkpoint: str) -> DataFrame:
    """What a stream has sent once it has read all there is, as a table."""
    out = new_path(frame.sparkSession, "streamed")
    frame.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out, "parquet", "append").awaitTermination()
    return frame.sparkSession.read.schema(frame.schema).parquet(out)


@query("stream_downsample", with_("ev") + f"SELECT event_type, user_id, ts // {HOUR} * {HOUR} AS ts, round(avg(value), 6) AS avg, round(min(value), 6) AS min, round(max(value), 6) AS max, CAST(count(*) AS DOUBLE) AS count FROM ev GROUP BY event_type, user_id, ts // {HOUR} HAVING ts // {HOUR} * {HOUR} + {HOUR} <= (SELECT max(ts) FROM ev) - {HOUR}")
def stream_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of each series, those that the watermark (an hour behind the latest event) has passed."""
    path, checkpoint = landed(spark, sf_dir)
    wide = stream_json(spark, path).select(F.element_at("labels", "event_type").alias("event_type"), F.element_at("labels", "user_id").alias("user_id"), "ts", "value")
    out = streamed(downsampled(wide, ["event_type", "user_id"], HOUR, "1 hour"), checkpoint)
    return out.withColumns({c: F.round(c, 6) for c in ("avg", "min", "max")})


@query("stream_first_writes", with_("ev") + f"SELECT 'event_value' AS name, {_EV_KEY} AS series, ts, round(value, 6) AS value FROM ev")
def stream_first_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, checkpoint = landed(spark, sf_dir, 2)
    out = first_writes(stream_json(spark, path)).select("name", F.col("labels_key").alias("series"), "ts", "value")
    return rounded(streamed(out, checkpoint))


@query("downsample_metrics", with_("ev", d=f"SELECT event_type, user_id, ts // {DAY} * {DAY} AS ts, avg(value) AS a, min(value) AS i, max(value) AS x, CAST(count(*) AS DOUBLE) AS c FROM ev GROUP BY event_type, user_id, ts // {DAY}") + "SELECT 'event_value_' || k AS name, event_type, user_id, ts, round(v, 6) AS value FROM (SELECT event_type, user_id, ts, unnest(['avg', 'min', 'max', 'count']) AS k, unnest([a, i, x, c]) AS v FROM d)")
def downsample_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A level as four metrics."""
    level = downsample(event_value(spark, sf_dir).df, DAY, ["event_type", "user_id"]).withColumn("name", F.lit("event_value"))
    return rounded(as_metrics(level))


# --- scraped text

_NAMES = f"'app.event_value.' || event_type || '.10_0_0_' || user_id AS flat FROM (SELECT DISTINCT {LABELS['ev']} FROM ({METRICS['ev']}))"


@query("flat_names", f"SELECT {_NAMES}")
def flat_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = event_value(spark, sf_dir).df.select("event_type", "user_id").distinct()
    return series.select(flat_name(F.lit("event_value"), F.col("event_type"), F.concat(F.lit("10.0.0."), "user_id", F.lit(":80")), prefix="app").alias("flat"))


@query("scraped_pages", with_("ev") + "SELECT 'app.event_value' AS name, event_type, 'j' AS job, user_id || ':80' AS instance, 'prod' AS env, ts, round(value, 6) AS value FROM ev")
def scraped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each user: labels of the line over those of the target, job and instance over all."""
    line = F.format_string('event_value{event_type="%s",job="own"} %s %d', "event_type", F.col("value").cast("string"), "ts")
    pages = event_value(spark, sf_dir).df.groupBy("user_id").agg(F.array_join(F.collect_list(line), "\n").alias("body"))
    fixed = F.create_map(F.lit("env"), F.lit("prod"), F.lit("event_type"), F.lit("of the target"))
    rows = landed_samples(pages.select(F.lit("j").alias("job"), F.concat("user_id", F.lit(":80")).alias("instance"), F.lit(0).cast("long").alias("fetched"), fixed.alias("labels"), F.lit("app").alias("prefix"), "body"))
    get = lambda k: F.element_at("labels", k).alias(k)
    return rounded(rows.select("name", get("event_type"), get("job"), get("instance"), get("env"), "ts", "value"))


_CONFIG = {"global": {"scrape_interval": "30s"}, "scrape_configs": [{"job_name": "a", "static_configs": [{"targets": ["h:1", "h:2"]}]}, {"job_name": "b", "scrape_interval": "1m", "scrape_timeout": "20s", "metrics_path": "/m", "scheme": "https", "static_configs": [{"targets": ["i:3"]}]}]}


@query("scrape_config", values("job, target, seconds, timeout, path, scheme", [("a", "h:1", 30, 10, "/metrics", "http"), ("a", "h:2", 30, 10, "/metrics", "http"), ("b", "i:3", 60, 20, "/m", "https")]))
def scrape_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(j.name, t.url, j.interval, j.timeout, j.path, j.scheme) for j in load_config(json.dumps(_CONFIG)) for t in j.targets]
    return literal(spark, rows, "job string, target string, seconds long, timeout long, path string, scheme string")


# --- the language

_TIMES = [("5m", 300), ("1h30m", 5400), ("500ms", 0), ("1y", 31_536_000), ("2w", 1_209_600), ("1.5h", 5400), ("1d12h", 129_600)]
QUERIES["durations"] = lambda spark, sf_dir: literal(spark, [(t, parse_duration(t)) for t, _ in _TIMES], "text string, seconds long")
SQL["durations"] = values("text, seconds", _TIMES)
_FORMS = [(5400, "1h30m"), (0, "0s"), (90_061, "1d1h1m1s"), (60, "1m")]
QUERIES["formatted_durations"] = lambda spark, sf_dir: literal(spark, [(n, format_duration(n)) for n, _ in _FORMS], "seconds long, text string")
SQL["formatted_durations"] = values("seconds, text", _FORMS)
_CONFIGURED = [("30", 30), ("100us", 0), ("5ns", 0), ("15s", 15), ("7d", 604_800)]
QUERIES["configured_durations"] = lambda spark, sf_dir: literal(spark, [(t, parse_config_duration(t)) for t, _ in _CONFIGURED], "text string, seconds long")
SQL["configured_durations"] = values("text, seconds", _CONFIGURED)
_MOMENTS = [("now", 10_000), ("now-1h", 6400), ("now+2d", 182_800), ("1700000000.9", 1_700_000_000), ("2024-01-01T00:00:00Z", START), ("2024-01-01T01:00:00+01:00", START)]
QUERIES["moments"] = lambda spark, sf_dir: literal(spark, [(t, parse_time(t, 10_000)) for t, _ in _MOMENTS], "text string, seconds long")
SQL["moments"] = values("text, seconds", _MOMENTS)
_STEPS = [(60, 15, 15), (7200, 60, 60), (100_000, 600, 300), (700_000, 3600, 300)]
QUERIES["automatic_steps"] = lambda spark, sf_dir: literal(spark, [(n, automatic_step(n), automatic_step(n, True)) for n, *_ in _STEPS], "seconds long, step long, rate_step long")
SQL["automatic_steps"] = values("seconds, step, rate_step", _STEPS)

_TOKENS = [("word", "sum"), ("symbol", "("), ("word", "a.b:c"), ("symbol", "{"), ("word", "x"), ("symbol", "!~"), ("text", "'é\\'s'"), ("symbol", ","), ("word", "y"), ("symbol", "="), ("text", "`raw\\n`"), ("symbol", "}"), ("symbol", "["), ("duration", "1h30m"), ("symbol", "]"), ("symbol", ")"), ("symbol", ">="), ("number", ".5"), ("symbol", "^"), ("number", "1e3"), ("end", "")]
QUERIES["tokens"] = lambda spark, sf_dir: literal(spark, [(k, t.kind, t.text) for k, t in enumerate(S.tokenize("sum(a.b:c{x!~'é\\'s', y=`raw\\n`}[1h30m]) >= .5 ^ 1e3 # a comment"))], "place long, kind string, text string")
SQL["tokens"] = values("place, kind, text", [(k, *t) for k, t in enumerate(_TOKENS)])
_CANONICAL = [
    ('sum(rate(m{env="p"}[5m])) by (job)', 'sum by (job)(rate(m{env="p"}[300s]))'),
    ("2^3^2", "(2 ^ (3 ^ 2))"),
    ("-2^2", "(-2 ^ 2)"),
    ("1+2*3 > bool 4", "((1 + (2 * 3)) > bool 4)"),
    ("a or b and c unless d", "(a or ((b and c) unless d))"),
    ("a / on (x) group_left (y) b", "(a / on (x) group_left (y) b)"),
    ("x offset 5m @ end()", "x offset 300s @ end()"),
    ("max_over_time(rate(x[1m])[10m:30s])", "max_over_time(rate(x[60s])[600s:30s])"),
    ('{"foo.bar", a=~"b.*",}', 'foo.bar{a=~"b.*"}'),
    ("x{a='it\\'s'}", 'x{a="it\'s"}'),
    ("((x))", "x"),
]
QUERIES["canonical_queries"] = lambda spark, sf_dir: literal(spark, [(q, str(S.parse(q))) for q, _ in _CANONICAL], "query string, canonical string")
SQL["canonical_queries"] = values("query, canonical", _CANONICAL)
@query("syntax_nodes", values("kind, n", [("Aggregate", 2), ("Call", 1), ("Matcher", 1), ("Number", 2), ("Selector", 2)]))
def syntax_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a tree by kind."""
    tree = S.parse('sum(rate(m{a="b"}[5m])) / topk(3, n) + -1')
    kinds = [type(x).__name__ for x in S.walk(tree)]
    return literal(spark, [(k, kinds.count(k)) for k in ("Aggregate", "Call", "Matcher", "Number", "Selector")], "kind string, n long")


_NUMBERS = [("1 + 2 * 3", 7.0), ("-2 ^ 2", 4.0), ("2 ^ 3 ^ 2", 512.0), ("7 % 4", 3.0), ("(1 + 2) * 3", 9.0), ("1e3 + .5", 1000.5), ("2 > bool 1", 1.0), ("10 / 4 - 1", 1.5)]


@query("numbers", values("query, value", _NUMBERS))
def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What expressions of numbers alone evaluate to."""
    e = Engine(spark, TableSource({}))
    frames = [e.instant(q, END).select(F.lit(q).alias("query"), "value") for q, _ in _NUMBERS]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("union_of_sources", with_("ev", "op") + f"SELECT DISTINCT 'event_value' AS name, {_EV_KEY} AS series FROM ev UNION SELECT DISTINCT 'order_totalprice', {_OP_KEY} FROM op")
def union_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of a store of events and of hot orders together, each once."""
    rows = labelled(spark, sf_dir)
    store = Store(spark, new_path(spark, "store"), bucket_size=365 * DAY)
    store.write(rows.where("name = 'event_value'"), 1)
    return with_key(Engine(spark, HybridSource(store.source(), MapSource(rows))).series(["event_value", "order_totalprice"]))

