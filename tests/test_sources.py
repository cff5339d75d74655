"""Sources, stores, downsampling and streams."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tsengine.api import Service, answer
from tsengine.functions.pipeline import per_series
from tsengine.model import MapSource, labels_key
from tsengine.operators.downsample import Level, as_metrics, coarser, downsample, level_for
from tsengine.plans.engine import Engine
from tsengine.sources.buffer import WriteBuffer
from tsengine.sources.exposition import flat_name, parse_lines, target_labels, write_text
from tsengine.sources.hybrid import hybrid, in_memory, on_disk, partitioned
from tsengine.sources.json_writes import parse_requests, send
from tsengine.sources.scrape import ConfigError, landed_samples, load_config, scrape
from tsengine.sources.store import Store, in_order, merge_hot_cold
from tsengine.streaming.ingest import downsampled, first_writes, into_store, stream_json, stream_scraped

TEXT = """# HELP http_requests_total Total HTTP requests
# TYPE http_requests_total counter
http_requests_total{method="GET",status="200"} 1234
http_requests_total{method="POST",status="201"} 567
cpu_usage 45.5
memory_bytes{type="heap"} 8388608 1234567890

broken line
bad{a="b"} x
ms 1 1234567890123
odd{a="x,y=\\"z\\"",b="\\\\n"} +Inf
"""


def lines(spark, text):
    return spark.createDataFrame([(x,) for x in text.split("\n")], "value string")


def test_exposition(spark):
    got = {(r["name"], tuple(sorted(r["labels"].items()))): (r["ts"], r["value"]) for r in parse_lines(lines(spark, TEXT), now=F.lit(99)).collect()}
    assert got == {
        ("http_requests_total", (("method", "GET"), ("status", "200"))): (99, 1234.0),
        ("http_requests_total", (("method", "POST"), ("status", "201"))): (99, 567.0),
        ("cpu_usage", ()): (99, 45.5),
        ("memory_bytes", (("type", "heap"),)): (1_234_567_890, 8388608.0),
        ("ms", ()): (1_234_567_890, 1.0),
        ("odd", (("a", 'x,y="z"'), ("b", "\\n"))): (99, float("inf")),
    }
    samples = parse_lines(lines(spark, TEXT), now=F.lit(99))
    again = parse_lines(write_text(samples))
    assert sorted(map(str, again.collect())) == sorted(map(str, samples.collect()))


def test_flat_names(spark):
    name = lambda *a, **b: spark.range(1).select(flat_name(*[F.lit(x) for x in a], **b)).first()[0]
    assert name("http_requests_total", "api", "localhost:8080", prefix="app") == "app.http_requests_total.api.localhost"
    assert name("cpu-usage:rate") == "cpu_usage_rate"
    assert name("x", "j", "10.0.0.1:80") == "x.j.10_0_0_1"


def test_target_labels(spark):
    own = F.create_map(F.lit("a"), F.lit("1"), F.lit("job"), F.lit("mine"))
    got = spark.range(1).select(target_labels(own, "j", "i:1", {"a": "2", "b": "3"}, {"b": "4", "c": "5"})).first()[0]
    assert got == {"a": "1", "b": "3", "c": "5", "job": "j", "instance": "i:1"}


def test_json_writes(spark):
    bodies = ['{"metric": "m", "value": 1.5, "time": 10, "tags": {"a": "1", "b": "2"}, "labels": {"b": "3"}}', '[{"metric": "n", "value": 2, "timestamp": 20, "time": 5}, {"metric": "", "value": 1}, {"metric": "x"}]', "nonsense", '{"metric": "o", "value": 3}']
    got = sorted((r["name"], r["ts"], r["value"], tuple(sorted(r["labels"].items()))) for r in parse_requests(spark.createDataFrame([(b,) for b in bodies], "value string"), now=F.lit(77)).collect())
    assert got == [("m", 10, 1.5, (("a", "1"), ("b", "3"))), ("n", 20, 2.0, ()), ("o", 77, 3.0, ())]


def test_scrape_config():
    jobs = load_config(json.dumps({"global": {"scrape_interval": "30s"}, "scrape_configs": [{"job_name": "test-job", "static_configs": [{"targets": ["h:1"], "labels": {"a": "b"}}]}]}))
    assert (jobs[0].interval, jobs[0].timeout, jobs[0].path, jobs[0].targets[0].labels) == (30, 10, "/metrics", {"a": "b"})
    for bad in ({}, {"scrape_configs": [{"job_name": "x"}]}, {"scrape_configs": [{"static_configs": [{"targets": ["h"]}]}]}, {"scrape_configs": [{"job_name": "x", "scrape_timeout": "1m", "static_configs": [{"targets": ["h"]}]}]}):
        with pytest.raises(ConfigError):
            load_config(json.dumps(bad))


def samples(spark, rows):
    return spark.createDataFrame(rows, "name string, labels map<string,string>, ts long, value double")


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), bucket_size=86_400)
    assert store.samples().count() == 0
    store.write(samples(spark, [("m", {"a": "1"}, 100, 1.0), ("m", {"a": "1"}, 90_000, 2.0), ("n", {}, 100, 5.0)]), 1)
    store.write(samples(spark, [("m", {"a": "1"}, 100, 9.0), ("m", {"a": "2"}, 100, 3.0)]), 2)
    assert sorted((r["labels_key"], r["ts"], r["value"]) for r in store.samples().collect()) == [('m{a="1"}', 100, 1.0), ('m{a="1"}', 90_000, 2.0), ('m{a="2"}', 100, 3.0), ("n{}", 100, 5.0)]
    assert store.samples(50, 200).count() == 3
    e = Engine(spark, store.source())
    assert sorted((r["a"], r["value"]) for r in e.instant("m", 1000).collect()) == [("1", 1.0), ("2", 3.0)]
    plan = e.range("m", 100_000, 200_000)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [" in plan
    assert [r["labels_key"] for r in store.find_series({"__name__": "m", "a": "2"}).collect()] == ['m{a="2"}']
    assert sorted((r["label"], r["value"], r["labels_key"]) for r in store.postings().collect()) == [("a", "1", 'm{a="1"}'), ("a", "2", 'm{a="2"}')]
    ids = {r["labels_key"]: r["series"] for r in store.series().collect()}
    assert [r["labels_key"] for r in store.labels_for([ids["n{}"]]).collect()] == ["n{}"]
    compact = store.compact(str(tmp_path / "compact"))
    assert compact.samples().count() == 4
    plan = Engine(spark, compact.source()).range('m{a="2"}', 0, 200_000)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\([^)]*ts#", plan)  # nothing stored twice, so nothing to deduplicate
    assert re.search(r"name#\d+ = m", plan) and re.search(r"series#\d+L (=|IN) ", plan)
    assert store.expire(now=200_000, keep_seconds=100_000) == [0]
    assert store.samples().count() == 1


def test_store_writes_replace_themselves(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for value in (1.0, 2.0):
        store.write(samples(spark, [("m", {"a": "1", "b": "2"}, 100, value)]), 7)
    store.write(samples(spark, [("m", {"b": "2", "a": "1"}, 100, 3.0), ("m", {"a": "1", "b": "2"}, 101, 4.0), ("m", {"a": "1", "b": "2"}, 101, 3.5)]), 8)
    assert sorted((r["ts"], r["value"]) for r in store.samples().collect()) == [(100, 2.0), (101, 3.5)]
    assert store.series().count() == 1
    with pytest.raises(Exception, match="one id for two series"):
        rows = samples(spark, [("x", {}, 1, 1.0)]).withColumn("series", F.lit(store.series().first()["series"]))
        store._write_series(rows, 9)


def test_store_is_compact(spark, tmp_path):
    """A thousand samples a minute apart, ten different values, take less than 8 bytes each."""
    rows = samples(spark, [("cpu", {"host": "a"}, 1_700_000_000 + 60 * k, 50.0 + k % 10) for k in range(20_000)])
    Store(spark, str(tmp_path / "store"), spread=1).write(rows, 1)
    assert len(list((tmp_path / "store" / "samples").rglob("*.parquet"))) == 1
    size = sum(p.stat().st_size for p in (tmp_path / "store" / "samples").rglob("*.parquet"))
    assert size / 20_000 < 8


def test_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tsengine.sources.store.FILE_ROWS", 100)
    store = Store(spark, str(tmp_path / "store"), bucket_size=1000, spread=2)
    store.write(samples(spark, [("m", {"k": str(k % 40)}, k, 1.0) for k in range(1000)]), 1)
    assert len(list((tmp_path / "store/samples/seq=1/bucket=0").glob("*.parquet"))) >= 10
    assert store.samples().count() == 1000


def test_corrupt_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.write(samples(spark, [("m", {}, 100, 1.0)]), 1)
    (tmp_path / "store/samples/seq=1/bucket=0/part-broken.parquet").write_text("no Parquet, however long one looks")
    with pytest.raises(Exception, match="Parquet|parquet"):
        store.samples().collect()
    assert Store(spark, store.path, skip_corrupt=True).samples().count() == 1


def test_hybrid(spark, tmp_path):
    store = on_disk(spark, str(tmp_path / "store"))
    store.write(samples(spark, [("m", {"a": "1"}, 100, 1.0), ("m", {"a": "1"}, 4000, 2.0), ("old", {}, 5, 1.0)]), 1)
    both = hybrid(store, samples(spark, [("m", {"a": "1"}, 100, 7.0), ("m", {"a": "1", "b": "x"}, 4000, 9.0), ("new", {}, 5, 1.0)]))
    assert both.names() == ["m", "new", "old"]
    assert both.labels_of("m") == ["a", "b"]
    got = lambda source: sorted((r["b"] or "", r["ts"], r["value"]) for r in Engine(spark, source).range("m", 0, 5000).collect())
    assert got(both) == [("", 100, 7.0), ("", 4000, 2.0), ("x", 4000, 9.0)]
    assert got(both.evicted(3700)) == [("", 100, 1.0), ("", 4000, 2.0), ("x", 4000, 9.0)]
    assert partitioned(spark, str(tmp_path / "parts"), 3).spread == 3
    assert in_memory(samples(spark, [("m", {}, 1, 1.0)])).names() == ["m"]
    assert on_disk(spark, store.path, keep_seconds=10, now=10**9).samples().count() == 0


def test_write_buffer(spark, tmp_path):
    now, number = [0.0], iter(range(1, 99))
    buffer = WriteBuffer(Store(spark, str(tmp_path / "store")), points=3, seconds=5, clock=lambda: now[0], number=lambda: next(number))
    stored = lambda: buffer.store.samples().count()
    buffer.add([("m", {}, k, 1.0) for k in range(2)])
    assert (len(buffer), stored(), buffer.waiting().count()) == (2, 0, 2)
    buffer.add([("m", {}, k, 1.0) for k in range(2, 7)])
    assert (len(buffer), stored()) == (1, 6)
    now[0] = 6.0
    buffer.add([("m", {}, 8, 1.0)])
    assert (len(buffer), stored()) == (0, 8)
    buffer.flush()
    assert stored() == 8


@pytest.fixture
def target():
    """A page that counts how often it is fetched."""
    import http.server
    import threading

    class Page(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b'up{a="1"} 5\n# nothing\nn 3 60\n')

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Page)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"127.0.0.1:{server.server_port}"
    server.shutdown()


def test_sending(spark):
    """Samples posted to a service in batches."""
    import http.server
    import threading

    sizes, service = [], Service(None)
    service.buffer = type("Held", (list,), {"add": lambda self, rows: self.extend(rows) or len(rows)})()

    class Write(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            sizes.append(len(json.loads(body)))
            status, text = service.handle("POST", self.path, {}, body)
            self.send_response(status)
            self.end_headers()
            self.wfile.write(text.encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Write)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        given = samples(spark, [("m", {"k": str(k % 3)}, k, float(k)) for k in range(1, 26)]).coalesce(1)
        assert send(given, f"http://127.0.0.1:{server.server_port}/api/v1/write/batch", 10) == 25
    finally:
        server.shutdown()
    assert sizes == [10, 10, 5]
    assert sorted(service.buffer, key=lambda r: r[2]) == [("m", {"k": str(k % 3)}, k, float(k)) for k in range(1, 26)]


def test_scraping(spark, target, tmp_path):
    config = json.dumps({"scrape_configs": [{"job_name": "j", "scrape_interval": "1s", "scrape_timeout": "1s", "metric_prefix": "p", "static_configs": [{"targets": [target, "127.0.0.1:1"], "labels": {"env": "e"}}]}]})
    pages = scrape(spark, config)
    assert pages.rdd.getNumPartitions() == 2
    got = {(r["name"], r["value"], tuple(sorted(r["labels"].items()))) for r in landed_samples(pages).collect()}
    fixed = (("env", "e"), ("instance", target), ("job", "j"))
    assert got == {("p.up", 5.0, (("a", "1"), *fixed)), ("p.n", 3.0, fixed)}
    store = Store(spark, str(tmp_path / "store"))
    query = into_store(stream_scraped(spark, config), store, str(tmp_path / "check"), "1 second")
    try:
        for _ in range(60):
            query.awaitTermination(1)
            if store.samples().where("name = 'p.up'").count() >= 2:
                break
    finally:
        query.stop()
    assert store.samples().where("name = 'p.up'").count() >= 2
    assert store.samples().where("name = 'p.n'").count() == 1


def test_service_requests(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    service = Service(Engine(spark, store.source()), WriteBuffer(store, points=1))
    assert service.write('{"metric": "m", "value": 2, "timestamp": 1700000000000, "tags": {"a": 1}}') == (200, '{"status": "success", "written": 1}')
    assert json.loads(service.handle("POST", "/api/v1/write/batch", {}, '[{"metric": "m", "value": 3, "time": 1700000060}, {"value": 1}]')[1])["written"] == 1
    for body in ("", "[]", '{"value": 1}', '{"metric": "m", "value": "x"}'):
        assert service.write(body)[0] == 400
    service = Service(Engine(spark, store.source()))
    assert service.handle("POST", "/api/v1/write", {}, "{}")[0] == 405
    assert json.loads(service.handle("GET", "/api/v1/labels", {})[1])["data"] == ["__name__", "a"]
    assert json.loads(service.handle("GET", "/api/v1/label/a/values", {})[1])["data"] == ["1"]
    series = json.loads(service.handle("GET", "/api/v1/series", {"match[]": ["m"]})[1])["data"]
    assert sorted(map(str, series)) == ["{'__name__': 'm', 'a': '1'}", "{'__name__': 'm'}"]
    status, body = service.handle("GET", "/api/v1/query_range", {"query": "m", "start": "1700000000", "end": "1700000060", "profile": "true"})
    assert status == 200 and json.loads(body)["profile"]["rows"] == 4  # two series and two samples
    assert service.stats["rows_read"] >= 2 and service.stats["range_seconds_max"] > 0


def test_answers_are_bounded(spark, monkeypatch):
    service = Service(Engine(spark, MapSource(samples(spark, [("m", {"k": str(k)}, 1, 1.0) for k in range(5)]))))
    monkeypatch.setattr("tsengine.api.MOST_SERIES", 4)
    assert service.query("m", 5)[0] == 400
    assert service.query("sum(m)", 5)[0] == 200


def test_queries_time_out(spark):
    """A query whose function never ends is cancelled, and the service answers on."""
    engine = Engine(spark, MapSource(samples(spark, [("m", {"k": "a"}, 1, 1.0)])))

    def slow(pdf):
        import time

        time.sleep(60)
        return pdf

    engine.register("slow", per_series(slow, "name string, k string, ts long, value double"))
    service = Service(engine, timeout=2)
    assert service.pipeline([{"query": "m", "start": 1, "end": 5}, {"function": "slow"}])[0] == 500
    assert service.query("m", 5)[0] == 200


def test_scans_do_not_aggregate(spark, tmp_path):
    """First writes are found after the exchange: a scan's task may read any number of samples and sorts none."""
    store = Store(spark, str(tmp_path / "store"), 1000)
    rows = [("m", {"k": str(t % 3)}, t, float(t)) for t in range(90)]
    store.write(samples(spark, rows), 1)
    store.write(samples(spark, rows[::4]).withColumn("value", F.lit(-1.0)), 2)
    df = store._first_writes("m", None, None)
    assert "Aggregate" not in df._jdf.queryExecution().executedPlan().toString().split("Exchange")[-1]
    assert sorted((r["ts"], r["value"]) for r in df.collect()) == [(t, float(t)) for t in range(90)]


def test_functions_of_series(spark):
    """Series by series or many whole ones, also series longer than a batch, without a group of Spark's for each."""
    points = [(s, t, float(t % 7)) for s, n in (("a", 1), (None, 25), ("b", 3), ("c", 10), ("d", 2)) for t in range(1, n + 1)]
    rows = samples(spark, [("m", {"k": s} if s else {}, t, v) for s, t, v in points])
    engine = Engine(spark, MapSource(rows.repartition(3)))
    schema, stage = "k string, ts long, value double", {"query": "m", "start": 1, "end": 50}

    def one(pdf):
        assert pdf["ts"].tolist() == list(range(1, len(pdf) + 1)) and pdf["k"].nunique(dropna=False) == 1
        return pdf.tail(1).assign(value=float(len(pdf)))[["k", "ts", "value"]] if len(pdf) != 3 else pdf.head(0)

    def several(pdf):
        found = pdf.groupby("k", sort=False, dropna=False).agg(ts=("ts", "max"), value=("ts", "count")).reset_index()
        return found[found["value"] != 3].astype({"value": "float64"})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        for name, function, many in (("one", one, False), ("several", several, True)):
            engine.register(name, per_series(function, schema, many))
            df = engine.pipeline([stage, {"function": name}])
            assert {tuple(r) for r in df.collect()} == {("a", 1, 1.0), (None, 25, 25.0), ("c", 10, 10.0), ("d", 2, 2.0)}
            assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_arrival_order(spark):
    rows = [("m", {}, "m{}", t, float(k), k) for k, t in enumerate([1000, 1000, 500, 1001, 3500, 3601, 3000])]
    df = spark.createDataFrame(rows, "name string, labels map<string,string>, labels_key string, ts long, value double, seq long")
    assert sorted(r["seq"] for r in in_order(df).collect()) == [0, 3, 4, 5]


def test_merge(spark):
    cold = samples(spark, [("m", {}, 1, 1.0), ("m", {}, 2, 2.0)]).withColumn("k", labels_key(F.col("name"), F.col("labels")))
    hot = samples(spark, [("m", {}, 2, 9.0), ("m", {}, 3, 3.0)]).withColumn("k", labels_key(F.col("name"), F.col("labels")))
    assert sorted((r["ts"], r["value"]) for r in merge_hot_cold(cold, hot).collect()) == [(1, 1.0), (2, 9.0), (3, 3.0)]


def test_map_source(spark):
    df = samples(spark, [("m", {"a": "1"}, 10, 1.0), ("m", {"b": "x"}, 10, 2.0), ("n", {"c": "1"}, 10, 3.0)])
    e = Engine(spark, MapSource(df))
    assert e.source.labels_of("m") == ["a", "b"]
    assert sorted(str((r["a"], r["b"], r["value"])) for r in e.instant("m", 20).collect()) == ["('1', None, 1.0)", "(None, 'x', 2.0)"]


def test_downsample(spark):
    df = spark.createDataFrame([("s", 0, 1.0), ("s", 59, 3.0), ("s", 60, 5.0), ("t", 10, 7.0)], "k string, ts long, value double")
    minute = downsample(df, 60, ["k"])
    assert sorted(map(tuple, minute.select("k", "ts", "avg", "min", "max", "count").collect())) == [("s", 0, 2.0, 1.0, 3.0, 2.0), ("s", 60, 5.0, 5.0, 5.0, 1.0), ("t", 0, 7.0, 7.0, 7.0, 1.0)]
    assert sorted(map(tuple, coarser(minute, 3600, ["k"]).collect())) == [("s", 0, 3.0, 1.0, 5.0, 3.0), ("t", 0, 7.0, 7.0, 7.0, 1.0)]
    long = as_metrics(minute.withColumn("name", F.lit("m")))
    assert sorted((r["name"], r["value"]) for r in long.where("k = 't'").collect()) == [("m_avg", 7.0), ("m_count", 1.0), ("m_max", 7.0), ("m_min", 7.0)]
    assert level_for(0, 86_400).name == "raw"
    assert level_for(0, 10 * 86_400).name == "1m"
    assert level_for(0, 60 * 86_400, 3600).name == "1h"
    with pytest.raises(ValueError):
        Level("", 1)


def test_streams_equal_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [{"metric": "m", "value": float(k), "timestamp": 1000 + 37 * k, "labels": {"s": str(k % 3)}} for k in range(60)]
    for part in range(3):
        (folder / f"{part}.json").write_text("\n".join(json.dumps(r) for r in rows[part * 20 : part * 20 + 20] + rows[part * 20 : part * 20 + 5]))
    store = Store(spark, str(tmp_path / "store"))
    query = into_store(stream_json(spark, str(folder)), store, str(tmp_path / "check"), once=True)
    query.awaitTermination(120)
    assert store.samples().count() == 60
    stream = first_writes(stream_json(spark, str(folder))).withColumn("s", F.element_at("labels", "s"))
    out = downsampled(stream.drop("event_time"), ["name", "s"], 600, "1 hour")
    q = out.writeStream.format("memory").queryName("down").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["s"], r["ts"]): (r["avg"], r["count"]) for r in spark.table("down").collect()}
    batch = downsample(store.samples().withColumn("s", F.element_at("labels", "s")), 600, ["name", "s"])
    expected = {(r["s"], r["ts"]): (r["avg"], r["count"]) for r in batch.collect()}
    assert all(expected[k] == v for k, v in got.items())


def test_landed_pages(spark):
    landed = spark.createDataFrame([("j", "http://h:1/metrics", "h:1", 50, {"env": "p"}, 'm{a="1"} 2\nn 3 60')], "job string, url string, instance string, fetched long, labels map<string,string>, body string")
    got = sorted((r["name"], r["ts"], r["value"], r["labels"]["env"], r["labels"]["job"], r["labels"]["instance"]) for r in landed_samples(landed, "p").collect())
    assert got == [("p.m", 50, 2.0, "p", "j", "h:1"), ("p.n", 60, 3.0, "p", "j", "h:1")]


def test_service(spark):
    df = samples(spark, [("cpu", {"env": "prod", "host": "1"}, 10, 60.0), ("cpu", {"env": "prod", "host": "2"}, 10, 70.0), ("cpu", {"env": "dev", "host": "3"}, 10, 47.5)])
    service = Service(Engine(spark, MapSource(df)))
    status, body = service.query("avg(cpu) by (env)", 20)
    result = {x["metric"]["env"]: x["value"] for x in json.loads(body)["data"]["result"]}
    assert (status, result) == (200, {"prod": [10, "65.000000"], "dev": [10, "47.500000"]})
    assert json.loads(answer(service.engine.range("cpu", 0, 20), True))["data"]["result"][0]["metric"]["__name__"] == "cpu"
    assert service.query("sum(", 1)[0] == 400
    assert "plan" in json.loads(service.query_range("cpu", 0, 20, profile=True)[1])["profile"]
    assert "tsengine_instant_queries 2" in service.metrics()


def test_command_line(spark, tmp_path):
    from tsengine.__main__ import run, split_pipeline

    path = str(tmp_path / "store")
    assert split_pipeline('sum(x{a="b|c"}) | double_values | pass') == ['sum(x{a="b|c"})', "double_values", "pass"]
    for k, value in enumerate(("1", "2.5")):
        assert run(spark, [path, "put", "m", value, "host=a", "--time", str(1000 + 10 * k)]) == "written 1"
    body = json.loads(run(spark, [path, "query", "m", "--time", "now"], now=2000))
    assert body["data"]["result"] == [{"metric": {"__name__": "m", "host": "a"}, "value": [1010, "2.500000"]}]
    body = json.loads(run(spark, [path, "range", "m | double_values", "--start", "now-1h", "--end", "1020", "--step", "1s"], now=4000))
    assert body["data"]["result"][0]["values"] == [[1000, "2.000000"], [1010, "5.000000"]]
    assert run(spark, [path, "metrics", "m"]) == "m"
    assert json.loads(run(spark, [path, "series", "m"])) == {"name": "m", "labels": {"host": "a"}}
