"""The shapes of the HTTP interface: JSON results, errors, self-metrics and a query's profile."""

from __future__ import annotations

import contextlib
import json
import re
import threading
import time
import uuid
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.aggregates import decimal
from .plans.compiler import QueryError
from .plans.durations import DurationError, parse_config_duration, parse_time
from .plans.syntax import QuerySyntaxError
from .sources.json_writes import point


def result_rows(df: DataFrame, matrix: bool) -> DataFrame:
    """One row per series: metric (its labels) and value [ts, "v"] or values [[ts, "v"], ...] in order of time."""
    labels = [c for c in df.columns if c not in ("ts", "value")]
    pairs = [F.struct(F.lit("__name__" if c == "name" else c).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in labels]
    entries = F.filter(F.array(*pairs), lambda e: e["value"].isNotNull()) if pairs else F.expr("cast(array() as array<struct<key:string,value:string>>)")
    point = F.struct(F.col("ts"), decimal(F.col("value")).alias("v"))
    rows = df.select(F.map_from_entries(entries).alias("metric"), *[f"`{c}`" for c in labels], point.alias("p"))
    grouped = rows.groupBy(*[f"`{c}`" for c in labels]).agg(F.first("metric").alias("metric"), F.sort_array(F.collect_list("p")).alias("points"))
    return grouped.select("metric", F.col("points").alias("values") if matrix else F.element_at("points", -1).alias("value"))


def _nodes(plan):
    """Every physical node of an executed plan, through adaptive stages."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        yield from _nodes(plan.executedPlan())
        return
    if name.endswith("QueryStage"):
        yield from _nodes(plan.plan())
        return
    yield plan
    children = plan.children()
    for k in range(children.size()):
        yield from _nodes(children.apply(k))


def scan_counters(df: DataFrame) -> dict[str, int]:
    """rows, files and bytes that the scans of a frame read, after an action on that very frame."""
    out = Counter()
    for node in _nodes(df._jdf.queryExecution().executedPlan()):
        for key, metric in (("rows", "numOutputRows"), ("files", "numFiles"), ("bytes", "filesSize")):
            found = node.metrics().get(metric) if "Scan" in node.nodeName() else None
            if found is not None and found.isDefined():
                out[key] += found.get().value()
    return {k: out[k] for k in ("rows", "files", "bytes")}


#: Series and points that an answer may have; larger results are written by Spark, not sent to a client.
MOST_SERIES, MOST_POINTS = 10_000, 1_000_000


def answer(df: DataFrame, matrix: bool) -> str:
    """A result as the interface's JSON text; a result of more series or points than a client can take is an error."""
    return _answer(df, matrix)[0]


def _answer(df: DataFrame, matrix: bool) -> tuple[str, dict[str, int]]:
    found = df.limit(MOST_POINTS + 1)
    rows = result_rows(found, matrix).select(F.to_json(F.struct("*")).alias("j"), F.size("values").alias("n") if matrix else F.lit(1).alias("n")).limit(MOST_SERIES + 1)
    lines = rows.collect()
    if len(lines) > MOST_SERIES or sum(r["n"] for r in lines) > MOST_POINTS:
        raise QueryError("the result is too large for one answer; narrow the query or write the result as a table")
    out = []
    for row in lines:
        x = json.loads(row["j"])
        pair = lambda p: [p["ts"], p["v"]]
        out.append({"metric": x.get("metric", {}), **({"values": [pair(p) for p in x["values"]]} if matrix else {"value": pair(x["value"])})})
    return json.dumps({"status": "success", "data": {"resultType": "matrix" if matrix else "vector", "result": out}}), scan_counters(rows)


def _failed(kind: str, text: str) -> str:
    return json.dumps({"status": "error", "errorType": kind, "error": text})


class Service:
    """Answers requests with JSON texts and statuses, and counts them. With a buffer it takes writes too.

    A query's jobs are cancelled after timeout seconds, Python functions of pipelines among them.
    """

    def __init__(self, engine, buffer=None, timeout: float = 300):
        self.engine, self.buffer, self.timeout, self.stats = engine, buffer, timeout, Counter()

    def query(self, query: str, at: float | None = None, profile: bool = False) -> tuple[int, str]:
        return self._run("instant", lambda: self.engine.instant(query, at), False, profile)

    def query_range(self, query: str, start: int = 0, end: int | None = None, step: int = 0, profile: bool = False) -> tuple[int, str]:
        return self._run("range", lambda: self.engine.range(query, start, end, step), True, profile)

    def pipeline(self, stages: list[dict], profile: bool = False) -> tuple[int, str]:
        return self._run("pipeline", lambda: self.engine.pipeline(stages), True, profile)

    # --- metadata: lists of texts, or of label sets

    def labels(self, matchers: Iterable[str] = (), start: int | None = None, end: int | None = None, **page) -> tuple[int, str]:
        return self._list("labels", lambda: self.engine.label_names(matchers, start, end, **page), lambda r: r["label"])

    def label_values(self, label: str, matchers: Iterable[str] = (), start: int | None = None, end: int | None = None, **page) -> tuple[int, str]:
        return self._list("label_values", lambda: self.engine.label_values(label, matchers, start, end, **page), lambda r: r["value"])

    def series(self, matchers: list[str], start: int | None = None, end: int | None = None) -> tuple[int, str]:
        return self._list("series", lambda: self.engine.series(matchers, start, end).orderBy("name", F.to_json("labels")), lambda r: {"__name__": r["name"], **dict(sorted(r["labels"].items()))})

    # --- writes

    def write(self, body: str, now: float | None = None) -> tuple[int, str]:
        """One request, {"metric", "value", "timestamp" or "time", "labels" or "tags"}."""
        return self._written("write", body, False, now)

    def write_batch(self, body: str, now: float | None = None) -> tuple[int, str]:
        """An array of requests; those without a metric or a value are left out of the count."""
        return self._written("write_batch", body, True, now)

    def handle(self, method: str, path: str, parameters: dict, body: str = "") -> tuple[int, str]:
        """A request by its method and path; parameters are texts, match[] a list of them."""
        get = parameters.get
        number = lambda key: None if get(key) in (None, "") else parse_time(get(key))
        matchers = parameters.get("match[]") or []
        page = {"pattern": get("filter") or "", "limit": int(get("limit") or 0), "offset": int(get("offset") or 0)}
        routes = {
            "query": (("GET", "POST"), lambda: self.query(get("query") or "", number("time"), get("profile") == "true")),
            "query_range": (("GET", "POST"), lambda: self.query_range(get("query") or "", number("start") or 0, number("end"), parse_config_duration(get("step") or "0"), get("profile") == "true")),
            "labels": (("GET", "POST"), lambda: self.labels(matchers, number("start"), number("end"), **page)),
            "series": (("GET", "POST"), lambda: self.series(matchers, number("start"), number("end"))),
            "write": (("POST",), lambda: self.write(body)),
            "write/batch": (("POST",), lambda: self.write_batch(body)),
        }
        name = path.removeprefix("/api/v1/")
        value = re.fullmatch(r"labels?/([^/]+)/values", name)
        methods, call = (("GET",), lambda: self.label_values(value[1], matchers, number("start"), number("end"), **page)) if value else routes.get(name, ((), None))
        if call is None:
            return 404, _failed("not_found", path)
        if method not in methods:
            return 405, _failed("bad_method", f"{method} is not allowed here")
        try:
            return call()
        except (DurationError, ValueError) as e:
            return 400, _failed("bad_data", str(e))

    def _written(self, kind: str, body: str, many: bool, now: float | None) -> tuple[int, str]:
        self.stats[f"{kind}_requests"] += 1
        if self.buffer is None:
            return 405, _failed("bad_method", "nothing is written here")
        try:
            given = json.loads(body)
            rows = [r for r in map(lambda x: point(x, now), given if many else [given]) if r is not None]
        except (ValueError, TypeError, AttributeError) as e:
            self.stats["write_errors"] += 1
            return 400, _failed("bad_data", f"not a write request: {e}")
        if not many and not rows:
            self.stats["write_errors"] += 1
            return 400, _failed("bad_data", "a write needs a metric and a value")
        self.stats["points_written"] += self.buffer.add(rows)
        return 200, json.dumps({"status": "success", "written": len(rows)})

    def _list(self, kind: str, make, show) -> tuple[int, str]:
        self.stats[f"{kind}_requests"] += 1
        try:
            rows = make().limit(MOST_POINTS + 1).collect()
            if len(rows) > MOST_POINTS:
                raise QueryError("too many for one answer; give a limit")
        except (QuerySyntaxError, QueryError, DurationError) as e:
            return 400, _failed("bad_data", str(e))
        return 200, json.dumps({"status": "success", "data": [show(r) for r in rows]})

    def _run(self, kind: str, make, matrix: bool, profile: bool) -> tuple[int, str]:
        began = time.time()
        self.stats[f"{kind}_queries"] += 1
        try:
            with self._limited():
                df = make()
                text, counters = _answer(df, matrix)
        except (QuerySyntaxError, QueryError, DurationError) as e:
            self.stats[f"{kind}_errors"] += 1
            return 400, _failed("bad_data", str(e))
        except Exception as e:  # what fails while it runs is the server's fault
            self.stats[f"{kind}_errors"] += 1
            return 500, _failed("execution", str(e).splitlines()[0] if str(e) else type(e).__name__)
        took = time.time() - began
        self.stats[f"{kind}_seconds"] += took
        self.stats[f"{kind}_seconds_max"] = max(self.stats[f"{kind}_seconds_max"], took)
        for key, n in counters.items():
            self.stats[f"{key}_read"] += n
        if profile:
            body = json.loads(text)
            body["profile"] = {"seconds": took, "series": len(body["data"]["result"]), **counters, "plan": df._jdf.queryExecution().toString()}
            text = json.dumps(body)
        return 200, text

    @contextlib.contextmanager
    def _limited(self):
        context, group = self.engine.spark.sparkContext, f"tsengine-{uuid.uuid4().hex}"
        context.setJobGroup(group, "a query of the service", interruptOnCancel=True)
        timer = threading.Timer(self.timeout, context.cancelJobGroup, [group])
        timer.start()
        try:
            yield
        finally:
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)

    def metrics(self) -> str:
        """The counters as exposition text."""
        return "".join(f"# TYPE tsengine_{k} counter\ntsengine_{k} {v:g}\n" for k, v in sorted(self.stats.items()))
