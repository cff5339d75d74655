"""JSON write requests: {"metric", "value", "time" or "timestamp", "tags" or "labels"}, single or in batches."""

from __future__ import annotations

import json
import time as clock
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .exposition import seconds

REQUEST = "metric string, value double, time long, timestamp long, tags map<string,string>, labels map<string,string>"


def samples(requests: DataFrame, now: Column | None = None) -> DataFrame:
    """name, labels, ts and value; requests without a metric are left out, labels win over tags, timestamp over time."""
    now = F.unix_timestamp() if now is None else now
    none = F.create_map().cast("map<string,string>")
    tags, labels = F.coalesce("tags", none), F.coalesce("labels", none)
    both = F.map_concat(F.map_filter(tags, lambda k, _: ~F.map_contains_key(labels, k)), labels)
    ts = F.coalesce(F.nullif("timestamp", F.lit(0)), F.nullif("time", F.lit(0)), now)
    rows = requests.where((F.coalesce("metric", F.lit("")) != "") & F.col("value").isNotNull())
    return rows.select(F.col("metric").alias("name"), both.alias("labels"), seconds(ts).alias("ts"), "value")


def parse_requests(lines: DataFrame, column: str = "value", now: Column | None = None) -> DataFrame:
    """Samples of request bodies, one a row: an object or an array of objects; what is neither is left out."""
    body = F.ltrim(F.col(column))
    many = F.when(body.startswith("["), F.from_json(body, f"array<struct<{_struct()}>>")).otherwise(F.array(F.from_json(body, f"struct<{_struct()}>")))
    return samples(lines.select(F.explode(many).alias("r")).select("r.*"), now)


def _struct() -> str:
    return ", ".join(":".join(x.split(" ", 1)) for x in REQUEST.split(", "))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Samples of files of requests, one a line, read with a fixed schema."""
    return samples(spark.read.schema(REQUEST).json(path))


def point(request: dict, now: float | None = None) -> tuple | None:
    """One request as (name, labels, ts, value), by the rules of `samples`; None without a metric or a value."""
    if not request.get("metric") or request.get("value") is None:
        return None
    ts = int(request.get("timestamp") or request.get("time") or (clock.time() if now is None else now))
    labels = {**(request.get("tags") or {}), **(request.get("labels") or {})}
    return request["metric"], {k: str(v) for k, v in labels.items()}, ts // 1000 if ts > 9_999_999_999 else ts, float(request["value"])


def _sender(url: str, size: int):
    def run(batches):
        rows: list[dict] = []
        written = 0

        def post() -> int:
            request = Request(url, json.dumps(rows).encode(), {"Content-Type": "application/json"})
            with urlopen(request, timeout=60) as answer:  # noqa: S310
                return json.loads(answer.read())["written"]

        for batch in batches:
            for name, labels, ts, value in zip(*(batch.column(c).to_pylist() for c in ("name", "labels", "ts", "value")), strict=True):
                rows.append({"metric": name, "labels": dict(labels or {}), "timestamp": ts, "value": value})
                if len(rows) >= size:
                    written += post()
                    rows = []
        if rows:
            written += post()
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["written"])

    return run


def send(samples: DataFrame, url: str, size: int = 1000) -> int:
    """Post samples as batch writes of size requests at most, from the tasks that hold them; the number taken.

    A task that is run again posts its samples again; a store keeps the first of them.
    """
    ship(samples.sparkSession)
    sent = samples.select("name", "labels", "ts", "value").mapInArrow(_sender(url, size), "written long")
    return sent.agg(F.sum("written")).first()[0] or 0
