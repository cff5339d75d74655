"""A command line over a store: python -m tsengine STORE COMMAND ...

  query QUERY [--time T]
  range QUERY [--start T] [--end T] [--step D]      QUERY | FUNCTION | ... applies pipeline functions to a range
  put NAME VALUE [--time T] [LABEL=VALUE ...]
  metrics [PATTERN]                                 names of metrics, those that contain a pattern
  series SELECTOR ...

Times are Unix seconds, RFC 3339, now, now-1h; durations are such as 15s or 1h30m.
"""

from __future__ import annotations

import argparse
import re
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .api import answer
from .plans.durations import automatic_step, parse_duration, parse_time
from .plans.engine import Engine
from .sources.store import Store


def split_pipeline(text: str) -> list[str]:
    """The parts of a text around | outside quotes."""
    parts = re.findall(r"""(?:[^|"'`]|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`[^`]*`)+""", text)
    return [p.strip() for p in parts]


def arguments(args: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tsengine", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("store")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("query", "range"):
        command = commands.add_parser(name)
        command.add_argument("query")
        command.add_argument("--time", default="now")
        command.add_argument("--start", default="now-1h")
        command.add_argument("--end", default="now")
        command.add_argument("--step")
    put = commands.add_parser("put")
    put.add_argument("name")
    put.add_argument("value", type=float)
    put.add_argument("labels", nargs="*")
    put.add_argument("--time", default="now")
    commands.add_parser("metrics").add_argument("pattern", nargs="?", default="")
    commands.add_parser("series").add_argument("selectors", nargs="+")
    return parser.parse_args(args)


def run(spark: SparkSession, args: list[str], now: float | None = None) -> str:
    """The output of a command."""
    given = arguments(args)
    store = Store(spark, given.store)
    engine = Engine(spark, store.source())
    if given.command == "query":
        return answer(engine.instant(given.query, parse_time(given.time, now)), False)
    if given.command == "range":
        query, *functions = split_pipeline(given.query)
        start, end = parse_time(given.start, now), parse_time(given.end, now)
        step = parse_duration(given.step) if given.step else automatic_step(end - start, "rate(" in query)
        return answer(engine.pipeline([{"query": query, "start": start, "end": end, "step": step}, *({"function": f} for f in functions)]), True)
    if given.command == "put":
        labels = dict(x.split("=", 1) for x in given.labels)
        row = spark.createDataFrame([(given.name, labels, parse_time(given.time, now), given.value)], "name string, labels map<string,string>, ts long, value double")
        store.write(row, time.time_ns())
        return "written 1"
    if given.command == "metrics":
        return "\n".join(r["name"] for r in store.metric_names().where(F.col("name").contains(given.pattern)).orderBy("name").collect())
    return "\n".join(r[0] for r in engine.series(given.selectors).select(F.to_json(F.struct("name", "labels"))).collect())


if __name__ == "__main__":
    print(run(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), sys.argv[1:]))
