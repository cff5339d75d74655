"""Scraped targets: configuration, and a data source whose partitions are targets, fetched by executors.

`spark.read.format("tsengine_scrape")` fetches every target once; `spark.readStream` fetches each job's at its interval, all
targets of a tick at the same time, a task for each. Either gives pages (`LANDED`); `landed_samples` parses and labels
them. Pages that other programs land in a folder as JSON have the same columns.
"""

from __future__ import annotations

import json
import math
import time
import urllib.request
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..plans.durations import parse_config_duration
from ..shipping import ship
from .exposition import parse_lines

LANDED = "job string, url string, instance string, fetched long, labels map<string,string>, prefix string, body string"


class ConfigError(ValueError):
    """A scrape configuration that can't be used."""


@dataclass
class Target:
    url: str
    labels: dict[str, str] = field(default_factory=dict)


@dataclass
class Job:
    name: str
    targets: list[Target]
    interval: int = 15
    timeout: int = 10
    path: str = "/metrics"
    scheme: str = "http"
    prefix: str = ""
    labels: dict[str, str] = field(default_factory=dict)


def load_config(text: str) -> list[Job]:
    """Jobs of a configuration in JSON, or in YAML where a reader for it is installed.

    Intervals and timeouts default to 15 and 10 seconds and to the global section's; a job needs a name and a target,
    and can't time out later than it repeats.
    """
    try:
        config = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError:
            raise ConfigError("only JSON can be read here") from None
        config = yaml.safe_load(text)
    common = config.get("global") or {}
    jobs = []
    for raw in config.get("scrape_configs") or []:
        if not raw.get("job_name"):
            raise ConfigError("a job needs a name")
        groups = raw.get("static_configs") or []
        targets = [Target(t, dict(g.get("labels") or {})) for g in groups for t in g.get("targets") or []]
        if not targets:
            raise ConfigError(f"job {raw['job_name']} has no targets")
        every = lambda key, default: parse_config_duration(str(raw.get(key) or common.get(key) or default))
        job = Job(raw["job_name"], targets, every("scrape_interval", "15s"), every("scrape_timeout", "10s"), raw.get("metrics_path") or "/metrics", raw.get("scheme") or "http", raw.get("metric_prefix") or "", dict(raw.get("labels") or {}))
        if job.timeout > job.interval:
            raise ConfigError(f"job {job.name} times out later than it repeats")
        jobs.append(job)
    if not jobs:
        raise ConfigError("no jobs")
    return jobs


def page(job: Job, target: Target, now: int) -> tuple | None:
    """A target's page as a row of LANDED; None if it does not answer in time."""
    url = f"{job.scheme}://{target.url}{job.path}"
    try:
        with urllib.request.urlopen(url, timeout=job.timeout) as answer:  # noqa: S310
            body = answer.read().decode(errors="replace")
    except OSError:
        return None
    return (job.name, url, target.url, now, {**job.labels, **target.labels}, job.prefix, body)


class _Tick(InputPartition):
    def __init__(self, job: Job, target: Target, now: int):
        self.job, self.target, self.now = job, target, now


class _Fetcher:
    """Reads partitions that are targets."""

    def __init__(self, jobs: list[Job]):
        self.jobs = jobs

    def read(self, partition: _Tick):
        row = page(partition.job, partition.target, partition.now)
        if row is not None:
            yield row


class _Once(_Fetcher, DataSourceReader):
    def partitions(self):
        now = int(time.time())
        return [_Tick(j, t, now) for j in self.jobs for t in j.targets] or [_Tick(Job("", []), Target(""), now)]


class _Stream(_Fetcher, DataSourceStreamReader):
    """Offsets are ticks of the jobs' common interval; a job is due when a multiple of its own has passed."""

    @property
    def tick(self) -> int:
        return max(1, math.gcd(*(j.interval for j in self.jobs)))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"tick": int(time.time()) // self.tick - 1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"tick": int(time.time()) // self.tick}

    def partitions(self, start: dict, end: dict):
        due = lambda j: end["tick"] * self.tick // max(1, j.interval) > start["tick"] * self.tick // max(1, j.interval)
        return [_Tick(j, t, end["tick"] * self.tick) for j in self.jobs if due(j) for t in j.targets]

    def commit(self, end: dict) -> None:
        pass


class ScrapeSource(DataSource):
    """Option config: the text of a scrape configuration."""

    @classmethod
    def name(cls) -> str:
        return "tsengine_scrape"

    def schema(self) -> str:
        return LANDED

    def reader(self, schema):
        return _Once(load_config(self.options["config"]))

    def streamReader(self, schema):  # noqa: N802
        return _Stream(load_config(self.options["config"]))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and its code to the workers."""
    ship(spark)
    spark.dataSource.register(ScrapeSource)


def scrape(spark: SparkSession, config: str) -> DataFrame:
    """Pages of all targets of a configuration, fetched once for each action."""
    register(spark)
    return spark.read.format("tsengine_scrape").option("config", config).load()


def scrape_stream(spark: SparkSession, config: str) -> DataFrame:
    """Pages of all targets, each job's at its interval."""
    register(spark)
    return spark.readStream.format("tsengine_scrape").option("config", config).load()


def landed_samples(landed: DataFrame, prefix: str = "") -> DataFrame:
    """Samples of landed pages (batch or stream): the metric's labels win over the target's, then job and instance.

    Names get a page's prefix, or the one given.
    """
    own = F.coalesce(F.nullif("prefix", F.lit("")), F.lit(prefix)) if "prefix" in landed.columns else F.lit(prefix)
    lines = landed.select("job", "instance", "fetched", F.col("labels").alias("fixed"), own.alias("lead"), F.explode(F.split("body", "\n")).alias("value"))
    rows = parse_lines(lines, "value", F.col("fetched"))
    name = F.concat_ws(".", F.nullif("lead", F.lit("")), "name")
    return rows.select(name.alias("name"), _merged(F.col("labels"), F.col("fixed"), F.col("job"), F.col("instance")).alias("labels"), "ts", "value")


def _merged(own: Column, fixed: Column, job: Column, instance: Column) -> Column:
    mine = F.map_filter(own, lambda k, _: ~k.isin("job", "instance"))
    rest = F.map_filter(F.coalesce(fixed, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(mine, k) & ~k.isin("job", "instance"))
    return F.map_concat(rest, mine, F.create_map(F.lit("job"), job, F.lit("instance"), instance))
