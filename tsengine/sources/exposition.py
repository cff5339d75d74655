"""The text exposition format: lines such as name{label="value"} 1.5 1700000000."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LINE = r"^\s*([A-Za-z_:][\w:.]*)\s*(?:\{(.*)\})?\s+(\S+)(?:\s+(-?\d+))?\s*$"
_PAIR = r'([A-Za-z_][\w.]*)\s*=\s*"((?:[^"\\]|\\.)*)"'
_NUMBER = r"^[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|[Ii]nf|NaN|nan)$"


def seconds(ts: Column) -> Column:
    """Milliseconds (more than ten digits) become seconds."""
    return F.when(ts > 9_999_999_999, F.floor(ts / 1000)).otherwise(ts).cast("long")


def number(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.isin("inf", "+inf"), F.lit(float("inf"))).when(low == "-inf", F.lit(float("-inf"))).when(low.isin("nan", "+nan", "-nan"), F.lit(float("nan"))).otherwise(text.try_cast("double"))


def _unescape(text: Column) -> Column:
    # a marker keeps an escaped backslash from joining what follows it
    text = F.replace(text, F.lit("\\\\"), F.lit("\u0001"))
    text = F.replace(F.replace(text, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
    return F.replace(text, F.lit("\u0001"), F.lit("\\"))


def parse_lines(lines: DataFrame, column: str = "value", now: Column | None = None) -> DataFrame:
    """name, labels, ts and value of each sample line; comments, blank and malformed lines are left out.

    Lines without a time get now (by default the query's time). Other columns of lines are kept.
    """
    text = F.col(column)
    part = lambda k: F.regexp_extract(text, _LINE, k)
    others = [F.col(c) for c in lines.columns if c != column]
    rows = lines.where(~F.ltrim(text).startswith("#") & text.rlike(_LINE)).select(*others, part(1).alias("name"), part(2).alias("inner"), part(3).alias("number"), part(4).alias("time"))
    rows = rows.where(F.col("number").rlike(_NUMBER))
    keys, values = F.regexp_extract_all("inner", F.lit(_PAIR), 1), F.transform(F.regexp_extract_all("inner", F.lit(_PAIR), 2), _unescape)
    # of a label given twice the last counts
    pairs = F.arrays_zip(keys.alias("key"), values.alias("value"))
    labels = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["key"]), F.create_map(p["key"], p["value"])))
    now = F.unix_timestamp() if now is None else now
    ts = F.when(F.col("time") == "", now).otherwise(seconds(F.col("time").try_cast("long")))
    return rows.select(*others, "name", labels.alias("labels"), ts.cast("long").alias("ts"), number(F.col("number")).alias("value"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Samples of text files, one line each."""
    return parse_lines(spark.read.text(path))


def flat_name(name: Column, job: Column | None = None, instance: Column | None = None, prefix: str = "") -> Column:
    """prefix.name.job.host, with dashes and colons of the name and dots of the host as underscores."""
    parts = [F.lit(prefix)] if prefix else []
    parts.append(F.translate(name, "-:", "__"))
    if job is not None:
        parts.append(F.nullif(job, F.lit("")))
    if instance is not None:
        parts.append(F.nullif(F.translate(F.element_at(F.split(instance, ":"), 1), ".", "_"), F.lit("")))
    return F.concat_ws(".", *parts)


def target_labels(metric: Column, job: str, instance: str, static: dict | None = None, configured: dict | None = None) -> Column:
    """A target's samples' labels: the metric's own win over static ones, those over the job's; then job and instance."""
    fixed = {**(configured or {}), **(static or {})}
    base = F.create_map(*[F.lit(x) for kv in fixed.items() for x in kv]) if fixed else F.create_map().cast("map<string,string>")
    own = F.map_filter(metric, lambda k, _: ~k.isin("job", "instance"))
    rest = F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k) & ~k.isin("job", "instance"))
    return F.map_concat(rest, own, F.create_map(F.lit("job"), F.lit(job), F.lit("instance"), F.lit(instance)))


def _number_text(value: Column) -> Column:
    inf = F.lit(float("inf"))
    return F.when(value == inf, "+Inf").when(value == -inf, "-Inf").otherwise(value.cast("string"))


def write_text(samples: DataFrame) -> DataFrame:
    """Lines (value) in the exposition format."""
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), F.replace(F.replace(e["value"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    inner = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(F.lit(""))
    return samples.select(F.concat(F.col("name"), inner, F.lit(" "), _number_text(F.col("value")), F.lit(" "), F.col("ts").cast("string")).alias("value"))
