"""A Parquet store of samples with a table of series beside them; the first write of a series and time wins.

    PATH/series/seq=N/              series (a 64-bit id), name, labels, labels_key
    PATH/samples/seq=N/bucket=B/    name, series, ts, value, sorted by name, series and time

Samples carry ids, never label maps; times are delta-encoded. Every write has a number, and readers take of each series
and time the sample of the lowest, so a write needs no look at stored samples, and one repeated under its number replaces
itself. Only buckets that several writes share are deduplicated by readers; a compacted store never is. Labels are
filtered on the table of series, before samples are read. `expire` deletes buckets by age.

A store's bucket should hold a few files' worth of samples: a day where a day fills gigabytes, 90 days by default.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import MapSource, between, label_column, labels_key, series_id
from ..plans.syntax import Matcher
from ..scratch import delete, folders

BUCKET = 90 * 86_400
SERIES = "series long, name string, labels map<string,string>, labels_key string, seq long"
COLUMNS = "name string, series long, ts long, value double, seq long, bucket long"
#: Samples of a file at most.
FILE_ROWS = 4_000_000
#: Series that a selector with labels may name for their ids to become a filter on the Parquet scan.
PUSHED_IDS = 256
#: Delta encoding of times needs the second version of Parquet's pages, and no dictionary for them.
ENCODING = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9", "parquet.writer.version": "v2", "parquet.enable.dictionary#ts": "false"}


def bucket(ts, size: int):
    """The start of the stretch of time that holds ts."""
    return (F.floor(ts / F.lit(size)) * size).cast("long")


def deduplicate(samples: DataFrame, order: str = "seq", last: bool = False) -> DataFrame:
    """One sample for each series and time: the first written, or the last; equal orders go by the smaller value."""
    pick = F.max_by if last else F.min_by
    keys = ["name", "labels_key", "ts"]
    return samples.groupBy(*keys).agg(F.first("labels").alias("labels"), pick("value", F.struct(order, "value")).alias("value")).select("name", "labels", "labels_key", "ts", "value")


def in_order(samples: DataFrame, order: str = "seq", size: int = 3600) -> DataFrame:
    """Samples in the order they arrive without those older than one before them in their series and stretch of time.

    A sample at the same time as the last is a repetition and left out as well.
    """
    w = Window.partitionBy("name", "labels_key", bucket(F.col("ts"), size)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return samples.withColumn("__last", F.max("ts").over(w)).where("__last is null or ts > __last").drop("__last")


def merge_hot_cold(cold: DataFrame, hot: DataFrame) -> DataFrame:
    """Both stores' samples; where they have the same series and time, the hot one's."""
    both = cold.withColumn("__rank", F.lit(0)).unionByName(hot.withColumn("__rank", F.lit(1)))
    keys = [c for c in cold.columns if c not in ("value", "labels")]
    others = [F.first("labels").alias("labels")] if "labels" in cold.columns else []
    return both.groupBy(*keys).agg(*others, F.max_by("value", "__rank").alias("value")).select(*cold.columns)


@dataclass
class Store:
    """A store at a path. Its samples are read through `source`, which prunes buckets.

    skip_corrupt leaves files out that can't be read, instead of failing the query.
    """

    spark: SparkSession
    path: str
    bucket_size: int = BUCKET
    #: Parts of a bucket that one write makes, each by a task of its own; a part is a file, or several of FILE_ROWS.
    spread: int = 4
    skip_corrupt: bool = False
    _buckets: dict[int, list[int]] = field(default_factory=dict, repr=False)

    def _floor(self, ts: int | None) -> int | None:
        return None if ts is None else ts // self.bucket_size * self.bucket_size

    def _read(self, table: str, schema: str) -> DataFrame:
        if not folders(self.spark, f"{self.path}/{table}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("ignoreCorruptFiles", str(self.skip_corrupt).lower()).parquet(f"{self.path}/{table}")

    # --- writing

    def write(self, samples: DataFrame, seq: int) -> None:
        """Append samples (name, labels, ts, value; maybe arrival) under a number that grows with each write.

        The series it brings are written first. The samples are shuffled once, by bucket and part of the series.
        """
        arrival = F.col("arrival") if "arrival" in samples.columns else F.lit(0)
        keyed = samples.withColumn("pairs", F.array_sort(F.map_entries("labels"))).withColumn("series", series_id(F.col("name"), F.col("pairs")))
        known = keyed.groupBy("series", "name", "pairs").agg(F.lit(1).alias("one"))
        self._write_series(known.withColumn("labels", F.map_from_entries("pairs")), seq)
        rows = keyed.select("name", "series", "ts", "value", arrival.cast("long").alias("arrival"), bucket(F.col("ts"), self.bucket_size).alias("bucket"))
        self._write_samples(rows, F.struct("arrival", "value"), self.path, seq)

    def _write_series(self, keyed: DataFrame, seq: int) -> None:
        """Append the series not yet known; two series of one id are an error, though hardly ever to be seen."""
        key = labels_key(F.col("name"), F.col("labels"))
        new = keyed.select("series", "name", "labels").dropDuplicates(["series"]).withColumn("labels_key", key)
        known = self._read("series", SERIES).where(F.col("seq") != seq).select("series", F.col("labels_key").alias("known")).dropDuplicates(["series"])
        clash = F.raise_error(F.concat(F.lit("one id for two series: "), "known", F.lit(" and "), "labels_key")).cast("boolean")
        fresh = new.join(known, "series", "left").where(F.when(F.col("known").isNull(), True).when(F.col("known") == F.col("labels_key"), False).otherwise(clash))
        fresh.select("series", "name", "labels", "labels_key").write.mode("overwrite").parquet(f"{self.path}/series/seq={seq}")

    def _write_samples(self, rows: DataFrame, order, path: str, seq: int) -> None:
        keys = ["bucket", "part", "name", "series", "ts"]
        dealt = rows.withColumn("part", F.pmod("series", F.lit(self.spread))).repartition("bucket", "part").sortWithinPartitions(*keys)
        # the aggregation streams over that order and needs no other exchange
        once = dealt.groupBy(*keys).agg(F.min(F.struct(order.alias("order"), F.col("value").alias("v"))).alias("first"))
        target = once.select("bucket", "name", "series", "ts", F.col("first.v").alias("value"))
        target.write.options(**ENCODING).option("maxRecordsPerFile", FILE_ROWS).mode("overwrite").partitionBy("bucket").parquet(f"{path}/samples/seq={seq}")
        self._buckets.pop(seq, None)

    def compact(self, to: str) -> Store:
        """A copy at another path in which every series and time is stored once."""
        rows = self._first_writes(None, None, None)
        self.series().write.mode("overwrite").parquet(f"{to}/series/seq=0")
        self._write_samples(rows, F.lit(0), to, 0)
        return Store(self.spark, to, self.bucket_size, self.spread, self.skip_corrupt)

    def expire(self, now: int, keep_seconds: int) -> list[int]:
        """Delete the buckets whose samples are all older than keep_seconds; the buckets deleted. Series stay known."""
        gone = set()
        for seq, buckets in list(self._listed().items()):
            for b in buckets:
                if b + self.bucket_size <= now - keep_seconds:
                    delete(self.spark, f"{self.path}/samples/seq={seq}/bucket={b}")
                    gone.add(b)
            self._buckets.pop(seq, None)
        return sorted(gone)

    # --- reading

    def _listed(self) -> dict[int, list[int]]:
        """The buckets of every write, from the folders' names; what is known of a write is kept."""
        for name in folders(self.spark, f"{self.path}/samples"):
            seq = int(name.removeprefix("seq=")) if name.startswith("seq=") else None
            if seq is not None and seq not in self._buckets:
                self._buckets[seq] = [int(b.removeprefix("bucket=")) for b in folders(self.spark, f"{self.path}/samples/{name}") if b.startswith("bucket=")]
        return self._buckets

    def _shared(self, low: int | None, high: int | None) -> list[int]:
        """The buckets of a time range that several writes have."""
        times: dict[int, int] = {}
        for buckets in self._listed().values():
            for b in buckets:
                if (low is None or b >= self._floor(low)) and (high is None or b <= high):
                    times[b] = times.get(b, 0) + 1
        return sorted(b for b, n in times.items() if n > 1)

    def _first_writes(self, name: str | None, low: int | None, high: int | None, ids: Iterable[int] | None = None) -> DataFrame:
        """name, series, ts, value and bucket of stored samples, each series and time once."""
        df = self._read("samples", COLUMNS).where(between(F.col("ts"), low, high)).where(between(F.col("bucket"), self._floor(low), self._floor(high)))
        df = df if name is None else df.where(F.col("name") == name)
        df = df if ids is None else df.where(F.col("series").isin(list(ids)))
        columns = ["name", "series", "ts", "value", "bucket"]
        shared = self._shared(low, high)
        if not shared:
            return df.select(*columns)
        # the aggregation sorts: after the exchange, in parts of a size that Spark chooses. A scan's task reads as many bytes
        # as any other table's, but of samples that take a few bytes, and its files' row groups are never divided
        dealt = df.where(F.col("bucket").isin(shared)).repartition("series", "ts")
        several = dealt.groupBy("name", "series", "ts", "bucket").agg(F.min_by("value", F.struct("seq", "value")).alias("value"))
        return df.where(~F.col("bucket").isin(shared)).select(*columns).unionByName(several.select(*columns))

    def samples(self, low: int | None = None, high: int | None = None) -> DataFrame:
        """Stored samples of a time range, first writes only: name, labels, labels_key, ts, value, bucket."""
        known = self.series().select("series", "labels", "labels_key")
        return self._first_writes(None, low, high).join(known, "series").select("name", "labels", "labels_key", "ts", "value", "bucket")

    def source(self) -> StoredSource:
        return StoredSource(self)

    # --- series

    def series(self) -> DataFrame:
        """series (id), name, labels and labels_key of every series."""
        return self._read("series", SERIES).dropDuplicates(["series"]).select("series", "name", "labels", "labels_key")

    def metric_names(self) -> DataFrame:
        return self._read("series", SERIES).select("name").distinct()

    def postings(self) -> DataFrame:
        """label, value, series and labels_key: one row for each label of each series."""
        return self.series().select(F.explode("labels").alias("label", "value"), "series", "labels_key")

    def find_series(self, labels: dict[str, str]) -> DataFrame:
        """The series that have all of the labels."""
        out = self.series()
        for k, v in labels.items():
            out = out.where(F.col("name") == v if k == "__name__" else F.element_at("labels", k) == v)
        return out

    def labels_for(self, ids: Iterable[int]) -> DataFrame:
        """Names and labels of series by their ids."""
        return self.series().where(F.col("series").isin(list(ids)))


class StoredSource(MapSource):
    """A store's samples for queries. Names and labels come from the table of series and are kept."""

    def __init__(self, store: Store):
        super().__init__(store.series(), store.bucket_size)
        self._store = store

    def _chosen(self, name: str, labels: list[str], matchers: tuple[Matcher, ...]) -> DataFrame:
        from ..operators.selectors import matches

        out = self.df.where(F.col("name") == name).select("series", *[F.element_at("labels", x).alias(label_column(x)) for x in labels])
        for m in matchers:
            out = out.where(matches(m, m.label in labels))
        return out

    def scan(self, name: str, low: int | None, high: int | None, labels: list[str], matchers: tuple[Matcher, ...] = ()) -> DataFrame:
        chosen, ids = self._chosen(name, labels, matchers), None
        if matchers:
            few = chosen.select("series").limit(PUSHED_IDS + 1).collect()
            ids = [r["series"] for r in few] if len(few) <= PUSHED_IDS else None
        rows = self._store._first_writes(name, low, high, ids)
        return rows.join(chosen, "series").select(*[label_column(x) for x in labels], "ts", "value")

    def series(self, name: str, low: int | None, high: int | None, labels: list[str], matchers: tuple[Matcher, ...] = ()) -> DataFrame:
        """Label columns of the series, with a sample in the range if one is given; samples give their ids alone."""
        chosen = self._chosen(name, labels, matchers)
        if low is not None or high is not None:
            chosen = chosen.join(self._store._first_writes(name, low, high).select("series").distinct(), "series", "left_semi")
        return chosen.drop("series")
