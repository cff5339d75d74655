"""Functions that pipelines apply to results: DataFrames of labels, ts and value in, and out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship

#: Rows of a function's results that a worker gives back at a time, or those of one series.
OUT_ROWS = 10_000
#: The number of a sample in its series, from 1.
PLACE = "__place"


def label_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("ts", "value")]


def _series(df: DataFrame):
    return Window.partitionBy(*([f"`{c}`" for c in label_columns(df)] or [F.lit(0)]))


def passed(df: DataFrame) -> DataFrame:
    """The result as it is."""
    return df


def double_values(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.col("value") * 2)


def add_label(df: DataFrame, processor: str = "tsengine") -> DataFrame:
    """Marks the series as processed, and by what."""
    return df.withColumns({"processed": F.lit("true"), "processor": F.lit(processor)})


def filter_high_values(df: DataFrame, threshold: float = 100.0) -> DataFrame:
    """The series with any value of at least threshold, whole."""
    high = F.max(F.when(~F.isnan("value"), F.col("value"))).over(_series(df)) >= threshold
    return df.withColumn("__high", high).where("__high").drop("__high")


def aggregate_sum(df: DataFrame) -> DataFrame:
    """All series added up, time by time."""
    return df.groupBy("ts").agg(F.sum("value").alias("value")).select(F.lit("aggregated_sum").alias("name"), "ts", "value")


def moving_average(df: DataFrame, window: int = 3) -> DataFrame:
    """The mean of the last window samples of a series; its first window - 1 samples are as they were."""
    w = _series(df).orderBy("ts")
    mean = F.avg("value").over(w.rowsBetween(-(window - 1), 0))
    return df.withColumn("value", F.when(F.row_number().over(w) >= window, mean).otherwise(F.col("value")))


def rate_of_change(df: DataFrame) -> DataFrame:
    """Change per second between neighbouring samples of a series, without resets; one-sample series are as they were."""
    w = _series(df).orderBy("ts")
    gap, gain = F.col("ts") - F.lag("ts").over(w), F.col("value") - F.lag("value").over(w)
    n = F.count(F.lit(1)).over(_series(df))
    marked = df.withColumns({"__gap": gap, "__gain": gain, "__n": n}).where("__n < 2 or __gap > 0")
    return marked.withColumn("value", F.when(F.col("__n") < 2, F.col("value")).otherwise(F.try_divide("__gain", "__gap"))).drop("__gap", "__gain", "__n")


FUNCTIONS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "pass": passed,
    "passthrough": passed,
    "double_values": double_values,
    "add_label": add_label,
    "filter_high_values": filter_high_values,
    "aggregate_sum": aggregate_sum,
    "moving_average": moving_average,
    "rate_of_change": rate_of_change,
}


def _whole_series(frames):
    """Of frames of series in order, frames of whole series: what may go on in the next frame is kept for it."""
    import pandas as pd

    kept: list = []
    for frame in frames:
        begins = (frame[PLACE].to_numpy() == 1).nonzero()[0]
        last = begins[-1] if len(begins) else 0
        if len(begins) and (last or kept):
            yield pd.concat([*kept, frame.iloc[:last]], ignore_index=True)
            kept = []
        kept.append(frame.iloc[last:])
    if kept:
        yield pd.concat(kept, ignore_index=True)


def _one_by_one(frame, function: Callable):
    """The function's results for each series of a frame, put together to frames of many."""
    import pandas as pd

    begins = [*(frame[PLACE].to_numpy() == 1).nonzero()[0].tolist(), len(frame)]
    frame = frame.drop(columns=PLACE)
    run, kind, n = [], None, 0
    for at, end in zip(begins, begins[1:], strict=False):
        out = function(frame.iloc[at:end].reset_index(drop=True))
        if not len(out):
            continue
        own = (out.columns.tolist(), out.dtypes.tolist())
        if run and (own != kind or n >= OUT_ROWS):  # other types are converted by Spark, not by pandas
            yield pd.concat(run, ignore_index=True)
            run, n = [], 0
        run.append(out)
        kind, n = own, n + len(out)
    if run:
        yield pd.concat(run, ignore_index=True)


def per_series(function: Callable, schema: str, many: bool = False) -> Callable[[DataFrame], DataFrame]:
    """A pipeline function from one that takes and returns a pandas frame of one series (its samples by time).

    With many, it takes whole series, as many as a batch holds, one after the other: a call for each series costs about a
    millisecond, whatever it does. Spark puts series in order; no group of its own is made for each, which costs more yet.
    """

    def run(frames):
        for frame in _whole_series(frames):
            if many:
                yield function(frame.drop(columns=PLACE))
            else:
                yield from _one_by_one(frame, function)

    def apply(df: DataFrame) -> DataFrame:
        ship(df.sparkSession)
        return df.withColumn(PLACE, F.row_number().over(_series(df).orderBy("ts"))).mapInPandas(run, schema)

    return apply


def run_code(df: DataFrame, code: str) -> DataFrame:
    """Python text that reads df (as input_data too) and leaves its answer in result, on the driver.

    Only for engines that allow code: the text can do whatever the driver can.
    """
    space = {"df": df, "input_data": df, "result": df, "F": F}
    exec(code, space)  # noqa: S102
    return space["result"]
