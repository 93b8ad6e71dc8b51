"""Streams of events as binned series, and fitted models applied to streams of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.boost import Booster


def streaming_bins(events: DataFrame, keys: list[str], ts: str, value: str, bin_length: str = "1 day", late: str = "2 days") -> DataFrame:
    """Mean of each (keys, bin) of an event stream, given out once the watermark has passed the bin.

    Events later than ``late`` behind the newest one are dropped, which bounds the state to the open bins.
    """
    stamped = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    binned = stamped.groupBy(*keys, F.window("_ts", bin_length).alias("_w")).agg(F.avg(value).alias("value"), F.count(F.lit(1)).alias("n"))
    return binned.select(*keys, F.col("_w.start").alias("bin"), "value", "n")


def score_stream(rows: DataFrame, model: Booster) -> DataFrame:
    """A fitted model on a stream of (row_id, static, series) rows: a projection, so any output mode will do."""
    if not rows.isStreaming:
        raise ValueError("not a stream; use model.predict")
    return model.predict(rows)
