"""Series from event tables, and the moves between long rows and arrays.

Long rows (keys..., t, value) are the form in which statistics and windows run, since every step can go to another
task; arrays (``series: array<double>``) are the form for kernels that need a whole series at hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def binned_means(events: DataFrame, keys: list[str], bin_: Column, value: str) -> DataFrame:
    """Mean of each (keys, bin) that has rows: (keys..., t, value)."""
    return events.groupBy(*keys, bin_.cast("int").alias("t")).agg(F.avg(value).alias("value"))


def dense(long: DataFrame, rows: DataFrame, keys: list[str], channels: list[str] | None, steps: int, channel: str = "channel") -> DataFrame:
    """Every step of every series of ``rows`` (one row a row id), with NULL where ``long`` has nothing.

    The grid is exploded from the row ids, so it is as large as the result and joins on the full key.
    """
    grid = rows.select(*keys)
    if channels is not None:
        grid = grid.withColumn(channel, F.explode(F.array(*[F.lit(c) for c in channels])))
    grid = grid.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    on = [*keys, *([channel] if channels is not None else []), "t"]
    return grid.join(long, on, "left").select(*on, "value")


def to_arrays(long: DataFrame, keys: list[str], t: str = "t", value: str = "value") -> DataFrame:
    """(keys..., series): the values in order of time, NULLs kept."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(value).alias("v"))))
    return long.groupBy(*keys).agg(F.transform(pairs, lambda p: p["v"]).alias("series"))


def to_long(rows: DataFrame, keys: list[str], series: str = "series") -> DataFrame:
    """(keys..., t, value) of an array column."""
    return rows.select(*keys, F.posexplode(series).alias("t", "value"))


def pad(series: Column, steps: int) -> Column:
    """A ragged series filled up on the right with NULL; a longer one than ``steps`` is an error."""
    short = F.concat(series, F.array_repeat(F.lit(None).cast("double"), F.greatest(F.lit(steps) - F.size(series), F.lit(0))))
    return F.when(F.size(series) > steps, F.raise_error(F.concat(F.lit("series is longer than "), F.lit(str(steps))))).otherwise(short)


def pad_to_longest(rows: DataFrame, series: str = "series") -> DataFrame:
    """All series at the length of the longest, found in one aggregate."""
    longest = rows.agg(F.coalesce(F.max(F.size(series)), F.lit(0))).first()[0]
    return rows.withColumn(series, pad(F.col(series), longest))


def take_channels(series: Column, names: list[str], wanted: list[str]) -> Column:
    """Channels of an array of channels by name, in the wanted order; an unknown name is an error."""
    missing = [w for w in wanted if w not in names]
    if missing:
        raise ValueError(f"unknown channels {missing}; there are {names}")
    return F.array(*[F.get(series, F.lit(names.index(w))) for w in wanted])


def block_means(long: DataFrame, keys: list[str], k: int, t: str = "t", value: str = "value") -> DataFrame:
    """Means of k steps at a time; a shorter rest at the end is dropped, missing steps don't count."""
    whole = long.groupBy(*keys, F.floor(F.col(t) / k).cast("int").alias("t")).agg(F.avg(value).alias("value"), F.count(F.lit(1)).alias("_n"))
    return whole.where(F.col("_n") == k).drop("_n")


def missing_fraction(long: DataFrame, by: list[str] | None = None, value: str = "value") -> DataFrame:
    """Share of steps without a value."""
    return long.groupBy(*(by or [])).agg(F.avg(F.col(value).isNull().cast("double")).alias("missing"))
