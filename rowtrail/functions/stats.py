"""Missing-aware statistics of a window of a series, as aggregates over long rows (one row a time step).

A long row is (keys..., t, value) with t a whole number and value NULL where nothing was observed.  All of these are
built-in aggregates with partial aggregation before the shuffle, so a row id that holds most of the data costs one
partial row a task.  ``mean_abs_change`` needs the neighbour in time and is therefore fed by ``with_previous``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STAT_NAMES = ("mean", "std", "min", "max", "slope", "median", "mean_abs_change", "last", "delta")
#: With the first observation too: the ten of the aggregate baselines.
STAT10_NAMES = ("mean", "std", "min", "max", "slope", "median", "mean_abs_change", "first", "last", "delta")
#: Spread below which a column or window counts as flat.
FLAT = 1e-12


def with_previous(long: DataFrame, keys: list[str], t: str = "t", value: str = "value") -> DataFrame:
    """Adds ``previous``: the value one step earlier of the same series, NULL where that step is missing or absent."""
    w = W.partitionBy(*keys).orderBy(t)
    return long.withColumn("previous", F.when(F.col(t) - F.lag(t).over(w) == 1, F.lag(value).over(w)))


def stat(name: str, t: str = "t", value: str = "value", previous: str = "previous") -> Column:
    """The aggregate of one statistic over observed values; NULL where it isn't defined."""
    v, seen = F.col(value).cast("double"), F.col(value).isNotNull()
    first, last = (f(F.when(seen, v), F.when(seen, F.col(t))) for f in (F.min_by, F.max_by))
    exprs = {
        "mean": lambda: F.avg(v),
        "std": lambda: F.stddev_pop(v),
        "min": lambda: F.min(v),
        "max": lambda: F.max(v),
        "slope": lambda: F.when(F.count(v) >= 2, F.regr_slope(v, F.col(t).cast("double"))),
        "median": lambda: F.percentile(v, F.lit(0.5)),
        "mean_abs_change": lambda: F.avg(F.abs(v - F.col(previous))),
        "first": lambda: first,
        "last": lambda: last,
        "delta": lambda: last - first,
    }
    if name not in exprs:
        raise ValueError(f"unknown statistic {name!r}")
    return exprs[name]()


def interval_stats(
    long: DataFrame, keys: list[str], start: int | None = None, end: int | None = None, stats: tuple[str, ...] = STAT_NAMES, t: str = "t", value: str = "value", by: list[str] | None = None
) -> DataFrame:
    """One row a series with the statistics of its steps in [start, end); ``by`` are further grouping columns.

    Time is counted within the window only for the slope, which doesn't depend on where it starts.
    """
    part = long
    if start is not None:
        part = part.where(F.col(t) >= start)
    if end is not None:
        part = part.where(F.col(t) < end)
    group = [*keys, *(by or [])]
    if "mean_abs_change" in stats:
        part = with_previous(part, group, t, value)
    return part.groupBy(*group).agg(*[stat(s, t, value).alias(s) for s in stats])


def window_of(t: Column, steps: int, windows: int) -> Column:
    """The window of a step when ``steps`` are cut into ``windows`` parts, the first steps % windows one longer."""
    q, r = divmod(steps, windows)
    long_part = r * (q + 1)
    late = F.lit(r) + F.floor((t - long_part) / F.lit(max(q, 1)))
    return F.when(t < long_part, F.floor(t / F.lit(q + 1))).otherwise(late).cast("int")


def windowed_stats(long: DataFrame, keys: list[str], steps: int, windows: int = 4, stats: tuple[str, ...] = STAT10_NAMES, t: str = "t", value: str = "value") -> DataFrame:
    """The statistics of each of ``windows`` consecutive parts of a series of ``steps`` steps."""
    return interval_stats(long.withColumn("window", window_of(F.col(t), steps, windows)), keys, stats=stats, t=t, value=value, by=["window"])


def strict_stats(long: DataFrame, keys: list[str], stats: tuple[str, ...] = STAT10_NAMES, t: str = "t", value: str = "value") -> DataFrame:
    """The variant in which one missing step makes every statistic of the series NULL."""
    part = with_previous(long, keys, t, value)
    whole = F.count(F.col(value)) == F.count(F.lit(1))
    return part.groupBy(*keys).agg(*[F.when(whole, stat(s, t, value)).alias(s) for s in stats])
