"""Synthetic rows with series, from ``spark.range`` and hash-based numbers: the same rows under any partitioning."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import normal, uniform


#: Values of a channel that are worked on at a time, so that what lies between stays in the cache.
AT_ONCE = 1 << 14
_P1, _P2, _P3, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _hashed(state: np.ndarray, number: np.ndarray | int) -> np.ndarray:
    """``xxhash64`` of one more whole number of 32 bits, from the hash of those before it."""
    h = (state + (_P5 + np.uint64(4))) ^ (np.asarray(number, np.uint64) * _P1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * _P2 + _P3
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _uniforms(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _channel(seed: int, tag: int, steps: int, sd: float, shape: Callable | None = None, *given: Column) -> Column:
    """A channel: ``sd * normal(seed, tag, row_id, t)`` and a shape added to it, for a batch of rows at a time.

    ``shape`` gets the noise (rows x steps), the times and a column of numbers for each of ``given``.  The values are
    those of ``functions.scalar.normal`` up to rounding in the last places.
    """

    @F.arrow_udf("array<double>")
    def channel(state: pa.Array, *given: pa.Array) -> pa.Array:
        states = np.asarray(state).astype(np.int64).view(np.uint64)[:, None]
        numbers = [np.asarray(g).astype(np.float64)[:, None] for g in given]
        t, out = np.arange(steps), np.empty((len(states), steps))
        size = max(1, AT_ONCE // steps)
        with np.errstate(over="ignore"):
            for i in range(0, len(out), size):
                h = _hashed(states[i : i + size], t)
                x = sd * (np.sqrt(-2 * np.log(_uniforms(_hashed(h, 1)))) * np.cos(6.283185307179586 * _uniforms(_hashed(h, 2))))
                out[i : i + size] = x if shape is None else shape(x, t, *(g[i : i + size] for g in numbers))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * steps, pa.int32()), pa.array(out.ravel()))

    return channel(F.xxhash64(F.lit(seed), F.lit(tag), F.col("row_id")), *given)


def _bump(center, width: float, height, t):
    z = (t - center) / width
    return height * np.exp(-0.5 * z * z)


def _doublet(center, width: float, height, t):
    z = (t - center) / width
    return -height * z * np.exp(-0.5 * z * z)


def _middle(values: DataFrame, few: int = 10_000) -> float | None:
    """The exact median of the one column.

    Each pass counts the values in bins of the range at hand and goes on in the bin that holds the middle; the driver
    gets a row a bin, then ``few`` values at most, and no task holds more than that either.
    """
    v = F.col(values.columns[0])
    low, high, n = values.agg(F.min(v), F.max(v), F.count(v)).first()
    if not n:
        return None
    held, k = n, (n - 1) // 2
    while held > few and low < high:
        number = F.least(F.floor((v - low) / ((high - low) / 1024)), F.lit(1023))
        bins = sorted(values.where(v.between(low, high)).groupBy(number.alias("bin")).agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).collect())
        upto = list(accumulate(b.n for b in bins))
        at = bisect_right(upto, k)
        low, high, held, k = bins[at].low, bins[at].high, bins[at].n, k - (upto[at] - bins[at].n)
    found = sorted(r[0] for r in values.where(v.between(low, high)).collect()) if low < high else None
    lower = found[k] if found else low
    if n % 2:
        return lower
    if k + 1 < held:
        upper = found[k + 1] if found else low
    else:
        upper = values.where(v > high).agg(F.min(v)).first()[0]
    return 0.5 * lower + 0.5 * upper


def _statics(seed: int, count: int) -> list[Column]:
    return [normal(F.lit(seed), F.lit(900 + i), F.col("row_id")) for i in range(count)]


def _rows(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "row_id")


def _u(seed: int, tag: int) -> Column:
    return uniform(F.lit(seed), F.lit(tag), F.col("row_id"))


def _apart(seed: int, steps: int) -> tuple[Column, Column]:
    """Two centres, the first in the left third and the second in the right third."""
    return 0.12 * steps + _u(seed, 11) * 0.25 * steps, 0.62 * steps + _u(seed, 12) * 0.25 * steps


def _finish(rows: DataFrame, statics: list[Column], channels: list[Column], label: Column) -> DataFrame:
    return rows.select("row_id", F.array(*statics).alias("static"), F.array(*channels).alias("series"), label.alias("label"))


def bump_order(spark: SparkSession, n: int = 500, steps: int = 100, noise: float = 1.0, extra: int = 4, amp: float = 3.0, seed: int = 0) -> DataFrame:
    """Whether a zero-area doublet comes before its negative or after it, exclusive-or a static flag.

    Both stand at random places that don't overlap, so neither whole-series nor fixed-window statistics hold the order.
    """
    rows = _rows(spark, n)
    flag, up = (_u(seed, 1) < 0.5), (_u(seed, 2) < 0.5)
    width = max(1.5, steps / 50)
    reach = 3 * width  # on either side of a centre
    first = reach + _u(seed, 11) * max(steps - 6 * reach, 1)
    second = first + 2.5 * reach + _u(seed, 12) * F.greatest(steps - reach - first - 2.5 * reach, F.lit(0.0))
    sign = F.when(up, F.lit(amp * noise)).otherwise(F.lit(-amp * noise))
    x = _channel(seed, 3, steps, noise, lambda v, t, a, b, s: v + _doublet(a, width, s, t) + _doublet(b, width, -s, t), first, second, sign)
    return _finish(rows, [flag.cast("double"), *_statics(seed, extra)], [x], (up != flag).cast("int"))


def timing(spark: SparkSession, n: int = 500, steps: int = 100, noise: float = 0.5, extra: int = 4, amp: float = 3.0, seed: int = 0) -> DataFrame:
    """Whether a shape comes before the row's own deadline."""
    deadline, center = 0.2 * steps + _u(seed, 1) * 0.6 * steps, 0.1 * steps + _u(seed, 2) * 0.8 * steps
    x = _channel(seed, 3, steps, noise, lambda v, t, at: v + _doublet(at, steps * 0.03, amp, t), center)
    return _finish(_rows(spark, n), [deadline, *_statics(seed, extra)], [x], (center < deadline).cast("int"))


def slope_window(spark: SparkSession, n: int = 500, steps: int = 120, noise: float = 0.8, extra: int = 4, seed: int = 0) -> DataFrame:
    """The sign of a drift inside a fixed window, exclusive-or a static gate over 0.

    The series is noise over a sum of steps: their size is the sign's within the window, and random and up to two and a
    half times as large in the three stretches around it, which govern the slope of the whole.
    """
    gate, up = 2 * _u(seed, 1) - 1, _u(seed, 2) < 0.5
    borders = [0, round(0.38 * steps), round(0.58 * steps), round(0.79 * steps), steps]
    slopes = [F.when(up, F.lit(0.12)).otherwise(F.lit(-0.12)) if k == 1 else 0.6 * _u(seed, 20 + k) - 0.3 for k in range(4)]

    def drift(v, t, *sizes):
        return v + sum(s * np.maximum(0, np.minimum(t + 1, b) - a) for s, a, b in zip(sizes, borders, borders[1:]))

    x = _channel(seed, 3, steps, noise, drift, *slopes)
    return _finish(_rows(spark, n), [gate, *_statics(seed, extra)], [x], (up != (gate > 0)).cast("int"))


def amplitude(spark: SparkSession, n: int = 500, steps: int = 100, noise: float = 0.5, extra: int = 4, seed: int = 0) -> DataFrame:
    """Regression: the height of an early bump times a static coefficient; a taller bump elsewhere means nothing."""
    coef, height = 0.5 + 1.5 * _u(seed, 1), 1 + 2 * _u(seed, 2)
    a, b = _apart(seed, steps)
    x = _channel(seed, 3, steps, noise, lambda v, t, a, b, low, high: v + _bump(a, steps * 0.03, low, t) + _bump(b, steps * 0.03, high, t), a, b, height, 4 + _u(seed, 5))
    return _finish(_rows(spark, n), [coef, *_statics(seed, extra)], [x], height * coef + 0.1 * normal(F.lit(seed), F.lit(6), F.col("row_id")))


def lead_lag(spark: SparkSession, n: int = 500, steps: int = 100, noise: float = 1.0, extra: int = 4, lag: int = 6, amp: float = 3.0, seed: int = 0) -> DataFrame:
    """Which of two channels leads, exclusive-or a static flag."""
    flag, leads = _u(seed, 1) < 0.5, _u(seed, 2) < 0.5
    center = 0.2 * steps + _u(seed, 4) * 0.6 * steps
    shift = F.when(leads, F.lit(lag / 2)).otherwise(F.lit(-lag / 2))
    bent = lambda v, t, at: v + _doublet(at, steps * 0.03, amp, t)
    x, y = _channel(seed, 3, steps, noise, bent, center - shift), _channel(seed, 5, steps, noise, bent, center + shift)
    return _finish(_rows(spark, n), [flag.cast("double"), *_statics(seed, extra)], [x, y], (leads != flag).cast("int"))


def pure_static(spark: SparkSession, n: int = 500, columns: int = 10, seed: int = 0, series_steps: int = 0, noise: float = 1.0) -> DataFrame:
    """A rule over statics alone; with ``series_steps`` a channel of noise beside it."""
    x = _statics(seed, columns)
    channels = [_channel(seed + 99991, 3, series_steps, noise)] if series_steps else []
    rows = _rows(spark, n)
    score = 1.5 * x[0] - 1.2 * x[1] + x[0] * x[2]
    middle = _middle(rows.select(score.alias("score")))
    series = F.array(*channels) if channels else F.array().cast("array<array<double>>")
    return rows.select("row_id", F.array(*x).alias("static"), series.alias("series"), (score > middle).cast("int").alias("label"))


SCENARIOS = {
    "bump_order": bump_order, "timing": timing, "slope_window": slope_window, "amp_regression": amplitude, "lead_lag": lead_lag,
    "static_control": lambda spark, n=500, seed=0: pure_static(spark, n, seed=seed, series_steps=100),
}
