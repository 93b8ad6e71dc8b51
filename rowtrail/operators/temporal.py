"""Sliding operators on series: sums, template distances and correlations, pooling pyramids, rank features.

Matching a template against every position of a series is done by an Arrow-fed NumPy kernel on whole batches of
series (each row is independent, so it is a narrow pass); everything else is built-in expressions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FLAT = 1e-12


def sliding_sums(long: DataFrame, keys: list[str], length: int, t: str = "t", value: str = "value") -> DataFrame:
    """For each window of ``length`` steps of a dense series, by its start: sum, sum of squares, number missing."""
    w = W.partitionBy(*keys).orderBy(t).rowsBetween(0, length - 1)
    v = F.coalesce(F.col(value), F.lit(0.0))
    out = long.select(
        *keys, F.col(t).alias("start"), F.sum(v).over(w).alias("s1"), F.sum(v * v).over(w).alias("s2"), F.sum(F.col(value).isNull().cast("long")).over(w).alias("missing"), F.count(F.lit(1)).over(w).alias("_n")
    )
    return out.where(F.col("_n") == length).drop("_n")


def znorm(values: list[float]) -> list[float] | None:
    """A template centred and scaled to unit deviation; zeros where it is flat, None where a value is missing."""
    a = np.asarray([np.nan if v is None else v for v in values], float)
    if not np.isfinite(a).all() or not len(a):
        return None
    sd = a.std()
    return ((a - a.mean()) / sd if sd > FLAT else np.zeros(len(a))).tolist()


def unit_snippet(values: list[float]) -> list[float] | None:
    """A snippet centred and scaled to unit length; None if it is flat or misses a value."""
    a = np.asarray([np.nan if v is None else v for v in values], float)
    if not np.isfinite(a).all() or not len(a):
        return None
    a = a - a.mean()
    norm = np.linalg.norm(a)
    return (a / norm).tolist() if norm > FLAT else None


def unit_snippet_column(series: Column) -> Column:
    """The same as an expression on an array column."""
    n = F.size(series)
    mean = F.aggregate(series, F.lit(0.0), lambda a, x: a + x) / n
    centred = F.transform(series, lambda x: x - mean)
    norm = F.sqrt(F.aggregate(centred, F.lit(0.0), lambda a, x: a + x * x))
    return F.when((n > 0) & ~F.exists(series, lambda x: x.isNull()) & (norm > FLAT), F.transform(centred, lambda x: x / norm))


def _blocks(series: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal length as one matrix: (row numbers, values with NaN for missing)."""
    lengths = series.map(lambda x: -1 if x is None else len(x)).to_numpy()
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        if n > 0:
            yield at, np.array([np.asarray(series.iloc[i], float) for i in at])


def _windows(x: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(windows, means, deviations, complete) of every position."""
    w = np.lib.stride_tricks.sliding_window_view(x, length, axis=1)
    ok = np.isfinite(w).all(2)
    z = np.where(np.isfinite(x), x, 0.0)
    c1, c2 = (np.concatenate([np.zeros((len(x), 1)), np.cumsum(v, 1)], 1) for v in (z, z * z))
    mean = (c1[:, length:] - c1[:, :-length]) / length
    sd = np.sqrt(np.maximum((c2[:, length:] - c2[:, :-length]) / length - mean**2, 0))
    return np.lib.stride_tricks.sliding_window_view(z, length, axis=1), mean, sd, ok


#: Templates longer than this are slid along by a Fourier transform.
DIRECT = 64


def _products(w: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Inner product of a template with each window, of which ``w`` is a view over rows with 0 for missing steps."""
    if len(t) <= DIRECT:
        return w @ t
    rows = np.concatenate([w[:, :, 0], w[:, -1, 1:]], 1)
    size = 1 << (rows.shape[1] + len(t) - 2).bit_length()
    whole = np.fft.irfft(np.fft.rfft(rows, size, axis=1) * np.fft.rfft(t[::-1], size), size, axis=1)
    return whole[:, len(t) - 1 : rows.shape[1]]


def match_template(x: np.ndarray, template: list[float], kind: str = "distance", normalise: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Best match of a template along each row of x: (value, position in [0, 1]); NaN where there is none.

    distance: least mean squared difference, of z-normed windows and template or as they are; a flat window or
    template counts as zeros.  correlation: the signed correlation of the largest absolute value, 0 for flat ones.
    Windows with a missing step don't count.  Of equal matches the earliest is taken.
    """
    n, length = x.shape[1], len(template)
    t = np.asarray(template, float)
    value, place = np.full(len(x), np.nan), np.full(len(x), np.nan)
    if length > n or not length or not np.isfinite(t).all():
        return value, place
    w, mean, sd, ok = _windows(x, length)
    flat = sd <= FLAT
    centred = t - t.mean()
    t_sd = centred.std()
    if kind == "distance" and not normalise:
        score = np.maximum(sd**2 + mean**2 - 2 * _products(w, t) / length + (t**2).mean(), 0)
    else:
        unit = centred / t_sd if t_sd > FLAT else np.zeros(length)
        corr = np.where(flat, 0.0, _products(w, unit) / length / np.where(flat, 1.0, sd))
        if kind == "distance":
            score = np.maximum(np.where(flat, 0.0, 1.0) - 2 * corr + (1.0 if t_sd > FLAT else 0.0), 0)
        else:
            corr = np.clip(corr, -1, 1)
            score = -np.abs(corr)
    score = np.where(ok, score, np.inf)
    best = score.argmin(1)
    found = np.isfinite(score[np.arange(len(x)), best])
    picked = (corr if kind == "correlation" else score)[np.arange(len(x)), best]
    value[found] = picked[found]
    place[found] = best[found] / (n - length) if n > length else 0.0
    return value, place


def match_column(series: Column, template: list[float], kind: str = "distance", normalise: bool = True) -> Column:
    """``match_template`` as a column of structs (value, position) on an array column; NULL series give NULLs."""

    @F.pandas_udf("value double, position double")
    def matched(s: pd.Series) -> pd.DataFrame:
        value, place = np.full(len(s), np.nan), np.full(len(s), np.nan)
        for at, x in _blocks(s):
            value[at], place[at] = match_template(x, template, kind, normalise)
        return pd.DataFrame({"value": pd.Series(value).astype(object).where(np.isfinite(value), None), "position": pd.Series(place).astype(object).where(np.isfinite(place), None)})

    return matched(series)


def gather_window(series: Column, position: Column, length: int) -> Column:
    """The window at a position in [0, 1], centred and of unit length; NULL where it is flat or misses a step."""
    start = F.rint(position * (F.size(series) - length)).cast("int")
    return unit_snippet_column(F.slice(series, start + 1, length))


def pool(series: Column) -> Column:
    """One level of the pyramid: means of pairs over what is observed, an odd last step dropped."""
    half = F.floor(F.size(series) / F.lit(2)).cast("int")

    def pair(i: Column) -> Column:
        a, b = F.get(series, 2 * i), F.get(series, 2 * i + 1)
        return F.when(a.isNotNull() & b.isNotNull(), (a + b) / 2).otherwise(F.coalesce(a, b))

    return F.when(half > 0, F.transform(F.sequence(F.lit(0), half - 1), pair)).otherwise(F.array().cast("array<double>"))


def pyramid_levels(steps: int, filter_length: int, most: int = 8) -> list[int]:
    """Lengths of the levels of a series of so many steps."""
    out = [steps]
    while len(out) < most and out[-1] // 2 >= filter_length + 1:
        out.append(out[-1] // 2)
    return out


def pool_long(long: DataFrame, keys: list[str], steps: int, t: str = "t", value: str = "value") -> DataFrame:
    """One level on long rows."""
    return long.where(F.col(t) < 2 * (steps // 2)).groupBy(*keys, F.floor(F.col(t) / 2).cast("int").alias("t")).agg(F.avg(value).alias("value"))


def dct_basis(length: int, count: int) -> list[list[float]]:
    """The first cosine components without the constant one, each a column of unit length."""
    count = max(1, min(count, length - 1))
    out = []
    for k in range(1, count + 1):
        c = [math.cos(math.pi * k * (2 * i + 1) / (2 * length)) for i in range(length)]
        norm = math.sqrt(sum(x * x for x in c))
        out.append([x / norm for x in c])
    return out


def refit_template(windows: list[list[float]], residual: list[float], hessian: list[float], basis: list[list[float]], ridge: float) -> list[float] | None:
    """A template fitted to residuals on centred windows in a basis, hessian-weighted, the intercept free.

    Works on the sums that the normal equations need, a matrix of (basis + 1) squared.  None with fewer rows than
    basis + 2, or where nothing is found.
    """
    b = np.asarray(basis, float).T
    if len(windows) < b.shape[1] + 2:
        return None
    x = np.column_stack([np.ones(len(windows)), np.asarray(windows, float) @ b])
    h, r = np.asarray(hessian, float), np.asarray(residual, float)
    return solved_template(x.T @ (x * h[:, None]), x.T @ (h * r), basis, ridge)


def solved_template(gram: np.ndarray, right: np.ndarray, basis: list[list[float]], ridge: float) -> list[float] | None:
    """The template of ``refit_template`` from its normal equations, which tasks can add up."""
    b = np.asarray(basis, float).T
    coef = np.linalg.lstsq(gram + np.diag([0.0] + [ridge] * b.shape[1]), right, rcond=None)[0]
    return unit_snippet((b @ coef[1:]).tolist())


def ecdf(rows: DataFrame, value: str, grid: DataFrame, grid_value: str, out: str = "ecdf") -> DataFrame:
    """Share of the frozen grid at most each value; NULL values and an empty grid give NULL.

    Both sides are laid in one order and the grid counted along it, so neither side is broadcast or crossed.  The
    running count is per bucket of the order with the buckets' totals added, so no task sees everything.
    """
    g = grid.where(F.col(grid_value).isNotNull()).groupBy(F.col(grid_value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    total = g.agg(F.sum("_c")).first()[0]
    if not total:
        return rows.withColumn(out, F.lit(None).cast("double"))
    cuts = [float(c) for c in g.approxQuantile("_v", [i / 64 for i in range(1, 64)], 0.002)]
    cuts = sorted(set(cuts))
    bucket = lambda c: F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x < c))
    values = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("_v")).distinct().withColumn("_c", F.lit(0).cast("long"))
    both = values.unionByName(g).groupBy("_v").agg(F.sum("_c").alias("_c")).withColumn("_b", bucket(F.col("_v")))
    totals = both.groupBy("_b").agg(F.sum("_c").alias("_t"))
    before = totals.select("_b", (F.sum("_t").over(W.orderBy("_b")) - F.col("_t")).alias("_before"))  # 64 rows at most
    run = both.withColumn("_run", F.sum("_c").over(W.partitionBy("_b").orderBy("_v"))).join(F.broadcast(before), "_b")
    ranked = run.select(F.col("_v"), ((F.col("_run") + F.col("_before")) / F.lit(float(total))).alias(out))
    return rows.join(ranked, F.col(value) == F.col("_v"), "left").drop("_v")


def comparison(rows: DataFrame, a: str, grid_a: tuple[DataFrame, str], b: str, grid_b: tuple[DataFrame, str], out: str = "comparison") -> DataFrame:
    """The rows with the difference of two columns' shares of their frozen grids, each a table and its column."""
    both = ecdf(ecdf(rows, a, *grid_a, "_share_a"), b, *grid_b, "_share_b")
    return both.withColumn(out, F.col("_share_a") - F.col("_share_b")).drop("_share_a", "_share_b")


def running_sum(rows: DataFrame, by: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """The rows with the sum of a series' values so far, in the order of its columns."""
    return rows.withColumn(out, F.sum(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
