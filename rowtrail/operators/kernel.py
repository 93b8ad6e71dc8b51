"""Features of many specs at once on Arrow batches: one NumPy pass over a batch instead of an expression a spec."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .specs import Spec
from .temporal import match_template

FLAT = 1e-12


def window_stat(x: np.ndarray, name: str) -> np.ndarray:
    """A statistic of each row of a window, NaN for missing steps and where it isn't defined."""
    n = np.isfinite(x).sum(1)
    out = np.full(len(x), np.nan)
    if not x.shape[1]:
        return out
    seen = np.isfinite(x)
    z = np.where(seen, x, 0.0)
    t = np.arange(x.shape[1], dtype=float)
    with np.errstate(invalid="ignore", divide="ignore"), warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        if name in ("mean", "std"):
            mean = z.sum(1) / n
            return mean if name == "mean" else np.sqrt(np.maximum((z * z).sum(1) / n - mean * mean, 0))
        if name in ("min", "max"):
            return getattr(np, f"nan{name}")(x, axis=1)
        if name == "median":
            return np.nanmedian(x, axis=1)
        if name == "slope":
            st, sv, stt, stv = (seen * t).sum(1), z.sum(1), (seen * t * t).sum(1), (z * t).sum(1)
            below = stt - st * st / n
            return np.where((n >= 2) & (np.abs(below) > FLAT), (stv - st * sv / n) / np.where(np.abs(below) > FLAT, below, 1), np.nan)
        if name == "mean_abs_change":
            return np.nanmean(np.abs(np.diff(x, axis=1)), axis=1) if x.shape[1] > 1 else out
        if name in ("first", "last", "delta"):
            some = n > 0
            first = x[np.arange(len(x)), seen.argmax(1)]
            last = x[np.arange(len(x)), x.shape[1] - 1 - seen[:, ::-1].argmax(1)]
            return np.where(some, {"first": first, "last": last, "delta": last - first}[name], np.nan)
    raise ValueError(f"unknown statistic {name!r}")


def pooled(x: np.ndarray) -> np.ndarray:
    """Means of pairs over what is observed."""
    a = x[:, : x.shape[1] // 2 * 2].reshape(len(x), -1, 2)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        return np.nanmean(a, axis=2)


def evaluate(specs: list[Spec], static: np.ndarray, series: np.ndarray) -> np.ndarray:
    """(rows, specs) features of a block: static (rows, p), series (rows, channels, steps), NaN for missing."""
    out = np.full((len(static), len(specs)), np.nan)
    matched: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    for i, s in enumerate(specs):
        if s.kind == "static":
            out[:, i] = static[:, s.column]
        elif s.kind == "interval":
            out[:, i] = window_stat(series[:, s.channel, s.start : s.end], s.stat)
        elif s.kind == "product":
            c1, s1, lo1, hi1, c2, s2, lo2, hi2 = s.frozen
            inner = evaluate([s.inner], static, series)[:, 0]
            out[:, i] = np.clip((inner - c1) / (s1 if s1 > FLAT else 1), lo1, hi1) * np.clip((static[:, s.column] - c2) / (s2 if s2 > FLAT else 1), lo2, hi2)
        elif s.kind in ("shapelet_dist", "shapelet_pos", "filter_resp", "filter_pos"):
            key = (s.kind[:7], s.channel, s.template, s.scale, s.normalise)
            if key not in matched:  # one pass gives value and position
                x = series[:, s.channel]
                for _ in range(s.scale):
                    x = pooled(x)
                matched[key] = match_template(x, list(s.template), "distance" if s.kind.startswith("shapelet") else "correlation", s.normalise)
            out[:, i] = matched[key][1 if s.is_position else 0]
        elif s.kind == "comparison":
            a, b = evaluate([s.inner], static, series)[:, 0], static[:, s.column]
            ranks = [np.searchsorted(grid, x, side="right") / max(len(grid), 1) for grid, x in zip(s.grids, (a, b))]
            out[:, i] = np.where(np.isfinite(a) & np.isfinite(b), ranks[0] - ranks[1], np.nan)
        else:
            raise ValueError(f"unknown kind {s.kind!r}")
    return out


def blocks(static: pa.Array, series: pa.Array, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Both blocks of an Arrow batch as matrices of a frozen shape (columns, channels, steps), NaN for missing.

    Shorter series are padded; other shapes, and a block that is there where the fit had none or the other way round,
    are errors.
    """
    p, c, t = shape
    n = len(static)

    def numbers(a: pa.Array) -> np.ndarray:
        return a.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)

    sizes = np.diff(np.asarray(static.offsets))
    if static.null_count or (sizes != p).any():
        raise ValueError(f"rows must have {p} static columns, as in the fit")
    x = numbers(static.flatten()).reshape(n, p)
    if series.null_count or (np.diff(np.asarray(series.offsets)) != c).any():
        raise ValueError(f"rows must have {c} channels, as in the fit" if c else "the fit had no series")
    channels = series.flatten()
    lengths = np.diff(np.asarray(channels.offsets)) if len(channels) else np.zeros(0, int)
    if (lengths > t).any():
        raise ValueError(f"series must have {t} steps at most, as in the fit")
    flat = numbers(channels.flatten()) if len(channels) else np.zeros(0)
    if (lengths == t).all():
        return x, flat.reshape(n, c, t)
    y = np.full((n * c, t), np.nan)
    y[np.arange(t)[None, :] < lengths[:, None]] = flat
    return x, y.reshape(n, c, t)


def features_column(specs: list[Spec], static: Column, series: Column) -> Column:
    """The features of all specs as one array column with NULL for missing, from the flat buffers of Arrow batches."""

    @F.arrow_udf("array<double>")
    def computed(a: pa.Array, b: pa.Array) -> pa.Array:
        if not len(a):
            return pa.array([], pa.list_(pa.float64()))
        channels = b.flatten()
        shape = (len(a[0]), len(b[0]), len(channels[0]) if len(channels) else 0)
        if (np.diff(np.asarray(channels.offsets)) != shape[2]).any() if len(channels) else False:
            raise ValueError("series of a batch differ in shape; pad them first")
        got = evaluate(specs, *blocks(a, b, shape))
        flat = pa.array(got.ravel(), mask=~np.isfinite(got.ravel()))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1) * len(specs), pa.int32()), flat)

    return computed(static, series)
