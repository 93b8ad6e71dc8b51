"""A bank of dilated convolutions with positive-share pooling: fixed features of a series, learnt without labels."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import uniform

#: The 84 kernels: which three of nine taps weigh +2; the others weigh -1, so each kernel sums to zero.
KERNELS = list(combinations(range(9), 3))


def dilations(steps: int, features: int, most: int = 32) -> dict[int, int]:
    """Dilation -> features per kernel: log-spaced up to the length, shared by how often each one is drawn."""
    if steps <= 9:
        return {1: features}
    top = math.log2((steps - 1) / 8)
    drawn = Counter(int(2**x) for x in np.linspace(0, top, min(features, most)))
    total = sum(drawn.values())
    share = {d: max(1, int(c * features / total)) for d, c in sorted(drawn.items())}
    keys, i = list(share), 0
    while sum(share.values()) < features:
        share[keys[i % len(keys)]] += 1
        i += 1
    return share


def impute_row_mean(series: Column) -> Column:
    """Missing steps as the mean of the series' observed ones, 0 where there are none."""
    seen = F.filter(series, lambda x: x.isNotNull())
    mean = F.when(F.size(seen) > 0, F.aggregate(seen, F.lit(0.0), lambda a, x: a + x) / F.size(seen)).otherwise(F.lit(0.0))
    return F.transform(series, lambda x: F.coalesce(x, mean))


def response(x: np.ndarray, kernel: int, dilation: int) -> np.ndarray | None:
    """Convolution of each row: even kernels over the zero-padded series, odd ones only where all taps lie inside."""
    span = 8 * dilation
    if kernel % 2 == 0:
        x = np.pad(x, ((0, 0), (span // 2, span - span // 2)))
    n = x.shape[1] - span
    if n < 1:
        return None
    taps = [x[:, j * dilation : j * dilation + n] for j in range(9)]
    a, b, c = KERNELS[kernel]
    return 3 * (taps[a] + taps[b] + taps[c]) - sum(taps)


@dataclass
class RocketBank:
    """Frozen convolutions (channel, kernel, dilation, biases) for series of one length."""

    steps: int
    channels: int
    entries: list[tuple[int, int, int, list[float]]] = field(default_factory=list)

    @classmethod
    def fit(cls, rows: DataFrame, series: str, steps: int, channels: int = 1, features: int = 10_000, seed: int = 0, id_column: str = "row_id") -> RocketBank:
        """Biases are quantiles of each kernel's response on one donor row, drawn by a hash of its id.

        ``series`` is an array of channels, each an array of ``steps`` values.  84 x dilations donors are fetched,
        one for each kernel and dilation to choose from, a thousand rows or so at any input size.
        """
        share = dilations(steps, max(1, features // len(KERNELS)))
        wanted = len(KERNELS) * len(share)
        filled = F.transform(F.col(series), impute_row_mean)
        donors = rows.select(F.col(id_column).alias("id"), filled.alias("x")).orderBy(uniform(seed, F.col(id_column))).limit(wanted).collect()
        if not donors:
            raise ValueError("no rows to fit on")
        rng = np.random.default_rng(seed)
        bank = cls(steps, channels)
        for dilation, count in share.items():
            for kernel in range(len(KERNELS)):
                channel, donor = int(rng.integers(channels)), donors[int(rng.integers(len(donors)))]
                got = response(np.asarray([donor.x[channel]], float), kernel, dilation)
                if got is not None:
                    at = np.linspace(0, 1, count + 2)[1:-1]
                    bank.entries.append((channel, kernel, dilation, np.quantile(got[0], at).tolist()))
        return bank

    @property
    def width(self) -> int:
        return sum(len(b) for *_, b in self.entries)

    def features(self, x: np.ndarray) -> np.ndarray:
        """Shares of each response above its biases, for a block of shape (rows, channels, steps)."""
        if x.shape[1:] != (self.channels, self.steps):
            raise ValueError(f"fitted on {self.channels} x {self.steps}, got {x.shape[1:]}")
        out, at = np.empty((len(x), self.width)), 0
        for channel, kernel, dilation, biases in self.entries:
            got = response(x[:, channel], kernel, dilation)
            for b in biases:
                out[:, at] = (got > b).mean(1)
                at += 1
        return out

    def transform(self, series: Column) -> Column:
        """The features of an array of channels as an array column, computed on Arrow batches."""
        bank = self

        @F.pandas_udf("array<double>")
        def shares(s: pd.Series) -> pd.Series:
            if not len(s):
                return pd.Series([], dtype=object)
            x = np.array([np.stack([np.asarray(c, float) for c in row]) for row in s])
            seen = np.isfinite(x)
            mean = np.where(seen, x, 0).sum(2) / np.maximum(seen.sum(2), 1)
            return pd.Series(list(bank.features(np.where(seen, x, mean[:, :, None]))))

        return shares(series)


def response_column(series: Column, kernel: int, dilation: int) -> Column:
    """One kernel's response along an array column; empty where the series is too short."""

    @F.pandas_udf("array<double>")
    def responded(s: pd.Series) -> pd.Series:
        out = []
        for x in s:
            got = response(np.asarray([x], float), kernel, dilation) if x is not None and len(x) else None
            out.append([] if got is None else got[0])
        return pd.Series(out, dtype=object)

    return responded(series)
