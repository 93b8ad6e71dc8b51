"""Row blocks made ready for models: coercion, checks, imputing, products of margins and statics, representations.

Rows have ``static`` (array of doubles) and ``series`` (array of channels, each an array of steps); NULL is missing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import STAT10_NAMES
from .kernel import window_stat

EPS = 1e-12


def finite(value: Column) -> Column:
    """NULL for a double that is no number or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def finite_static(static: Column) -> Column:
    return F.transform(static.cast("array<double>"), finite)


def finite_series(series: Column) -> Column:
    return F.transform(series.cast("array<array<double>>"), lambda c: F.transform(c, finite))


def _guard(ok: Column, message: str, value: Column) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


def coerced(rows: DataFrame, static: str | None = "static", series: str | None = "series", pad_to: int = 0) -> DataFrame:
    """The rows with both blocks as arrays of doubles, non-finite values NULL, series padded with NULL to ``pad_to``.

    A block that isn't named is of zero width; naming neither is an error, as is a longer series than ``pad_to``.  A
    number is taken for a block of one column, an array of numbers for a series of one channel.
    """
    if static is None and series is None:
        raise ValueError("a static or a series block is needed")
    kinds = dict(rows.dtypes)
    none = F.array().cast("array<double>")
    s = none if static is None else F.col(static) if kinds[static].startswith("array") else F.array(F.col(static).cast("double"))
    x = F.array().cast("array<array<double>>") if series is None else F.col(series) if kinds[series].startswith("array<array") else F.array(F.col(series))
    x = finite_series(x)
    if pad_to:
        fits = F.forall(x, lambda c: F.size(c) <= pad_to)
        padded = F.transform(x, lambda c: F.concat(c, F.array_repeat(F.lit(None).cast("double"), F.lit(pad_to) - F.size(c))))
        x = _guard(fits, "a series is longer than the frozen length", padded)
    return rows.withColumns({"static": F.coalesce(finite_static(s), none), "series": F.coalesce(x, F.array().cast("array<array<double>>"))})


def checked(rows: DataFrame, width: int, channels: int, steps: int) -> DataFrame:
    """The rows, or an error at the first whose blocks don't have the frozen shape."""
    s = _guard(F.size("static") == width, f"rows must have {width} static columns", F.col("static"))
    ok = (F.size("series") == channels) & F.forall("series", lambda c: F.size(c) == steps)
    return rows.withColumns({"static": s, "series": _guard(ok, f"series must be {channels} x {steps}", F.col("series"))})


def drop_static(rows: DataFrame) -> DataFrame:
    """The rows with a static block of zero width."""
    return rows.withColumn("static", F.array().cast("array<double>"))


def zero_missing(values: Column) -> Column:
    """Missing and non-finite values as 0."""
    return F.transform(values, lambda v: F.coalesce(finite(v), F.lit(0.0)))


def design_matrix(rows: DataFrame, features: Column | None = None, static_only: bool = False, out: str = "x") -> DataFrame:
    """``[static | features]`` as one array; the statics alone where there are no features or only they are wanted."""
    return rows.withColumn(out, F.col("static") if static_only or features is None else F.concat("static", features))


@dataclass
class StaticScale:
    """Frozen medians, ranges, means and deviations of static columns, from one aggregate pass."""

    median: list[float] = field(default_factory=list)
    low: list[float] = field(default_factory=list)
    high: list[float] = field(default_factory=list)
    mean: list[float] = field(default_factory=list)
    sd: list[float] = field(default_factory=list)

    @classmethod
    def fit(cls, rows: DataFrame, width: int, static: str = "static") -> StaticScale:
        """Means and deviations are of the imputed columns; a column without any value counts as 0 throughout."""
        parts = []
        for i in range(width):
            v = F.get(F.col(static), F.lit(i))
            parts += [F.median(v), F.min(v), F.max(v), F.sum(v), F.sum(v * v), F.count(v)]
        row = rows.agg(F.count(F.lit(1)), *parts).first()
        n, out = row[0], cls()
        for i in range(width):
            median, low, high, s, ss, seen = (x or 0.0 for x in row[1 + 6 * i : 7 + 6 * i])
            gap = n - seen
            mean = (s + gap * median) / max(n, 1)
            sd = max((ss + gap * median * median) / max(n, 1) - mean * mean, 0.0) ** 0.5
            for name, value in (("median", median), ("low", low), ("high", high), ("mean", mean), ("sd", sd)):
                getattr(out, name).append(float(value))
        return out

    def kept(self) -> list[int]:
        """Columns that aren't flat."""
        return [i for i, s in enumerate(self.sd) if s > EPS]

    def standardised(self, static: Column, i: int, clip: bool = False) -> Column:
        v = F.coalesce(F.get(static, F.lit(i)), F.lit(self.median[i]))
        if clip:
            v = F.least(F.greatest(v, F.lit(self.low[i])), F.lit(self.high[i]))
        return (v - self.mean[i]) / (self.sd[i] if self.sd[i] > EPS else 1.0)


def margin_products(margin: Column, static: Column, scale: StaticScale) -> Column:
    """All products of a margin and a static column, which is imputed, kept inside its training range and standardised."""
    columns = F.array(*[scale.standardised(static, i, clip=True) for i in range(len(scale.mean))])
    return F.flatten(F.transform(margin, lambda m: F.transform(columns, lambda z: m * z)))


def augmented(rows: DataFrame, margin: str, scale: StaticScale | None = None, out: str = "static") -> DataFrame:
    """The static block with margins, and their products with the statics where a scale is given, laid behind it."""
    parts = [F.col("static"), F.col(margin)] + ([margin_products(F.col(margin), F.col("static"), scale)] if scale else [])
    return rows.withColumn(out, F.concat(*parts))


def augmented_names(width: int, outputs: int, products: bool) -> list[str]:
    """Names of the columns that ``augmented`` makes, in its order."""
    names = [f"static[{i}]" for i in range(width)] + [f"margin[{k}]" for k in range(outputs)]
    return names + [f"margin[{k}] x static[{i}]" for k in range(outputs) for i in range(width)] if products else names


@dataclass
class StaticDesign:
    """``[1 | standardised statics that aren't flat | products of centred ranks]``, not to be penalised."""

    scale: StaticScale
    ranks: list[tuple[list[float], list[float]]] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)

    #: Knots of a frozen rank scale: exact up to so many distinct values, equal steps in rank beyond.
    KNOTS = 4096

    @classmethod
    def fit(cls, rows: DataFrame, width: int, interactions: bool = False, static: str = "static") -> StaticDesign:
        """Pairs come in only where a quarter of the rows could carry all columns."""
        out = cls(StaticScale.fit(rows, width, static))
        kept = out.scale.kept()
        k = len(kept)
        if not interactions or k < 2 or 1 + k + k * (k - 1) // 2 > max(1, rows.count() // 4):
            return out
        for i in kept:
            v = F.coalesce(F.get(F.col(static), F.lit(i)), F.lit(out.scale.median[i]))
            out.ranks.append(rank_scale(rows.select(v.alias("v")), "v", cls.KNOTS))
        out.pairs = [(a, b) for a in range(k) for b in range(a)]
        return out

    @property
    def width(self) -> int:
        return 1 + len(self.scale.kept()) + len(self.pairs)

    def column(self, static: Column) -> Column:
        kept = self.scale.kept()
        parts = [F.array(F.lit(1.0), *[self.scale.standardised(static, i) for i in kept])]
        if self.pairs:
            ranks = [_rank(F.coalesce(F.get(static, F.lit(i)), F.lit(self.scale.median[i])), *r) - 0.5 for i, r in zip(kept, self.ranks)]
            parts.append(F.array(*[ranks[a] * ranks[b] for a, b in self.pairs]))
        return F.concat(*parts)


def rank_scale(rows: DataFrame, column: str, knots: int = 4096) -> tuple[list[float], list[float]]:
    """(values, share of rows up to each) of a column: every distinct value, or every so-many-th of more of them."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    many = counts.agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("n")).first()
    if not many.d:
        return [], []
    if many.d <= knots:
        got = [(r.v, r.n) for r in counts.orderBy("v").collect()]
    else:
        cuts = sorted(set(counts.approxQuantile("v", [i / knots for i in range(1, knots + 1)], 0.1 / knots)))
        at = F.array_position(F.transform(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col("v") <= c), True)
        got = [(cuts[r.k - 1], r.n) for r in counts.groupBy(at.cast("int").alias("k")).agg(F.sum("n").alias("n")).where("k > 0").orderBy("k").collect()]
    values, sums = [float(v) for v, _ in got], np.cumsum([n for _, n in got])
    return values, (sums / many.n).tolist()


def _rank(value: Column, values: list[float], shares: list[float]) -> Column:
    """Share of the frozen rows up to a value, on Arrow batches by binary search."""

    @F.pandas_udf("double")
    def share(v: pd.Series) -> pd.Series:
        at = np.searchsorted(np.asarray(values), v.to_numpy(float), side="right")
        return pd.Series(np.concatenate([[0.0], shares])[at])

    return share(value)


# ---------------------------------------------------------------- representations of series


def window_borders(steps: int, windows: int) -> list[tuple[int, int]]:
    """Windows of nearly equal length, the longer ones first."""
    each, more = divmod(steps, windows)
    sizes = [each + (i < more) for i in range(windows)]
    ends = np.cumsum(sizes).tolist()
    return [(e - s, e) for s, e in zip(sizes, ends)]


def _blocks(windows: int, strict: bool) -> Callable[[Column], Column]:
    def column(series: Column) -> Column:
        @F.pandas_udf("array<double>")
        def stats(s: pd.Series) -> pd.Series:
            if not len(s):
                return pd.Series([], dtype=object)
            x = np.array([[np.asarray(c, float) for c in row] for row in s])
            out = []
            for c in range(x.shape[1]):
                for a, b in window_borders(x.shape[2], windows):
                    w = x[:, c, a:b]
                    broken = ~np.isfinite(w).all(1)
                    for name in STAT10_NAMES:
                        v = window_stat(w, name)
                        out.append(np.where(broken, np.nan, v) if strict else v)
            wide = np.stack(out, 1) if out else np.zeros((len(x), 0))
            return pd.Series([[None if v != v else v for v in row] for row in wide.tolist()])

        return stats(series)

    return column


#: Name -> features of a series block; None for the statics alone.
REPRESENTATIONS: dict[str, Callable[[Column], Column] | None] = {
    "static_only": None,
    "agg": _blocks(1, False),
    "wagg4": _blocks(4, False),
    "wagg8": _blocks(8, False),
    "wagg16": _blocks(16, False),
    "raw_flat": F.flatten,
    "agg_naive": _blocks(1, True),
    "wagg8_naive": _blocks(8, True),
}


def represented(rows: DataFrame, name: str, out: str = "x") -> DataFrame:
    """The design matrix of rows under a named representation; an unknown name is an error."""
    if name not in REPRESENTATIONS:
        raise ValueError(f"unknown representation {name!r}; known: {', '.join(REPRESENTATIONS)}")
    made = REPRESENTATIONS[name]
    return design_matrix(rows, made(F.col("series")) if made else None, made is None, out)
