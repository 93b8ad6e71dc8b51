"""Feature specs: what a split looks at, as plain values, and their compilation to columns.

One function, ``spec_column``, serves training and prediction, so both always see the same feature.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalar import bounded
from ..functions.stats import STAT_NAMES
from .temporal import match_column, pool


@dataclass(frozen=True)
class Spec:
    """A scalar feature of a row: a static column, a window statistic, a template match, a product of two, or the
    difference of a feature's and a static's ranks among training values (``comparison``)."""

    kind: str
    column: int = -1
    channel: int = -1
    start: int = 0
    end: int = 0
    stat: str = ""
    template: tuple[float, ...] = ()
    scale: int = 0
    normalise: bool = True  # of shapelets: windows and template z-normed, or as they are
    inner: Spec | None = None
    frozen: tuple[float, ...] = ()  # centre, scale, low, high of the inner feature, then of the static column
    grids: tuple[tuple[float, ...], ...] = ()  # of a comparison: sorted training values of the inner feature and of the static

    @property
    def family(self) -> str:
        if self.kind == "static":
            return f"static[{self.column}]"
        if self.kind == "product":
            return f"product({self.inner.family} x static[{self.column}])"
        if self.kind == "comparison":
            return f"comparison({self.inner.family} : static[{self.column}])"
        return f"{self.kind}(ch={self.channel})"

    @property
    def name(self) -> str:
        if self.kind == "interval":
            return f"{self.stat}(ch={self.channel}, [{self.start}, {self.end}))"
        if self.kind in ("shapelet_dist", "shapelet_pos", "filter_resp", "filter_pos"):
            return f"{self.kind}(ch={self.channel}, len={len(self.template)}, scale={self.scale})"
        return self.family

    @property
    def is_position(self) -> bool:
        return self.kind.endswith("_pos")

    def describe(self, threshold: float, missing_left: bool) -> str:
        return f"{self.name} <= {threshold:.4g} [missing->{'left' if missing_left else 'right'}]"


def array_stat(window: Column, name: str) -> Column:
    """One statistic of an array with NULLs for missing steps; NULL where it isn't defined."""
    seen = F.filter(F.transform(window, lambda v, i: F.struct(i.cast("double").alias("t"), v.alias("v"))), lambda p: p["v"].isNotNull())
    values = F.transform(seen, lambda p: p["v"])
    n = F.size(values)
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))
    some = lambda c, least=1: F.when(n >= least, c)
    mean = total(values, lambda v: v) / n
    if name == "mean":
        return some(mean)
    if name == "std":
        return some(F.sqrt(F.greatest(total(values, lambda v: v * v) / n - mean * mean, F.lit(0.0))))
    if name in ("min", "max"):
        return some((F.array_min if name == "min" else F.array_max)(values))
    if name == "slope":
        st, sv, stt, stv = (total(seen, f) for f in (lambda p: p["t"], lambda p: p["v"], lambda p: p["t"] * p["t"], lambda p: p["t"] * p["v"]))
        below = stt - st * st / n
        return some(F.when(F.abs(below) > 1e-12, (stv - st * sv / n) / below), 2)
    if name == "median":
        s = F.array_sort(values)
        return some((F.get(s, F.floor((n - 1) / F.lit(2)).cast("int")) + F.get(s, F.floor(n / F.lit(2)).cast("int"))) / 2)
    if name == "mean_abs_change":
        steps = F.filter(F.zip_with(F.slice(window, 1, F.greatest(F.size(window) - 1, F.lit(0))), F.slice(window, 2, F.greatest(F.size(window) - 1, F.lit(0))), lambda a, b: F.abs(b - a)), lambda d: d.isNotNull())
        return F.when(F.size(steps) > 0, total(steps, lambda d: d) / F.size(steps))
    if name in ("first", "last", "delta"):
        first, last = F.get(values, F.lit(0)), F.get(values, n - 1)
        return {"first": first, "last": last, "delta": last - first}[name]
    raise ValueError(f"unknown statistic {name!r}")


def spec_column(spec: Spec, static: str = "static", series: str = "series") -> Column:
    """The feature as a column on rows with ``static`` (array) and ``series`` (array of channels)."""
    if spec.kind == "static":
        return F.get(F.col(static), F.lit(spec.column))
    if spec.kind == "interval":
        return array_stat(F.slice(F.get(F.col(series), F.lit(spec.channel)), spec.start + 1, spec.end - spec.start), spec.stat)
    if spec.kind in ("shapelet_dist", "shapelet_pos", "filter_resp", "filter_pos"):
        x = F.get(F.col(series), F.lit(spec.channel))
        for _ in range(spec.scale):
            x = pool(x)
        matched = match_column(x, list(spec.template), "distance" if spec.kind.startswith("shapelet") else "correlation", spec.normalise)
        return matched["position"] if spec.is_position else matched["value"]
    if spec.kind == "comparison":
        parts = (spec_column(spec.inner, static, series), F.get(F.col(static), F.lit(spec.column)))
        share = lambda c, grid: F.size(F.filter(F.array(*[F.lit(float(x)) for x in grid]).cast("array<double>"), lambda x: x <= c)) / F.lit(max(len(grid), 1))
        a, b = (F.when(c.isNotNull(), share(c, grid)) for c, grid in zip(parts, spec.grids))
        return a - b
    if spec.kind == "product":
        c1, s1, lo1, hi1, c2, s2, lo2, hi2 = spec.frozen
        return bounded(spec_column(spec.inner, static, series), c1, s1, lo1, hi1) * bounded(F.get(F.col(static), F.lit(spec.column)), c2, s2, lo2, hi2)
    raise ValueError(f"unknown kind {spec.kind!r}")


@dataclass(frozen=True)
class Draws:
    """How many candidates a node draws of each kind, and how."""

    intervals: int = 16
    shapelets: int = 0
    stats: tuple[str, ...] = STAT_NAMES
    min_length: int = 3
    whole: float = 0.25
    shapelet_min: int = 3
    shapelet_share: float = 0.5
    normalise: bool = True
    filters: int = 0  # templates of few steps on a pyramid, the first ``fitted`` of them refitted to the residuals
    fitted: int = 0
    refits: int = 2
    ridge: float = 1.0  # penalty of a refit
    filter_length: int = 9
    components: int = 5


def draw_interval(rng: random.Random, channels: int, steps: int, draws: Draws) -> Spec:
    """A window of log-uniform length at a uniform place, sometimes the whole series, with a statistic."""
    channel, stat = rng.randrange(channels), rng.choice(draws.stats)
    if steps <= draws.min_length or rng.random() < draws.whole:
        return Spec("interval", channel=channel, start=0, end=steps, stat=stat)
    length = min(steps, max(draws.min_length, round(draws.min_length * (steps / draws.min_length) ** rng.random())))
    start = rng.randint(0, steps - length)
    return Spec("interval", channel=channel, start=start, end=start + length, stat=stat)


def draw_piece(rng: random.Random, channels: int, steps: int, draws: Draws) -> tuple[int, int, int]:
    """(channel, start, length) of a template: log-uniform length up to a share of the series, at a uniform place."""
    least = min(draws.shapelet_min, steps)
    top = min(steps, max(least + 1, int(draws.shapelet_share * steps)))
    length = min(steps, round(least * (top / least) ** rng.random()))
    return rng.randrange(channels), rng.randint(0, steps - length), length


def shapelets(channel: int, piece: list[float], normalise: bool = True) -> list[Spec]:
    """Two candidates of a template: how far the best match is, and where."""
    base = Spec("shapelet_dist", channel=channel, template=tuple(piece), normalise=normalise)
    return [base, replace(base, kind="shapelet_pos")]
