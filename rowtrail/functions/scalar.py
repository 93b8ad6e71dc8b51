"""Scalar expressions that keep missing values missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(z: Column) -> Column:
    """The logistic function without overflow on either side."""
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def softmax(scores: Column) -> Column:
    """Probabilities of an array of scores, the largest taken off first."""
    top = F.array_max(scores)
    parts = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(parts, lambda x: x / total)


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    """x within [low, high]; NULL stays NULL, which ``greatest`` and ``least`` alone would not keep."""
    low, high = (b if isinstance(b, Column) else F.lit(b) for b in (low, high))
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def bounded(x: Column, center: float | Column, scale: float | Column, low: float | Column, high: float | Column) -> Column:
    """x standardised by frozen numbers (a flat scale counts as 1) and cut at frozen bounds."""
    scale = scale if isinstance(scale, Column) else F.lit(scale)
    return clip((x - center) / F.when(scale > 1e-12, scale).otherwise(F.lit(1.0)), low, high)


def midpoint(low: Column, high: Column) -> Column:
    """A threshold between two neighbours; the lower one where rounding would reach the upper."""
    mid = low + (high - low) / 2
    return F.when(mid >= high, low).otherwise(mid)


def goes_left(feature: Column, threshold: float | Column, missing_left: bool | Column) -> Column:
    """A split's predicate: at most the threshold, with a side for missing values."""
    return F.coalesce(feature <= threshold, missing_left if isinstance(missing_left, Column) else F.lit(missing_left))


def mixed_hash(*parts: Column | int) -> Column:
    """Whole number in [0, 2^32) from whole-number parts by multiplications that every engine can repeat."""
    h = F.lit(0).cast("long")
    for p in parts:
        h = ((h + (p if isinstance(p, Column) else F.lit(p)).cast("long") + 1) * 1103515245) % 4294967296
        h = (h.bitwiseXOR(F.shiftright(h, 15)) * 1597334677) % 4294967296
    return h


def uniform(*parts: Column | int) -> Column:
    """A number in (0, 1) that depends on the parts alone, not on how rows are partitioned."""
    h = F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


def normal(*parts: Column | int) -> Column:
    """A standard normal number that depends on the parts alone (Box-Muller)."""
    u, v = uniform(*parts, 1), uniform(*parts, 2)
    return F.sqrt(-2 * F.log(u)) * F.cos(6.283185307179586 * v)
