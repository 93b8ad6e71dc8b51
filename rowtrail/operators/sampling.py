"""Draws without replacement, permutations and weighted choices, all from hashes of row ids.

A position in hash order is a bucket's offset plus the place within it, so no window sees more than a bucket.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import uniform

BUCKETS = 1024


def hash_order(rows: DataFrame, key: Column, by: list[str] | None = None, out: str = "place") -> DataFrame:
    """Rows with ``place``: 0, 1, 2, ... in the order of ``key`` (uniform in [0, 1)), within each group of ``by``.

    ``key`` should be without ties; a group is cut into buckets by ``key``, whose counts are added up.
    """
    by = by or []
    cut = rows.withColumn("_u", key).withColumn("_b", F.floor(F.col("_u") * BUCKETS).cast("int"))
    counts = cut.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(*by, "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = cut.withColumn("_r", F.row_number().over(W.partitionBy(*by, "_b").orderBy("_u")) - 1)
    return placed.join(offsets, [*by, "_b"]).withColumn(out, F.col("_before") + F.col("_r")).drop("_u", "_b", "_r", "_before")


def exact_subsample(rows: DataFrame, id_column: str, share: float, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """max(1, round(share * n)) rows of the whole, or of each group of ``by``, in hash order of their ids."""
    by = by or []
    sizes = rows.groupBy(*by).agg(F.greatest(F.round(F.count(F.lit(1)) * share), F.lit(1.0)).alias("_quota"))
    placed = hash_order(rows, uniform(seed, F.col(id_column)), by)
    joined = placed.join(F.broadcast(sizes), by if by else F.lit(True))
    return joined.where(F.col("place") < F.col("_quota")).drop("place", "_quota")


def capped_subsample(rows: DataFrame, id_column: str, label: str, size: int, seed: int = 7919) -> DataFrame:
    """About ``size`` rows with each class in proportion and at least one of each; all rows where size is 0 or covers them."""
    n = rows.count()
    if size <= 0 or size >= n:
        return rows
    return exact_subsample(rows, id_column, size / n, seed, [label])


def permuted(rows: DataFrame, id_column: str, value: str, seeds: list[int], out: str = "shuffled") -> DataFrame:
    """(id, shuffled): for each row the values that it gets under each permutation, an array in the order of ``seeds``.

    Under one seed the rows' values change places: the row at a place of the seed's order takes the value of the row
    at that place of a fixed order.  One equi-join on places.
    """
    base = hash_order(rows.select(id_column, value), uniform(-1, F.col(id_column))).select("place", F.col(value).alias("_v"))
    long = rows.select(id_column, F.explode(F.array(*[F.lit(s) for s in seeds])).alias("_s"))
    draw = F.xxhash64("_s", id_column)
    places = hash_order(long, (F.shiftrightunsigned(draw, 11) * F.lit(2.0**-53)), ["_s"])
    index = {s: i for i, s in enumerate(seeds)}
    at = F.element_at(F.create_map(*[F.lit(x) for s, i in index.items() for x in (s, i)]), F.col("_s"))
    got = places.join(base, "place").groupBy(id_column).agg(F.array_sort(F.collect_list(F.struct(at.alias("i"), F.col("_v").alias("v")))).alias("_all"))
    return got.select(id_column, F.transform("_all", lambda x: x["v"]).alias(out))


def weighted_choice(rows: DataFrame, id_column: str, weight: Column, by: list[str], seed: int = 0) -> DataFrame:
    """One row of each group of ``by``, chosen with a chance in proportion to its weight: the least -log(u) / weight.

    A minimum with a partial aggregate, so a group is never gathered.  Groups without positive weights give no row.
    """
    u = F.greatest(uniform(seed, F.col(id_column)), F.lit(1e-300))
    keyed = rows.withColumn("_w", weight).where("_w > 0").withColumn("_k", -F.log(u) / F.col("_w"))
    columns = [c for c in rows.columns if c not in by]
    return keyed.groupBy(*by).agg(F.min_by(F.struct(*columns), F.struct("_k", id_column)).alias("_r")).select(*by, "_r.*")


def residual_weight(g: Column, h: Column, center: Column) -> Column:
    """How much a row's residual stands out: h times the squared distance of its Newton step from the node's."""
    return h * F.pow(-g / F.when(F.abs(h) > 1e-16, h) - center, 2)


# ---------------------------------------------------------------- counts of draws, on the driver


def thinned(requested: int, share: float) -> int:
    """Draws left of ``requested``: the share of them, one at least; none of none."""
    return max(1, math.ceil(share * requested)) if requested > 0 else 0


def some_columns(width: int, share: float, rng) -> list[int]:
    """Distinct column numbers in rising order: the share of all, one at least."""
    return sorted(rng.sample(range(width), min(width, max(1, math.ceil(share * width))))) if width else []


def some_entries(entries: list, share: float, rng) -> list:
    """Entries of a bank for one tree: the rounded share of them, one at least, in their order."""
    if not entries or share >= 1:
        return list(entries)
    return [entries[i] for i in sorted(rng.sample(range(len(entries)), max(1, round(share * len(entries)))))]


def fourier_weights(width: int, features: int, gamma: float = 1.0, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(weights, offsets) of random Fourier features of a Gaussian kernel whose bandwidth follows the width."""
    rng = np.random.default_rng(seed + 1)
    spread = math.sqrt(gamma / max(width, 1))
    return rng.normal(scale=spread, size=(width, features)), rng.uniform(0, 2 * math.pi, features)
