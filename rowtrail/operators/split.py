"""The exact split scan of gradient boosting as a relational query.

Input is long: (problem keys..., feature value f or NULL, gradient g, hessian h).  Rows are first summed per distinct
value, so ties vanish and the running sums touch one row a distinct value; the sums then run within each problem.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import midpoint
from .sampling import hash_order
from .tables import stored


@dataclass(frozen=True)
class ScanRules:
    """l2: penalty on leaf values; gamma: cost of a split; least hessian and least rows of a side."""

    l2: float = 1.0
    gamma: float = 0.0
    min_child_weight: float = 1e-3
    min_samples_leaf: int = 1


def leaf_value(g: Column, h: Column, l2: float) -> Column:
    return F.when(h + l2 > 0, -g / (h + l2)).otherwise(F.lit(0.0))


def _score(g: Column, h: Column, l2: float) -> Column:
    return F.when(h + l2 > 0, g * g / (h + l2)).otherwise(F.lit(0.0))


def scan_splits(long: DataFrame, by: list[str], rules: ScanRules = ScanRules(), f: str = "f", g: str = "g", h: str = "h", n: str | None = None, buckets: int | None = 0) -> DataFrame:
    """Every allowed cut: (by..., threshold, missing_left, gain, sums of both sides, below and above).

    A cut lies between two neighbouring distinct values; missing rows go left, or right, whole.  ``missing_left`` is
    tried both ways only where rows are missing, and is true otherwise.  ``n`` names a column of counts where rows are
    sums already.  With ``buckets`` the values of a problem are cut into ranges, sums run within a range, and the ranges'
    totals are added before them, so no task needs a whole problem; with 0, a problem's distinct values are one window.
    None stands for as many ranges as the session shuffles into.

    Borders of ranges come from a sample that another run of the plan would draw anew, so the numbered sums are written
    once, to a table, and both the running sums and the totals read that.
    """
    count = F.count(F.lit(1)) if n is None else F.sum(n)
    sums = long.groupBy(*by, F.col(f).alias("f")).agg(F.sum(g).alias("g"), F.sum(h).alias("h"), count.alias("n"))
    if buckets is None:
        buckets = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if buckets:
        sums = stored(sums.repartitionByRange(buckets, *by, "f").withColumn("_part", F.spark_partition_id()), "sums")
    else:
        sums = sums.withColumn("_part", F.lit(0))
    of_range = W.partitionBy(*by, "_part")
    order = of_range.orderBy(F.col("f").asc_nulls_last())
    run = order.rowsBetween(W.unboundedPreceding, 0)
    local = sums.where("f is not null").withColumns({"above": F.lead("f").over(order), **{f"run_{c}": F.sum(c).over(run) for c in "ghn"}})
    totals = sums.groupBy(*by, "_part").agg(F.min("f").alias("low"), *[F.sum(F.when(F.col("f").isNotNull(), F.col(c))).alias(f"seen_{c}") for c in "ghn"], *[F.sum(F.when(F.col("f").isNull(), F.col(c))).alias(f"miss_{c}") for c in "ghn"])
    ranges = W.partitionBy(*by).orderBy("_part")  # a row a range
    whole = W.partitionBy(*by)
    before = {f"pre_{c}": F.coalesce(F.sum(f"seen_{c}").over(ranges.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) for c in "ghn"}
    missing = {f"miss_{c}": F.coalesce(F.sum(f"miss_{c}").over(whole), F.lit(0)) for c in "ghn"}
    every = {f"all_{c}": F.sum(F.coalesce(F.col(f"seen_{c}"), F.lit(0)) + F.coalesce(F.col(f"miss_{c}"), F.lit(0))).over(whole) for c in "ghn"}
    after = F.first("low", ignorenulls=True).over(ranges.rowsBetween(1, W.unboundedFollowing))
    offsets = totals.select(*by, "_part", after.alias("after"), *[c.alias(k) for k, c in {**before, **missing, **every}.items()])
    scanned = local.join(offsets, [*by, "_part"]).withColumn("above", F.coalesce("above", "after")).where("above is not null")
    sides = scanned.withColumn("missing_left", F.explode(F.when(F.col("miss_n") > 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    left = {c: F.col(f"run_{c}") + F.col(f"pre_{c}") + F.when(F.col("missing_left"), F.col(f"miss_{c}")).otherwise(F.lit(0)) for c in "ghn"}
    right = {c: F.col(f"all_{c}") - left[c] for c in "ghn"}
    gain = 0.5 * (_score(left["g"], left["h"], rules.l2) + _score(right["g"], right["h"], rules.l2) - _score(F.col("all_g"), F.col("all_h"), rules.l2)) - rules.gamma
    allowed = (left["h"] >= rules.min_child_weight) & (right["h"] >= rules.min_child_weight) & (left["n"] >= rules.min_samples_leaf) & (right["n"] >= rules.min_samples_leaf)
    made = sides.where(allowed)
    return made.select(*by, midpoint(F.col("f"), F.col("above")).alias("threshold"), "missing_left", gain.alias("gain"), left["g"].alias("gl"), left["h"].alias("hl"), right["g"].alias("gr"), right["h"].alias("hr"), F.col("f").alias("below"), "above")


def best_splits(long: DataFrame, by: list[str], rules: ScanRules = ScanRules(), digits: int = 9, buckets: int | None = None, **columns: str) -> DataFrame:
    """The best allowed cut of each problem with a gain over 0; ties by missing-left first, then the lowest threshold."""
    cuts = scan_splits(long, by, rules, buckets=buckets, **columns).where(F.col("gain") > 0)
    key = F.struct(F.round("gain", digits).alias("gain"), F.col("missing_left").cast("int").alias("left"), (-F.col("threshold")).alias("low"))
    best = F.max_by(F.struct("threshold", "missing_left", "gain", "gl", "hl", "gr", "hr", "below", "above"), key)
    return cuts.groupBy(*by).agg(best.alias("best")).select(*by, "best.*")


def permuted_gradients(rows: DataFrame, by: list[str], id_column: str, permutations: int, seed: int) -> DataFrame:
    """(by..., id, perm, g, h): under each permutation the pairs (g, h) change places among the rows of a group.

    The row at a place of the permutation's hash order gets the pair of the row at that place of a fixed order.
    """
    keyed = rows.select(*by, id_column, F.struct("g", "h").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("perm"))
    u = lambda *parts: F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)
    fixed = hash_order(keyed, u(F.lit(seed), F.col(id_column)), [*by, "perm"]).select(*by, "perm", "place", "d")
    moved = hash_order(keyed.drop("d"), u(F.lit(seed), "perm", F.lit(1), F.col(id_column)), [*by, "perm"]).join(fixed, [*by, "perm", "place"])
    return moved.select(*by, "perm", id_column, "d.*")


def chance_gain(long: DataFrame, by: list[str], id_column: str, rules: ScanRules = ScanRules(), permutations: int = 16, quantile: float = 0.95, seed: int = 0) -> DataFrame:
    """(by..., chance): the gain that the best of a node's candidates reaches on shuffled gradients.

    ``long`` has, per row of a node and candidate, the id, by..., candidate, f, g and h.  Gradients (and hessians with
    them) change places among the rows of a node; per permutation the best gain over all candidates counts, and the
    quantile of those is what a split should beat.
    """
    rows = long.groupBy(*by, id_column).agg(F.first("g").alias("g"), F.first("h").alias("h"))
    moved = permuted_gradients(rows, by, id_column, permutations, seed)
    mixed = long.drop("g", "h").join(moved, [*by, id_column])
    best = best_splits(mixed, [*by, "perm", "candidate"], rules).groupBy(*by, "perm").agg(F.max("gain").alias("gain"))
    every = rows.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("perm"))
    all_ = every.join(best, [*by, "perm"], "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))
    return all_.groupBy(*by).agg(F.percentile("gain", F.lit(quantile)).alias("chance"))


def selection_charge(candidates: Column, rows: Column, scale: Column, weight: float) -> Column:
    """The gain that the best of many useless candidates is expected to show, which a split has to beat."""
    return weight * scale * (F.log(candidates) + 0.4 * F.log(rows))
