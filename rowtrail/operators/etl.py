"""Joins, windows and reshaping that turn recordings into rows with series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def interval_join(intervals: DataFrame, keys: list[str], step: float, start: str = "start", length: str = "length", order: str = "start") -> DataFrame:
    """Intervals as the steps they cover: floor(start / step) and on for max(1, floor(length / step)) steps.

    A later interval (by ``order``) overwrites an earlier one on the same step.  Exploding makes it an equi-join key,
    so no range comparison of two tables is needed.
    """
    first = F.floor(F.col(start) / step).cast("int")
    count = F.greatest(F.floor(F.col(length) / step), F.lit(1)).cast("int")
    rest = [c for c in intervals.columns if c not in keys]
    steps = intervals.select(*keys, F.struct(*rest).alias("_rest"), F.col(order).alias("_o"), F.explode(F.sequence(first, first + count - 1)).alias("t"))
    return steps.groupBy(*keys, "t").agg(F.max_by("_rest", F.struct("_o", "_rest")).alias("_rest")).select(*keys, "t", "_rest.*")


def trim_around(rows: DataFrame, keys: list[str], order: str, wanted: Column, margin: int) -> DataFrame:
    """Rows from ``margin`` places before a series' first wanted row to ``margin`` after its last; series without one go."""
    w = W.partitionBy(*keys)
    placed = rows.withColumn("_p", F.row_number().over(w.orderBy(order)))
    edges = placed.withColumn("_a", F.min(F.when(wanted, F.col("_p"))).over(w)).withColumn("_b", F.max(F.when(wanted, F.col("_p"))).over(w))
    return edges.where(F.col("_p").between(F.col("_a") - margin, F.col("_b") + margin)).drop("_p", "_a", "_b")


def tumbling_in_islands(rows: DataFrame, keys: list[str], t: str, length: int) -> DataFrame:
    """Non-overlapping windows of ``length`` rows inside runs of consecutive t; shorter rests go.

    Adds island, window (number within the island) and place (number within the window).
    """
    w = W.partitionBy(*keys).orderBy(t)
    opens = F.when(F.col(t) - F.lag(t).over(w) == 1, 0).otherwise(1)
    islands = rows.withColumn("_open", opens).withColumn("island", F.sum("_open").over(w).cast("int")).drop("_open")
    rank = F.row_number().over(W.partitionBy(*keys, "island").orderBy(t)) - 1
    cut = islands.withColumn("_r", rank).withColumn("window", F.floor(F.col("_r") / length).cast("int")).withColumn("place", (F.col("_r") % length).cast("int")).drop("_r")
    full = F.count(F.lit(1)).over(W.partitionBy(*keys, "island", "window"))
    return cut.withColumn("_n", full).where(F.col("_n") == length).drop("_n")


def frequent_single_label(labels: DataFrame, row: str, label: str, least: int) -> DataFrame:
    """Rows with exactly one label among those that at least ``least`` rows have: (row, label)."""
    frequent = labels.groupBy(label).agg(F.count_distinct(row).alias("_n")).where(F.col("_n") >= least).select(label)
    kept = labels.join(frequent, label, "left_semi").select(row, label).distinct()
    return kept.groupBy(row).agg(F.min(label).alias(label), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 1).drop("_n")


def observed_with_outcome(records: DataFrame, outcomes: DataFrame, observations: DataFrame, key: str) -> DataFrame:
    """Records that have an outcome and at least one observation; null keys go."""
    return records.where(F.col(key).isNotNull()).join(outcomes, key, "inner").join(observations.select(key).distinct(), key, "left_semi")


def pivot_means(long: DataFrame, keys: list[str], column: str, values: list, value: str) -> DataFrame:
    """One column a listed value of ``column`` with its mean; listing them saves the pass that would look for them."""
    return long.groupBy(*keys).pivot(column, values).agg(F.avg(value))


def stratified_holdout(rows: DataFrame, y: str, order: Column, share: float, bucket: Column | None = None) -> DataFrame:
    """Adds is_test: in each class the first max(1, round(share * n)) rows in the given order.

    ``bucket`` is a whole number that rises with the order and cuts a class into parts; places are then counted within
    a part behind the sizes of those before it, so a class of any size is spread over tasks.
    """
    cut = rows.withColumn("_b", F.lit(0) if bucket is None else bucket)
    counts = cut.groupBy(y, "_b").agg(F.count(F.lit(1)).alias("_c"))
    of_class = W.partitionBy(y)  # a row a bucket
    before = F.coalesce(F.sum("_c").over(of_class.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = counts.select(y, "_b", before.alias("_before"), F.greatest(F.round(F.sum("_c").over(of_class) * share), F.lit(1)).alias("_quota"))
    place = F.row_number().over(W.partitionBy(y, "_b").orderBy(order))
    return cut.withColumn("_r", place).join(sizes, [y, "_b"]).withColumn("is_test", F.col("_before") + F.col("_r") <= F.col("_quota")).drop("_b", "_r", "_before", "_quota")


def group_holdout(rows: DataFrame, group: str, order: Column, share: float) -> DataFrame:
    """Adds is_test for whole groups: the first max(1, round(share * groups)) of them in the given order."""
    groups = rows.select(group).distinct().withColumn("_o", order)
    n = groups.count()
    held = groups.orderBy("_o", group).limit(max(1, int(n * share + 0.5))).select(group, F.lit(True).alias("is_test"))
    return rows.join(held, group, "left").withColumn("is_test", F.coalesce("is_test", F.lit(False)))


def clean_sentinels(c: Column, age_limit: float | None = None, age_value: float | None = None, missing: float = -1.0) -> Column:
    """The missing sentinel as NULL; values over a limit as one fixed value."""
    out = F.when(c != missing, c)
    return F.when(out > age_limit, F.lit(age_value)).otherwise(out) if age_limit is not None else out
