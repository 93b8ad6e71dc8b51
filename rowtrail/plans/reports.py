"""Reports over a table of results: dataset, model, seed, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def one_row_a_cell(results: DataFrame, keys: list[str]) -> DataFrame:
    """The rows as they are, or an error where a cell of ``keys`` has several."""
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    return results.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.lit("a result cell has several rows"))).otherwise(F.lit(True)).cast("boolean")).drop("_n")


def summarise(results: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Mean, population deviation and number of scores."""
    return results.groupBy(*keys).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("sd"), F.count(score).alias("n"))


def paired_margins(results: DataFrame, arm: str, base: str, keys: list[str], model: str = "model", score: str = "score") -> DataFrame:
    """arm minus base in points, per shared (keys); keys are usually dataset and seed.  An arm with two rows is an error."""
    of = lambda f, m: f(F.when(F.col(model) == m, F.col(score)))
    both = results.where(F.col(model).isin(arm, base)).groupBy(*keys).agg(of(F.max, arm).alias("_a"), of(F.max, base).alias("_b"), F.greatest(of(F.count, arm), of(F.count, base)).alias("_n"))
    once = F.when(F.col("_n") > 1, F.raise_error(F.lit("a result cell has several rows"))).otherwise(F.lit(True)).cast("boolean")
    return both.where(once).where("_a is not null and _b is not null").select(*keys, (100 * (F.col("_a") - F.col("_b"))).alias("margin"))


def unpaired(results: DataFrame, arm: str, base: str, keys: list[str], model: str = "model") -> DataFrame:
    """Keys that only one of the two has."""
    a, b = (results.where(F.col(model) == m).select(*keys).distinct() for m in (arm, base))
    return a.join(b, keys, "left_anti").withColumn("only", F.lit(arm)).unionByName(b.join(a, keys, "left_anti").withColumn("only", F.lit(base)))


def competition_ranks(results: DataFrame, cell: list[str], model: str = "model", score: str = "score") -> DataFrame:
    """1 for the best score of a cell and so on; equal scores in the order of the models' names."""
    w = W.partitionBy(*cell).orderBy(F.col(score).desc(), model)
    return results.withColumn("rank", F.row_number().over(w))


def mean_ranks(results: DataFrame, cell: list[str], model: str = "model", score: str = "score") -> DataFrame:
    return competition_ranks(results, cell, model, score).groupBy(model).agg(F.avg("rank").alias("mean_rank"), F.sum((F.col("rank") == 1).cast("long")).alias("wins"))


def sweep(results: DataFrame, baseline: str, dataset: str = "dataset", arm: str = "model", score: str = "score") -> DataFrame:
    """Each arm of a sweep against the baseline: mean lift in points, datasets it lifts, and whether they are a majority."""
    cells = results.groupBy(dataset, arm).agg(F.avg(score).alias("s"))
    base = cells.where(F.col(arm) == baseline).select(dataset, F.col("s").alias("b"))
    lifts = cells.where(F.col(arm) != baseline).join(base, dataset).withColumn("lift", 100 * (F.col("s") - F.col("b")))
    return lifts.groupBy(arm).agg(
        F.avg("lift").alias("mean_lift"),
        F.sum((F.col("lift") > 0).cast("long")).alias("lifted"),
        F.count(F.lit(1)).alias("datasets"),
        (F.sum((F.col("lift") > 0).cast("long")) * 2 > F.count(F.lit(1))).alias("majority"),
    )


def sweep_optimism(results: DataFrame, baseline: str, dataset: str = "dataset", arm: str = "model", score: str = "score") -> DataFrame:
    """What picking an arm per dataset would claim beyond the best single arm, in points."""
    cells = results.groupBy(dataset, arm).agg(F.avg(score).alias("s"))
    base = cells.where(F.col(arm) == baseline).select(dataset, F.col("s").alias("b"))
    lifts = cells.where(F.col(arm) != baseline).join(base, dataset).withColumn("lift", 100 * (F.col("s") - F.col("b")))
    picked = lifts.groupBy(dataset).agg(F.max("lift").alias("top")).agg(F.avg("top").alias("picked"))
    single = lifts.groupBy(arm).agg(F.avg("lift").alias("m")).agg(F.max("m").alias("honest"))
    return picked.join(single, F.lit(True)).select("picked", "honest", (F.col("picked") - F.col("honest")).alias("optimism"))


def nominal_size(n: Column, sizes: tuple[int, ...] = (100, 250, 500, 1000)) -> Column:
    """The nominal training size within max(5, 5 %) of n, else 0 for a full set."""
    out = F.lit(0)
    for s in reversed(sizes):
        out = F.when(F.abs(n - s) <= max(5, 0.05 * s), F.lit(s)).otherwise(out)
    return out


def importance(splits: DataFrame, family: str = "family", gain: str = "gain") -> DataFrame:
    """Total gain of each feature family, the largest first."""
    return splits.groupBy(family).agg(F.sum(gain).alias("gain")).orderBy(F.col("gain").desc(), family)


def timing(results: DataFrame, model: str = "model", seconds: str = "fit_seconds") -> DataFrame:
    return results.groupBy(model).agg(F.avg(seconds).alias("mean_seconds"), F.max(seconds).alias("max_seconds")).orderBy("mean_seconds")


def verdict(value: Column, passes: float, fails: float) -> Column:
    """PASS from ``passes`` on, FAIL up to ``fails``, MARGINAL between; NULL is 'not judged'."""
    return F.when(value.isNull(), F.lit("not judged")).when(value >= passes, F.lit("PASS")).when(value <= fails, F.lit("FAIL")).otherwise(F.lit("MARGINAL"))
