"""Evaluation metrics as aggregates over (truth, score) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def roc_auc(rows: DataFrame, y: str = "y", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by ranks that are averaged over ties; NULL where one class is absent.

    Rows are first counted per distinct score, so the ranking runs over distinct scores only.
    """
    by = by or []
    counts = rows.groupBy(*by, score).agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) == 0).cast("long")).alias("neg"))
    below = F.coalesce(F.sum("neg").over(W.partitionBy(*by).orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("wins", F.col("pos") * (below + F.col("neg") / F.lit(2.0)))
    total = F.sum("pos") * F.sum("neg")
    return ranked.groupBy(*by).agg(F.when(total > 0, F.sum("wins") / total).alias("auc"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def binary_metrics(rows: DataFrame, y: str = "y", predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """accuracy, precision, recall and f1 of 0/1 predictions; a division by nothing gives 0."""
    t, p = F.col(y) == 1, F.col(predicted) == 1
    tp, fp, fn, hit = (F.sum(c.cast("long")) for c in (t & p, ~t & p, t & ~p, t == p))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return rows.groupBy(*(by or [])).agg(
        ratio(hit, F.count(F.lit(1))).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1")
    )


def regression_metrics(rows: DataFrame, y: str = "y", predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """rmse, mae and r2 (NULL where y doesn't vary)."""
    e, v = F.col(predicted) - F.col(y), F.col(y)
    spread = F.var_pop(v)
    return rows.groupBy(*(by or [])).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.when(spread > 0, 1 - F.avg(e * e) / spread).alias("r2"))


def balanced_accuracy(rows: DataFrame, y: str = "y", predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """Mean recall over the classes that occur in the truth."""
    by = by or []
    recall = rows.groupBy(*by, y).agg(F.avg((F.col(y) == F.col(predicted)).cast("double")).alias("recall"))
    return recall.groupBy(*by).agg(F.avg("recall").alias("balanced_accuracy"))


def one_vs_rest_auc(rows: DataFrame, y: str = "y", scores: str = "scores", by: list[str] | None = None) -> DataFrame:
    """Mean AUC over classes, each against the rest by its own column of ``scores``; classes without rows don't count."""
    by = by or []
    long = rows.select(*by, F.col(y), F.posexplode(scores).alias("class", "score")).withColumn("truth", (F.col(y) == F.col("class")).cast("int"))
    return roc_auc(long, "truth", "score", [*by, "class"]).groupBy(*by).agg(F.avg("auc").alias("auc"))
