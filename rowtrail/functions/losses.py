"""Losses as expressions: the first score, gradients and hessians, link and metric."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import clip, sigmoid, softmax


@dataclass(frozen=True)
class Loss:
    """y is a double (a class number for the classifiers); raw an array of one score per output."""

    name: str
    outputs: int = 1

    def init_scores(self, rows: DataFrame, y: str = "y") -> list[float]:
        """The first score of each output, in one aggregate pass."""
        if self.name == "softmax":
            counts = {int(r[0]): r[1] for r in rows.groupBy(y).count().collect()}
            n = sum(counts.values())
            return [math.log(max(counts.get(k, 0) / n, 1e-6)) for k in range(self.outputs)]
        mean = rows.agg(F.avg(y)).first()[0]
        if self.name == "logistic":
            p = min(max(mean, 1e-6), 1 - 1e-6)
            return [math.log(p / (1 - p))]
        return [mean]

    def gradients(self, y: Column, raw: Column) -> Column:
        """An array of structs (g, h), one per output."""
        if self.name == "squared":
            return F.array(F.struct((raw[0] - y).alias("g"), F.lit(1.0).alias("h")))
        if self.name == "logistic":
            p = sigmoid(raw[0])
            return F.array(F.struct((p - y).alias("g"), F.greatest(p * (1 - p), F.lit(1e-16)).alias("h")))
        return F.transform(softmax(raw), lambda p, k: F.struct((p - (k == y.cast("int")).cast("double")).alias("g"), F.greatest(p * (1 - p), F.lit(1e-16)).alias("h")))

    def transform(self, raw: Column) -> Column:
        """Predictions: the score itself, [1 - p, p], or class probabilities."""
        if self.name == "squared":
            return raw
        if self.name == "logistic":
            p = sigmoid(raw[0])
            return F.array(1 - p, p)
        return softmax(raw)

    @property
    def metric_name(self) -> str:
        return {"squared": "rmse", "logistic": "logloss", "softmax": "mlogloss"}[self.name]

    def metric(self, y: Column, raw: Column) -> Column:
        """The metric as an aggregate."""
        if self.name == "squared":
            return F.sqrt(F.avg((raw[0] - y) * (raw[0] - y)))
        if self.name == "logistic":
            p = clip(sigmoid(raw[0]), 1e-15, 1 - 1e-15)
            return -F.avg(y * F.log(p) + (1 - y) * F.log(1 - p))
        return -F.avg(F.log(clip(F.get(softmax(raw), y.cast("int")), 1e-15, 1.0)))


def squared_error() -> Loss:
    return Loss("squared")


def logistic() -> Loss:
    return Loss("logistic")


def softmax_loss(classes: int) -> Loss:
    """For three classes or more; two are what ``logistic`` is for."""
    if classes < 3:
        raise ValueError("softmax needs at least 3 classes")
    return Loss("softmax", classes)
