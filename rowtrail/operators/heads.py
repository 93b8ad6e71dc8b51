"""Classifiers on one fixed feature bank: each head fits (row_id, x, label) and predicts a class for rows with x.

Labels are whole numbers from 0 on.  ``x`` is an array of doubles; features are standardised by the training rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ridge import fit_ridge, signed_targets

#: Bytes of training features that the nearest-neighbour head hands to every task; beyond that it refuses.
MOST_NEIGHBOUR_BYTES = 256 << 20
Head = Callable[[DataFrame, DataFrame, int], DataFrame]


def _ml(make: Callable[[int, int], object]) -> Head:
    def head(train: DataFrame, test: DataFrame, classes: int) -> DataFrame:
        width = train.select(F.size("x").alias("w")).first().w
        vectors = lambda d: d.select("row_id", array_to_vector("x").alias("raw"), *(["label"] if "label" in d.columns else []))
        scale = StandardScaler(withMean=True, inputCol="raw", outputCol="features").fit(vectors(train))
        model = make(classes, width).fit(scale.transform(vectors(train)).withColumn("label", F.col("label").cast("double")))
        return model.transform(scale.transform(vectors(test)).drop("label")).select("row_id", F.col("prediction").cast("int").alias("predicted"))

    return head


def _ridge(train: DataFrame, test: DataFrame, classes: int) -> DataFrame:
    target = signed_targets(F.col("label"), list(range(classes)))
    scored = fit_ridge(train.withColumn("t", target)).margins(test)
    if classes == 2:
        return scored.select("row_id", (F.get("margin", F.lit(0)) > 0).cast("int").alias("predicted"))
    return scored.select("row_id", (F.array_position("margin", F.array_max("margin")) - 1).cast("int").alias("predicted"))


def _neighbours(k: int) -> Head:
    def head(train: DataFrame, test: DataFrame, classes: int) -> DataFrame:
        """Majority of the k nearest training rows; ties go to the nearer one.  The training block is broadcast, which its
        size must allow; the rows to judge stay where they are."""
        shape = train.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("w")).first()
        if 8 * shape.n * shape.w > MOST_NEIGHBOUR_BYTES:
            raise ValueError("too many training rows for nearest neighbours")
        rows = train.select("x", "label").toArrow()
        x = np.asarray(rows.column("x").combine_chunks().flatten(), float).reshape(shape.n, shape.w)
        center, scale = x.mean(0), np.where(x.std(0) > 1e-12, x.std(0), 1)
        shared = train.sparkSession.sparkContext.broadcast(((x - center) / scale, np.asarray(rows.column("label")).astype(int)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, labels = shared.value
            square = (known * known).sum(1)
            for b in batches:
                if b.num_rows:
                    v = (np.asarray(b.column("x").flatten(), float).reshape(b.num_rows, -1) - center) / scale
                    near = np.argsort(square - 2 * v @ known.T, axis=1, kind="stable")[:, :k]
                    votes = np.zeros((len(v), classes))
                    for j in range(near.shape[1]):
                        votes[np.arange(len(v)), labels[near[:, j]]] += 1 + (1e-3 / (j + 1))
                    yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array(votes.argmax(1), pa.int32())], names=["row_id", "predicted"])

        return test.select("row_id", "x").mapInArrow(run, f"row_id {dict(test.dtypes)['row_id']}, predicted int")

    return head


HEADS: dict[str, Head] = {
    "ridge": _ridge,
    "logreg": _ml(lambda k, w: LogisticRegression(regParam=0.01, maxIter=100)),
    "linsvc": _ml(lambda k, w: OneVsRest(classifier=LinearSVC(regParam=0.01, maxIter=50))),
    "boosted": _ml(lambda k, w: OneVsRest(classifier=GBTClassifier(maxIter=20, maxDepth=3, seed=0))),
    "forest": _ml(lambda k, w: RandomForestClassifier(numTrees=100, maxDepth=10, seed=0)),
    "knn": _neighbours(5),
    "mlp": _ml(lambda k, w: MultilayerPerceptronClassifier(layers=[w, 64, k], maxIter=100, seed=0)),
}


def compare_heads(train: DataFrame, test: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(head, balanced_accuracy) of heads on the same features; ``test`` has labels too."""
    from ..functions.metrics import balanced_accuracy

    classes = train.agg(F.max("label")).first()[0] + 1
    out = None
    for name in names or list(HEADS):
        if name not in HEADS:
            raise ValueError(f"unknown head {name!r}; known: {', '.join(HEADS)}")
        got = HEADS[name](train, test, classes).join(test.select("row_id", F.col("label").alias("y")), "row_id")
        row = balanced_accuracy(got).select(F.lit(name).alias("head"), "balanced_accuracy")
        out = row if out is None else out.unionByName(row)
    return out
