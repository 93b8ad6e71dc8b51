"""Grids of result cells: data sets x sizes x seeds x models, each written as soon as it is done."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import balanced_accuracy
from ..operators import boost, design
from ..operators.sampling import capped_subsample
from ..sources.generators import SCENARIOS
from . import sinks

Fit = Callable[[DataFrame, DataFrame], dict[str, float]]
#: Test rows of a scenario come from seeds that no training rows have.
TEST_SEED = 10_000


def boosted(name: str | None, params: boost.Params) -> Fit:
    """Fit on a representation (None: the raw blocks) and score the test rows."""

    def fit(train: DataFrame, test: DataFrame) -> dict[str, float]:
        if name is not None:
            train, test = (design.represented(d, name).select("row_id", F.col("x").alias("static"), F.array().cast("array<array<double>>").alias("series"), "label") for d in (train, test))
        train, test = boost.stored(train), boost.stored(test)
        if dict(train.dtypes)["label"] == "double":
            got = boost.fit_regressor(train.withColumn("y", F.col("label")), params).predict(test)
            return {"rmse": got.agg(F.sqrt(F.avg(F.pow(F.col("label") - F.col("prediction"), 2)))).first()[0]}
        got = boost.fit_classifier(train, params).predict(test)
        return {"balanced_accuracy": balanced_accuracy(got.select(F.col("label").alias("y"), F.col("prediction").alias("predicted"))).first()[0]}

    return fit


def registry(params: boost.Params | None = None) -> dict[str, Fit]:
    """Arms by name: the raw blocks and each representation under the same settings."""
    p = params or boost.Params()
    return {"ours": boosted(None, p), **{n: boosted(n, p) for n in design.REPRESENTATIONS}}


def chosen(arms: dict[str, Fit], names: list[str]) -> dict[str, Fit]:
    unknown = [n for n in names if n not in arms]
    if unknown:
        raise ValueError(f"unknown arms: {', '.join(unknown)}; known: {', '.join(arms)}")
    return {n: arms[n] for n in names}


def run_cell(train: DataFrame, test: DataFrame, fit: Fit) -> dict:
    start = time.monotonic()
    metrics = fit(train, test)
    return {"fit_seconds": time.monotonic() - start, "metrics": metrics}


def run_scenarios(spark: SparkSession, path: str, scenarios: list[str], sizes: list[int], seeds: list[int], arms: dict[str, Fit], test_rows: int = 1000) -> dict[str, str]:
    """Every cell of the grid that isn't in the table at ``path`` yet is run and appended to it.

    Returns what could not be run, and why; the other cells go on.
    """
    done, failed = sinks.done_cells(spark, path), {}
    for name in scenarios:
        if name not in SCENARIOS:
            failed[name] = "unknown scenario"
            continue
        for seed in seeds:
            test = None
            for size in sizes:
                for arm, fit in arms.items():
                    if (name, arm, size, seed) in done:
                        continue
                    test = test if test is not None else boost.stored(SCENARIOS[name](spark, n=test_rows, seed=TEST_SEED + seed))
                    try:
                        cell = run_cell(boost.stored(SCENARIOS[name](spark, n=size, seed=seed)), test, fit)
                    except ValueError as e:
                        failed[f"{name}/{arm}/{size}/{seed}"] = str(e)
                        continue
                    sinks.append_cell({"dataset": name, "model": arm, "n_train": size, "seed": seed, **cell}, spark, path)
    return failed


def run_datasets(spark: SparkSession, path: str, datasets: dict[str, tuple[DataFrame, DataFrame]], sizes: list[int], seeds: list[int], arms: dict[str, Fit]) -> dict[str, str]:
    """The same over given (train, test) rows, subsampled by class to each size (0 for all rows)."""
    done, failed = sinks.done_cells(spark, path), {}
    for name, (train, test) in datasets.items():
        for seed in seeds:
            for size in sizes:
                some = boost.stored(capped_subsample(train, "row_id", "label", size, seed + 7919))
                n = some.count()
                for arm, fit in arms.items():
                    if (name, arm, n, seed) in done:
                        continue
                    try:
                        cell = run_cell(some, test, fit)
                    except ValueError as e:
                        failed[f"{name}/{arm}/{n}/{seed}"] = str(e)
                        continue
                    sinks.append_cell({"dataset": name, "model": arm, "n_train": n, "seed": seed, **cell}, spark, path)
    return failed


def clinical_names(splits: DataFrame, statics: list[str], channels: list[str], text: str = "text", gain: str = "gain") -> DataFrame:
    """(text, family, gain) of splits with columns and channels by their names, the family being the text before its window."""
    said = F.col(text)
    for i, s in enumerate(statics):
        said = F.replace(said, F.lit(f"static[{i}]"), F.lit(s))
    for i, c in enumerate(channels):
        said = F.regexp_replace(said, rf"\(ch={i}\b", f"({c}")
    return splits.select(said.alias("text"), F.trim(F.regexp_extract(said, r"^[^,<]*", 0)).alias("family"), F.col(gain).alias("gain"))


def demo(spark: SparkSession, rows: int = 300, rounds: int = 10) -> DataFrame:
    """(model, balanced_accuracy): one summary a series against the raw series, on the order of two shapes."""
    params = boost.Params(rounds=rounds, depth=4, rate=0.3, draws=boost.Draws(intervals=8, shapelets=24))
    train, test = (boost.stored(SCENARIOS["bump_order"](spark, n=rows, seed=s)) for s in (0, TEST_SEED))
    got = [(n, boosted(r, params)(train, test)["balanced_accuracy"]) for n, r in (("summary", "agg"), ("series", None))]
    return spark.createDataFrame(got, "model string, balanced_accuracy double")
