"""Whether a data set can show what fusing statics and series is worth, judged by baselines alone."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import balanced_accuracy
from ..functions.scalar import uniform
from ..operators import boost, design
from ..operators.etl import group_holdout
from ..operators.sampling import exact_subsample

#: Bars: statics over chance, series on statics, and finer over coarse summaries; rows that are looked at.
INFORMATIVE, EXOGENEITY, REGIME, MOST_ROWS = 0.03, 0.25, 0.05, 1500


@dataclass
class Screen:
    static_lift: float
    exogeneity: float
    regime_gap: float
    notes: list[str] = field(default_factory=list)

    @property
    def informative(self) -> bool:
        return self.static_lift >= INFORMATIVE

    @property
    def exogenous(self) -> bool:
        return self.exogeneity < EXOGENEITY

    @property
    def temporal(self) -> bool:
        return self.regime_gap >= REGIME

    @property
    def passes(self) -> bool:
        return self.informative and self.exogenous and self.temporal


def r_squared(rows: DataFrame, y: str = "y", predicted: str = "prediction") -> float:
    """1 less the share of the variance left; 0 where there is no variance."""
    row = rows.agg(F.sum(F.pow(F.col(y) - F.col(predicted), 2)).alias("e"), F.var_pop(y).alias("v"), F.count(F.lit(1)).alias("n")).first()
    return 1 - row.e / (row.v * row.n) if row.n and row.v and row.v > 0 else 0.0


def chance(labels: DataFrame, task: str, y: str = "y") -> float:
    """What the metric gives for knowing nothing."""
    return 0.0 if task == "regression" else 1.0 / max(labels.select(y).distinct().count(), 1)


def baseline_score(train: DataFrame, test: DataFrame, task: str, params: boost.Params) -> float:
    """A small boosted baseline on (row_id, x, y): R2, or balanced accuracy for classes.  Missing features count as 0."""
    ready = lambda d: d.select("row_id", design.zero_missing(F.col("x")).alias("static"), F.array().cast("array<array<double>>").alias("series"), F.col("y").alias("y"), F.col("y").alias("label"))
    train, test = ready(train), ready(test)
    if task == "regression":
        return r_squared(boost.fit_regressor(train, params).predict(test))
    model = boost.fit_classifier(train, params)
    return balanced_accuracy(model.predict(test).select("y", F.col("prediction").alias("predicted"))).first()[0]


def held_out(rows: DataFrame, seed: int, share: float = 0.3, group: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Training and test rows, by whole groups where there are any: statics of a known subject would be recalled."""
    if group:
        cut = group_holdout(rows, group, uniform(seed, F.col(group)), share)
    else:
        cut = rows.withColumn("is_test", uniform(seed, F.col("row_id")) < share)
    return cut.where("not is_test").drop("is_test"), cut.where("is_test").drop("is_test")


def screen(rows: DataFrame, task: str, seeds: int = 3, group: str | None = None, params: boost.Params | None = None) -> Screen:
    """Mean over ``seeds`` splits of up to ``MOST_ROWS`` rows (row_id, static, series, y): three measures, each judged.

    static_lift: a baseline on the statics over chance; exogeneity: the best R2 of any static column from summaries of
    the series; regime_gap: the best finer representation of the series less one summary.
    """
    params = params or boost.Params(rounds=10, depth=3, rate=0.3)
    width = rows.select(F.max(F.size("static"))).first()[0] or 0
    has_series = (rows.select(F.max(F.size("series"))).first()[0] or 0) > 0
    got = []
    notes = (["split by subject"] if group else []) + ([] if width else ["no static block at all"]) + ([] if has_series else ["no series"])
    n = rows.count()
    for seed in range(seeds):
        some = boost.stored(exact_subsample(rows, "row_id", MOST_ROWS / n, seed) if n > MOST_ROWS else rows)
        x = lambda name, d: design.represented(d, name)
        alone = design.drop_static(some)
        score = lambda d, t=task: baseline_score(*held_out(d, seed, group=group), t, params)  # noqa: E731, B023
        lift = score(x("static_only", some)) - chance(some, task) if width else 0.0
        worst = 0.0
        for i in range(width if has_series else 0):
            v = F.get("static", F.lit(i))
            known = some.withColumn("y", v.cast("double")).where("y is not null")
            row = known.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("y").alias("s")).first()
            if row.n >= 50 and row.s and row.s > 0:
                worst = max(worst, score(x("agg", design.drop_static(known)), "regression"))
        gap = max(score(x(name, alone)) for name in ("wagg4", "wagg8", "raw_flat")) - score(x("agg", alone)) if has_series else 0.0
        got.append((lift, worst, gap))
    mean = [round(sum(g[i] for g in got) / len(got), 4) for i in range(3)]
    out = Screen(*mean, notes)
    out.notes += [text for ok, text in ((out.informative, "statics at chance: nothing to fuse"), (out.exogenous, "statics can be read off the series"), (out.temporal, "a fixed summary loses nothing")) if not ok]
    return out
