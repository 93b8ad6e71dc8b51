"""Pre-registered verdicts over result cells: each rule is one DataFrame plan with its bars as parameters.

A cell is (dataset, size, seed, model, score), the score being the dataset's headline metric.  Margins are in points,
a hundredth of the score.  What isn't there is reported as such and never judged: a verdict over nothing is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELL = ["dataset", "size"]


def headline(results: DataFrame, metric_of: dict[str, str], prefix_of: dict[str, str] | None = None) -> DataFrame:
    """(dataset, size, seed, model, score) of results with a map column ``metrics``: the metric fixed for the dataset.

    A dataset without one is an error, never a default.  Scores that are missing or not finite are left out.
    """
    chosen = F.lit(None).cast("string")
    for start, metric in (prefix_of or {}).items():
        chosen = F.when(F.col("dataset").startswith(start), F.lit(metric)).otherwise(chosen)
    for name, metric in metric_of.items():
        chosen = F.when(F.col("dataset") == name, F.lit(metric)).otherwise(chosen)
    known = F.coalesce(chosen, F.raise_error(F.concat(F.lit("no headline metric for "), F.col("dataset"))).cast("string"))
    rows = results.select("dataset", F.col("n_train").alias("size"), "seed", "model", F.element_at("metrics", known).alias("score"))
    return rows.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf")))


def refuse_overlap(cells: DataFrame, used: list[str]) -> DataFrame:
    """The cells, or an error if any belongs to a dataset that suggested the hypotheses."""
    bad = F.array_sort(F.array_intersect(F.collect_set("dataset"), F.array(*[F.lit(u) for u in used])))
    seen = cells.agg(F.array_join(bad, ", ").alias("bad")).first().bad
    if seen:
        raise ValueError(f"used before: {seen}")
    return cells


def wide_means(cells: DataFrame, models: list[str], by: list[str] = CELL) -> DataFrame:
    """Mean score of each named model as a column of its own, NULL where it has no cell."""
    return cells.groupBy(*by).agg(*[F.avg(F.when(F.col("model") == m, F.col("score"))).alias(m) for m in models])


def three_way(value: Column, passes: float, fails: float, middle: str, strict: bool = True) -> Column:
    """PASS from ``passes`` on, FAIL under ``fails`` (or at it, if not strict), else ``middle``; NULL for NULL."""
    failed = value < fails if strict else value <= fails
    return F.when(value >= passes, F.lit("PASS")).when(failed, F.lit("FAIL")).when(value.isNotNull(), F.lit(middle))


# ---------------------------------------------------------------- the first hypotheses


def informative_cells(cells: DataFrame, ours: str, plain: str, static: str, least: float) -> DataFrame:
    """(dataset, size, margin, gap, informative): margin over the plain baseline and gap to statics alone, in points, where
    all three have cells; a series is informative where the plain baseline gains ``least`` points over statics."""
    m = wide_means(cells, [ours, plain, static]).where(F.col(ours).isNotNull() & F.col(plain).isNotNull() & F.col(static).isNotNull())
    return m.select(*CELL, (100 * (F.col(ours) - F.col(plain))).alias("margin"), (100 * (F.col(ours) - F.col(static))).alias("gap"), (100 * (F.col(plain) - F.col(static)) >= least).alias("informative"))


def first_verdicts(cells: DataFrame, ours: str, plain: str, static: str, rivals: list[str], informative: float = 2.0, win: float = 2.0, small: tuple[int, ...] = (100, 250)) -> DataFrame:
    """(hypothesis, value, n, verdict) of four rules.

    H1: share of informative cells won by ``win`` points, 60 % passes, under 50 % fails.  H2: at small sizes the margin
    is negative on no more than half of them.  H3: on datasets without statics, the median over datasets of (our median
    over sizes less the best rival cell), -5 passes, under -10 fails.  H4: no uninformative cell over 4 points worse
    than statics alone.
    """
    judged = informative_cells(cells, ours, plain, static, informative)
    share = judged.where("informative").agg(F.avg((F.col("margin") >= win).cast("double")).alias("value"), F.count(F.lit(1)).alias("n"))
    h1 = share.select(F.lit("H1").alias("hypothesis"), "value", "n", three_way(F.col("value"), 0.6, 0.5, "INCONCLUSIVE").alias("verdict"))
    few = judged.where("informative").where(F.col("size").isin(*small)).agg(F.sum((F.col("margin") < 0).cast("double")).alias("value"), F.count(F.lit(1)).alias("n"))
    h2 = few.select(F.lit("H2").alias("hypothesis"), "value", "n", F.when(F.col("n") > 0, F.when(F.col("value") > F.col("n") / 2, F.lit("FAIL")).otherwise(F.lit("PASS"))).alias("verdict"))
    mixed = cells.where(F.col("model") == static).select("dataset").distinct()
    alone = cells.join(mixed, "dataset", "left_anti").groupBy(*CELL, "model").agg(F.avg("score").alias("mean"))
    gaps = alone.groupBy("dataset").agg(F.percentile(F.when(F.col("model") == ours, F.col("mean")), F.lit(0.5)).alias("a"), F.max(F.when(F.col("model").isin(*rivals), F.col("mean"))).alias("b"))
    gap = gaps.select((100 * (F.col("a") - F.col("b"))).alias("g")).agg(F.percentile("g", F.lit(0.5)).alias("value"), F.count("g").alias("n"))
    h3 = gap.select(F.lit("H3").alias("hypothesis"), "value", "n", three_way(F.col("value"), -5, -10, "MARGINAL").alias("verdict"))
    harm = judged.where("not informative").agg(F.sum((F.col("gap") < -4).cast("double")).alias("value"), F.count(F.lit(1)).alias("n"))
    h4 = harm.select(F.lit("H4").alias("hypothesis"), "value", "n", F.when(F.col("n") > 0, F.when(F.col("value") > 0, F.lit("FAIL")).otherwise(F.lit("PASS"))).alias("verdict"))
    return h1.unionByName(h2).unionByName(h3).unionByName(h4)


def headroom(cells: DataFrame, static: str) -> DataFrame:
    """(dataset, size, lift): points of the best model that uses the series over statics alone."""
    means = cells.groupBy(*CELL, "model").agg(F.avg("score").alias("mean"))
    both = means.groupBy(*CELL).agg(F.max(F.when(F.col("model") != static, F.col("mean"))).alias("top"), F.max(F.when(F.col("model") == static, F.col("mean"))).alias("s"))
    return both.where("top is not null and s is not null").select(*CELL, (100 * (F.col("top") - F.col("s"))).alias("lift"))


def baseline_table(cells: DataFrame, ours: str, baselines: list[str], plain: str, oracle: str, lower_is_better: bool = False) -> DataFrame:
    """(dataset, size, best, ours, ahead, vs_plain, vs_oracle): the best baseline of each cell, whether ours leads it, and the
    gains over the plain baseline and the oracle, whose sign counts improvement as positive."""
    means = cells.groupBy(*CELL, "model").agg(F.avg("score").alias("mean"))
    sign = -1.0 if lower_is_better else 1.0
    best = F.max_by("model", F.when(F.col("model").isin(*baselines), F.struct((sign * F.col("mean")).alias("m"), F.col("model").alias("name"))))
    of = {m: F.max(F.when(F.col("model") == m, F.col("mean"))) for m in (ours, plain, oracle)}
    top = F.max(F.when(F.col("model").isin(*baselines), sign * F.col("mean")))
    t = means.groupBy(*CELL).agg(best.alias("best"), top.alias("top"), of[ours].alias("a"), of[plain].alias("b"), of[oracle].alias("c"))
    return t.select(*CELL, "best", F.col("a").alias("ours"), (sign * F.col("a") > F.col("top")).alias("ahead"), (sign * (F.col("a") - F.col("b"))).alias("vs_plain"), (sign * (F.col("a") - F.col("c"))).alias("vs_oracle"))


# ---------------------------------------------------------------- regimes and ranks


def regimes(cells: DataFrame, plain: str, rivals: list[str], shape: float = 5.0, summary: float = 2.0) -> DataFrame:
    """(dataset, size, loss, regime): points that the best rival gains over the plain baseline, and what that says of the cell.

    ``shape`` points or more: the shape of the series matters; up to ``summary``: a summary holds it all.
    """
    m = cells.groupBy(*CELL, "model").agg(F.avg("score").alias("mean")).groupBy(*CELL).agg(
        F.max(F.when(F.col("model").isin(*rivals), F.col("mean"))).alias("top"), F.max(F.when(F.col("model") == plain, F.col("mean"))).alias("plain")
    )
    loss = 100 * (F.col("top") - F.col("plain"))
    label = F.when(loss >= shape, F.lit("shape")).when(loss <= summary, F.lit("summary")).when(loss.isNotNull(), F.lit("ambiguous")).otherwise(F.lit("unclassified"))
    return m.select(*CELL, loss.alias("loss"), label.alias("regime"))


def credited(cells: DataFrame, twins: dict[str, str]) -> DataFrame:
    """(dataset, size, model, mean) with models that are one competitor credited with the better of them."""
    name = F.col("model")
    for twin, kept in twins.items():
        name = F.when(F.col("model") == twin, F.lit(kept)).otherwise(name)
    return cells.groupBy(*CELL, "model").agg(F.avg("score").alias("mean")).groupBy(*CELL, name.alias("model")).agg(F.max("mean").alias("mean"))


def regime_verdicts(cells: DataFrame, ours: str, plain: str, rivals: list[str], win: float = 2.0) -> DataFrame:
    """(regime, cells, wins, harmed): cells of each regime, those won by ``win`` points over the plain baseline, those lost by more."""
    margins = wide_means(cells, [ours, plain]).where(F.col(ours).isNotNull()).select(*CELL, (100 * (F.col(ours) - F.col(plain))).alias("margin"))
    both = regimes(cells, plain, rivals).join(margins, CELL)
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return both.groupBy("regime").agg(F.count(F.lit(1)).alias("cells"), count(F.col("margin") >= win).alias("wins"), count(F.col("margin") < -win).alias("harmed"))


def conditional_claim(counts: DataFrame) -> DataFrame:
    """(verdict): helps where shape matters (60 % won) and harms at most a fifth where a summary holds all; under 50 % won fails."""
    at = lambda regime, c: F.sum(F.when(F.col("regime") == regime, F.col(c)))
    s = counts.agg(at("shape", "cells").alias("n"), at("shape", "wins").alias("w"), at("summary", "cells").alias("m"), at("summary", "harmed").alias("h"))
    rate, harm = F.col("w") / F.col("n"), F.coalesce(F.col("h") / F.col("m"), F.lit(0.0))
    return s.select(F.when((rate < 0.5) | (harm > 0.2), F.lit("FAIL")).when((rate >= 0.6) & (harm <= 0.2), F.lit("PASS")).otherwise(F.lit("INCONCLUSIVE")).alias("verdict"))


def standing(means: DataFrame, ours: str) -> DataFrame:
    """(model, mean_rank, beaten): mean rank over the cells that ours has (best first, ties by name), and whether it is worse than ours."""
    has = means.where(F.col("model") == ours).select(*CELL)
    place = F.row_number().over(W.partitionBy(*CELL).orderBy(F.col("mean").desc(), "model"))
    ranks = means.join(has, CELL, "left_semi").select("model", place.alias("r")).groupBy("model").agg(F.avg("r").alias("mean_rank"))
    return ranks.join(F.broadcast(ranks.where(F.col("model") == ours).select(F.col("mean_rank").alias("own"))), F.lit(True)).select("model", "mean_rank", (F.col("mean_rank") > F.col("own")).alias("beaten"))


# ---------------------------------------------------------------- arms


def decomposition(cells: DataFrame, outside: list[str], bank: str, trees: str, statics: str) -> DataFrame:
    """(dataset, size, bank, trees, statics): what our bank adds to the better outside one, trees to the bank, statics to the trees."""
    m = wide_means(cells, [*outside, bank, trees, statics])
    best = F.greatest(*[F.col(o) for o in outside]) if len(outside) > 1 else F.col(outside[0])
    steps = [(100 * (F.col(a) - b)).alias(n) for n, a, b in (("bank", bank, best), ("trees", trees, F.col(bank)), ("statics", statics, F.col(trees)))]
    return m.where(F.col(bank).isNotNull() & F.col(trees).isNotNull() & F.col(statics).isNotNull()).select(*CELL, *steps)


def paired_gain(cells: DataFrame, a: str, b: str, passes: float, fails: float, strict: bool) -> DataFrame:
    """(dataset, seeds, gain, verdict): mean margin over the seeds that both have, judged by two bars."""
    seeds = wide_means(cells, [a, b], ["dataset", "seed"]).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    g = seeds.groupBy("dataset").agg(F.count(F.lit(1)).alias("seeds"), F.avg(100 * (F.col(a) - F.col(b))).alias("gain"))
    return g.withColumn("verdict", three_way(F.col("gain"), passes, fails, "MARGINAL", strict))


def dose_verdicts(margins: DataFrame, arms: list[str], bar: float = 3.0, seeds: int = 4) -> DataFrame:
    """(hypothesis, value, verdict) over (arm, seed, margin), the arms from most to least.

    width: the first arm's mean leads the last one's by ``bar`` and so does its sign on ``seeds`` shared seeds; order:
    means don't rise; control: the last arm's mean is over 0.  An arm without rows leaves its verdicts NULL.
    """
    by_seed = margins.groupBy("seed").agg(*[F.avg(F.when(F.col("arm") == a, F.col("margin"))).alias(a) for a in arms])
    first, last = F.col(arms[0]), F.col(arms[-1])
    mean = margins.agg(*[F.avg(F.when(F.col("arm") == a, F.col("margin"))).alias(f"m_{a}") for a in arms])
    gap = F.col(f"m_{arms[0]}") - F.col(f"m_{arms[-1]}")
    agree = by_seed.join(F.broadcast(mean), F.lit(True)).agg(F.sum((F.signum(first - last) == F.signum(gap)).cast("long")).alias("agree"), *[F.max(f"m_{a}").alias(f"m_{a}") for a in arms])
    falls = F.lit(True)
    for x, y in zip(arms, arms[1:]):
        falls = falls & (F.col(f"m_{x}") >= F.col(f"m_{y}"))
    word = lambda c: F.when(c, F.lit("PASS")).when(~c, F.lit("FAIL"))
    rows = F.array(
        F.struct(F.lit("width").alias("hypothesis"), gap.alias("value"), F.when(gap.isNotNull(), word((gap >= bar) & (F.coalesce("agree", F.lit(0)) >= seeds))).alias("verdict")),
        F.struct(F.lit("order").alias("hypothesis"), gap.alias("value"), word(falls).alias("verdict")),
        F.struct(F.lit("control").alias("hypothesis"), F.col(f"m_{arms[-1]}").alias("value"), word(F.col(f"m_{arms[-1]}") > 0).alias("verdict")),
    )
    return agree.select(F.explode(rows).alias("r")).select("r.*")


def regressions(results: DataFrame, base: str, arms: list[str], error: str = "rmse", score: str = "auc", error_bar: float = 2.0, points_bar: float = 1.0) -> DataFrame:
    """(scenario, model, metric, change, worse) over (scenario, model, seed, error and score columns), seeds paired.

    The error is compared where the base has one, in percent of the base's, else the score in points; positive is
    better.  A scenario with neither comes with NULLs, so that nothing is dropped in silence.
    """
    r = results.where(F.col("model").isin(base, *arms)).select("scenario", "model", "seed", F.col(error).alias("e"), F.col(score).alias("s"))
    ref = r.where(F.col("model") == base).select("scenario", "seed", F.col("e").alias("e0"), F.col("s").alias("s0"))
    kind = ref.groupBy("scenario").agg(F.when(F.count("e0") > 0, F.lit(error)).when(F.count("s0") > 0, F.lit(score)).alias("metric"))
    every = r.select("scenario").distinct().join(F.broadcast(r.sparkSession.createDataFrame([(a,) for a in arms], "model string")))
    pairs = r.where(F.col("model") != base).join(ref, ["scenario", "seed"])
    mean = lambda x, y: F.avg(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(x)))
    m = pairs.groupBy("scenario", "model").agg(mean("e", "e0").alias("e"), mean("e0", "e").alias("e0"), mean("s", "s0").alias("s"), mean("s0", "s").alias("s0"))
    t = every.join(kind, "scenario", "left").join(m, ["scenario", "model"], "left")
    change = F.when(F.col("metric") == error, 100 * (F.col("e0") - F.col("e")) / F.col("e0")).when(F.col("metric") == score, 100 * (F.col("s") - F.col("s0")))
    return t.withColumn("change", change).select("scenario", "model", "metric", "change", F.when(F.col("metric") == error, F.col("change") < -error_bar).otherwise(F.col("change") < -points_bar).alias("worse"))


def product_gate(veto: DataFrame, results: DataFrame, base: str, arms: list[str], diagnostic: str, veto_bar: float = 2.0, improve: float = 4.0) -> DataFrame:
    """(model, veto_margin, cut, regressed, ships) of each arm: first the veto (paired points of ``veto``'s scores), then the
    diagnostic's error cut, then no scenario worse."""
    seeds = wide_means(veto, [base, *arms], ["seed"])
    margin = seeds.agg(*[F.avg(100 * (F.col(a) - F.col(base))).alias(a) for a in arms]).select(F.explode(F.array(*[F.struct(F.lit(a).alias("model"), F.col(a).alias("veto_margin")) for a in arms])).alias("x")).select("x.*")
    r = regressions(results, base, arms)
    judged = r.groupBy("model").agg(F.max(F.when(F.col("scenario") == diagnostic, F.col("change"))).alias("cut"), F.sum(F.coalesce(F.col("worse"), F.lit(False)).cast("long")).alias("regressed"))
    ships = (F.col("veto_margin") >= -veto_bar) & (F.col("cut") >= improve) & (F.col("regressed") == 0)
    return margin.join(judged, "model").select("model", "veto_margin", "cut", "regressed", F.coalesce(ships, F.lit(False)).alias("ships"))


def release_gate(now: DataFrame, before: DataFrame, ours: str, rival: str, old: str, headline_set: str, majority: int = 9, bar: float = 2.0, tolerance: float = 1.0) -> DataFrame:
    """(ahead, datasets, breadth, margin, held, worst, kept, release): ahead on ``majority`` datasets and on the mean; the
    headline dataset's margin; no dataset worse than before by over ``tolerance``.  A missing part clears nothing."""
    paired = wide_means(now.where(F.col("dataset") != headline_set), [ours, rival], ["dataset", "seed"]).where(F.col(ours).isNotNull() & F.col(rival).isNotNull())
    sets = paired.groupBy("dataset").agg(F.avg(ours).alias("a"), F.avg(rival).alias("b"))
    wide = sets.agg(F.sum((F.col("a") > F.col("b")).cast("long")).alias("ahead"), F.count(F.lit(1)).alias("datasets"), F.avg("a").alias("ma"), F.avg("b").alias("mb"))
    head = wide_means(now.where(F.col("dataset") == headline_set), [ours, rival], ["seed"]).agg(F.avg(100 * (F.col(ours) - F.col(rival))).alias("margin"))
    then = before.where(F.col("model") == old).groupBy("dataset").agg(F.avg("score").alias("x"))
    change = then.join(now.where(F.col("model") == ours).groupBy("dataset").agg(F.avg("score").alias("y")), "dataset").agg(F.least(F.min(100 * (F.col("y") - F.col("x"))), F.lit(0.0)).alias("worst"), F.count(F.lit(1)).alias("shared"))
    one = wide.join(F.broadcast(head), F.lit(True)).join(F.broadcast(change), F.lit(True))
    breadth = F.when(F.col("datasets") > 0, (F.col("ahead") >= majority) & (F.col("ma") >= F.col("mb")))
    held, kept = F.col("margin") >= bar, F.when(F.col("shared") > 0, F.col("worst") >= -tolerance)
    release = F.when(breadth.isNull() | held.isNull() | kept.isNull(), F.lit("not cleared: incomplete")).when(~kept, F.lit("not cleared: worse than before")).when(breadth & held, F.lit("cleared")).when(held, F.lit("cleared for the headline alone")).otherwise(F.lit("not cleared: headline lost"))
    return one.select("ahead", "datasets", breadth.alias("breadth"), "margin", held.alias("held"), "worst", kept.alias("kept"), release.alias("release"))


def control_holds(heads: DataFrame, reference: DataFrame, control: str, same: str, tolerance: float = 0.5) -> DataFrame:
    """(worst, comparable): largest distance in points, over datasets, of a control arm from the arm that it repeats."""
    a = heads.where(F.col("model") == control).groupBy("dataset").agg(F.avg("score").alias("a"))
    b = reference.where(F.col("model") == same).groupBy("dataset").agg(F.avg("score").alias("b"))
    return a.join(b, "dataset").agg(F.max(F.abs(100 * (F.col("a") - F.col("b")))).alias("worst")).select("worst", (F.col("worst") <= tolerance).alias("comparable"))


def head_standings(cells: DataFrame, first: str, second: str, bar: float = 1.0) -> DataFrame:
    """(model, mean, mean_rank, vs_first, beats_first, beats_second, without_best) of models on one set of datasets.

    ``without_best`` is the mean margin over the first model without the dataset that carries it most.
    """
    m = cells.groupBy("dataset", "model").agg((100 * F.avg("score")).alias("mean"))
    on = W.partitionBy("dataset")
    t = m.select(
        "dataset", "model", "mean", F.row_number().over(on.orderBy(F.col("mean").desc(), "model")).alias("r"),
        *[F.max(F.when(F.col("model") == x, F.col("mean"))).over(on).alias(n) for x, n in ((first, "f"), (second, "s"))],
    ).withColumn("d", F.col("mean") - F.col("f"))
    g = t.groupBy("model").agg(
        F.avg("mean").alias("mean"), F.avg("r").alias("mean_rank"), F.avg("d").alias("vs_first"), F.sum((F.col("mean") >= F.col("f") + bar).cast("long")).alias("beats_first"),
        F.sum((F.col("mean") >= F.col("s") + bar).cast("long")).alias("beats_second"), F.sum("d").alias("total"), F.max("d").alias("most"), F.count(F.lit(1)).alias("n"),
    )
    return g.select("model", "mean", "mean_rank", "vs_first", "beats_first", "beats_second", F.when(F.col("n") > 1, (F.col("total") - F.col("most")) / (F.col("n") - 1)).alias("without_best"))
