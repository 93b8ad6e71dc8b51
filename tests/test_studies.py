import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowtrail.operators import boost, heads, split
from rowtrail.operators.bank import Bank, correlation
from rowtrail.operators.specs import Draws, Spec
from rowtrail.plans import grid, screen, sinks, verdicts


def test_results_files_and_cells(spark, tmp_path):
    path = str(tmp_path / "cells")
    assert sinks.done_cells(spark, path) == set()
    for seed in (2, 1):
        sinks.append_cell({"dataset": "d", "model": "m", "n_train": 10, "seed": seed, "fit_seconds": 0.5, "metrics": {"auc": 0.25 * seed}}, spark, path)
    assert sinks.done_cells(spark, path) == {("d", "m", 10, 1), ("d", "m", 10, 2)}
    out = str(tmp_path / "results.json")
    sinks.write_results(spark.read.parquet(path), out, {"x": "no file"})
    assert [(r.seed, r.metrics) for r in sinks.read_results(spark, out).collect()] == [(1, {"auc": 0.25}), (2, {"auc": 0.5})]
    assert sinks.unavailable(spark, out) == {"x": "no file"}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sinks.read_results(spark, str(tmp_path / "none")).collect()
    with pytest.raises(Exception, match="no headline metric"):
        verdicts.headline(sinks.read_results(spark, out), {"other": "auc"}).collect()
    table = spark.createDataFrame([("a", 1.0, None)], "name string, v double, w double")
    assert sinks.markdown(table, 2) == "| name | v | w |\n|---|---|---|\n| a | 1.00 | — |"
    assert "## part" in sinks.write_report(spark, "t", {"part": table}, str(tmp_path / "report"))
    sinks.cached(table, str(tmp_path / "c"))
    assert sinks.cached(table.limit(0), str(tmp_path / "c")).count() == 1


def test_verdicts_of_empty_and_refused(spark):
    cells = spark.createDataFrame([], "dataset string, size int, seed int, model string, score double")
    assert [r.verdict for r in verdicts.first_verdicts(cells, "a", "b", "s", ["r"]).collect()] == [None] * 4
    assert [r.verdict for r in verdicts.dose_verdicts(spark.createDataFrame([("x", 1, 2.0)], "arm string, seed int, margin double"), ["x", "y"]).collect()] == [None] * 3
    one = spark.createDataFrame([("d", 1, 1, "a", 0.5)], cells.schema)
    assert verdicts.release_gate(one, one, "a", "b", "c", "h").first().release == "not cleared: incomplete"
    with pytest.raises(ValueError, match="used before: d"):
        verdicts.refuse_overlap(one, ["d", "e"])
    assert verdicts.refuse_overlap(one, ["e"]).count() == 1


def test_planted_doses(spark):
    """Arms with margins of 6, 4 and 1 points pass; equal arms fail."""
    r = random.Random(1)
    rows = [(a, s, m + r.uniform(-0.5, 0.5)) for a, m in (("A", 6.0), ("B", 4.0), ("C", 1.0)) for s in range(5)]
    frame = lambda x: spark.createDataFrame(x, "arm string, seed int, margin double")
    assert [v.verdict for v in verdicts.dose_verdicts(frame(rows), ["A", "B", "C"]).collect()] == ["PASS"] * 3
    flat = [(a, s, 1.0 + 0.1 * s) for a in "ABC" for s in range(5)]
    assert [v.verdict for v in verdicts.dose_verdicts(frame(flat), ["A", "B", "C"]).collect()] == ["FAIL", "PASS", "PASS"]


def test_bank():
    rng = np.random.default_rng(0)
    x = rng.normal(size=200)
    spec = lambda i: Spec("interval", channel=0, start=i, end=i + 3, stat="mean")
    bank = Bank(2)
    bank.promote(spec(0), x, 1.0, 0)
    assert bank.promote(spec(0), x, 2.0, 3).gain == 3.0 and bank.promote(spec(1), 2 * x + 1e-6 * rng.normal(size=200), 4.0, 4).spec == spec(0)
    assert bank.promote(spec(2), np.full(200, np.nan), 9.0, 5) is None
    bank.promote(spec(3), rng.normal(size=200), 2.0, 5)
    assert bank.promote(spec(4), rng.normal(size=200), 1.0, 6) is None  # evicted at once: the least gain
    assert [(s["gain"], s["last_round"]) for s in bank.summary()] == [(7.0, 4), (2.0, 5)]
    target = x + 0.5 * rng.normal(size=200)
    fold = np.arange(200) % 2 == 0
    assert [e.spec for e in bank.screened(target, fold, 1, 5)] == [spec(0)] and len(bank.screened(target, np.ones(200, bool), 1, 5)) == 2
    assert correlation(x, np.full(200, 3.0)) == 0.0 and correlation(x, -x) == pytest.approx(1.0)


def rows_with_window(spark, n, seed, noise=0.3):
    """The label is the sign of a window's mean times a static's sign: only their product tells."""
    r = np.random.default_rng(seed)
    a, s = r.normal(size=n), np.sign(r.normal(size=n))
    x = r.normal(0, noise, (n, 20))
    x[:, 6:14] += a[:, None]
    y = (a * s > 0).astype(int)
    return spark.createDataFrame([(i, [float(s[i])], [x[i].tolist()], int(y[i]), float(a[i] * s[i])) for i in range(n)], "row_id int, static array<double>, series array<array<double>>, label int, t double").repartition(3)


def test_boosting_options(spark):
    train, test = (boost.stored(rows_with_window(spark, 240, s)) for s in (0, 1))
    params = boost.Params(rounds=8, depth=2, rate=0.5, subsample=0.8, bank=8, products=4, screen=4, columns=0.5, thin=0.8, charge=0.05, draws=Draws(intervals=10, shapelets=2, stats=("mean", "max")))
    model = boost.fit_classifier(train, params, test)
    got = model.predict(test)
    assert got.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] > 0.8
    assert model.bank.entries and len(model.curve("eval")) == len(model.history)
    again = boost.fit_classifier(train.repartition(5), params, test)
    assert [s["text"] for s in again.splits()] == [s["text"] for s in model.splits()]
    shorter = test.withColumn("series", F.transform("series", lambda c: F.slice(c, 1, 18)))
    assert model.predict(shorter).count() == 240
    for bad, message in ((test.withColumn("static", F.array(F.lit(1.0), F.lit(2.0))), "static columns"), (test.withColumn("series", F.concat("series", "series")), "channels"), (test.drop("series"), "channels")):
        with pytest.raises(Exception, match=message):
            model.predict(bad).collect()
    with pytest.raises(RuntimeError):
        boost.Booster(model.loss, params).curve()
    with pytest.raises(ValueError, match="unknown statistics"):
        boost.Params(draws=Draws(stats=("mode",))).check()
    # from margins that are right already there is little left to learn; a huge charge allows no split at all
    begun = boost.fit_classifier(train.withColumn("m", F.array(20 * F.col("t"))), boost.Params(rounds=1, depth=2), start="m")
    assert begun.history[0]["train"] < 0.1
    none = boost.fit_classifier(train, boost.Params(rounds=1, depth=2, charge=1e6))
    assert none.splits() == [] and len(none.trees[0][0]) == 1


def test_filters_find_a_shape(spark):
    """A bump at random places decides; templates refitted to the residuals find it."""
    r = np.random.default_rng(9)
    bump = np.exp(-0.5 * (np.arange(-4, 5) / 1.5) ** 2)

    def rows(n):
        out = []
        for i in range(n):
            x, y = r.normal(0, 0.4, 40), i % 2
            at = r.integers(0, 31)
            x[at : at + 9] += 2.5 * bump * (1 if y else -1)
            out.append((i, [], [x.tolist()], y))
        return spark.createDataFrame(out, "row_id int, static array<double>, series array<array<double>>, label int")

    params = boost.Params(rounds=3, depth=2, rate=0.7, draws=Draws(intervals=0, filters=4, fitted=2))
    model = boost.fit_classifier(boost.stored(rows(160)), params)
    assert {s["feature"].split("(")[0] for s in model.splits()} <= {"filter_resp", "filter_pos"}
    assert model.predict(rows(100)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] > 0.85


def test_first_tree_by_brute_force(spark):
    r = np.random.default_rng(4)
    n = 60
    x = np.round(r.normal(size=(n, 3)), 1)
    x[r.random((n, 3)) < 0.2] = np.nan
    y = np.where(np.nan_to_num(x[:, 1]) > 0.2, 2.0, -1.0) + r.normal(0, 0.1, n)
    rows = spark.createDataFrame([(i, [None if v != v else float(v) for v in x[i]], [], float(y[i])) for i in range(n)], "row_id int, static array<double>, series array<array<double>>, y double")
    rules = split.ScanRules(l2=1.0, min_child_weight=1.0, min_samples_leaf=5)
    tree = boost.fit_regressor(rows, boost.Params(rounds=1, depth=1, rate=1.0, rules=rules)).trees[0][0]
    g = y.mean() - y
    best = None
    for j in range(3):
        v = np.unique(x[~np.isnan(x[:, j]), j])
        for a, b in zip(v, v[1:]):
            for left in (True, False):
                go = np.where(np.isnan(x[:, j]), left, x[:, j] <= a)
                if 5 <= go.sum() <= n - 5:
                    score = lambda m: g[m].sum() ** 2 / (m.sum() + 1.0)  # noqa: E731, B023
                    gain = 0.5 * (score(go) + score(~go) - g.sum() ** 2 / (n + 1.0))
                    key = (round(gain, 9), left, -(a + b) / 2)
                    if best is None or key > best[0]:
                        best = (key, j, (a + b) / 2, -g[go].sum() / (go.sum() + 1), -g[~go].sum() / ((~go).sum() + 1))
    top = tree[0]
    assert (top.spec.column, round(top.threshold, 9), top.missing_left) == (best[1], round(best[2], 9), best[0][1])
    assert top.gain == pytest.approx(best[0][0]) and tree[top.left].value == pytest.approx(best[3]) and tree[top.right].value == pytest.approx(best[4])


def test_chance_gain(spark):
    r = np.random.default_rng(6)
    rows = [("n", i, c, float(r.normal()), float(r.normal()), 1.0) for i in range(80) for c in range(4)]
    rows = [(a, i, c, f, float(np.sin(i)), h) for a, i, c, f, _, h in rows]
    long = spark.createDataFrame(rows, "node string, row int, candidate int, f double, g double, h double")
    got = split.chance_gain(long, ["node"], "row", split.ScanRules(l2=1.0, min_samples_leaf=5), permutations=6, quantile=0.5).first()
    real = split.best_splits(long, ["node", "candidate"], split.ScanRules(l2=1.0, min_samples_leaf=5)).agg(F.max("gain")).first()[0]
    assert 0.2 * real < got.chance < 5 * real


def test_heads(spark):
    r = np.random.default_rng(2)
    rows = []
    for i in range(150):
        k = i % 3
        rows.append((i, (r.normal(0, 0.6, 4) + np.eye(4)[k] * 3).tolist(), k))
    frame = spark.createDataFrame(rows, "row_id int, x array<double>, label int")
    got = {h.head: h.balanced_accuracy for h in heads.compare_heads(frame.where("row_id < 90"), frame.where("row_id >= 90"), ["ridge", "logreg", "knn"]).collect()}
    assert set(got) == {"ridge", "logreg", "knn"} and min(got.values()) > 0.9
    with pytest.raises(ValueError, match="unknown head"):
        heads.compare_heads(frame, frame, ["other"])


def test_screen_measures(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 2.5), (3.0, 2.5)], "y double, prediction double")
    assert screen.r_squared(rows) == pytest.approx(1 - 0.5 / 2) and screen.r_squared(rows.withColumn("y", F.lit(1.0))) == 0.0
    r = np.random.default_rng(0)
    n = 120
    s = r.normal(size=n)
    blank = spark.createDataFrame([(i, [float(s[i])], [], float(s[i] + 0.1 * r.normal())) for i in range(n)], "row_id int, static array<double>, series array<array<double>>, y double")
    got = screen.screen(blank, "regression", seeds=1, params=boost.Params(rounds=4, depth=2, rate=0.5))
    assert got.informative and got.exogenous and not got.temporal and not got.passes and "no series" in got.notes


def test_grid(spark, tmp_path):
    params = boost.Params(rounds=1, depth=1)
    arms = grid.chosen(grid.registry(params), ["static_only"])
    path = str(tmp_path / "g")
    failed = grid.run_scenarios(spark, path, ["slope_window", "other"], [40], [0], arms, test_rows=30)
    assert failed == {"other": "unknown scenario"} and sinks.done_cells(spark, path) == {("slope_window", "static_only", 40, 0)}
    assert grid.run_scenarios(spark, path, ["slope_window"], [40], [0], {"static_only": None}, test_rows=30) == {}
    with pytest.raises(ValueError, match="unknown arms"):
        grid.chosen(arms, ["nope"])
    splits = spark.createDataFrame([("mean(ch=0, [1, 4)) <= 2 [missing->left]", 2.0), ("static[1] <= 3 [missing->right]", 1.0)], "text string, gain double")
    named = {r.text: r.family for r in grid.clinical_names(splits, ["age", "sex"], ["HR"]).collect()}
    assert named == {"mean(HR, [1, 4)) <= 2 [missing->left]": "mean(HR", "sex <= 3 [missing->right]": "sex"}
