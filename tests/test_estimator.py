import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from rowtrail.operators import boost, ridge
from rowtrail.plans.estimator import SETTINGS, FusedBoost, FusedModel

SCHEMA = "row_id int, static array<double>, series array<array<double>>, label string, y double, person string, held boolean, prediction string"


def frame(spark, n, seed, kind):
    """shape: a slow or a fast wave decides; noise: nothing does; number: the wave's amplitude is the target."""
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        fast, phase, amplitude = i % 2, r.uniform(0, 6), r.uniform(0.5, 2)
        x = amplitude * np.sin(phase + np.arange(40) * (1.5 if fast else 0.3)) + r.normal(0, 0.3, 40)
        x = r.normal(size=40) if kind == "noise" else x
        s = [float(r.normal()), None if i % 11 == 0 else float(r.normal())]
        person = None if i % 20 == 3 else f"p{i // 6}"
        y = amplitude + (s[0] if kind == "number" else 0.0)
        out.append((i, s, [x.tolist()], ("fast", "slow")[fast] if kind != "three" else "abc"[(fast + (s[0] > 0)) % 3], y, person, bool(i % 5 == 4), "mine"))
    return boost.stored(spark.createDataFrame(out, SCHEMA).repartition(3))


def small(**more):
    return FusedBoost(**{"rounds": 2, "depth": 2, "intervals": 4, "shapelets": 0, "bank": 0, "useBase": True, "rocketFeatures": 168, "permutations": 8, **more})


def accuracy(rows, name="guess"):
    return rows.agg(F.avg((F.col(name) == F.col("label")).cast("double"))).first()[0]


def test_base_carries_what_single_splits_miss(spark, tmp_path):
    train, test = frame(spark, 160, 0, "shape"), frame(spark, 100, 1, "shape")
    est = small(predictionCol="guess", baseStatics=True, marginProducts=True)
    model = est.fit(train)
    assert not model.declined and model.base is not None and model.base_r2[0] > max(0.0, model.base_r2[1])
    got = model.transform(test)
    assert set(got.columns) == {*test.columns, "guess", "probability"} and got.first().prediction == "mine"
    assert accuracy(got) > 0.9
    assert any("margin[0]" in s["feature"] for s in model.splits()) or model.trees.history[0]["train"] < 0.3
    assert list(model.importances().values()) == sorted(model.importances().values(), reverse=True)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = FusedModel.load(str(tmp_path / "m"))
    a, b = ([r.probability for r in m.transform(test).orderBy("row_id").collect()] for m in (model, again))
    assert a == b and again.given() == model.given() and again.splits() == model.splits()
    shorter = test.withColumn("series", F.transform("series", lambda c: F.slice(c, 1, 36)))
    assert again.transform(shorter).count() == 100


def test_noise_declines_the_base(spark):
    """The trees then start from the loss's own score, as they would without a base."""
    rows = frame(spark, 120, 2, "noise")
    model = small(permutations=20).fit(rows)
    assert model.declined and model.base is None and model.base_r2[0] <= max(0.0, model.base_r2[1])
    plain = small(useBase=False).fit(rows)
    assert plain.base_r2 is None and not plain.declined
    assert model.trees.base == plain.trees.base and model.splits() == plain.splits()
    assert len(model.transform(rows).first().probability) == 2


def test_trees_start_from_held_out_margins(spark):
    """Held out by row or by group: what the trees start from is what the base says without that row or group."""
    rows = frame(spark, 120, 3, "number")
    for group in ("", "person"):
        est = small(task="regression", labelCol="y", groupCol=group, baseStatics=True, rounds=1, fourier=0)
        wide = est._rows(rows, None).withColumn("y", F.col("in_y"))
        if group:
            wide = wide.withColumn("group", F.coalesce("in_person", F.concat(F.lit("row "), F.col("row_id").cast("string"))))
        base, kept, _ = est._base(wide, None, 2, 1, 40, "group" if group else None)
        margin = {r.row_id: r.margin[0] for r in kept.collect()}
        full = {r.row_id: r.margin[0] for r in base.margins(wide).collect()}
        y = {r.row_id: r.y for r in rows.collect()}
        assert len(margin) == 120
        error = lambda m: np.mean([(m[i] - y[i]) ** 2 for i in y])
        assert error(full) < error(margin) < np.var(list(y.values()))
        assert error(margin) == pytest.approx((1 - base.loo_r2) * np.var(list(y.values())), rel=1e-6)


def test_collapsed_margins_are_the_full_fits(spark):
    r = np.random.default_rng(4)
    x, z, t = r.normal(size=(50, 7)) * 3 + 1, np.column_stack([np.ones(50), r.normal(size=(50, 2))]), r.normal(size=(50, 2))
    rows = spark.createDataFrame([(i, a.tolist(), b.tolist(), c.tolist()) for i, (a, b, c) in enumerate(zip(x, z, t))], "row_id int, x array<double>, z array<double>, t array<double>")
    base = ridge.fit_ridge(rows, z="z")
    coef, side, offset = base.linear()
    want = np.array([q.margin for q in base.margins(rows).orderBy("row_id").collect()])
    assert np.allclose(x @ coef + z @ side + offset, want)


def test_regression_stops_early_in_a_pipeline(spark):
    rows = frame(spark, 150, 5, "number")
    est = small(task="regression", labelCol="y", validationIndicatorCol="held", stale=1, rounds=6, rate=1.0, fourier=12, predictionCol="guess", seed=3)
    fitted = Pipeline(stages=[est]).fit(rows)
    model = fitted.stages[0]
    assert len(model.trees.curve("eval")) == len(model.trees.trees) and model.trees.rounds_used <= len(model.trees.trees)
    error = fitted.transform(rows).agg(F.avg((F.col("guess") - F.col("y")) ** 2), F.var_pop("y")).first()
    assert error[0] < 0.6 * error[1] and "probability" not in fitted.transform(rows).columns


def test_three_classes(spark):
    rows = frame(spark, 150, 6, "three")
    model = small(rounds=3, depth=3, predictionCol="guess").fit(rows)
    got = model.transform(rows)
    assert accuracy(got) > 0.8 and all(abs(sum(r.probability) - 1) < 1e-9 for r in got.collect())


def test_settings(spark, tmp_path):
    est = FusedBoost(rounds=7, l2=0.5)
    assert est.given()["rounds"] == 7 and est.given().keys() == {n for n, *_ in SETTINGS} and len(SETTINGS) > 42
    assert est.copy({est.rounds: 9}).of("rounds") == 9 and est.of("rounds") == 7 and est.boosting().rules.l2 == 0.5
    est.write().overwrite().save(str(tmp_path / "e"))
    assert FusedBoost.load(str(tmp_path / "e")).given() == est.given()
    with pytest.raises(ValueError, match="holds a FusedBoost"):
        FusedModel.load(str(tmp_path / "e"))
    for bad, message in (({"task": "other"}, "unknown task"), ({"rate": 0.0}, "rate"), ({"stats": ["mode"]}, "statistics"), ({"rocketFeatures": 3}, "rocketFeatures"), ({"screenShare": 1.0}, "screen_share")):
        with pytest.raises(ValueError, match=message):
            FusedBoost(**bad).check()
    with pytest.raises(TypeError):
        FusedBoost(rounds="many")
    one = spark.createDataFrame([(1, [1.0], "a"), (2, [2.0], "a")], "row_id int, static array<double>, label string")
    with pytest.raises(ValueError, match="two classes"):
        FusedBoost().fit(one)
    plain = spark.createDataFrame([(i, [float(i)], "ab"[i > 20]) for i in range(40)], "row_id int, static array<double>, label string")
    assert accuracy(FusedBoost(rounds=3, rate=0.5, useBase=True).fit(plain).transform(plain), "prediction") == 1.0
