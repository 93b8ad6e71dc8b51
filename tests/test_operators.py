import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowtrail.functions import metrics, scalar, stats
from rowtrail.functions.losses import logistic, softmax_loss, squared_error
from rowtrail.operators import boost, etl, kernel, ridge, rocket, split, temporal
from rowtrail.operators.specs import Draws, Spec, array_stat, draw_interval, spec_column
from rowtrail.plans import persistence, reports
from rowtrail.sources import generators, series
from rowtrail.streaming.assembly import score_stream, streaming_bins


def messy():
    r = np.random.default_rng(0)
    x = r.normal(size=(12, 25))
    x[r.random(x.shape) < 0.25] = np.nan
    x[0] = np.nan
    x[1] = 7
    x[2] = np.nan
    x[2, 6] = 1.0
    x[3] = 0.5 * np.arange(25) + 2
    x[4] = np.nan
    x[4, :2] = [1, 3]
    return x


def lists(x):
    return [[None if v != v else float(v) for v in row] for row in x]


def close(a, b):
    return (a is None and (b is None or b != b)) or (a is not None and b is not None and b == b and abs(a - b) < 1e-9)


def test_statistics_agree_in_all_three_forms(spark):
    x = messy()
    rows = spark.createDataFrame(list(enumerate(lists(x))), "row_id int, series array<double>")
    long = stats.interval_stats(series.to_long(rows, ["row_id"]), ["row_id"], stats=stats.STAT10_NAMES)
    from_long = {r.row_id: r for r in long.collect()}
    arrays = {r.row_id: r for r in rows.select("row_id", *[array_stat(F.col("series"), s).alias(s) for s in stats.STAT10_NAMES]).collect()}
    for s in stats.STAT10_NAMES:
        want = kernel.window_stat(x, s)
        for i in range(len(x)):
            assert close(from_long[i][s], want[i]), (s, i)
            assert close(arrays[i][s], want[i]), (s, i)
    assert from_long[3]["slope"] == pytest.approx(0.5) and from_long[2]["slope"] is None and from_long[4]["delta"] == 2
    with pytest.raises(ValueError):
        stats.stat("nothing")


def test_windows_split_like_array_split(spark):
    for steps, windows in ((30, 4), (7, 3), (5, 5), (3, 4)):
        got = [r.w for r in spark.range(steps).select(stats.window_of(F.col("id"), steps, windows).alias("w")).collect()]
        want = [w for w, part in enumerate(np.array_split(np.arange(steps), windows)) for _ in part]
        assert got == want


def test_specs_compile_to_what_the_kernel_computes(spark):
    x = messy()
    rng = random.Random(1)
    template = tuple(np.random.default_rng(2).normal(size=5))
    specs = [draw_interval(rng, 1, 25, Draws()) for _ in range(12)] + [Spec(k, channel=0, template=template, scale=s) for k in ("shapelet_dist", "shapelet_pos", "filter_resp", "filter_pos") for s in (0, 1)]
    specs += [Spec("static", column=0), Spec("product", column=0, inner=specs[0], frozen=(0.0, 1.0, -1.0, 1.0, 0.5, 0.5, -1.0, 1.0))]
    rows = spark.createDataFrame([(i, [i / 10], [v]) for i, v in enumerate(lists(x))], "row_id int, static array<double>, series array<array<double>>")
    got = rows.select("row_id", kernel.features_column(specs, F.col("static"), F.col("series")).alias("k"), F.array(*[spec_column(s) for s in specs]).alias("c")).collect()
    for r in got:
        for a, b, s in zip(r.k, r.c, specs):
            assert close(a, b if b is not None else float("nan")) or close(b, a if a is not None else float("nan")), s


def test_template_matching_against_brute_force():
    r = np.random.default_rng(3)
    x = r.normal(size=(6, 30))
    x[0, 4] = np.nan
    x[1] = 2.0
    x[2, 5:20] = 1.0
    t = r.normal(size=7)
    for kind, norm in (("distance", True), ("distance", False), ("correlation", True)):
        value, place = temporal.match_template(x, t.tolist(), kind, norm)
        z = lambda w: (w - w.mean()) / w.std() if w.std() > 1e-12 else np.zeros(len(w))
        for i in range(len(x)):
            best = None
            for p in range(24):
                w = x[i, p : p + 7]
                if not np.isfinite(w).all():
                    continue
                if kind == "distance":
                    d = ((z(w) - z(t)) ** 2).mean() if norm else ((w - t) ** 2).mean()
                    key, v = d, d
                else:
                    v = float((z(w) * z(t)).mean())
                    key = -abs(v)
                if best is None or key < best[0] - 1e-12:
                    best = (key, v, p)
            assert value[i] == pytest.approx(best[1], abs=1e-9) and place[i] == pytest.approx(best[2] / 23)
    assert np.isnan(temporal.match_template(x, [1.0] * 31)[0]).all()


def test_pyramid_and_snippets(spark):
    row = spark.createDataFrame([([1.0, 3.0, 5.0, None, None, None, 2.0, 4.0],)], "s array<double>")
    assert row.select(temporal.pool(F.col("s")).alias("p")).first().p == [2, 5, None, 3]
    assert temporal.pyramid_levels(100, 9) == [100, 50, 25, 12]
    assert temporal.unit_snippet([1, 1, 1]) is None and temporal.znorm([1, 1]) == [0, 0] and temporal.znorm([1, None]) is None
    b = np.array(temporal.dct_basis(9, 5))
    assert np.allclose(b @ b.T, np.eye(5)) and np.allclose(b.sum(1), 0)
    r = np.random.default_rng(0)
    windows, truth = r.normal(size=(60, 9)), b[1]
    windows -= windows.mean(1, keepdims=True)
    fit = np.array(temporal.refit_template(windows.tolist(), (windows @ truth).tolist(), [1.0] * 60, b.tolist(), 1.0))
    assert abs(fit @ truth) > 0.9 and temporal.refit_template(windows[:6].tolist(), [0.0] * 6, [1.0] * 6, b.tolist(), 1.0) is None


def brute_split(f, g, h, rules):
    miss = [i for i, v in enumerate(f) if v is None]
    seen = sorted({v for v in f if v is not None})
    score = lambda a, b: a * a / (b + rules.l2) if b + rules.l2 > 0 else 0.0
    best = None
    for lo, hi in zip(seen, seen[1:]):
        for ml in (True, False) if miss else (True,):
            left = [i for i, v in enumerate(f) if (ml if v is None else v <= lo)]
            gl, hl, gt, ht = sum(g[i] for i in left), sum(h[i] for i in left), sum(g), sum(h)
            if min(hl, ht - hl) < rules.min_child_weight or min(len(left), len(f) - len(left)) < rules.min_samples_leaf:
                continue
            gain = 0.5 * (score(gl, hl) + score(gt - gl, ht - hl) - score(gt, ht)) - rules.gamma
            if gain > 0 and (best is None or gain > best + 1e-9):
                best = gain
    return best


def test_split_scan_against_brute_force(spark):
    r = random.Random(0)
    rows, problems = [], []
    for p in range(40):
        n = r.randint(1, 30)
        f = [None if r.random() < 0.2 else round(r.gauss(0, 1), 1) for _ in range(n)]
        g, h = [r.gauss(0, 1) for _ in range(n)], [r.uniform(0.05, 1.5) for _ in range(n)]
        problems.append((f, g, h))
        rows += [(p, *x) for x in zip(f, g, h)]
    rows += [(90, None, 1.0, 1.0)] * 20 + [(91, 2.0, 1.0, 1.0)] * 20
    rules = split.ScanRules(l2=1.0, gamma=0.02, min_child_weight=0.3, min_samples_leaf=2)
    got = {x.p: x for x in split.best_splits(spark.createDataFrame(rows, "p int, f double, g double, h double"), ["p"], rules).collect()}
    for p, (f, g, h) in enumerate(problems):
        want = brute_split(f, g, h, rules)
        assert (p in got) == (want is not None)
        if want is not None:
            assert got[p].gain == pytest.approx(want)
    assert 90 not in got and 91 not in got
    literal = [(0, f, g, 1.0) for f, g in zip([0, 0, 0, 1, 1, 1, None, None, None], [-1, -1, -1, 1, 1, 1, 1, 1, 1])]
    side = split.best_splits(spark.createDataFrame([(p, None if f is None else float(f), float(g), h) for p, f, g, h in literal], "p int, f double, g double, h double"), ["p"]).first()
    assert side.missing_left is False


def test_losses_are_derivatives(spark):
    for loss, k, ys in ((squared_error(), 1, [0.3, -2.0]), (logistic(), 1, [0.0, 1.0]), (softmax_loss(4), 4, [0.0, 3.0])):
        r = random.Random(1)
        rows = [(y, [r.gauss(0, 1.5) for _ in range(k)]) for y in ys for _ in range(5)] + [(ys[0], [50.0] * k), (ys[1], [-50.0] * k)]
        df = spark.createDataFrame(rows, "y double, raw array<double>")

        def value(y, raw):
            if loss.name == "squared":
                return 0.5 * (raw[0] - y) ** 2
            if loss.name == "logistic":
                return np.logaddexp(0, raw[0]) - y * raw[0]
            return np.logaddexp.reduce(raw) - raw[int(y)]

        for row in df.select("y", "raw", loss.gradients(F.col("y"), F.col("raw")).alias("d")).collect():
            for j in range(k):
                up, down = list(row.raw), list(row.raw)
                up[j] += 1e-5
                down[j] -= 1e-5
                assert row.d[j].g == pytest.approx((value(row.y, up) - value(row.y, down)) / 2e-5, abs=1e-4)
                assert row.d[j].h > 0
    with pytest.raises(ValueError):
        softmax_loss(2)


def test_metrics_edges(spark):
    df = spark.createDataFrame([("one", 1, 0.2, 1), ("one", 1, 0.3, 1), ("two", 0, 0.1, 0), ("two", 1, 0.9, 0), ("two", 0, 0.9, 0)], "k string, y int, score double, predicted int")
    auc = {r.k: r.auc for r in metrics.roc_auc(df, by=["k"]).collect()}
    assert auc == {"one": None, "two": 0.75}
    b = {r.k: r for r in metrics.binary_metrics(df, by=["k"]).collect()}
    assert (b["two"].precision, b["two"].recall, b["two"].f1) == (0, 0, 0) and b["one"].f1 == 1
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0)], "y double, predicted double")
    assert metrics.regression_metrics(flat).first().r2 is None


def test_scalar_nulls(spark):
    row = spark.range(1).select(
        scalar.clip(F.lit(None).cast("double"), -2.0, 2.0).alias("a"), scalar.bounded(F.lit(5.0), 0.0, 0.0, -2.0, 2.0).alias("b"), scalar.goes_left(F.lit(None).cast("double"), 1.0, True).alias("c"), scalar.sigmoid(F.lit(-800.0)).alias("d")
    ).first()
    assert (row.a, row.b, row.c, row.d) == (None, 2.0, True, 0.0)


def test_rocket_bank(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(20, 40))
    rows = spark.createDataFrame([(i, [v]) for i, v in enumerate(lists(x))], "row_id int, series array<array<double>>")
    bank = rocket.RocketBank.fit(rows, "series", 40, features=84 * 6)
    got = np.array([q.f for q in rows.orderBy("row_id").select(bank.transform(F.col("series")).alias("f")).collect()])
    assert got.shape == (20, bank.width) and ((0 <= got) & (got <= 1)).all()
    ch, k, d, biases = bank.entries[5]
    a = rocket.KERNELS[k]
    pad = np.pad(x[3], (4 * d, 4 * d)) if k % 2 == 0 else x[3]
    conv = [sum((2 if j in a else -1) * pad[i + j * d] for j in range(9)) for i in range(len(pad) - 8 * d)]
    at = sum(len(b) for *_, b in bank.entries[:5])
    assert got[3, at] == pytest.approx(np.mean(np.array(conv) > biases[0]))
    assert sum(rocket.dilations(40, 6).values()) == 6 and rocket.dilations(9, 4) == {1: 4}
    with pytest.raises(ValueError):
        bank.features(np.zeros((1, 1, 41)))


def test_ridge_hold_outs_equal_refits(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(36, 5))
    t = 1.5 * x[:, :1] - x[:, 3:4] + r.normal(0, 0.3, (36, 1))
    rows = spark.createDataFrame([(i, i % 6, x[i].tolist(), t[i].tolist()) for i in range(36)], "i int, grp int, x array<double>, t array<double>").repartition(3)
    base = ridge.fit_ridge(rows)

    def refit(keep, at):
        z = (x - base.center) / base.scale
        a = np.hstack([np.ones((36, 1)), z])
        pen = np.diag([0.0] + [base.penalty] * 5)
        w = np.linalg.solve(a[keep].T @ a[keep] + pen, a[keep].T @ t[keep])
        return a[at] @ w

    one = {q.i: q.margin[0] for q in base.leave_one_out(rows).collect()}
    group = {q.i: q.margin[0] for q in base.leave_group_out(rows, "grp", "i").collect()}
    full = {q.i: q.margin[0] for q in base.margins(rows).collect()}
    for i in range(36):
        keep = np.arange(36) != i
        assert one[i] == pytest.approx(refit(keep, [i])[0, 0], abs=1e-8)
        assert group[i] == pytest.approx(refit(np.arange(36) % 6 != i % 6, [i])[0, 0], abs=1e-8)
        assert full[i] == pytest.approx(refit(np.ones(36, bool), [i])[0, 0], abs=1e-8)


def test_boosting_learns_saves_and_streams(spark, tmp_path):
    train, test = generators.slope_window(spark, 300, seed=1), generators.slope_window(spark, 300, seed=2)
    train, test = (boost.stored(x) for x in (train, test))
    params = boost.Params(rounds=5, depth=3, rate=0.4, stale=3, draws=Draws(intervals=14, stats=("slope", "delta"), whole=0.15))
    model = boost.fit_classifier(train, params, test)
    got = model.predict(test)
    assert got.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] > 0.8
    assert all(a["train"] >= b["train"] - 0.02 for a, b in zip(model.history, model.history[1:]))
    assert any("slope" in s["feature"] or "delta" in s["feature"] for s in model.splits(6))
    persistence.save(model, spark, str(tmp_path / "m"))
    again = persistence.load(spark, str(tmp_path / "m"))
    a, b = ({r.row_id: r.probability for r in m.predict(test).collect()} for m in (model, again))
    assert a == b
    test.write.parquet(str(tmp_path / "in"))
    stream = score_stream(spark.readStream.schema(test.schema).parquet(str(tmp_path / "in")), again)
    q = stream.writeStream.format("memory").queryName("scored").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {r.row_id: r.probability for r in spark.table("scored").collect()} == a
    with pytest.raises(ValueError):
        boost.Params(rounds=0).check()


def test_streaming_bins(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "e"))
    stream = streaming_bins(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), ["event_type"], "ts", "value", late="60 days")
    q = stream.writeStream.format("memory").queryName("bins").outputMode("complete").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    want = {(r.event_type, r.d): (r.v, r.n) for r in events.groupBy("event_type", F.to_date("ts").alias("d")).agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("n")).collect()}
    got = {(r.event_type, r.bin.date()): (r.value, r.n) for r in spark.table("bins").collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and math.isclose(got[k][0], want[k][0]) for k in want)


def test_generators_do_not_depend_on_partitions(spark):
    for name, make in generators.SCENARIOS.items():
        a = sorted(map(str, make(spark, 30, seed=3).collect()))
        b = sorted(map(str, make(spark, 30, seed=3).repartition(5).collect()))
        assert a == b and len(a) == 30, name


def test_etl_windows(spark):
    rows = spark.createDataFrame([("a", t) for t in (0, 1, 2, 3, 4, 9, 10, 11, 20)], "k string, t int")
    got = [tuple(r) for r in etl.tumbling_in_islands(rows, ["k"], "t", 2).orderBy("t").collect()]
    assert [(t, i, w, p) for _, t, i, w, p in got] == [(0, 1, 0, 0), (1, 1, 0, 1), (2, 1, 1, 0), (3, 1, 1, 1), (9, 2, 0, 0), (10, 2, 0, 1)]
    iv = spark.createDataFrame([("r", 0.0, 90.0, "w"), ("r", 60.0, 10.0, "n"), ("r", 200.0, 30.0, "x")], "k string, start double, length double, label string")
    assert {r.t: r.label for r in etl.interval_join(iv, ["k"], 30.0).collect()} == {0: "w", 1: "w", 2: "n", 6: "x"}


def test_reports(spark):
    rows = spark.createDataFrame([("d1", "a", 0, 0.9), ("d1", "b", 0, 0.8), ("d1", "a", 1, 0.7), ("d1", "b", 2, 0.7)], "dataset string, model string, seed int, score double")
    assert [round(r.margin, 9) for r in reports.paired_margins(rows, "a", "b", ["dataset", "seed"]).collect()] == [10.0]
    assert {(r.seed, r.only) for r in reports.unpaired(rows, "a", "b", ["dataset", "seed"]).collect()} == {(1, "a"), (2, "b")}
    with pytest.raises(Exception, match="several rows"):
        reports.one_row_a_cell(rows.unionByName(rows), ["dataset", "model", "seed"]).collect()
    v = spark.createDataFrame([(3.0,), (1.0,), (0.0,), (None,)], "v double").select(reports.verdict(F.col("v"), 2.0, 0.0).alias("x"))
    assert [r.x for r in v.collect()] == ["PASS", "MARGINAL", "FAIL", "not judged"]
    sizes = spark.createDataFrame([(97,), (106,), (512,), (3000,)], "n int").select(reports.nominal_size(F.col("n")).alias("s"))
    assert [r.s for r in sizes.collect()] == [100, 0, 500, 0]


def test_generated_series_are_noise_by_hash_and_a_shape(spark):
    """The channels come from NumPy on Arrow batches (one evaluation a scenario, no lambda over steps); the same numbers as Spark's expressions give."""
    from rowtrail.functions.scalar import normal

    rows = generators.timing(spark, 40, steps=30, seed=7)
    assert "lambdafunction" not in rows._jdf.queryExecution().optimizedPlan().toString()
    want = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda t: 0.5 * normal(F.lit(7), F.lit(3), F.col("row_id"), t))
    center = 3 + generators._u(7, 2) * 24
    for r in rows.select("series", want.alias("noise"), center.alias("c")).collect():
        for t, (x, v) in enumerate(zip(r.series[0], r.noise, strict=True)):
            z = (t - r.c) / (30 * 0.03)
            assert x == pytest.approx(v - 3 * z * math.exp(-0.5 * z * z), abs=1e-12)
    noise = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda t: 2.0 * normal(F.lit(99995), F.lit(3), F.col("row_id"), t))
    for r in generators.pure_static(spark, 20, seed=4, series_steps=9, noise=2.0).select("series", noise.alias("v")).collect():
        assert r.series[0] == pytest.approx(r.v, abs=1e-12)
    assert generators.pure_static(spark, 5).first().series == []
    assert generators.pure_static(spark, 0, series_steps=9).count() == 0


def test_middle_is_the_exact_median(spark):
    for values in ([1.5], [2.0, 1.0], [3.0] * 50, [0.0] * 30 + [1e9] * 30, [0.0] * 31 + [1e9] * 30, [math.sin(i * i) for i in range(501)], [math.exp(i % 37) for i in range(400)], [-1e-300, 5.0, 1e-300, -4.0]):
        frame = spark.createDataFrame([(v,) for v in values], "v double")
        want = frame.agg(F.percentile("v", F.lit(0.5))).first()[0]
        assert generators._middle(frame, few=3) == want == generators._middle(frame)
    assert generators._middle(spark.createDataFrame([], "v double")) is None
