import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowtrail.functions.losses import logistic, squared_error
from rowtrail.operators import boost, growth, kernel, split
from rowtrail.operators.bank import Bank, Entry
from rowtrail.operators.growth import Level, Node, Piece
from rowtrail.operators.specs import Draws, Spec, spec_column
from rowtrail.operators.temporal import dct_basis, match_template, refit_template
from rowtrail.plans import persistence

SCHEMA = "row_id int, static array<double>, series array<array<double>>, y double"


def frame(spark, static, series, y):
    return spark.createDataFrame([(i, [None if v != v else float(v) for v in s], [c.tolist() for c in x], float(t)) for i, (s, x, t) in enumerate(zip(static, series, y))], SCHEMA)


def worked(rows, model):
    """Rows as a round sees them at its start."""
    raw = F.array(*[F.lit(float(b)) for b in model.loss.init_scores(rows)])
    return rows.withColumns({"d": model.loss.gradients(F.col("y"), raw), "id": F.xxhash64("row_id")}).drop("y").persist()


def grower(rows, params, bank=None, loss=None, round_=0, shape=None):
    model = boost.Booster(loss or squared_error(), params)
    work = worked(rows, model)
    n, g, h = work.agg(F.count(F.lit(1)), F.sum(F.get("d", F.lit(0))["g"]), F.sum(F.get("d", F.lit(0))["h"])).first()
    first = rows.first()
    return boost.Grower(params, shape or (len(first.static), len(first.series), len(first.series[0]) if first.series else 0), work, n, [(g, h)], round_, bank, {}, [(0.0, 1.0, -3.0, 3.0)] * len(first.static))


@pytest.mark.parametrize("small", [10**9, 0])
def test_cuts_are_those_of_the_exact_scan(spark, monkeypatch, small):
    """20,000 distinct values and 64 bins: the threshold is that of best_splits, by one task or by ranges of values."""
    monkeypatch.setattr(boost, "SMALL", small)
    r = np.random.default_rng(3)
    n = 20_000
    x = r.normal(size=(n, 3))
    x[r.random((n, 3)) < 0.1] = np.nan
    y = np.where(np.nan_to_num(x[:, 1], nan=1.0) > 0.123, 1.0, -1.0) + r.normal(0, 2, n)
    rows = boost.stored(frame(spark, x, [[]] * n, y).repartition(3))
    rules = split.ScanRules(l2=1.0, min_child_weight=1.0, min_samples_leaf=5)
    tree = boost.fit_regressor(rows, boost.Params(rounds=1, depth=1, rules=rules, bins=64, sample=3000)).trees[0][0]
    long = rows.select(F.posexplode("static").alias("c", "f"), (F.lit(float(y.mean())) - F.col("y")).alias("g"), F.lit(1.0).alias("h"))
    best = split.best_splits(long, ["c"], rules).orderBy(F.desc("gain")).first()
    assert (tree[0].spec.column, tree[0].missing_left) == (best.c, best.missing_left)
    assert tree[0].threshold == best.threshold and tree[0].gain == pytest.approx(best.gain, abs=1e-6)


def test_no_cut_within_a_bin_beats_its_bound():
    r = np.random.default_rng(0)
    for _ in range(300):
        n, rules = 60, split.ScanRules(l2=float(r.choice([0.0, 1.0])), gamma=0.1, min_child_weight=float(r.choice([0.01, 3.0])), min_samples_leaf=int(r.integers(1, 6)))
        f = np.sort(r.integers(0, 40, n).astype(float))
        f[r.random(n) < 0.15] = np.nan
        g, h = r.normal(size=n) + (f > 20), r.uniform(0.1, 1, n)
        edges = np.sort(r.choice(np.arange(1.0, 40), 5, False))

        def bins(code):
            out = {"code": np.unique(code)}
            parts = {"g": g, "h": h, "n": np.ones(n), "a": np.maximum(g, 0), "b": np.minimum(g, 0)}
            out |= {k: np.array([v[code == c].sum() for c in out["code"]]) for k, v in parts.items()}
            return out | {"low": np.array([f[code == c].min() for c in out["code"]]), "high": np.array([f[code == c].max() for c in out["code"]])}

        code = np.where(np.isfinite(f), np.searchsorted(edges, f, side="right"), growth.MISSING)
        each = np.where(np.isfinite(f), np.unique(f, return_inverse=True)[1], growth.MISSING)
        exact, _ = growth.best_cut(bins(each), rules)
        coarse, bound = growth.best_cut(bins(code), rules)
        assert max(coarse[0], bound.max()) >= exact[0] - 1e-9
        inside = np.flatnonzero((bins(code)["low"][: len(bound)] <= exact[2]) & (exact[2] < bins(code)["high"][: len(bound)])) if exact[0] else []
        assert all(bound[k] >= exact[0] - 1e-9 for k in inside)


def test_sketches_merge():
    r = np.random.default_rng(1)
    values = r.lognormal(size=300_000)
    parts = []
    for piece in np.array_split(values, 7):
        s = growth.Sketch()
        for batch in np.array_split(piece, 11):
            s.add(batch)
        parts += list(s.parts())
    whole = growth.Sketch()
    for k, v in parts:
        whole.add(v, k)
    points = whole.points(101)
    ranks = np.searchsorted(np.sort(values), points) / len(values)
    assert np.abs(ranks - np.linspace(0, 1, len(points))).max() < 0.01
    assert sum(len(v) for _, v in whole.parts()) < 20 * growth.SKETCH
    few = growth.Sketch()
    few.add(np.array([3.0, 1.0, 3.0]))
    assert few.points(10).tolist() == [1.0, 3.0] and len(growth.Sketch().points(5)) == 0


def batch_of(ids, static, series, g, h):
    d = pa.array([[{"g": a, "h": b}] for a, b in zip(g, h)])
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(static, pa.list_(pa.float64())), pa.array(series, pa.list_(pa.list_(pa.float64()))), d], names=["id", "static", "series", "d"])


def test_donors_come_from_the_nodes_rows_by_weight():
    r = np.random.default_rng(2)
    n, slots = 24, 4000
    static = [[float(i % 2)] for i in range(n)]
    series = [[[float(i), float(i) + 1.0, 0.5, None if i in (3, 8) else 2.0]] for i in range(n)]
    g, h = r.normal(size=n), r.uniform(0.5, 2, n)
    tree = [Node(spec=Spec("static", column=0), threshold=0.5, left=1, right=2), Node(), Node()]
    mean = 0.3
    level = Level([tree], (1, 1, 4), split.ScanRules(), 5, 2, [0.0], {(0, 1): [], (0, 2): []}, {}, {(0, 1): mean, (0, 2): mean})
    pieces = {(0, 1): [Piece(0, 0, 0, 4, True)] * slots, (0, 2): [Piece(0, 0, 0, 4)] * slots}
    ids = r.integers(-(2**62), 2**62, n)
    halves = [batch_of(ids[q].tolist(), [static[i] for i in q], [series[i] for i in q], g[q], h[q]) for q in (np.arange(0, 9), np.arange(9, n))]
    won: dict = {}
    for b in halves:  # one task each
        for out in growth.donor_races(level, pieces)(iter([b])):
            for row in out.to_pylist():
                key = (row["node"], row["slot"])
                won[key] = min(won.get(key, (np.inf, None)), (row["key"], int(row["piece"][0])))
    assert len(won) == 2 * slots
    for node, even in ((1, True), (2, False)):
        mine = [i for i in range(n) if (i % 2 == 0) == even]
        weight = np.array([0.0 if i in (3, 8) else h[i] * (-g[i] / h[i] - mean) ** 2 if even else 1.0 for i in mine])
        seen = np.array([won[node, s][1] for s in range(slots)])
        assert set(seen.tolist()) <= set(mine)
        share, want = np.array([(seen == i).mean() for i in mine]), weight / weight.sum()
        assert np.abs(share - want).max() < 5 * np.sqrt(0.25 / slots) and (share[weight == 0] == 0).all()


def test_refit_is_that_of_the_whole_table(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(90, 1, 20))
    y = r.normal(size=90)
    g = grower(frame(spark, r.normal(size=(90, 1)), x, y).repartition(4), boost.Params(draws=Draws(components=4, ridge=0.7)))
    g.level.pools, g.level.means = {(0, 0): []}, {(0, 0): 0.0}
    unit = (np.arange(7) - 3.0) / np.linalg.norm(np.arange(7) - 3.0)
    got = g._refits({(0, 0, 5): (0, 0, unit.tolist())})[0, 0, 5][2]
    _, place = match_template(x[:, 0], unit.tolist(), "correlation")
    w = x[np.arange(90)[:, None], 0, np.round(place * 13).astype(int)[:, None] + np.arange(7)]
    want = refit_template((w - w.mean(1, keepdims=True)).tolist(), (y - y.mean()).tolist(), [1.0] * 90, dct_basis(7, 4), 0.7)
    assert np.allclose(got, want)


def test_screening_rows_add_nothing(spark):
    r = np.random.default_rng(7)
    n = 400
    static = r.normal(size=(n, 1))
    series = r.normal(size=(n, 2, 12))
    y = series[:, 0, :4].mean(1) * 3 + r.normal(0, 0.1, n)
    spec = lambda c: Spec("interval", channel=c, start=0, end=4, stat="mean")
    bank = Bank(8, [Entry(spec(c), gain=1.0, stats=(0.0, 1.0, -3.0, 3.0)) for c in (1, 0)] + [Entry(Spec("interval", channel=1, start=5, end=9, stat="max"), gain=1.0)])
    params = boost.Params(bank=8, screen=1, screen_share=0.3, draws=Draws(intervals=0), depth=1)
    rows = boost.stored(frame(spark, static, series, y))
    left_out = []
    for round_ in range(2):
        g = grower(rows, params, bank, round_=round_)
        g._screen()
        assert [e.spec for e in g.shortlist[0]] == [spec(0)] and g.level.folds == [0.3]
        ids = np.array([x.id for x in g.work.orderBy("row_id").select("id").collect()]).astype(np.uint64)
        fold = growth.in_fold(ids, g.level, 0)
        x, t = series[fold, 0, :4].mean(1), (y - y.mean())[fold]
        found = g.moments([spec(0)], 0)
        assert found.n[0, 0] == fold.sum() and found.correlation(0, 1) == pytest.approx(abs(np.corrcoef(x, t)[0, 1]))
        g._draw({(0, 0): 1})
        cuts, whole = g._cuts()
        assert whole[0, 0].n == (~fold).sum() and whole[0, 0].g == pytest.approx((y.mean() - y)[~fold].sum())
        assert all(c[7] + c[9] == pytest.approx((~fold).sum()) for c in cuts if c[3] > 0)
        left_out.append(fold)
    assert 60 < left_out[0].sum() < 180 and (left_out[0] != left_out[1]).any()
    few = grower(rows.limit(8), params, bank)
    few._screen()
    assert few.level.folds == [0.0] and len(few.shortlist[0]) == 3


def test_chance_in_growth_is_chance_gain(spark):
    r = np.random.default_rng(6)
    n = 120
    x = r.normal(size=(n, 4))
    x[r.random((n, 4)) < 0.1] = np.nan
    rows = boost.stored(frame(spark, x, [[]] * n, r.normal(size=n)).repartition(3))
    params = boost.Params(null=6, null_quantile=0.5, seed=3, depth=1)
    g = grower(rows, params)
    g._draw({(0, 0): 1})
    got = g.chance()[0, 0]
    long = g.work.select("row_id", F.posexplode("static").alias("candidate", "f"), F.get("d", F.lit(0))["g"].alias("g"), F.get("d", F.lit(0))["h"].alias("h"), F.lit(0).alias("node"))
    want = split.chance_gain(long, ["node"], "row_id", params.rules, permutations=6, quantile=0.5, seed=3).first().chance
    assert got == pytest.approx(want, abs=1e-8) and got > 0
    # noise alone doesn't pass the largest of many permutations; a real step does
    strict = boost.Params(rounds=1, depth=1, null=20)
    assert boost.fit_regressor(rows, strict).splits() == []
    real = frame(spark, x, [[]] * n, np.where(np.nan_to_num(x[:, 2]) > 0, 2.0, 0.0) + r.normal(0, 0.1, n))
    assert boost.fit_regressor(real, strict).splits()[0]["feature"] == "static[2]"


def test_each_node_draws_its_own_pool(spark):
    r = np.random.default_rng(8)
    rows = boost.stored(frame(spark, r.normal(size=(200, 1)), r.normal(size=(200, 3, 40)), r.normal(size=200)))
    g = grower(rows, boost.Params(depth=2, draws=Draws(intervals=6, shapelets=3, filters=2, fitted=1)))
    g.level.trees[0] = [Node(spec=Spec("static"), threshold=0.0, left=1, right=2), Node(), Node()]
    g.sums |= {(0, 1): (1.0, 90.0), (0, 2): (-1.0, 110.0)}
    g._draw({(0, 1): 2, (0, 2): 3})
    a, b = (set(g.level.pools[0, i]) for i in (1, 2))
    assert a & b == {Spec("static", column=0)} and {s.kind for s in a} == {"static", "interval", "shapelet_dist", "shapelet_pos", "filter_resp", "filter_pos"}
    side = {x.row_id: x.static[0] <= 0 for x in rows.collect()}
    held = {i: [c for x in rows.collect() if side[x.row_id] == (i == 1) for c in x.series] for i in (1, 2)}
    for i in (1, 2):
        for s in g.level.pools[0, i]:
            if s.kind == "shapelet_dist":
                t = list(s.template)
                assert any(c[k : k + len(t)] == t for c in held[i] for k in range(len(c)))


def test_kinds(spark):
    r = np.random.default_rng(9)
    static, series = r.normal(size=(30, 2)), r.normal(size=(30, 1, 9))
    static[3, 1] = np.nan
    inner = Spec("interval", channel=0, start=1, end=6, stat="mean")
    grids = (tuple(sorted(r.normal(size=7).tolist())), tuple(sorted(r.normal(size=5).tolist())))
    spec = Spec("comparison", column=1, inner=inner, grids=grids)
    got = kernel.evaluate([spec], static, series)[:, 0]
    want = [np.nan if b != b else np.mean(np.array(grids[0]) <= a) - np.mean(np.array(grids[1]) <= b) for a, b in zip(series[:, 0, 1:6].mean(1), static[:, 1])]
    assert np.allclose(got, want, equal_nan=True)
    rows = frame(spark, static, series, static[:, 0])
    column = [x[0] for x in rows.orderBy("row_id").select(spec_column(spec)).collect()]
    assert np.allclose([np.nan if v is None else v for v in column], want, equal_nan=True)
    raw = Spec("shapelet_dist", channel=0, template=(0.5, -0.5, 1.0), normalise=False)
    assert np.allclose(kernel.evaluate([raw], static, series)[:, 0], [min(((x[0, k : k + 3] - raw.template) ** 2).mean() for k in range(7)) for x in series])
    with pytest.raises(ValueError, match="unknown kind"):
        kernel.evaluate([Spec("other")], static, series)


def test_everything_is_saved(spark, tmp_path):
    r = np.random.default_rng(10)
    n = 150
    series = r.normal(size=(n, 1, 16))
    rows = boost.stored(frame(spark, r.normal(size=(n, 1)), series, (series[:, 0, 4:9].mean(1) > 0).astype(float)))
    params = boost.Params(rounds=3, depth=2, bank=4, products=2, null=2, draws=Draws(intervals=8, stats=("mean",), shapelets=1, normalise=False), rules=split.ScanRules(l2=0.5))
    model = boost.Booster(logistic(), params).fit(rows)
    persistence.save(model, spark, str(tmp_path / "m"))
    again = persistence.load(spark, str(tmp_path / "m"))
    assert again.params == params and again.bank.summary() == model.bank.summary() and model.bank.entries
    assert [e.frozen() for e in again.bank.entries] == [e.frozen() for e in model.bank.entries]
    a, b = ([x.probability for x in m.predict(rows).orderBy("row_id").collect()] for m in (model, again))
    assert a == b
