import numpy as np
import pytest
from pyspark.sql import functions as F

from rowtrail.operators import design, ridge, sampling


def frame(spark, x, t, z=None, parts=3):
    rows = [(i, i % 6, x[i].tolist(), t[i].tolist(), (z[i] if z is not None else np.ones(1)).tolist()) for i in range(len(x))]
    return spark.createDataFrame(rows, "i int, grp int, x array<double>, t array<double>, z array<double>").repartition(parts)


def refit(base, x, t, z, keep, at):
    a = np.hstack([z, (x - base.center) / base.scale])
    pen = np.diag([0.0] * z.shape[1] + [base.penalty] * x.shape[1])
    w = np.linalg.solve(a[keep].T @ a[keep] + pen, a[keep].T @ t[keep])
    return a[at] @ w


@pytest.mark.parametrize("width,rows_side", [(9, False), (90, True), (90, False)])
def test_design_and_both_sides_equal_refits(spark, width, rows_side):
    """With an unpenalised design, by features and by rows: held-out margins are those of refits."""
    r = np.random.default_rng(3)
    n = 60
    x, s = r.normal(size=(n, width)), r.normal(size=(n, 2))
    t = np.hstack([1.5 * x[:, :1] - x[:, 3:4] + s[:, :1] + r.normal(0, 0.3, (n, 1)), np.sign(x[:, 1:2])])
    z = np.hstack([np.ones((n, 1)), s])
    rows = frame(spark, x, t, z)
    base = ridge.fit_ridge(rows, z="z", group="grp", id_column="i" if rows_side else None)
    one = {q.i: q.margin for q in base.leave_one_out(rows).collect()}
    group = {q.i: q.margin for q in base.leave_group_out(rows, "grp", "i").collect()}
    full = {q.i: q.margin for q in base.margins(rows).collect()}
    every = np.arange(n)
    lost = 0.0
    for i in range(n):
        assert one[i] == pytest.approx(refit(base, x, t, z, every != i, [i])[0], abs=1e-6)
        without = refit(base, x, t, z, every % 6 != i % 6, [i])[0]
        assert group[i] == pytest.approx(without, abs=1e-6)
        assert full[i] == pytest.approx(refit(base, x, t, z, every >= 0, [i])[0], abs=1e-6)
        lost += ((without - t[i]) ** 2).sum()
    assert base.loo_error == pytest.approx(lost / (2 * n), rel=1e-6)


def test_noise_is_declined_and_signal_kept(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(80, 12))
    for t, declined in ((np.sign(r.normal(size=(80, 1))), True), (np.sign(x[:, :1] + 0.2 * r.normal(size=(80, 1))), False)):
        rows = frame(spark, x, t)
        base = ridge.fit_ridge(rows)
        null = ridge.chance_r2(rows, base, "i", permutations=16)
        assert -0.5 < null < 0.5 and base.declined == declined
    ridge.calibrate(rows, base, "i")
    a, b = base.calibration[0]
    assert a > 0
    held = {q.i: q.margin[0] for q in base.leave_one_out(rows).collect()}
    p = 1 / (1 + np.exp(-np.array([held[i] for i in range(80)])))
    assert abs(p.mean() - (t > 0).mean()) < 0.01  # Newton's optimum balances the classes
    # a margin that points the wrong way is flattened, not turned round
    assert ridge.platt(rows, -F.get("t", F.lit(0)) * 2 + F.get("x", F.lit(3)) / 9, (F.get("t", F.lit(0)) > 0).cast("int"), 8)[0] == 0.0


def test_random_fourier_features(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(10, 4))
    got = np.array([q.v for q in frame(spark, x, x).orderBy("i").select(ridge.random_fourier(F.col("x"), 4, 2000, 1.0, 3).alias("v")).collect()])
    assert np.allclose(got[:, :4], x)
    kernel = got[:, 4:] @ got[:, 4:].T
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 8)
    assert np.abs(kernel - want).max() < 0.12


def test_tiles_give_the_same_sums(spark, monkeypatch):
    r = np.random.default_rng(2)
    x, t = r.normal(size=(40, 7)), r.normal(size=(40, 1))
    rows = frame(spark, x, t)
    whole, n = ridge.cross_products(rows, ["x", "t"], (7, 1))
    monkeypatch.setattr(ridge, "TILE", 3)
    parts, _ = ridge.cross_products(rows, ["x", "t"], (7, 1))
    v = np.hstack([x, t])
    assert n == 40 and np.allclose(whole, v.T @ v) and np.allclose(parts, whole)


def test_sampling(spark):
    rows = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("label"), (F.col("id") * 1.0).alias("v"))
    placed = sampling.hash_order(rows, sampling.uniform(1, F.col("row_id"))).orderBy("place").collect()
    assert [p.place for p in placed] == list(range(1000)) and [p.row_id for p in placed] != list(range(1000))
    assert sampling.exact_subsample(rows, "row_id", 0.1234).count() == 123
    assert sampling.exact_subsample(rows, "row_id", 1e-9).count() == 1
    some = sampling.capped_subsample(rows, "row_id", "label", 50).groupBy("label").count().collect()
    assert sorted(s["count"] for s in some) == [17, 17, 17]
    assert sampling.capped_subsample(rows, "row_id", "label", 0).count() == 1000
    mixed = sampling.permuted(rows, "row_id", "v", [5, 6]).collect()
    for k in (0, 1):
        assert sorted(m.shuffled[k] for m in mixed) == [float(i) for i in range(1000)]
        assert sum(m.shuffled[k] == m.row_id for m in mixed) < 10
    drawn = [sampling.weighted_choice(rows, "row_id", F.when(F.col("row_id") % 10 == 0, F.lit(9.0)).when(F.col("row_id") % 10 == 1, F.lit(1.0)).otherwise(F.lit(0.0)), ["label"], s).collect() for s in range(20)]
    picks = [r.row_id % 10 for d in drawn for r in d]
    assert len(picks) == 60 and set(picks) <= {0, 1} and 44 <= picks.count(0) <= 60
    assert [sampling.thinned(*a) for a in ((0, 0.5), (5, 0.5), (4, 0.1))] == [0, 3, 1]


def test_blocks_are_coerced_and_checked(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([(1, [1.0, nan, None], [[1.0, -inf], [None, 2.0]])], "row_id int, static array<double>, series array<array<double>>")
    got = design.coerced(rows, pad_to=3).first()
    assert got.static == [1.0, None, None] and got.series == [[1.0, None, None], [None, 2.0, None]]
    flat = design.coerced(rows.select("row_id", F.lit(7).alias("s"), F.array(F.lit(1), F.lit(2)).alias("x")), "s", "x").first()
    assert flat.static == [7.0] and flat.series == [[1.0, 2.0]]
    with pytest.raises(ValueError):
        design.coerced(rows, None, None)
    with pytest.raises(Exception, match="longer than the frozen"):
        design.coerced(rows, pad_to=1).collect()
    with pytest.raises(Exception, match="2 static columns"):
        design.checked(design.coerced(rows), 2, 2, 2).collect()
    assert design.drop_static(rows).first().static == []


def test_products_and_design(spark):
    rows = spark.createDataFrame([(i, [float(i), None if i == 3 else 2.0 * i, 5.0], [0.5, -1.0]) for i in range(8)], "row_id int, static array<double>, margin array<double>")
    scale = design.StaticScale.fit(rows, 3)
    v = np.array([0, 2, 4, 8, 8, 10, 12, 14.0])
    assert scale.mean[1] == pytest.approx(v.mean()) and scale.sd[1] == pytest.approx(v.std()) and scale.kept() == [0, 1]
    beyond = rows.select(F.array(F.lit(100.0), F.lit(None).cast("double"), F.lit(5.0)).alias("static"), "margin").limit(1)
    got = design.augmented(beyond, "margin", scale).first().static
    assert len(got) == len(design.augmented_names(3, 2, True)) == 3 + 2 + 6
    assert got[5] == pytest.approx(0.5 * (7 - 3.5) / np.arange(8).std()) and got[8] == pytest.approx(-2 * got[5])
    d = design.StaticDesign.fit(spark.range(40).select(F.array(F.col("id") * 1.0, (F.col("id") % 4) * 1.0).alias("static")), 2, interactions=True)
    assert d.width == 4 and d.pairs == [(1, 0)]
    row = spark.createDataFrame([([9.0, 3.0],)], "static array<double>").select(d.column(F.col("static")).alias("d")).first().d
    assert row[0] == 1.0 and row[3] == pytest.approx((10 / 40 - 0.5) * (1.0 - 0.5))


def test_representations(spark):
    series = [[float(i) if i % 3 else None for i in range(16)], [1.0] * 16]
    rows = spark.createDataFrame([(1, [7.0], series)], "row_id int, static array<double>, series array<array<double>>")
    sizes = {n: len(design.represented(rows, n).first().x) for n in design.REPRESENTATIONS}
    assert sizes == {"static_only": 1, "agg": 21, "wagg4": 81, "wagg8": 161, "wagg16": 321, "raw_flat": 33, "agg_naive": 21, "wagg8_naive": 161}
    strict = design.represented(rows, "agg_naive").first().x
    assert strict[1] is None and strict[11] == 1.0
    with pytest.raises(ValueError):
        design.represented(rows, "other")


def by_id(rows, of="margin"):
    return np.array([q[of] for q in rows.orderBy("i").collect()])


def test_leading_axes_equal_the_dense_fit_where_they_are_the_rank(spark):
    r = np.random.default_rng(11)
    n, width = 70, 90
    x, s = r.normal(size=(n, 12)) @ r.normal(size=(12, width)), r.normal(size=(n, 1))
    t = x[:, :2] / 4 + s + r.normal(0, 0.5, (n, 2))
    rows = frame(spark, x, t, np.hstack([np.ones((n, 1)), s])).persist()
    dense = ridge.fit_ridge(rows, z="z", group="grp")
    part = ridge.fit_ridge(rows, z="z", group="grp", axes=20)
    assert part.penalty == pytest.approx(dense.penalty) and part.captured == pytest.approx(1) and len(part.values) == 12
    assert part.loo_error == pytest.approx(dense.loo_error, rel=1e-8)
    for of in ("margins", "leave_one_out"):
        assert np.allclose(by_id(getattr(part, of)(rows)), by_id(getattr(dense, of)(rows)), atol=1e-6)
    assert np.allclose(by_id(part.leave_group_out(rows, "grp", "i")), by_id(dense.leave_group_out(rows, "grp", "i")), atol=1e-6)
    assert ridge.chance_r2(rows, part, "i", z="z", permutations=8) == pytest.approx(ridge.chance_r2(rows, dense, "i", z="z", permutations=8), abs=1e-6)
    rows.unpersist()


def test_fewer_axes_than_the_rank_find_the_greatest(spark, monkeypatch):
    r = np.random.default_rng(12)
    x = r.normal(size=(120, 40)) * 0.7 ** np.arange(40) @ np.linalg.qr(r.normal(size=(40, 40)))[0]
    rows = frame(spark, x, r.normal(size=(120, 1))).persist()
    monkeypatch.setattr(ridge, "TILE", 12)  # three axes a pass
    part = ridge.fit_ridge(rows, axes=16)
    v = (x - x.mean(0)) / x.std(0)
    whole = np.linalg.eigvalsh(v.T @ v)[::-1]
    assert np.allclose(sorted(part.values, reverse=True)[:8], whole[:8], rtol=1e-5)
    assert part.captured == pytest.approx(part.values.sum() / whole.sum(), rel=1e-6) and 0.9 < part.captured < 1
    rows.unpersist()


def test_twenty_thousand_features(spark):
    r = np.random.default_rng(13)
    x = r.normal(size=(30, 20_000))
    rows = frame(spark, x, x[:, :1] + r.normal(size=(30, 1))).persist()
    part, dense = ridge.fit_ridge(rows), ridge.fit_ridge(rows, id_column="i")
    assert len(part.values) == 29 and np.allclose(sorted(part.values), sorted(dense.values), rtol=1e-8)
    assert np.allclose(by_id(part.leave_one_out(rows)), by_id(dense.leave_one_out(rows)), atol=1e-6)
    with pytest.raises(ValueError, match="numbers"):
        ridge.fit_ridge(rows, axes=1 << 20)
    rows.unpersist()
