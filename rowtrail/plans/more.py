"""Registered queries of row blocks, hold-outs, banks and derived columns, with their SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import mixed_hash
from ..operators import design, ridge, sampling, temporal
from ..operators.bank import Bank
from ..operators.specs import Spec
from ..operators.tables import folder_of
from ..sources import datasets, recording_source, recordings
from .catalogue import QUERIES, hash_sql, query, rounded, table, user_series

# ---------------------------------------------------------------- coercion and blocks

DIRTY = "WITH e AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN NULL ELSE value END AS v FROM events)"


def dirty_events(spark, sf_dir) -> DataFrame:
    """Events whose values are NaN or infinite here and there, as arrays of one number."""
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.array(v).alias("static"))


@query(f"{DIRTY} SELECT event_type, count(*) AS n, count(v) AS seen, round(avg(v), 6) + 0.0 AS mean, round(max(v), 6) + 0.0 AS high, round(min(v), 6) + 0.0 AS low FROM e GROUP BY event_type")
def finite_values(spark, sf_dir):
    """NaN and infinite numbers count as missing."""
    clean = design.coerced(dirty_events(spark, sf_dir), "static", None).select("event_type", F.get("static", F.lit(0)).alias("v"))
    return rounded(clean.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("seen"), F.avg("v").alias("mean"), F.max("v").alias("high"), F.min("v").alias("low")))


PEOPLE = "WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal / 1000 END AS a, CAST(c_nationkey AS DOUBLE) AS b, CAST(c_custkey % 5 - 2 AS DOUBLE) AS m FROM customer)"
SCALED = f"{PEOPLE}, q AS (SELECT median(a) AS ma, median(b) AS mb, min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb FROM p), f AS (SELECT avg(coalesce(a, ma)) AS ca, stddev_pop(coalesce(a, ma)) AS sa, avg(coalesce(b, mb)) AS cb, stddev_pop(coalesce(b, mb)) AS sb FROM p, q)"


def people(spark, sf_dir) -> DataFrame:
    """(row_id, static = [balance or missing, nation], margin)."""
    c = table(spark, sf_dir, "customer")
    balance = F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal") / 1000)
    return c.select(F.col("c_custkey").alias("row_id"), F.array(balance, F.col("c_nationkey").cast("double")).alias("static"), F.array((F.col("c_custkey") % 5 - 2).cast("double")).alias("margin"))


@query(
    f"{SCALED} SELECT c_custkey AS row_id, round(a, 6) + 0.0 AS x0, round(b, 6) + 0.0 AS x1, round(m, 6) + 0.0 AS x2, round(m * (least(greatest(coalesce(a, ma), la), ha) - ca) / sa, 6) + 0.0 AS x3, round(m * (least(greatest(b, lb), hb) - cb) / sb, 6) + 0.0 AS x4 FROM p, q, f"
)
def augmented_products(spark, sf_dir):
    """Statics with a margin and its products with the standardised statics."""
    rows = people(spark, sf_dir)
    wide = design.augmented(rows, "margin", design.StaticScale.fit(rows, 2))
    return rounded(wide.select("row_id", *[F.get("static", F.lit(i)).alias(f"x{i}") for i in range(5)]))


@query(f"{SCALED} SELECT c_custkey AS row_id, 1.0::DOUBLE AS z0, round((coalesce(a, ma) - ca) / sa, 6) + 0.0 AS z1, round((b - cb) / sb, 6) + 0.0 AS z2 FROM p, q, f")
def static_design(spark, sf_dir):
    rows = people(spark, sf_dir)
    z = design.StaticDesign.fit(rows, 2).column(F.col("static"))
    return rounded(rows.select("row_id", z.alias("z")).select("row_id", *[F.get("z", F.lit(i)).alias(f"z{i}") for i in range(3)]))


@query(f"{PEOPLE} SELECT c_custkey AS row_id, round(coalesce(a, 0), 6) + 0.0 AS x0, round(b, 6) + 0.0 AS x1, CAST(0 AS INTEGER) AS width FROM p")
def zero_and_drop(spark, sf_dir):
    """Missing statics as 0, and the width of the block once it is dropped."""
    rows = people(spark, sf_dir)
    zero = rows.select("row_id", design.zero_missing(F.col("static")).alias("x"))
    none = design.drop_static(rows).select("row_id", F.size("static").alias("width"))
    return rounded(zero.join(none, "row_id").select("row_id", F.get("x", F.lit(0)).alias("x0"), F.get("x", F.lit(1)).alias("x1"), "width"))


@query("SELECT s_acctbal AS v, round(cume_dist() OVER (ORDER BY s_acctbal), 6) + 0.0 AS share FROM supplier QUALIFY row_number() OVER (PARTITION BY s_acctbal ORDER BY s_suppkey) = 1")
def frozen_grid(spark, sf_dir):
    """A column's sorted distinct values with the share of rows up to each."""
    values, shares = design.rank_scale(table(spark, sf_dir, "supplier"), "s_acctbal", 1 << 20)
    return rounded(spark.createDataFrame(list(zip(values, shares)), "v double, share double"))


@query(
    "WITH e AS (SELECT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS t, value FROM events WHERE event_type = 'view'), d AS (SELECT user_id, t, avg(value) AS v FROM e GROUP BY ALL), "
    "g AS (SELECT user_id, t FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range(0, 30)) AS t)), s AS (SELECT g.user_id, g.t, d.v FROM g LEFT JOIN d USING (user_id, t)), "
    "w AS (SELECT user_id, CASE WHEN t < 16 THEN t // 8 ELSE 2 + (t - 16) // 7 END AS k, v FROM s) "
    "SELECT user_id AS row_id, " + ", ".join(f"round(avg(v) FILTER (k = {k}), 6) + 0.0 AS mean{k}, round(max(v) FILTER (k = {k}), 6) + 0.0 AS max{k}" for k in range(4)) + " FROM w GROUP BY user_id"
)
def windowed_representation(spark, sf_dir):
    """The registered four-window representation of a channel: its means and maxima."""
    from ..sources import series

    arrays = series.to_arrays(user_series(spark, sf_dir).where("channel = 'view'"), ["user_id"])
    rows = arrays.select(F.col("user_id").alias("row_id"), F.array().cast("array<double>").alias("static"), F.array("series").alias("series"))
    x = design.represented(rows, "wagg4")
    return rounded(x.select("row_id", *[F.get("x", F.lit(10 * k + i)).alias(f"{n}{k}") for k in range(4) for n, i in (("mean", 0), ("max", 3))]))


# ---------------------------------------------------------------- ridge on one feature, where SQL can follow

ONE = "WITH r AS (SELECT c_custkey AS i, c_nationkey % 5 AS g, c_acctbal / 1000 AS x, c_nationkey / 10.0 + c_acctbal / 4000 AS t, CAST(length(c_mktsegment) AS DOUBLE) AS s FROM customer), a AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, count(*) AS n FROM r), z AS (SELECT i, g, (x - mx) / sx AS z, t, s, n, 0.001 * n AS pen FROM r, a)"


def one_feature(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    target = F.col("c_nationkey") / 10.0 + F.col("c_acctbal") / 4000
    return c.select(F.col("c_custkey").alias("i"), (F.col("c_nationkey") % 5).alias("g"), F.array(F.col("c_acctbal") / 1000).alias("x"), F.array(target).alias("t"), F.array(F.lit(1.0), F.length("c_mktsegment").cast("double")).alias("z"))


def margin_of(rows: DataFrame) -> DataFrame:
    return rounded(rows.select("i", F.get("margin", F.lit(0)).alias("margin")))


@query(f"{ONE}, b AS (SELECT avg(t) AS mt, sum(z * t) / (count(*) + max(pen)) AS beta FROM z) SELECT i, round((mt + beta * z - (1.0 / n + z * z / (n + pen)) * t) / (1 - 1.0 / n - z * z / (n + pen)), 6) + 0.0 AS margin FROM z, b")
def ridge_loo_margins(spark, sf_dir):
    """Leave-one-out margins of a ridge with one penalty on one feature."""
    rows = one_feature(spark, sf_dir)
    return margin_of(ridge.fit_ridge(rows, penalties=1).leave_one_out(rows))


@query(f"{ONE}, b AS (SELECT avg(t) AS mt, sum(z * t) / (count(*) + max(pen)) AS beta FROM z) SELECT i, round(mt + beta * z, 6) + 0.0 AS margin FROM z, b")
def ridge_full_margins(spark, sf_dir):
    rows = one_feature(spark, sf_dir)
    return margin_of(ridge.fit_ridge(rows, penalties=1).margins(rows))


@query(
    f"{ONE}, w AS (SELECT count(*) AS n, sum(z) AS sz, sum(t) AS st, sum(z * z) AS szz, sum(z * t) AS szt FROM z), k AS (SELECT g, count(*) AS n, sum(z) AS sz, sum(t) AS st, sum(z * z) AS szz, sum(z * t) AS szt FROM z GROUP BY g), "
    "m AS (SELECT k.g, w.n - k.n AS n, w.sz - k.sz AS sz, w.st - k.st AS st, w.szz - k.szz AS szz, w.szt - k.szt AS szt, 0.001 * w.n AS pen FROM w, k), c AS (SELECT g, sz / n AS mz, st / n AS mt, (szt - sz * st / n) / (szz - sz * sz / n + pen) AS beta FROM m) "
    "SELECT i, round(mt + beta * (z - mz), 6) + 0.0 AS margin FROM z JOIN c USING (g)"
)
def logo_margins(spark, sf_dir):
    """Leave-one-group-out margins: SQL refits without each group."""
    rows = one_feature(spark, sf_dir)
    return margin_of(ridge.fit_ridge(rows, penalties=1).leave_group_out(rows, "g", "i"))


@query(
    f"{ONE}, f AS (SELECT avg(s) AS ms, var_pop(s) AS vs, regr_slope(z, s) AS bz, regr_intercept(z, s) AS az, regr_slope(t, s) AS bt, regr_intercept(t, s) AS a_t FROM z), e AS (SELECT i, t, s, n, ms, vs, z - az - bz * s AS rz, t - a_t - bt * s AS rt, a_t + bt * s AS ft FROM z, f), "
    "p AS (SELECT sum(rz * rz) AS q, sum(rz * rt) AS c FROM e) SELECT i, round((ft + c / (1.001 * q) * rz - h * t) / (1 - h), 6) + 0.0 AS margin FROM (SELECT *, 1.0 / n + (s - ms) * (s - ms) / (n * vs) + rz * rz / (1.001 * q) AS h FROM e, p)"
)
def design_loo_margins(spark, sf_dir):
    """The same with an unpenalised static beside the feature: both are taken out of target and feature first."""
    rows = one_feature(spark, sf_dir)
    return margin_of(ridge.fit_ridge(rows, penalties=1, z="z").leave_one_out(rows))


# ---------------------------------------------------------------- models and samples


def boosted_fusion(spark, sf_dir):
    """Boosting with templates, filters, a bank and products on embeddings as series: the class of every vector."""
    from ..operators import boost
    from ..operators.specs import Draws

    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.array(F.col("embedding")[0].cast("double")).alias("static"), F.array(F.col("embedding").cast("array<double>")).alias("series"), (F.col("label") % 2).alias("label"))
    rows = boost.stored(e)
    params = boost.Params(rounds=4, depth=3, rate=0.4, bank=16, products=2, charge=0.02, draws=Draws(intervals=12, shapelets=4, filters=4, fitted=2))
    return boost.fit_classifier(rows, params).predict(rows).select("row_id", "prediction")


QUERIES["boosted_fusion"] = boosted_fusion


@query(f"WITH h AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {hash_sql('c_custkey')}, c_custkey) - 1 AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT c_custkey, c_mktsegment FROM h WHERE r < greatest(round(n * 0.2), 1)")
def exact_stratified_sample(spark, sf_dir):
    """A fifth of each class, one row at least, in hash order found through bucket counts."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    place = sampling.hash_order(c, mixed_hash(F.col("c_custkey")) / float(1 << 32), ["c_mktsegment"])
    sizes = c.groupBy("c_mktsegment").agg(F.greatest(F.round(F.count(F.lit(1)) * 0.2), F.lit(1.0)).alias("quota"))  # a row a class
    return place.join(F.broadcast(sizes), "c_mktsegment").where("place < quota").select("c_custkey", "c_mktsegment")


@query("WITH p AS (SELECT p_partkey, p_retailprice AS gain, p_size AS last_round, row_number() OVER (ORDER BY p_retailprice DESC, p_size DESC, p_partkey DESC) AS r FROM part) SELECT p_partkey, gain, last_round FROM p WHERE r <= 64")
def bank_after_eviction(spark, sf_dir):
    """What a bank of 64 keeps of features that are all unlike: tasks fill banks of their own, and one takes those in."""
    schema = "p_partkey long, gain double, last_round int"

    def kept(rows) -> list[tuple]:
        bank = Bank(64)
        for key, gain, last in sorted(rows):
            bank.credit(Spec("static", column=key), gain, last)
        return [(e.spec.column, e.gain, e.last_round) for e in bank.entries]

    def fill(frames):
        import pandas as pd

        rows: list[tuple] = []
        for f in frames:
            rows = kept([*rows, *f.itertuples(index=False, name=None)])
        yield pd.DataFrame(rows, columns=["p_partkey", "gain", "last_round"])

    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col("p_retailprice").cast("double").alias("gain"), F.col("p_size").cast("int").alias("last_round"))
    filled = parts.mapInPandas(fill, schema)  # 64 rows a task
    return spark.createDataFrame(kept([tuple(r) for r in filled.repartition(1).mapInPandas(fill, schema).collect()]), schema)


@query("SELECT p_brand AS family, count(*) AS n, round(sum(p_retailprice), 6) + 0.0 AS gain, max(p_size) AS last_round FROM part GROUP BY p_brand")
def bank_summary(spark, sf_dir):
    """A bank that was credited with each brand's wins, as it sums itself up."""
    wins = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.sum("p_retailprice").alias("gain"), F.max("p_size").alias("last_round")).orderBy("p_brand").collect()  # a row a brand
    bank = Bank(len(wins))
    for place, w in enumerate(wins):
        half = float(w.gain) / 2
        for gain, last in ((half, 0), (float(w.gain) - half, w.last_round)):
            bank.credit(Spec("interval", channel=place, end=9, stat="mean"), gain, last)
    rows = [(wins[int(s["family"].split("=")[1][:-1])].p_brand, wins[int(s["family"].split("=")[1][:-1])].n, s["gain"], s["last_round"]) for s in bank.summary()]
    return rounded(spark.createDataFrame(rows, "family string, n long, gain double, last_round int"))


@query("SELECT o_orderkey AS row_id, o_orderstatus <> 'P' AS is_train, row_number() OVER (ORDER BY CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END, o_orderkey) AS place FROM orders")
def train_first_order(spark, sf_dir):
    """Places in the order of training rows first."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), (F.col("o_orderstatus") != "P").alias("is_train"))
    return datasets.train_first_places(o).select("row_id", "is_train", "place")


# ---------------------------------------------------------------- derived columns and shapes of files


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) % 3 AS bucket FROM events")
def json_props(spark, sf_dir):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), (k % 3).alias("bucket"))


@query(
    "WITH r AS (SELECT c_custkey, ['a', 'b', 'c'][1 + c_custkey % 3] || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS record, 50.0 + c_nationkey AS weight, 150.0 + c_custkey % 50 AS height FROM customer) "
    "SELECT c_custkey, CAST(CAST(substr(record, 2) AS INTEGER) + CASE substr(record, 1, 1) WHEN 'b' THEN 100 WHEN 'c' THEN 200 ELSE 0 END AS INTEGER) AS subject, round(weight / ((height / 100) * (height / 100)), 6) + 0.0 AS bmi FROM r"
)
def derived_statics(spark, sf_dir):
    k = F.col("c_custkey")
    record = F.concat(F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (k % 3 + 1).cast("int")), F.lpad((k % 100).cast("string"), 2, "0"))
    bmi = datasets.body_mass(50.0 + F.col("c_nationkey"), 150.0 + (k % 50).cast("double"))
    return rounded(table(spark, sf_dir, "customer").select("c_custkey", datasets.apnea_group(record).alias("subject"), bmi.alias("bmi")))


@query("SELECT o_custkey AS row_id, round(max(o_totalprice) FILTER (r = 2), 6) + 0.0 AS oldest, round(max(o_totalprice) FILTER (r = 1), 6) + 0.0 AS newest FROM (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) GROUP BY o_custkey HAVING max(o_totalprice) FILTER (r = 2) IS NOT NULL")
def wide_months(spark, sf_dir):
    """A table with the newest step first becomes a series from the oldest on."""
    o = table(spark, sf_dir, "orders")
    top = F.slice(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_totalprice")), asc=False), 1, 2)
    wide = o.groupBy("o_custkey").agg(top.alias("p")).where(F.size("p") > 1).select("o_custkey", F.col("p")[0]["o_totalprice"].alias("m1"), F.col("p")[1]["o_totalprice"].alias("m2"), F.lit(0).alias("y"))
    rows = datasets.wide_table(wide, [], {"value": ["m2", "m1"]}, "y", "o_custkey")
    return rounded(rows.select("row_id", F.col("series")[0][0].alias("oldest"), F.col("series")[0][1].alias("newest")))


@query("WITH r AS (SELECT event_id, [click.value, click.value * 2] AS v, event_type FROM events click) SELECT event_id AS row, round(v[1], 6) + 0.0 AS a, round(v[2], 6) + 0.0 AS b, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS label FROM r")
def archive_rows(spark, sf_dir):
    """Events as lines of an archive file, read back with labels as places among the classes."""
    e = table(spark, sf_dir, "events")
    line = F.concat(F.col("value").cast("string"), F.lit(","), (F.col("value") * 2).cast("string"), F.lit(":"), F.col("event_type"))
    texts = e.select(F.col("event_id").cast("string").alias("path"), F.concat(F.lit("@problemName x\n@data\n"), line).alias("content"))
    both = datasets.train_and_test(datasets.ts_rows(texts), datasets.ts_rows(texts.limit(0)))
    return rounded(both.select(F.col("path").cast("long").alias("row"), F.col("series")[0][0].alias("a"), F.col("series")[0][1].alias("b"), F.col("label").cast("int").alias("label")))


# ---------------------------------------------------------------- running sums, differences, files side by side


@query("SELECT user_id, event_id, round(sum(value - 250) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS drift FROM events")
def cumulative_drift(spark, sf_dir):
    """The running sum of a user's steps in the order of time."""
    drifted = temporal.running_sum(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value") - 250, "drift")
    return rounded(drifted.select("user_id", "event_id", "drift"))


@query("SELECT DISTINCT o_custkey AS label FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P')")
def unknown_classes(spark, sf_dir):
    """Labels of one part that the other doesn't have."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("label"), "o_orderstatus")
    return datasets.unseen_labels(o.where("o_orderstatus <> 'P'"), o.where("o_orderstatus = 'P'"))


@query("WITH a AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS k FROM customer), b AS (SELECT DISTINCT user_id, lpad(CAST(user_id AS VARCHAR), 6, '0') AS k FROM events) SELECT 'd/' || a.k || 'E0.edf' AS path, 'd/' || b.k || 'EC.hyp' AS beside_path FROM a JOIN b USING (k)")
def files_beside(spark, sf_dir):
    """Files of two kinds joined on the first six characters of their names."""
    name = lambda c, end: F.concat(F.lit("d/"), F.lpad(c.cast("string"), 6, "0"), F.lit(end))
    a = table(spark, sf_dir, "customer").select(name(F.col("c_custkey"), "E0.edf").alias("path"), F.lit(b"").alias("content"))
    b = table(spark, sf_dir, "events").select("user_id").distinct().select(name(F.col("user_id"), "EC.hyp").alias("path"), F.lit(b"").alias("content"))
    return datasets.beside(a, b, lambda n: F.substring(n, 1, 6)).select("path", "beside_path")


@query(
    "WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS record, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x, CAST(label AS INTEGER) AS label FROM embeddings), m AS (SELECT record, x, label, unnest([0, 4, 10]) AS s FROM e) "
    "SELECT record, s AS start, label, " + ", ".join(f"round((x[s + {4 * i + 1}] + x[s + {4 * i + 2}] + x[s + {4 * i + 3}] + x[s + {4 * i + 4}]) / 4, 6) + 0.0 AS m{i}" for i in (0, 7, 14)) + " FROM m WHERE s + 60 <= 64"
)
def minute_segments(spark, sf_dir):
    """Marked stretches that lie wholly in a signal, four samples averaged to one."""
    e = table(spark, sf_dir, "embeddings")
    marks = F.array(*[F.struct(F.lit(s).alias("start"), F.col("label").cast("int").alias("label")) for s in (0, 4, 10)])
    rows = e.select(F.col("vec_id").cast("string").alias("record"), F.col("embedding").cast("array<double>").alias("samples"), marks.alias("marks"))
    got = datasets.minute_segments(rows, rate=1, keep=4)
    return rounded(got.select("record", "start", "label", *[F.col("series")[0][i].alias(f"m{i}") for i in (0, 7, 14)]))


@query(
    "WITH v AS (SELECT vec_id // 256 AS record, i, CAST(floor(CAST(x AS DOUBLE) * 1000 + 0.5) AS BIGINT) AS q FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings)) "
    "SELECT CAST(record AS BIGINT) AS record, CASE WHEN i < 48 THEN 'wide' ELSE 'narrow' END AS channel, count(*) AS n, CAST(sum(q) AS DOUBLE) AS total, CAST(max(q) AS DOUBLE) AS high FROM v GROUP BY ALL"
)
def recording_ranges(spark, sf_dir):
    """Vectors written as EDF recordings of 256 data records at most, read back in ranges smaller than a file."""
    e = table(spark, sf_dir, "embeddings")
    numbers = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000 + 0.5).cast("int"))
    blocks = e.groupBy(F.floor(F.col("vec_id") / 256).alias("record")).agg(F.array_sort(F.collect_list(F.struct("vec_id", numbers.alias("q")))).alias("v"))  # 256 vectors at most

    @F.pandas_udf("binary")
    def packed(v: pd.Series) -> pd.Series:
        return v.map(lambda rows: recordings.edf_file(["wide", "narrow"], [48, 16], np.array([r["q"] for r in rows])))

    folder = folder_of(spark, "recordings")
    recording_source.write_files(blocks.select(F.concat("record", F.lit(".edf")).alias("name"), packed(F.transform("v", lambda r: F.struct(r["q"].alias("q")))).alias("content")), folder)
    read = recording_source.read_recordings(spark, folder, 10_000)
    x = read.select(F.regexp_extract("path", r"(\d+)\.edf$", 1).cast("long").alias("record"), "channel", F.explode("samples").alias("x"))
    return x.groupBy("record", "channel").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x")).alias("total"), F.round(F.max("x")).alias("high"))
