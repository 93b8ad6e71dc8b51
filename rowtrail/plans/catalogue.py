"""The registered queries over the star-schema tables, each with DuckDB SQL for the same rows.

Fixtures: users with daily mean event values per type (5 channels x 30 days), embeddings as series of 64 steps, and
orders per customer as ragged series.  Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import losses, metrics, stats
from ..functions.scalar import bounded, goes_left, mixed_hash
from ..operators import boost, design, etl, ridge, rocket, specs, split, temporal
from ..sources import generators, recordings, series
from ..operators.boost import stored
from . import reports

CHANNELS = ["click", "error", "purchase", "signup", "view"]
DAYS = 30
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """All doubles at so many places (a few more where the exact values would end in a tie)."""
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, channel, t, value): a row a user, channel and day, NULL on days without events."""
    events = table(spark, sf_dir, "events").withColumnRenamed("event_type", "channel")
    daily = series.binned_means(events, ["user_id", "channel"], F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")), "value")
    return series.dense(daily, events.select("user_id").distinct(), ["user_id"], CHANNELS, DAYS)


U = f"""WITH d AS (SELECT user_id, event_type AS channel, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t, avg(value) AS value FROM events GROUP BY ALL),
s AS (SELECT g.user_id, g.channel, CAST(g.t AS INTEGER) AS t, d.value FROM (SELECT user_id, channel, t FROM (SELECT DISTINCT user_id FROM events),
  (SELECT unnest({CHANNELS}) AS channel), (SELECT unnest(range(0, {DAYS})) AS t)) g LEFT JOIN d ON d.user_id = g.user_id AND d.channel = g.channel AND d.t = g.t)"""


def stats_sql(names: tuple[str, ...], where: str = "true") -> str:
    of = {
        "mean": "avg(value)", "std": "stddev_pop(value)", "min": "min(value)", "max": "max(value)",
        "slope": "CASE WHEN count(value) >= 2 THEN regr_slope(value, t) END", "median": "median(value)",
        "mean_abs_change": "avg(abs(value - previous))", "first": "arg_min(value, t) FILTER (value IS NOT NULL)",
        "last": "arg_max(value, t) FILTER (value IS NOT NULL)",
        "delta": "arg_max(value, t) FILTER (value IS NOT NULL) - arg_min(value, t) FILTER (value IS NOT NULL)",
    }
    return ", ".join(f'CASE WHEN {where} THEN round({of[n]}, 6) + 0.0 END AS "{n}"' for n in names)


LAGGED = "SELECT *, lag(value) OVER (PARTITION BY {by} ORDER BY t) AS previous FROM {rows}"


# ---------------------------------------------------------------- interval statistics


def sparse_series(spark, sf_dir) -> DataFrame:
    """``user_series`` without its missing days: statistics over what is observed need no more."""
    events = table(spark, sf_dir, "events").withColumnRenamed("event_type", "channel")
    return series.binned_means(events, ["user_id", "channel"], F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")), "value").where(F.col("t").between(0, DAYS - 1))


def every_series(spark, sf_dir, found: DataFrame, windows: int = 0) -> DataFrame:
    """``found`` with a row of NULLs for each user and channel (and window) without any."""
    keys = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("channel", F.explode(F.array(*[F.lit(c) for c in CHANNELS])))
    by = ["user_id", "channel"]
    if windows:
        keys, by = keys.withColumn("window", F.explode(F.array(*[F.lit(w) for w in range(windows)]))), [*by, "window"]
    return keys.join(found, by, "left")


@query(f"{U} SELECT user_id, channel, {stats_sql(stats.STAT_NAMES)} FROM ({LAGGED.format(by='user_id, channel', rows='s')}) GROUP BY user_id, channel")
def interval_stats_daily(spark, sf_dir):
    return rounded(every_series(spark, sf_dir, stats.interval_stats(sparse_series(spark, sf_dir), ["user_id", "channel"])))


@query(f"{U} SELECT user_id, channel, round(CASE WHEN count(value) >= 2 THEN regr_slope(value, t) END, 6) + 0.0 AS slope FROM s WHERE t >= 5 AND t < 20 GROUP BY ALL")
def interval_slope_subwindow(spark, sf_dir):
    return rounded(every_series(spark, sf_dir, stats.interval_stats(sparse_series(spark, sf_dir), ["user_id", "channel"], 5, 20, ("slope",))))


@query(f"{U} SELECT user_id, channel, {stats_sql(stats.STAT10_NAMES)} FROM ({LAGGED.format(by='user_id, channel', rows='s')}) GROUP BY user_id, channel")
def global_agg10(spark, sf_dir):
    return rounded(every_series(spark, sf_dir, stats.interval_stats(sparse_series(spark, sf_dir), ["user_id", "channel"], stats=stats.STAT10_NAMES)))


@query(
    f"{U}, w AS (SELECT *, CAST(CASE WHEN t < 16 THEN t // 8 ELSE 2 + (t - 16) // 7 END AS INTEGER) AS \"window\" FROM s) "
    f"SELECT user_id, channel, \"window\", {stats_sql(stats.STAT10_NAMES)} FROM ({LAGGED.format(by='user_id, channel, "window"', rows='w')}) GROUP BY user_id, channel, \"window\""
)
def windowed_agg4(spark, sf_dir):
    return rounded(every_series(spark, sf_dir, stats.windowed_stats(sparse_series(spark, sf_dir), ["user_id", "channel"], DAYS, 4), 4))


@query(f"{U} SELECT user_id, channel, {stats_sql(stats.STAT10_NAMES, 'count(value) = count(*)')} FROM ({LAGGED.format(by='user_id, channel', rows='s')}) GROUP BY user_id, channel")
def naive_agg10(spark, sf_dir):
    return rounded(stats.strict_stats(user_series(spark, sf_dir), ["user_id", "channel"]))


@query(f"{U} SELECT user_id, " + ", ".join(f"round(max(value) FILTER (t = {i}), 6) + 0.0 AS t{i}" for i in range(DAYS)) + " FROM s WHERE channel = 'view' GROUP BY user_id")
def flatten_series(spark, sf_dir):
    arrays = series.to_arrays(user_series(spark, sf_dir).where("channel = 'view'"), ["user_id"])
    return rounded(arrays.select("user_id", *[F.get("series", F.lit(i)).alias(f"t{i}") for i in range(DAYS)]))


@query(f"{U} SELECT user_id, channel, CAST(t // 4 AS INTEGER) AS t, round(avg(value), 6) + 0.0 AS value FROM s GROUP BY user_id, channel, t // 4 HAVING count(*) = 4")
def block_mean_decimate(spark, sf_dir):
    return rounded(series.block_means(user_series(spark, sf_dir), ["user_id", "channel"], 4))


@query("SELECT user_id, " + ", ".join(f"round(avg(value) FILTER (hour(ts) = {h}), 6) + 0.0 AS h{h}" for h in range(24)) + " FROM events GROUP BY user_id")
def hourly_mean_pivot(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("h", F.concat(F.lit("h"), F.hour("ts")))
    return rounded(etl.pivot_means(events, ["user_id"], "h", [f"h{h}" for h in range(24)], "value"))


@query(
    "WITH o AS (SELECT o_custkey, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS t FROM orders), m AS (SELECT max(t) AS m FROM o), "
    "g AS (SELECT o_custkey, unnest(range(0, (SELECT m FROM m) + 1)) AS t FROM (SELECT DISTINCT o_custkey FROM o)) "
    "SELECT g.o_custkey AS o_custkey, CAST(g.t AS INTEGER) AS t, round(o.v, 6) + 0.0 AS value FROM g LEFT JOIN o ON o.o_custkey = g.o_custkey AND o.t = g.t"
)
def pad_ragged_orders(spark, sf_dir):
    arrays = order_series(spark, sf_dir)
    return rounded(series.to_long(series.pad_to_longest(arrays), ["o_custkey"]))


def order_series(spark, sf_dir) -> DataFrame:
    """(o_custkey, series): order values by date and key, of any length."""
    pairs = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_totalprice")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(pairs, lambda p: p["o_totalprice"]).alias("series"))


@query(f"{U} SELECT user_id, channel, CAST(t // 2 AS INTEGER) AS t, round(avg(value), 6) + 0.0 AS value FROM s WHERE t < 30 GROUP BY user_id, channel, t // 2")
def pyramid_level1(spark, sf_dir):
    return rounded(temporal.pool_long(user_series(spark, sf_dir), ["user_id", "channel"], DAYS))


@query(
    f"{U}, a AS (SELECT user_id, channel, t // 2 AS t, avg(value) AS value FROM s WHERE t < 30 GROUP BY ALL) "
    "SELECT user_id, channel, CAST(t // 2 AS INTEGER) AS t, round(avg(value), 6) + 0.0 AS value FROM a WHERE t < 14 GROUP BY user_id, channel, t // 2"
)
def pyramid_level2(spark, sf_dir):
    arrays = series.to_arrays(user_series(spark, sf_dir), ["user_id", "channel"])
    return rounded(series.to_long(arrays.withColumn("series", temporal.pool(temporal.pool(F.col("series")))), ["user_id", "channel"]).withColumn("t", F.col("t").cast("int")))


@query(
    f"{U}, w AS (SELECT user_id, channel, t AS start, sum(coalesce(value, 0)) OVER f AS s1, sum(coalesce(value, 0) * coalesce(value, 0)) OVER f AS s2, sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) OVER f AS missing, count(*) OVER f AS n "
    'FROM s WINDOW f AS (PARTITION BY user_id, channel ORDER BY t ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)) SELECT user_id, channel, start AS "start", round(s1, 6) + 0.0 AS s1, round(s2, 6) + 0.0 AS s2, CAST(missing AS BIGINT) AS missing FROM w WHERE n = 7'
)
def sliding_sums(spark, sf_dir):
    return rounded(temporal.sliding_sums(user_series(spark, sf_dir), ["user_id", "channel"], 7))


@query(f"{U} SELECT channel, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS missing FROM s GROUP BY channel")
def missing_fraction(spark, sf_dir):
    return rounded(series.missing_fraction(user_series(spark, sf_dir), ["channel"]))


# ---------------------------------------------------------------- templates on embeddings

WINDOWS = """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
t0 AS (SELECT unnest(x[11:18]) AS v, unnest(range(0, 8)) AS j FROM e WHERE vec_id = 0),
t AS (SELECT j, v, (v - (SELECT avg(v) FROM t0)) / (SELECT stddev_pop(v) FROM t0) AS z FROM t0),
w AS (SELECT vec_id, p, j, x[p + j + 1] AS v FROM (SELECT vec_id, x, unnest(range(0, 57)) AS p FROM e), (SELECT unnest(range(0, 8)) AS j)),
c AS (SELECT vec_id, p, avg(w.v) AS m, stddev_pop(w.v) AS sd, sum(w.v * z) / 8 / stddev_pop(w.v) AS corr, avg((w.v - t.v) * (w.v - t.v)) AS raw FROM w JOIN t USING (j) GROUP BY ALL)"""


def embedded(spark, sf_dir) -> tuple[DataFrame, list[float]]:
    """Embeddings as double series, and the template: steps 10 to 17 of vector 0."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("series"))
    return rows, rows.where("vec_id = 0").first().series[10:18]


@query(f"{WINDOWS} SELECT vec_id, round(min(greatest(2 - 2 * corr, 0)), 6) + 0.0 AS value, round(arg_min(p, struct_pack(d := round(greatest(2 - 2 * corr, 0), 12), p := p)) / 56.0, 6) + 0.0 AS position FROM c GROUP BY vec_id")
def shapelet_dist_pos(spark, sf_dir):
    rows, template = embedded(spark, sf_dir)
    return rounded(rows.select("vec_id", temporal.match_column(F.col("series"), template).alias("m")).select("vec_id", "m.*"))


@query(f"{WINDOWS} SELECT vec_id, round(min(raw), 6) + 0.0 AS value, round(arg_min(p, raw) / 56.0, 6) + 0.0 AS position FROM c GROUP BY vec_id")
def shapelet_raw(spark, sf_dir):
    rows, template = embedded(spark, sf_dir)
    return rounded(rows.select("vec_id", temporal.match_column(F.col("series"), template, normalise=False).alias("m")).select("vec_id", "m.*"))


@query(f"{WINDOWS} SELECT vec_id, round(arg_max(corr, abs(corr)), 6) + 0.0 AS value, round(arg_max(p, abs(corr)) / 56.0, 6) + 0.0 AS position FROM c GROUP BY vec_id")
def ncc_align(spark, sf_dir):
    rows, template = embedded(spark, sf_dir)
    return rounded(rows.select("vec_id", temporal.match_column(F.col("series"), template, "correlation").alias("m")).select("vec_id", "m.*"))


@query(
    "WITH e AS (SELECT vec_id, unnest(embedding) AS f, unnest(range(0, 64)) AS pos FROM embeddings), c AS (SELECT vec_id, pos, CAST(f AS DOUBLE) - avg(CAST(f AS DOUBLE)) OVER (PARTITION BY vec_id) AS v FROM e) "
    "SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 6) + 0.0 AS col FROM c"
)
def znorm_snippet(spark, sf_dir):
    rows, _ = embedded(spark, sf_dir)
    return rounded(rows.select("vec_id", F.posexplode(temporal.unit_snippet_column(F.col("series")))))


@query(
    f"{WINDOWS}, b AS (SELECT vec_id, arg_max(p, abs(corr)) AS p FROM c GROUP BY vec_id), g AS (SELECT vec_id, j AS pos, v - avg(v) OVER (PARTITION BY vec_id) AS v FROM w JOIN b USING (vec_id, p)) "
    "SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 6) + 0.0 AS col FROM g"
)
def gather_windows(spark, sf_dir):
    rows, template = embedded(spark, sf_dir)
    found = rows.withColumn("m", temporal.match_column(F.col("series"), template, "correlation"))
    return rounded(found.select("vec_id", F.posexplode(temporal.gather_window(F.col("series"), F.col("m.position"), 8))))


# ---------------------------------------------------------------- convolution bank


@query(f"{U} SELECT user_id, channel, t, round(coalesce(value, avg(value) OVER (PARTITION BY user_id, channel), 0), 9) + 0.0 AS value FROM s")
def rocket_row_impute(spark, sf_dir):
    arrays = series.to_arrays(user_series(spark, sf_dir), ["user_id", "channel"])
    return rounded(series.to_long(arrays.withColumn("series", rocket.impute_row_mean(F.col("series"))), ["user_id", "channel"]), 9)


TAPS = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
k0 AS (SELECT vec_id, i, 3 * sum(CASE WHEN j < 3 THEN v ELSE 0 END) - sum(v) AS r FROM (SELECT vec_id, i, j, coalesce(CASE WHEN i + j - 4 BETWEEN 0 AND 63 THEN x[i + j - 3] END, 0) AS v
  FROM (SELECT vec_id, x, unnest(range(0, 64)) AS i FROM e), (SELECT unnest(range(0, 9)) AS j)) GROUP BY ALL),
k1 AS (SELECT vec_id, i, 3 * sum(CASE WHEN j IN (0, 1, 3) THEN v ELSE 0 END) - sum(v) AS r FROM (SELECT vec_id, i, j, x[i + 2 * j + 1] AS v
  FROM (SELECT vec_id, x, unnest(range(0, 48)) AS i FROM e), (SELECT unnest(range(0, 9)) AS j)) GROUP BY ALL)"""


@query(f"{TAPS} SELECT vec_id, round(quantile_cont(r, 0.25), 6) + 0.0 AS q1, round(quantile_cont(r, 0.5), 6) + 0.0 AS q2, round(quantile_cont(r, 0.75), 6) + 0.0 AS q3 FROM k0 GROUP BY vec_id")
def rocket_bias_quantiles(spark, sf_dir):
    rows, _ = embedded(spark, sf_dir)
    responses = rows.select("vec_id", F.explode(rocket.response_column(F.col("series"), 0, 1)).alias("r"))
    return rounded(responses.groupBy("vec_id").agg(*[F.percentile("r", F.lit(q)).alias(n) for q, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))]))


@query(
    f"{TAPS}, a AS (SELECT vec_id, avg(CASE WHEN r > -0.5 THEN 1.0 ELSE 0 END) AS f0, avg(CASE WHEN r > 0.25 THEN 1.0 ELSE 0 END) AS f1 FROM k0 GROUP BY ALL), b AS (SELECT vec_id, avg(CASE WHEN r > 0.1 THEN 1.0 ELSE 0 END) AS f2 FROM k1 GROUP BY ALL) "
    "SELECT vec_id, round(f0, 6) + 0.0 AS f0, round(f1, 6) + 0.0 AS f1, round(f2, 6) + 0.0 AS f2 FROM a JOIN b USING (vec_id)"
)
def rocket_ppv(spark, sf_dir):
    rows, _ = embedded(spark, sf_dir)
    bank = rocket.RocketBank(64, 1, [(0, 0, 1, [-0.5, 0.25]), (0, 1, 2, [0.1])])
    shares = rows.select("vec_id", bank.transform(F.array("series")).alias("f"))
    return rounded(shares.select("vec_id", *[F.get("f", F.lit(i)).alias(f"f{i}") for i in range(3)]))


# ---------------------------------------------------------------- rank, product and standardised features


@query("SELECT c_custkey, round((SELECT count(*) FROM supplier WHERE s_acctbal <= c_acctbal) / (SELECT CAST(count(*) AS DOUBLE) FROM supplier), 6) + 0.0 AS ecdf FROM customer")
def ecdf_rank(spark, sf_dir):
    return rounded(temporal.ecdf(table(spark, sf_dir, "customer"), "c_acctbal", table(spark, sf_dir, "supplier"), "s_acctbal").select("c_custkey", "ecdf"))


@query(
    "SELECT c_custkey, round((SELECT count(*) FROM supplier WHERE s_acctbal <= c_acctbal) / (SELECT CAST(count(*) AS DOUBLE) FROM supplier) - (SELECT count(*) FROM part WHERE p_size <= c_nationkey) / (SELECT CAST(count(*) AS DOUBLE) FROM part), 6) + 0.0 AS feature FROM customer"
)
def comparison_feature(spark, sf_dir):
    grids = (table(spark, sf_dir, "supplier"), "s_acctbal"), (table(spark, sf_dir, "part"), "p_size")
    both = temporal.comparison(table(spark, sf_dir, "customer"), "c_acctbal", grids[0], "c_nationkey", grids[1], "feature")
    return rounded(both.select("c_custkey", "feature"))


@query("SELECT c_custkey, round(least(greatest((c_acctbal - 4500) / 3000, -1), 1) * least(greatest((c_nationkey - 12) / 7.0, -1.5), 1.5), 6) + 0.0 AS feature FROM customer")
def product_feature(spark, sf_dir):
    a = bounded(F.col("c_acctbal"), 4500.0, 3000.0, -1.0, 1.0)
    b = bounded(F.col("c_nationkey").cast("double"), 12.0, 7.0, -1.5, 1.5)
    return rounded(table(spark, sf_dir, "customer").select("c_custkey", (a * b).alias("feature")))


@query(
    f"{U}, m AS (SELECT user_id, channel, avg(value) AS x FROM s GROUP BY ALL), f AS (SELECT user_id, channel, coalesce(x, median(x) OVER (PARTITION BY channel), 0) AS x FROM m), "
    "a AS (SELECT channel, avg(x) AS c, stddev_pop(x) AS s FROM f GROUP BY channel) SELECT user_id, channel, round((x - c) / CASE WHEN s > 1e-12 THEN s ELSE 1 END, 6) + 0.0 AS z FROM f JOIN a USING (channel)"
)
def standardize_impute(spark, sf_dir):
    """Each user's mean of each channel; users without one get the channel's median."""
    means = sparse_series(spark, sf_dir).groupBy("user_id").pivot("channel", CHANNELS).agg(F.avg("value"))
    rows = means.select("user_id", F.array(*CHANNELS).alias("static"))
    scale = design.StaticScale.fit(rows, len(CHANNELS))
    z = F.array(*[F.struct(F.lit(c).alias("channel"), scale.standardised(F.col("static"), i).alias("z")) for i, c in enumerate(CHANNELS)])
    return rounded(rows.select("user_id", F.explode(z).alias("p")).select("user_id", "p.*"))


# ---------------------------------------------------------------- losses


@query("SELECT o_orderkey, round((o_custkey % 7 - 3) - o_totalprice / 100000, 9) + 0.0 AS g, 1.0::DOUBLE AS h FROM orders")
def grad_hess_squared(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 100000).alias("y"), F.array((F.col("o_custkey") % 7 - 3).cast("double")).alias("raw"))
    return rounded(rows.select("o_orderkey", losses.squared_error().gradients(F.col("y"), F.col("raw"))[0].alias("d")).select("o_orderkey", "d.*"), 9)


@query("SELECT o_orderkey, round(p - y, 6) + 0.0 AS g, round(greatest(p * (1 - p), 1e-16), 6) + 0.0 AS h FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, 1 / (1 + exp(-(o_custkey % 7 - 3))) AS p FROM orders)")
def grad_hess_logistic(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("double").alias("y"), F.array((F.col("o_custkey") % 7 - 3).cast("double")).alias("raw"))
    return rounded(rows.select("o_orderkey", losses.logistic().gradients(F.col("y"), F.col("raw"))[0].alias("d")).select("o_orderkey", "d.*"))


@query(
    "WITH r AS (SELECT o_orderkey, CAST(o_orderkey % 3 AS INTEGER) AS y, exp((o_custkey % 5) / 2.0) AS a, exp((o_custkey % 3) / 2.0) AS b, exp((o_custkey % 2) / 2.0) AS c FROM orders), "
    "p AS (SELECT o_orderkey, y, unnest([a / (a + b + c), b / (a + b + c), c / (a + b + c)]) AS p, unnest([0, 1, 2]) AS k FROM r) SELECT o_orderkey, k AS k, round(p - CASE WHEN y = k THEN 1 ELSE 0 END, 6) + 0.0 AS g, round(greatest(p * (1 - p), 1e-16), 6) + 0.0 AS h FROM p"
)
def grad_hess_softmax(spark, sf_dir):
    raw = F.array(*[(F.col("o_custkey") % m).cast("double") / 2 for m in (5, 3, 2)])
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).cast("double").alias("y"), raw.alias("raw"))
    return rounded(rows.select("o_orderkey", F.posexplode(losses.softmax_loss(3).gradients(F.col("y"), F.col("raw"))).alias("k", "d")).select("o_orderkey", "k", "d.*"))


@query("SELECT label, round(ln(greatest(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM embeddings), 1e-6)), 6) + 0.0 AS score FROM embeddings GROUP BY label")
def init_scores(spark, sf_dir):
    counts = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    share = F.greatest(F.col("n") / F.sum("n").over(W.partitionBy()), F.lit(1e-6))  # one row a class
    return rounded(counts.select("label", F.log(share).alias("score")))


# ---------------------------------------------------------------- split scan

SCAN = """, a AS (SELECT *, sum(g) OVER (PARTITION BY problem ORDER BY f) AS rg, sum(n) OVER (PARTITION BY problem ORDER BY f) AS rn, lead(f) OVER (PARTITION BY problem ORDER BY f) AS nf FROM (SELECT problem, f, sum(g) AS g, count(*) AS n FROM p WHERE f IS NOT NULL GROUP BY ALL)),
q AS (SELECT problem, sum(g) AS tg, count(*) AS tn, coalesce(sum(g) FILTER (f IS NULL), 0) AS mg, count(*) FILTER (f IS NULL) AS mn FROM p GROUP BY ALL),
k AS (SELECT a.problem, f + (nf - f) / 2 AS threshold, ml AS missing_left, rg + CASE WHEN ml THEN mg ELSE 0 END AS gl, rn + CASE WHEN ml THEN mn ELSE 0 END AS nl, tg, tn
  FROM a JOIN q USING (problem), (SELECT unnest([true, false]) AS ml) WHERE nf IS NOT NULL AND (ml OR mn > 0)),
s2 AS (SELECT *, 0.5 * (gl * gl / (nl + 1.0) + (tg - gl) * (tg - gl) / (tn - nl + 1.0) - tg * tg / (tn + 1.0)) AS gain FROM k WHERE nl >= 5 AND tn - nl >= 5),
b AS (SELECT *, row_number() OVER (PARTITION BY problem ORDER BY round(gain, 9) DESC, missing_left DESC, threshold) AS rn FROM s2 WHERE gain > 0)
SELECT problem, round(threshold, 6) + 0.0 AS threshold, missing_left, round(gain, 6) + 0.0 AS gain FROM b WHERE rn = 1"""
RULES = split.ScanRules(l2=1.0, gamma=0.0, min_child_weight=0.1, min_samples_leaf=5)


def user_gradients(spark, sf_dir) -> DataFrame:
    """(user_id, g): squared-error gradients of the account balance around its mean, in thousands."""
    rows = table(spark, sf_dir, "events").select("user_id").distinct().join(table(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey")).select("user_id", (F.col("c_acctbal") / 1000).alias("y"))
    return rows.join(F.broadcast(rows.agg(F.avg("y").alias("m"))), F.lit(True)).select("user_id", (F.col("m") - F.col("y")).alias("g"), F.lit(1.0).alias("h"))


GRAD = ", y AS (SELECT user_id, c_acctbal / 1000 AS y FROM (SELECT DISTINCT user_id FROM events) JOIN customer ON c_custkey = user_id), gr AS (SELECT user_id, (SELECT avg(y) FROM y) - y AS g FROM y)"


def best(rows: DataFrame) -> DataFrame:
    return rounded(split.best_splits(rows, ["problem"], RULES).select("problem", "threshold", "missing_left", "gain"))


@query("WITH c AS (SELECT c_acctbal / 1000 AS f, (SELECT avg(c_nationkey) FROM customer) - c_nationkey AS g, 'balance' AS problem FROM customer), p AS (SELECT * FROM c)" + SCAN)
def best_split_static(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    mean = c.agg(F.avg("c_nationkey").alias("m"))
    return best(c.join(F.broadcast(mean), F.lit(True)).select(F.lit("balance").alias("problem"), (F.col("c_acctbal") / 1000).alias("f"), (F.col("m") - F.col("c_nationkey")).alias("g"), F.lit(1.0).alias("h")))


@query(f"{U}{GRAD}, p AS (SELECT channel AS problem, avg(value) AS f, g FROM s JOIN gr USING (user_id) WHERE t < 4 GROUP BY channel, user_id, g)" + SCAN)
def best_split_missing(spark, sf_dir):
    f = every_series(spark, sf_dir, stats.interval_stats(sparse_series(spark, sf_dir), ["user_id", "channel"], 0, 4, ("mean",)))
    return best(f.join(user_gradients(spark, sf_dir), "user_id").select(F.col("channel").alias("problem"), F.col("mean").alias("f"), "g", "h"))


@query(
    f"{U}{GRAD}, st AS (SELECT user_id, channel, avg(value) AS mean, min(value) AS min, max(value) AS max, CASE WHEN count(value) >= 2 THEN regr_slope(value, t) END AS slope FROM s GROUP BY user_id, channel), "
    "p AS (SELECT channel || '.' || stat AS problem, f, g FROM (SELECT user_id, channel, unnest(['mean', 'min', 'max', 'slope']) AS stat, unnest([mean, min, max, slope]) AS f FROM st) JOIN gr USING (user_id))" + SCAN
)
def best_split_per_stat(spark, sf_dir):
    names = ("mean", "min", "max", "slope")
    f = every_series(spark, sf_dir, stats.interval_stats(sparse_series(spark, sf_dir), ["user_id", "channel"], stats=names))
    long = f.select("user_id", "channel", F.explode(F.array(*[F.struct(F.lit(n).alias("s"), F.col(n).alias("f")) for n in names])).alias("x"))
    return best(long.join(user_gradients(spark, sf_dir), "user_id").select(F.concat_ws(".", "channel", "x.s").alias("problem"), F.col("x.f").alias("f"), "g", "h"))


@query(
    f"{U}{GRAD}, m AS (SELECT user_id, avg(value) AS f FROM s WHERE channel = 'view' AND t < 10 GROUP BY user_id) "
    "SELECT coalesce(f <= 250, true) AS \"left\", count(*) AS n, round(-sum(g) / (count(*) + 1.0), 6) + 0.0 AS leaf FROM m JOIN gr USING (user_id) GROUP BY 1"
)
def leaf_values_depth1(spark, sf_dir):
    f = stats.interval_stats(user_series(spark, sf_dir).where("channel = 'view'"), ["user_id"], 0, 10, ("mean",))
    rows = f.join(user_gradients(spark, sf_dir), "user_id").withColumn("left", goes_left(F.col("mean"), 250.0, True))
    return rounded(rows.groupBy("left").agg(F.count(F.lit(1)).alias("n"), split.leaf_value(F.sum("g"), F.sum("h"), 1.0).alias("leaf")))


@query("SELECT c_custkey, CASE WHEN c_acctbal <= 2000 THEN CASE WHEN c_nationkey <= 10 THEN 0 ELSE 1 END ELSE CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 3 END END AS leaf FROM customer")
def tree_route_fixed(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    top = goes_left(F.col("c_acctbal"), 2000.0, True)
    low = F.when(goes_left(F.col("c_nationkey"), 10.0, False), F.lit(0)).otherwise(F.lit(1))
    high = F.when(F.col("c_mktsegment") == "BUILDING", F.lit(2)).otherwise(F.lit(3))
    return c.select("c_custkey", F.when(top, low).otherwise(high).alias("leaf"))


@query("WITH a AS (SELECT c_mktsegment, sum((c_acctbal / 1000 - 4) * (c_acctbal / 1000 - 4)) AS s2, sum(c_acctbal / 1000 - 4) AS s, count(*) AS n FROM customer GROUP BY ALL) SELECT c_mktsegment, round(1.0 * ((s2 - s * s / n) / (n + 1.0)) * (ln(40) + 0.4 * ln(n)), 6) + 0.0 AS charge FROM a")
def selection_charge(spark, sf_dir):
    g = F.col("c_acctbal") / 1000 - 4
    sums = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.sum(g * g).alias("s2"), F.sum(g).alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
    scale = (F.col("s2") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") + 1.0)
    return rounded(sums.select("c_mktsegment", split.selection_charge(F.lit(40.0), F.col("n"), scale, 1.0).alias("charge")))


@query(
    f"{U}{GRAD}, st AS (SELECT user_id, channel, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max FROM s GROUP BY user_id, channel), "
    "l AS (SELECT channel || '.' || stat AS spec, f, g FROM (SELECT user_id, channel, unnest(['mean', 'std', 'min', 'max']) AS stat, unnest([mean, std, min, max]) AS f FROM st) JOIN gr USING (user_id)) "
    "SELECT spec, round(abs(corr(f, g)), 6) + 0.0 AS r FROM l GROUP BY spec ORDER BY abs(corr(f, g)) DESC, spec LIMIT 5"
)
def bank_corr_topk(spark, sf_dir):
    """The five features of a bank that go best with the residuals, from sums over all rows."""
    names = {specs.Spec("interval", channel=c, start=0, end=DAYS, stat=n): f"{channel}.{n}" for c, channel in enumerate(CHANNELS) for n in ("mean", "std", "min", "max")}
    found = boost.correlations(stored(user_rows(spark, sf_dir)), list(names), losses.squared_error())
    top = sorted(((names[s], r) for s, r in found.items()), key=lambda x: (-x[1], x[0]))[:5]
    return rounded(spark.createDataFrame(top, "spec string, r double"))


# ---------------------------------------------------------------- metrics


def scored_lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("y"), F.round(F.col("l_discount") + F.col("l_tax"), 2).alias("score"), (F.col("l_quantity") > 25).cast("int").alias("predicted"),
        "l_quantity", (F.col("l_extendedprice") / 1000).alias("price"),
    )


LINES = "WITH r AS (SELECT l_linestatus, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, round(l_discount + l_tax, 2) AS score, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS predicted, l_quantity, l_extendedprice / 1000 AS price FROM lineitem)"


@query(f"{LINES}, k AS (SELECT *, rank() OVER (PARTITION BY l_linestatus ORDER BY score) + (count(*) OVER (PARTITION BY l_linestatus, score) - 1) / 2.0 AS rk FROM r) SELECT l_linestatus, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) + 0.0 AS auc FROM k GROUP BY l_linestatus")
def roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(scored_lines(spark, sf_dir), by=["l_linestatus"]))


@query(
    f"{LINES}, c AS (SELECT l_linestatus, sum(y * predicted) AS tp, sum((1 - y) * predicted) AS fp, sum(y * (1 - predicted)) AS fn, avg(CASE WHEN y = predicted THEN 1.0 ELSE 0 END) AS a FROM r GROUP BY ALL) "
    "SELECT l_linestatus, round(a, 6) + 0.0 AS accuracy, round(tp / (tp + fp), 6) + 0.0 AS precision, round(tp / (tp + fn), 6) + 0.0 AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) + 0.0 AS f1 FROM c"
)
def prf_metrics(spark, sf_dir):
    return rounded(metrics.binary_metrics(scored_lines(spark, sf_dir), by=["l_linestatus"]))


@query(f"{LINES} SELECT l_linestatus, round(sqrt(avg((l_quantity - price) * (l_quantity - price))), 6) + 0.0 AS rmse, round(avg(abs(l_quantity - price)), 6) + 0.0 AS mae, round(1 - avg((l_quantity - price) * (l_quantity - price)) / var_pop(price), 6) + 0.0 AS r2 FROM r GROUP BY l_linestatus")
def regression_metrics(spark, sf_dir):
    return rounded(metrics.regression_metrics(scored_lines(spark, sf_dir), "price", "l_quantity", ["l_linestatus"]))


@query("WITH k AS (SELECT o_orderpriority, CAST(o_custkey % 3 AS INTEGER) AS y, CAST(o_orderkey % 3 AS INTEGER) AS p FROM orders), c AS (SELECT o_orderpriority, y, avg(CASE WHEN y = p THEN 1.0 ELSE 0 END) AS r FROM k GROUP BY ALL) SELECT o_orderpriority, round(avg(r), 6) + 0.0 AS balanced_accuracy FROM c GROUP BY o_orderpriority")
def balanced_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_custkey") % 3).alias("y"), (F.col("o_orderkey") % 3).alias("predicted"))
    return rounded(metrics.balanced_accuracy(rows, by=["o_orderpriority"]))


@query(
    "WITH e AS (SELECT label AS y, unnest(range(0, 10)) AS k, unnest([list_sum(list_transform(embedding[j * 6 + 1 : j * 6 + CASE WHEN j = 9 THEN 10 ELSE 6 END], lambda v: CAST(v AS DOUBLE))) FOR j IN range(0, 10)]) AS s FROM embeddings), r AS (SELECT k, CASE WHEN y = k THEN 1 ELSE 0 END AS y, rank() OVER (PARTITION BY k ORDER BY round(s, 9)) + (count(*) OVER (PARTITION BY k, round(s, 9)) - 1) / 2.0 AS rk FROM e), "
    "a AS (SELECT k, (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auc FROM r GROUP BY k) SELECT round(avg(auc), 6) + 0.0 AS auc FROM a"
)
def ovr_auc(spark, sf_dir):
    """Scores are sums over ten stretches of the vector, which are rounded so that both engines tie alike."""
    rows, _ = embedded(spark, sf_dir)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    scores = F.array(*[F.round(total(F.slice("series", j * 6 + 1, 10 if j == 9 else 6)), 9) for j in range(10)])
    return rounded(metrics.one_vs_rest_auc(rows.select(F.col("label").alias("y"), scores.alias("scores"))))


# ---------------------------------------------------------------- sampling, joins, windows

HASH = "((({c}) + 1) * 1103515245) % 4294967296"
MIXED = "(xor({h}, {h} >> 15) * 1597334677) % 4294967296"


def hash_sql(c: str) -> str:
    h = HASH.format(c=f"CAST({c} AS BIGINT)")
    return MIXED.format(h=f"({h})")


@query(f"WITH h AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {hash_sql('c_custkey')}, c_custkey) AS rn, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT c_custkey, c_mktsegment, rn <= greatest(round(n * 0.3), 1) AS is_test FROM h")
def stratified_split(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return etl.stratified_holdout(c, "c_mktsegment", F.struct(mixed_hash(F.col("c_custkey")), "c_custkey"), 0.3, F.floor(mixed_hash(F.col("c_custkey")) / (1 << 22))).select("c_custkey", "c_mktsegment", "is_test")


@query(f"WITH g AS (SELECT DISTINCT c_nationkey FROM customer), r AS (SELECT c_nationkey, row_number() OVER (ORDER BY {hash_sql('c_nationkey')}, c_nationkey) AS rn, count(*) OVER () AS n FROM g) SELECT c_custkey, c_nationkey, rn <= greatest(floor(n * 0.3 + 0.5), 1) AS is_test FROM customer JOIN r USING (c_nationkey)")
def group_split(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return etl.group_holdout(c, "c_nationkey", mixed_hash(F.col("c_nationkey")), 0.3).select("c_custkey", "c_nationkey", "is_test")


STAGES = "WITH i AS (SELECT user_id, event_id, event_type, epoch(ts) - epoch(TIMESTAMP '2024-01-01') AS start, value * 60 AS length FROM events), x AS (SELECT user_id, event_id, event_type, start, unnest(range(CAST(floor(start / 3600) AS BIGINT), CAST(floor(start / 3600) + greatest(floor(length / 3600), 1) AS BIGINT))) AS t FROM i), st AS (SELECT user_id, CAST(t AS INTEGER) AS t, arg_max(event_type, struct_pack(s := start, e := event_id)) AS event_type FROM x GROUP BY user_id, t)"


def staged(spark, sf_dir) -> DataFrame:
    """Events as intervals of a length of their value in minutes, on hourly steps; the later one counts."""
    micros = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 1e6
    events = table(spark, sf_dir, "events").select("user_id", micros.alias("start"), "event_id", "event_type", (F.col("value") * 60).alias("length"))
    return etl.interval_join(events.withColumn("order", F.struct("start", "event_id")), ["user_id"], 3600.0, order="order")


@query(f"{STAGES} SELECT * FROM st")
def stage_range_join(spark, sf_dir):
    return staged(spark, sf_dir).select("user_id", "t", "event_type")


@query(f"{STAGES}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS p FROM st), e AS (SELECT *, min(p) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS a, max(p) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS b FROM p) SELECT user_id, t, event_type FROM e WHERE p BETWEEN a - 5 AND b + 5")
def wake_trim(spark, sf_dir):
    return etl.trim_around(staged(spark, sf_dir).select("user_id", "t", "event_type"), ["user_id"], "t", F.col("event_type") == "purchase", 5)


@query(
    f"{STAGES}, o AS (SELECT user_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) = 1 THEN 0 ELSE 1 END AS o FROM st), isl AS (SELECT user_id, t, CAST(sum(o) OVER (PARTITION BY user_id ORDER BY t) AS INTEGER) AS island FROM o), "
    'r AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY t) - 1 AS r FROM isl), w AS (SELECT user_id, t, island, CAST(r // 4 AS INTEGER) AS "window", CAST(r % 4 AS INTEGER) AS place, count(*) OVER (PARTITION BY user_id, island, r // 4) AS n FROM r) SELECT user_id, t, island, "window", place FROM w WHERE n = 4'
)
def islands_tumbling(spark, sf_dir):
    return etl.tumbling_in_islands(staged(spark, sf_dir).select("user_id", "t"), ["user_id"], "t", 4)


@query("WITH l AS (SELECT DISTINCT l_orderkey, l_suppkey % 20 AS code FROM lineitem), f AS (SELECT code FROM l GROUP BY code HAVING count(*) >= (SELECT count(*) * 0.04 FROM l)), k AS (SELECT l_orderkey, min(code) AS code, count(*) AS n FROM l JOIN f USING (code) GROUP BY l_orderkey) SELECT l_orderkey, code FROM k WHERE n = 1")
def frequent_label_exactly_one(spark, sf_dir):
    labels = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 20).alias("code")).distinct()
    least = labels.count() * 0.04
    return etl.frequent_single_label(labels, "l_orderkey", "code", least)


@query("SELECT c_custkey, c_nationkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def observed_with_outcome(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id").select("id", "c_nationkey")
    names = c.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("id", "n_name")
    seen = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return etl.observed_with_outcome(c, names, seen, "id").select(F.col("id").alias("c_custkey"), "c_nationkey", "n_name")


@query("WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') SELECT k, 'both' AS side FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT k, 'one' FROM ((SELECT k FROM a UNION SELECT k FROM b) EXCEPT (SELECT k FROM a INTERSECT SELECT k FROM b))")
def set_operations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a, b = (o.where(c).select(F.col("o_custkey").alias("k")) for c in ("o_orderpriority = '1-URGENT'", "o_orderstatus = 'F'"))
    sides = a.withColumn("s", F.lit(1)).unionByName(b.withColumn("s", F.lit(2))).groupBy("k").agg(F.count_distinct("s").alias("n"))
    return sides.select("k", F.when(F.col("n") == 2, F.lit("both")).otherwise(F.lit("one")).alias("side"))


# ---------------------------------------------------------------- reports


def result_cells(spark, sf_dir) -> DataFrame:
    """A table of results: dataset = return flag, model = supplier key mod 4, seed = part key mod 5, score = mean discount."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("dataset"), F.concat(F.lit("m"), F.col("l_suppkey") % 4).alias("model"), (F.col("l_partkey") % 5).alias("seed")).agg(F.avg("l_discount").alias("score"))


CELLS = "WITH c AS (SELECT l_returnflag AS dataset, 'm' || (l_suppkey % 4) AS model, l_partkey % 5 AS seed, avg(l_discount) AS score FROM lineitem GROUP BY ALL)"


@query(f"{CELLS} SELECT dataset, seed, round(100 * (a.score - b.score), 6) + 0.0 AS margin FROM c a JOIN c b USING (dataset, seed) WHERE a.model = 'm1' AND b.model = 'm0'")
def paired_margins(spark, sf_dir):
    return rounded(reports.paired_margins(result_cells(spark, sf_dir), "m1", "m0", ["dataset", "seed"]))


@query(f"{CELLS} SELECT dataset, model, round(avg(score), 6) + 0.0 AS mean, round(stddev_pop(score), 6) + 0.0 AS sd, count(*) AS n FROM c GROUP BY dataset, model")
def summarise_mean_sd(spark, sf_dir):
    return rounded(reports.summarise(result_cells(spark, sf_dir), ["dataset", "model"]))


@query(f"{CELLS} SELECT dataset, seed, model, CAST(row_number() OVER (PARTITION BY dataset, seed ORDER BY score DESC, model) AS INTEGER) AS rank FROM c")
def competition_rank(spark, sf_dir):
    return reports.competition_ranks(result_cells(spark, sf_dir), ["dataset", "seed"]).select("dataset", "seed", "model", "rank")


LIFTS = f"{CELLS}, m AS (SELECT dataset, model, avg(score) AS s FROM c GROUP BY ALL), l AS (SELECT x.dataset, x.model, 100 * (x.s - b.s) AS lift FROM m x JOIN m b ON b.dataset = x.dataset AND b.model = 'm0' WHERE x.model <> 'm0')"


@query(f"{LIFTS} SELECT model, round(avg(lift), 6) + 0.0 AS mean_lift, CAST(sum(CASE WHEN lift > 0 THEN 1 ELSE 0 END) AS BIGINT) AS lifted, count(*) AS datasets, sum(CASE WHEN lift > 0 THEN 1 ELSE 0 END) * 2 > count(*) AS majority FROM l GROUP BY model")
def sweep_verdict(spark, sf_dir):
    return rounded(reports.sweep(result_cells(spark, sf_dir), "m0"))


@query(f"{LIFTS}, p AS (SELECT avg(top) AS picked FROM (SELECT dataset, max(lift) AS top FROM l GROUP BY ALL)), h AS (SELECT max(m) AS honest FROM (SELECT model, avg(lift) AS m FROM l GROUP BY ALL)) SELECT round(picked, 6) + 0.0 AS picked, round(honest, 6) + 0.0 AS honest, round(picked - honest, 6) + 0.0 AS optimism FROM p, h")
def sweep_optimism(spark, sf_dir):
    return rounded(reports.sweep_optimism(result_cells(spark, sf_dir), "m0"))


@query("SELECT p_type AS family, round(sum(p_retailprice), 6) + 0.0 AS gain FROM part GROUP BY p_type")
def importance_rollup(spark, sf_dir):
    return rounded(reports.importance(table(spark, sf_dir, "part"), "p_type", "p_retailprice").withColumnRenamed("p_type", "family"))


@query("SELECT p_brand AS model, round(avg(p_retailprice), 6) + 0.0 AS mean_seconds, round(max(p_retailprice), 6) + 0.0 AS max_seconds FROM part GROUP BY p_brand")
def timing_rollup(spark, sf_dir):
    return rounded(reports.timing(table(spark, sf_dir, "part"), "p_brand", "p_retailprice").withColumnRenamed("p_brand", "model"))


@query(
    f"{CELLS}, m AS (SELECT dataset, avg(100 * (a.score - b.score)) AS margin FROM c a JOIN c b USING (dataset, seed) WHERE a.model = 'm1' AND b.model = 'm0' GROUP BY dataset) "
    "SELECT dataset, round(margin, 6) + 0.0 AS margin, CASE WHEN margin >= 0.02 THEN 'PASS' WHEN margin <= 0 THEN 'FAIL' ELSE 'MARGINAL' END AS verdict FROM m"
)
def margin_verdict(spark, sf_dir):
    margins = reports.paired_margins(result_cells(spark, sf_dir), "m1", "m0", ["dataset", "seed"]).groupBy("dataset").agg(F.avg("margin").alias("margin"))
    return rounded(margins.withColumn("verdict", reports.verdict(F.col("margin"), 0.02, 0.0)))


@query(f"{CELLS}, k AS (SELECT model, seed, row_number() OVER (PARTITION BY dataset, seed ORDER BY score DESC, model) AS r FROM c) SELECT model, round(avg(r), 6) + 0.0 AS mean_rank, CAST(sum(CASE WHEN r = 1 THEN 1 ELSE 0 END) AS BIGINT) AS wins FROM k GROUP BY model")
def mean_rank(spark, sf_dir):
    return rounded(reports.mean_ranks(result_cells(spark, sf_dir), ["dataset", "seed"]))


@query(
    "WITH a AS (SELECT DISTINCT o_custkey AS seed FROM orders WHERE o_orderstatus = 'P'), b AS (SELECT DISTINCT o_custkey AS seed FROM orders WHERE o_orderstatus <> 'P') "
    "SELECT seed, 'a' AS only FROM a WHERE seed NOT IN (SELECT seed FROM b) UNION ALL SELECT seed, 'b' FROM b WHERE seed NOT IN (SELECT seed FROM a)"
)
def unpaired_seeds(spark, sf_dir):
    arms = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "P", F.lit("a")).otherwise(F.lit("b")).alias("model"), F.col("o_custkey").alias("seed"))
    return reports.unpaired(arms, "a", "b", ["seed"])


@query(
    "WITH n AS (SELECT o_custkey, count(*) * 41 AS n FROM orders GROUP BY o_custkey) SELECT CASE WHEN abs(n - 100) <= 5 THEN 100 WHEN abs(n - 250) <= 12.5 THEN 250 WHEN abs(n - 500) <= 25 THEN 500 WHEN abs(n - 1000) <= 50 THEN 1000 ELSE 0 END AS size, count(*) AS customers FROM n GROUP BY 1"
)
def nominal_sizes(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.count(F.lit(1)) * 41).alias("n"))
    return n.groupBy(reports.nominal_size(F.col("n")).alias("size")).agg(F.count(F.lit(1)).alias("customers"))


EAV = "WITH r AS (SELECT user_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) AS INTEGER) AS minute, event_type AS parameter, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value FROM events WHERE event_id % 13 <> 0)"


def eav_lines(spark, sf_dir) -> DataFrame:
    """Events as text lines of one file a user, some malformed and some with the missing sentinel."""
    value = F.when(F.col("event_id") % 11 == 0, F.lit("-1")).otherwise(F.col("value").cast("string"))
    line = F.when(F.col("event_id") % 13 == 0, F.lit("garbled;line")).otherwise(F.concat_ws(",", F.date_format("ts", "HH:mm"), "event_type", value))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("record_id"), line.alias("value"))


@query(f"{EAV} SELECT user_id AS record_id, parameter, least(hour, 19) AS t, round(avg(value), 6) + 0.0 AS value FROM r WHERE parameter <> 'signup' GROUP BY ALL HAVING avg(value) IS NOT NULL")
def eav_hourly(spark, sf_dir):
    return rounded(recordings.eav_series(recordings.eav_rows(eav_lines(spark, sf_dir)), ["signup"], 20))


@query(
    f"{EAV}, k AS (SELECT user_id, parameter, value, row_number() OVER (PARTITION BY user_id, parameter ORDER BY minute, value) AS n FROM r WHERE hour = 0 AND parameter IN ('signup', 'view') AND value IS NOT NULL) "
    "SELECT user_id AS record_id, round(max(value) FILTER (parameter = 'signup'), 6) + 0.0 AS signup, round(max(value) FILTER (parameter = 'view'), 6) + 0.0 AS \"view\" FROM k WHERE n = 1 GROUP BY user_id"
)
def eav_statics(spark, sf_dir):
    return rounded(recordings.eav_statics(recordings.eav_rows(eav_lines(spark, sf_dir)), ["signup", "view"]))


@query(
    "WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN (c_custkey % 90) || ' yr FEMALE' WHEN c_custkey % 4 = 1 THEN 'Male, ' || (c_custkey % 90) || 'yr' WHEN c_custkey % 4 = 2 THEN 'unknown' END AS t FROM customer) "
    "SELECT c_custkey, CAST(nullif(regexp_extract(lower(t), '(\\d+)\\s*yr', 1), '') AS DOUBLE) AS age, CASE WHEN lower(t) LIKE '%female%' THEN 0.0 WHEN lower(t) LIKE '%male%' THEN 1.0 END::DOUBLE AS sex FROM t"
)
def demographics_text(spark, sf_dir):
    k = F.col("c_custkey")
    years = (k % 90).cast("string")
    text = F.when(k % 4 == 0, F.concat(years, F.lit(" yr FEMALE"))).when(k % 4 == 1, F.concat(F.lit("Male, "), years, F.lit("yr"))).when(k % 4 == 2, F.lit("unknown"))
    age, sex = recordings.demographics(text)
    return table(spark, sf_dir, "customer").select("c_custkey", age.alias("age"), sex.alias("sex"))


# ---------------------------------------------------------------- models (no SQL; tested against brute force and held-out accuracy)


def user_rows(spark, sf_dir) -> DataFrame:
    """(row_id, y, static, series) of the users: balance in thousands, nation and segment, a series a channel."""
    arrays = series.to_arrays(user_series(spark, sf_dir), ["user_id", "channel"])
    users = arrays.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "series"))), lambda c: c["series"]).alias("series"))
    return users.join(table(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey")).select(
        F.col("user_id").alias("row_id"), (F.col("c_acctbal") / 1000).alias("y"), F.array(F.col("c_nationkey").cast("double"), (F.length("c_mktsegment")).cast("double")).alias("static"), "series"
    )


def boosted_rules(spark, sf_dir):
    """Boosted rules on users: account balance from static columns and event series; the splits found."""
    rows = stored(user_rows(spark, sf_dir))
    model = boost.fit_regressor(rows, boost.Params(rounds=3, depth=2, draws=specs.Draws(intervals=8)))
    return model.predict(rows).select("row_id", "prediction")


@query(
    "WITH sp AS (WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal / 1000 END AS a, CAST(c_custkey AS DOUBLE) AS b, (SELECT avg(c_nationkey) FROM customer) - c_nationkey AS g FROM customer), "
    f"p AS (SELECT 0 AS problem, a AS f, g FROM c UNION ALL SELECT 1, b, g FROM c){SCAN}), "
    "top AS (SELECT * FROM sp ORDER BY gain DESC, problem LIMIT 1), r AS (SELECT c_custkey, c_nationkey, CASE WHEN problem = 1 THEN c_custkey <= threshold WHEN c_custkey % 9 = 0 THEN missing_left ELSE c_acctbal / 1000 <= threshold END AS go, (SELECT avg(c_nationkey) FROM customer) AS m FROM customer, top) "
    "SELECT c_custkey, round(m + sum(c_nationkey - m) OVER (PARTITION BY go) / (count(*) OVER (PARTITION BY go) + 1.0), 6) + 0.0 AS prediction FROM r"
)
def boosted_stump(spark, sf_dir):
    """One tree of one split by the booster, its bins far fewer than the values: the cut is the exact scan's."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    rows = stored(c.select(k.alias("row_id"), F.col("c_nationkey").cast("double").alias("y"), F.array(F.when(k % 9 != 0, F.col("c_acctbal") / 1000), k.cast("double")).alias("static"), F.array().cast("array<array<double>>").alias("series")))
    model = boost.fit_regressor(rows, boost.Params(rounds=1, depth=1, rate=1.0, rules=RULES, bins=64))
    return rounded(model.predict(rows).select(F.col("row_id").alias("c_custkey"), "prediction"))


def ridge_base(spark, sf_dir):
    """Ridge on the embeddings' convolution features, one-vs-rest: leave-one-out margins of every vector."""
    rows, _ = embedded(spark, sf_dir)
    bank = rocket.RocketBank.fit(rows.select(F.col("vec_id").alias("row_id"), F.array("series").alias("s")), "s", 64, features=252, seed=0)
    target = ridge.signed_targets(F.col("label"), list(range(10)))
    wide = stored(rows.select("vec_id", "label", bank.transform(F.array("series")).alias("x"), target.alias("t")))
    held = ridge.fit_ridge(wide).leave_one_out(wide)
    return held.select("vec_id", "label", (F.array_position("margin", F.array_max("margin")) - 1).cast("int").alias("predicted"))


def generated_scenarios(spark, sf_dir):
    """Rows of each generator, as many as there are customers, with their labels."""
    n, out = table(spark, sf_dir, "customer").count(), None
    for name, make in generators.SCENARIOS.items():
        rows = make(spark, n).select(F.lit(name).alias("scenario"), "row_id", F.size("static").alias("statics"), F.size("series").alias("channels"), F.col("label").cast("double").alias("label"))
        out = rows if out is None else out.unionByName(rows)
    return out


for _f in (boosted_rules, ridge_base, generated_scenarios):
    QUERIES[_f.__name__] = _f
