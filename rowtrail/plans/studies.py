"""Registered queries of the study rules over cells made from order lines, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import verdicts
from .catalogue import query, rounded, table

MODELS = ["agg", "wagg4", "raw_flat", "minirocket", "minirocket10k", "static_only", "ours"]
SIZES = [100, 250, 1000]
RIVALS = ["wagg4", "raw_flat", "minirocket", "minirocket10k"]


def _pick(values: list, place) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (place + 1).cast("int"))


def cells(spark, sf_dir) -> DataFrame:
    """(dataset, size, seed, model, score): ten times the mean discount of lines; two of eight datasets have no statics."""
    line = table(spark, sf_dir, "lineitem")
    known = _pick(MODELS, F.col("l_suppkey") % 7)
    model = F.when((F.col("l_orderkey") % 8 >= 6) & (known == "static_only"), F.lit("wagg8")).otherwise(known)
    keys = [F.concat(F.lit("d"), F.col("l_orderkey") % 8).alias("dataset"), _pick(SIZES, F.col("l_linenumber") % 3).alias("size"), (F.col("l_partkey") % 5).alias("seed"), model.alias("model")]
    return line.groupBy(*keys).agg((10 * F.avg("l_discount")).alias("score"))


C = """WITH c0 AS (SELECT 'd' || (l_orderkey % 8) AS dataset, [100, 250, 1000][1 + l_linenumber % 3] AS size, l_partkey % 5 AS seed, l_discount, l_orderkey % 8 AS o,
  ['agg', 'wagg4', 'raw_flat', 'minirocket', 'minirocket10k', 'static_only', 'ours'][1 + l_suppkey % 7] AS m FROM lineitem),
c AS (SELECT dataset, size, seed, CASE WHEN o >= 6 AND m = 'static_only' THEN 'wagg8' ELSE m END AS model, 10 * avg(l_discount) AS score FROM c0 GROUP BY ALL),
s AS (SELECT dataset, size, model, avg(score) AS mean FROM c GROUP BY ALL)"""
W3 = f"""{C}, m AS (SELECT dataset, size, max(mean) FILTER (model = 'ours') AS a, max(mean) FILTER (model = 'agg') AS b, max(mean) FILTER (model = 'static_only') AS st FROM s GROUP BY ALL),
j AS (SELECT dataset, size, 100 * (a - b) AS margin, 100 * (a - st) AS gap, 100 * (b - st) >= 2 AS informative FROM m WHERE a IS NOT NULL AND b IS NOT NULL AND st IS NOT NULL)"""


@query(f"{W3} SELECT dataset, size, round(margin, 6) + 0.0 AS margin, round(gap, 6) + 0.0 AS gap, informative FROM j")
def study_informative_cells(spark, sf_dir):
    return rounded(verdicts.informative_cells(cells(spark, sf_dir), "ours", "agg", "static_only", 2.0))


@query(
    f"""{W3}, h1 AS (SELECT 'H1' AS hypothesis, avg(CASE WHEN margin >= 2 THEN 1.0 ELSE 0 END) AS value, count(*) AS n FROM j WHERE informative),
h2 AS (SELECT 'H2' AS hypothesis, CAST(sum(CASE WHEN margin < 0 THEN 1 ELSE 0 END) AS DOUBLE) AS value, count(*) AS n FROM j WHERE informative AND size IN (100, 250)),
t AS (SELECT dataset, median(mean) FILTER (model = 'ours') AS a, max(mean) FILTER (model IN ('minirocket', 'minirocket10k')) AS b FROM s WHERE dataset NOT IN (SELECT dataset FROM s WHERE model = 'static_only') GROUP BY dataset),
h3 AS (SELECT 'H3' AS hypothesis, median(100 * (a - b)) AS value, count(a - b) AS n FROM t),
h4 AS (SELECT 'H4' AS hypothesis, CAST(sum(CASE WHEN gap < -4 THEN 1 ELSE 0 END) AS DOUBLE) AS value, count(*) AS n FROM j WHERE NOT informative)
SELECT hypothesis, round(value, 6) + 0.0 AS value, n, CASE WHEN value >= 0.6 THEN 'PASS' WHEN value < 0.5 THEN 'FAIL' WHEN value IS NOT NULL THEN 'INCONCLUSIVE' END AS verdict FROM h1
UNION ALL SELECT hypothesis, round(value, 6) + 0.0, n, CASE WHEN n > 0 THEN CASE WHEN value > n / 2 THEN 'FAIL' ELSE 'PASS' END END FROM h2
UNION ALL SELECT hypothesis, round(value, 6) + 0.0, n, CASE WHEN value >= -5 THEN 'PASS' WHEN value < -10 THEN 'FAIL' WHEN value IS NOT NULL THEN 'MARGINAL' END FROM h3
UNION ALL SELECT hypothesis, round(value, 6) + 0.0, n, CASE WHEN n > 0 THEN CASE WHEN value > 0 THEN 'FAIL' ELSE 'PASS' END END FROM h4"""
)
def study_first_verdicts(spark, sf_dir):
    return rounded(verdicts.first_verdicts(cells(spark, sf_dir), "ours", "agg", "static_only", ["minirocket", "minirocket10k"]))


@query(f"{C} SELECT dataset, size, round(100 * (max(mean) FILTER (model <> 'static_only') - max(mean) FILTER (model = 'static_only')), 6) + 0.0 AS lift FROM s GROUP BY dataset, size HAVING max(mean) FILTER (model = 'static_only') IS NOT NULL AND max(mean) FILTER (model <> 'static_only') IS NOT NULL")
def study_headroom(spark, sf_dir):
    return rounded(verdicts.headroom(cells(spark, sf_dir), "static_only"))


@query(
    f"""{C}, b AS (SELECT dataset, size, arg_min(model, struct_pack(m := mean, n := model)) AS best, min(mean) AS top FROM s WHERE model IN ('agg', 'wagg4', 'raw_flat', 'minirocket') GROUP BY ALL),
o AS (SELECT dataset, size, max(mean) FILTER (model = 'ours') AS a, max(mean) FILTER (model = 'agg') AS p, max(mean) FILTER (model = 'minirocket10k') AS q FROM s GROUP BY ALL)
SELECT dataset, size, best, round(a, 6) + 0.0 AS ours, a < top AS ahead, round(p - a, 6) + 0.0 AS vs_plain, round(q - a, 6) + 0.0 AS vs_oracle FROM o JOIN b USING (dataset, size)"""
)
def study_baseline_table(spark, sf_dir):
    """The score as an error, lower being better."""
    return rounded(verdicts.baseline_table(cells(spark, sf_dir), "ours", MODELS[:4], "agg", "minirocket10k", lower_is_better=True))


REGIMES = f"""{C}, g AS (SELECT dataset, size, 100 * (max(mean) FILTER (model IN ('wagg4', 'raw_flat', 'minirocket', 'minirocket10k')) - max(mean) FILTER (model = 'agg')) AS loss FROM s GROUP BY ALL),
rg AS (SELECT *, CASE WHEN loss >= 5 THEN 'shape' WHEN loss <= 2 THEN 'summary' WHEN loss IS NOT NULL THEN 'ambiguous' ELSE 'unclassified' END AS regime FROM g)"""
COUNTS = f"""{REGIMES}, mm AS (SELECT dataset, size, 100 * (max(mean) FILTER (model = 'ours') - max(mean) FILTER (model = 'agg')) AS margin FROM s GROUP BY ALL HAVING max(mean) FILTER (model = 'ours') IS NOT NULL),
k AS (SELECT regime, count(*) AS cells, CAST(count(*) FILTER (margin >= 2) AS BIGINT) AS wins, CAST(count(*) FILTER (margin < -2) AS BIGINT) AS harmed FROM rg JOIN mm USING (dataset, size) GROUP BY regime)"""


@query(f"{REGIMES} SELECT dataset, size, round(loss, 6) + 0.0 AS loss, regime FROM rg")
def regime_class(spark, sf_dir):
    return rounded(verdicts.regimes(cells(spark, sf_dir), "agg", RIVALS))


@query(f"{COUNTS} SELECT * FROM k")
def regime_verdicts(spark, sf_dir):
    return verdicts.regime_verdicts(cells(spark, sf_dir), "ours", "agg", RIVALS)


@query(
    f"""{COUNTS}, z AS (SELECT sum(cells) FILTER (regime = 'shape') AS n, sum(wins) FILTER (regime = 'shape') AS w, coalesce(sum(harmed) FILTER (regime = 'summary') / sum(cells) FILTER (regime = 'summary'), 0) AS h FROM k)
SELECT CASE WHEN w / n < 0.5 OR h > 0.2 THEN 'FAIL' WHEN w / n >= 0.6 AND h <= 0.2 THEN 'PASS' ELSE 'INCONCLUSIVE' END AS verdict FROM z"""
)
def conditional_claim(spark, sf_dir):
    return verdicts.conditional_claim(verdicts.regime_verdicts(cells(spark, sf_dir), "ours", "agg", RIVALS))


@query(
    f"""{C}, t AS (SELECT dataset, size, CASE WHEN model = 'minirocket10k' THEN 'minirocket' ELSE model END AS model, max(mean) AS mean FROM s WHERE model NOT IN ('static_only', 'wagg8') GROUP BY ALL),
r AS (SELECT model, row_number() OVER (PARTITION BY dataset, size ORDER BY mean DESC, model) AS r FROM t WHERE (dataset, size) IN (SELECT (dataset, size) FROM t WHERE model = 'ours')),
k AS (SELECT model, avg(r) AS mean_rank FROM r GROUP BY model) SELECT model, round(mean_rank, 6) + 0.0 AS mean_rank, mean_rank > (SELECT mean_rank FROM k WHERE model = 'ours') AS beaten FROM k"""
)
def credited_standing(spark, sf_dir):
    means = verdicts.credited(cells(spark, sf_dir).where(~F.col("model").isin("static_only", "wagg8")), {"minirocket10k": "minirocket"})
    return rounded(verdicts.standing(means, "ours"))


@query(
    f"""{C}, m AS (SELECT dataset, size, greatest(max(mean) FILTER (model = 'minirocket'), max(mean) FILTER (model = 'minirocket10k')) AS o, max(mean) FILTER (model = 'raw_flat') AS b, max(mean) FILTER (model = 'wagg4') AS t, max(mean) FILTER (model = 'ours') AS f FROM s GROUP BY ALL)
SELECT dataset, size, round(100 * (b - o), 6) + 0.0 AS bank, round(100 * (t - b), 6) + 0.0 AS trees, round(100 * (f - t), 6) + 0.0 AS statics FROM m WHERE b IS NOT NULL AND t IS NOT NULL AND f IS NOT NULL"""
)
def arm_decomposition(spark, sf_dir):
    return rounded(verdicts.decomposition(cells(spark, sf_dir), ["minirocket", "minirocket10k"], "raw_flat", "wagg4", "ours"))


@query(
    f"""{C}, p AS (SELECT dataset, seed, avg(score) FILTER (model = 'ours') AS a, avg(score) FILTER (model = 'static_only') AS b FROM c GROUP BY ALL)
SELECT dataset, count(*) AS seeds, round(avg(100 * (a - b)), 6) + 0.0 AS gain, CASE WHEN avg(100 * (a - b)) >= 1 THEN 'PASS' WHEN avg(100 * (a - b)) <= 0 THEN 'FAIL' ELSE 'MARGINAL' END AS verdict FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY dataset"""
)
def best_half_gain(spark, sf_dir):
    return rounded(verdicts.paired_gain(cells(spark, sf_dir), "ours", "static_only", 1.0, 0.0, strict=False))


def arm_margins(spark, sf_dir) -> DataFrame:
    """(arm, seed, margin): the sizes as arms."""
    both = verdicts.wide_means(cells(spark, sf_dir), ["ours", "agg"], ["size", "seed"])
    return both.select(F.concat(F.lit("n"), "size").alias("arm"), "seed", (100 * (F.col("ours") - F.col("agg"))).alias("margin"))


@query(
    f"""{C}, a AS (SELECT 'n' || size AS arm, seed, 100 * (avg(score) FILTER (model = 'ours') - avg(score) FILTER (model = 'agg')) AS margin FROM c GROUP BY size, seed),
m AS (SELECT avg(margin) FILTER (arm = 'n1000') AS a, avg(margin) FILTER (arm = 'n250') AS b, avg(margin) FILTER (arm = 'n100') AS c FROM a),
g AS (SELECT count(*) FILTER (sign(x.margin - y.margin) = (SELECT sign(a - c) FROM m)) AS agree FROM a x JOIN a y USING (seed) WHERE x.arm = 'n1000' AND y.arm = 'n100')
SELECT 'width' AS hypothesis, round(a - c, 6) + 0.0 AS value, CASE WHEN a - c >= 0.5 AND agree >= 3 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM m, g
UNION ALL SELECT 'order', round(a - c, 6) + 0.0, CASE WHEN a >= b AND b >= c THEN 'PASS' ELSE 'FAIL' END FROM m
UNION ALL SELECT 'control', round(c, 6) + 0.0, CASE WHEN c > 0 THEN 'PASS' ELSE 'FAIL' END FROM m"""
)
def dose_verdicts(spark, sf_dir):
    return rounded(verdicts.dose_verdicts(arm_margins(spark, sf_dir), ["n1000", "n250", "n100"], 0.5, 3))


def scenario_results(spark, sf_dir) -> DataFrame:
    """(scenario, model, seed, rmse, auc): datasets d0 to d3 have an error, d4 to d6 a score, d7 neither."""
    one = cells(spark, sf_dir).groupBy("dataset", "model", "seed").agg(F.avg("score").alias("v"))
    place = F.substring("dataset", 2, 1).cast("int")
    return one.select(F.col("dataset").alias("scenario"), "model", "seed", F.when(place < 4, F.col("v")).alias("rmse"), F.when((place >= 4) & (place < 7), F.col("v")).alias("auc"))


REGRESS = f"""{C}, r AS (SELECT dataset AS scenario, model, seed, CASE WHEN dataset < 'd4' THEN avg(score) END AS e, CASE WHEN dataset BETWEEN 'd4' AND 'd6' THEN avg(score) END AS u FROM c GROUP BY dataset, model, seed),
p AS (SELECT x.scenario, x.model, avg(x.e) AS e, avg(y.e) AS e0, avg(x.u) AS u, avg(y.u) AS u0 FROM r x JOIN r y USING (scenario, seed) WHERE y.model = 'agg' AND x.model IN ('ours', 'wagg4') GROUP BY ALL),
d AS (SELECT scenario, model, CASE WHEN scenario < 'd4' THEN 'rmse' WHEN scenario < 'd7' THEN 'auc' END AS metric, CASE WHEN scenario < 'd4' THEN 100 * (e0 - e) / e0 ELSE 100 * (u - u0) END AS change FROM p),
w AS (SELECT *, CASE WHEN metric = 'rmse' THEN change < -2 ELSE change < -1 END AS worse FROM d)"""


@query(f"{REGRESS} SELECT scenario, model, metric, round(change, 6) + 0.0 AS change, worse FROM w")
def scenario_regressions(spark, sf_dir):
    return rounded(verdicts.regressions(scenario_results(spark, sf_dir), "agg", ["ours", "wagg4"]))


@query(
    f"""{REGRESS}, v AS (SELECT seed, avg(score) FILTER (model = 'agg') AS b, avg(score) FILTER (model = 'ours') AS o, avg(score) FILTER (model = 'wagg4') AS g FROM c WHERE dataset = 'd5' GROUP BY seed),
f AS (SELECT 'ours' AS model, avg(100 * (o - b)) AS veto_margin FROM v UNION ALL SELECT 'wagg4', avg(100 * (g - b)) FROM v),
q AS (SELECT model, max(change) FILTER (scenario = 'd0') AS cut, CAST(count(*) FILTER (worse) AS BIGINT) AS regressed FROM w GROUP BY model)
SELECT model, round(veto_margin, 6) + 0.0 AS veto_margin, round(cut, 6) + 0.0 AS cut, regressed, coalesce(veto_margin >= -2 AND cut >= 4 AND regressed = 0, false) AS ships FROM f JOIN q USING (model)"""
)
def product_gate(spark, sf_dir):
    c = cells(spark, sf_dir)
    return rounded(verdicts.product_gate(c.where("dataset = 'd5'"), scenario_results(spark, sf_dir), "agg", ["ours", "wagg4"], "d0"))


@query(
    f"""{C}, p AS (SELECT dataset, seed, avg(score) FILTER (model = 'ours') AS a, avg(score) FILTER (model = 'minirocket10k') AS b FROM c GROUP BY ALL),
q AS (SELECT dataset, avg(a) AS a, avg(b) AS b FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY dataset),
u AS (SELECT count(*) FILTER (a > b) AS ahead, count(*) AS datasets, avg(a) AS ma, avg(b) AS mb FROM q WHERE dataset <> 'd3'),
h AS (SELECT avg(100 * (a - b)) AS margin FROM p WHERE dataset = 'd3'),
l AS (SELECT least(min(100 * (y - x)), 0) AS worst FROM (SELECT dataset, avg(score) FILTER (model = 'raw_flat') AS x, avg(score) FILTER (model = 'ours') AS y FROM c GROUP BY dataset)),
e AS (SELECT ahead, datasets, ahead >= 4 AND ma >= mb AS breadth, margin, margin >= 0.2 AS held, worst, worst >= -1 AS kept FROM u, h, l)
SELECT ahead, datasets, breadth, round(margin, 6) + 0.0 AS margin, held, round(worst, 6) + 0.0 AS worst, kept,
  CASE WHEN NOT kept THEN 'not cleared: worse than before' WHEN breadth AND held THEN 'cleared' WHEN held THEN 'cleared for the headline alone' ELSE 'not cleared: headline lost' END AS release FROM e"""
)
def release_gate(spark, sf_dir):
    c = cells(spark, sf_dir)
    return rounded(verdicts.release_gate(c, c, "ours", "minirocket10k", "raw_flat", "d3", majority=4, bar=0.2))


@query(f"{C}, k AS (SELECT dataset, avg(score) FILTER (model = 'minirocket') AS a, avg(score) FILTER (model = 'minirocket10k') AS b FROM c GROUP BY dataset) SELECT round(max(abs(100 * (a - b))), 6) + 0.0 AS worst, max(abs(100 * (a - b))) <= 0.5 AS comparable FROM k")
def control_holds(spark, sf_dir):
    c = cells(spark, sf_dir)
    return rounded(verdicts.control_holds(c, c, "minirocket", "minirocket10k"))


@query(
    f"""{C}, m AS (SELECT dataset, model, 100 * avg(score) AS mean FROM c WHERE model <> 'wagg8' AND model <> 'static_only' GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY mean DESC, model) AS r, max(mean) FILTER (model = 'agg') OVER (PARTITION BY dataset) AS f, max(mean) FILTER (model = 'ours') OVER (PARTITION BY dataset) AS s FROM m)
SELECT model, round(avg(mean), 6) + 0.0 AS mean, round(avg(r), 6) + 0.0 AS mean_rank, round(avg(mean - f), 6) + 0.0 AS vs_first, CAST(count(*) FILTER (mean >= f + 1) AS BIGINT) AS beats_first, CAST(count(*) FILTER (mean >= s + 1) AS BIGINT) AS beats_second,
  round((sum(mean - f) - max(mean - f)) / (count(*) - 1), 6) + 0.0 AS without_best FROM t GROUP BY model"""
)
def head_standings(spark, sf_dir):
    return rounded(verdicts.head_standings(cells(spark, sf_dir).where(~F.col("model").isin("wagg8", "static_only")), "agg", "ours"))


@query(
    """WITH r AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'uea:x' ELSE 'icu' END AS dataset, o_custkey % 4 AS model, avg(o_totalprice) AS auc, max(o_totalprice) AS acc FROM orders GROUP BY ALL)
SELECT dataset, 7 AS size, model AS seed, 'm' AS model, round(CASE WHEN dataset = 'icu' THEN auc ELSE acc END, 6) + 0.0 AS score FROM r"""
)
def headline_cells(spark, sf_dir):
    """The metric fixed per dataset out of a map of metrics."""
    r = table(spark, sf_dir, "orders").groupBy(F.when(F.col("o_orderkey") % 2 == 0, F.lit("uea:x")).otherwise(F.lit("icu")).alias("dataset"), (F.col("o_custkey") % 4).alias("seed")).agg(F.avg("o_totalprice").alias("auc"), F.max("o_totalprice").alias("acc"))
    results = r.select("dataset", F.lit(7).alias("n_train"), "seed", F.lit("m").alias("model"), F.create_map(F.lit("roc_auc"), "auc", F.lit("balanced_accuracy"), "acc").alias("metrics"))
    return rounded(verdicts.headline(results, {"icu": "roc_auc"}, {"uea:": "balanced_accuracy"}))
