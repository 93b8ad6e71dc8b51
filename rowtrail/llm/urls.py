"""URL filters: explicit host/path rules first, a logistic regression on hashed character n-grams for the rest.

Everything is DataFrame expressions and ``pyspark.ml``; a url is judged by a narrow projection without a shuffle.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the registered query, as (verdict, host and path prefix).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

#: The small labelled table, one url a row; 1 = block.
LABELLED = [
    ("http://ads.clickhub.test/banner/track?id=1", 1), ("http://adserver.promo.test/pixel/impression", 1),
    ("https://track.affiliate.test/redirect/offer", 1), ("http://casino-bonus.test/free-spins/win", 1),
    ("http://best-poker-online.test/bet/casino", 1), ("https://cheap-pills.test/buy/viagra-online", 1),
    ("http://pharmacy-discount.test/order/pills", 1), ("http://hot-xxx-videos.test/adult/gallery", 1),
    ("http://porn-tube.test/free/videos/adult", 1), ("http://payday-loans-fast.test/apply/loan", 1),
    ("http://win-prize-now.test/claim/gift-card", 1), ("https://click.tracker.test/pixel/click/redirect", 1),
    ("http://free-download-crack.test/serial/keygen", 1), ("http://warez-torrent.test/crack/download", 1),
    ("http://replica-watches.test/buy/cheap/rolex", 1), ("http://seo-links-farm.test/tag/buy/cheap/links", 1),
    ("https://popup-ads.test/banner/click", 1), ("http://bonus-slots.test/casino/spin/win", 1),
    ("http://login-verify-account.test/secure/update/password", 1), ("http://doubleclicker.test/ad/banner/728x90", 1),
    ("https://sex-chat.test/adult/live/cams", 1), ("http://cheap-loans.test/offer/apply/now", 1),
    ("http://spam-offers.test/promo/click/offer", 1), ("http://adult-dating.test/join/free/sex", 1),
    ("https://www.city-news.test/en/2021/article.html", 0), ("https://blog.gardening.test/en/posts/soil", 0),
    ("https://docs.library.test/en/guide/install", 0), ("http://www.university.test/fr/recherche/articles", 0),
    ("https://history.museum.test/de/sammlung/objekt", 0), ("https://wiki.science.test/wiki/Photosynthesis", 0),
    ("https://m.newspaper.test/es/noticias/cultura", 0), ("http://www.school.test/en/course/12345", 0),
    ("https://forum.cooking.test/en/thread/98765", 0), ("https://www.weather.test/de/bericht/4567.html", 0),
    ("https://journal.medicine.test/en/paper/1029", 0), ("http://archive.books.test/fr/texte/2048/", 0),
    ("https://blog.travel.test/es/viaje/3321#top", 0), ("https://www.government.test/en/report/2019", 0),
    ("https://news.sports.test/en/36675", 0), ("http://www.theatre.test/fr/163/", 0),
    ("https://code.project.test/docs/reference.html", 0), ("https://www.recipes.test/de/23755", 0),
    ("https://m.radio.test/fr/35610#top", 0), ("https://magazine.art.test/en/20117", 0),
    ("http://www.townhall.test/es/26123?page=2", 0), ("https://encyclopedia.test/en/9897/", 0),
    ("https://www.nature.test/en/story/forest", 0), ("https://lectures.test/de/44607.html", 0),
]


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host from the first ``://`` up to ``/ ? #`` with A-Z lower-cased, then the path up to ``? #``.

    A null url, or one without ``://``, has both empty.
    """
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; both null if none does.  Equal lengths: the first in text order."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def grams(host: Column, path: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Character n-grams of host and path; the border characters and the part's letter keep the two apart."""

    def of(text: Column, part: str, n: int) -> Column:
        t = F.concat(F.lit("^"), F.lower(text), F.lit("$"))
        # one pass over the text: each character with those after it; taking substrings by place would be quadratic
        runs = F.when(F.length(t) < n, F.array(t)).otherwise(F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))."), 1))
        return F.transform(runs, lambda g: F.concat(F.lit(part), g))

    return F.concat(*[of(text, part, n) for text, part in ((host, "h"), (path, "p")) for n in sizes])


def train(spark: SparkSession, labelled: list[tuple[str, int]] | None = None, buckets: int = 1 << 16) -> PipelineModel:
    """Fit the model on the labelled table (a few dozen rows by default, so one partition)."""
    rows = spark.createDataFrame(labelled or LABELLED, "url string, label int").coalesce(1)
    host, path = url_parts(F.col("url"))
    rows = rows.select(F.col("label").cast("double").alias("label"), grams(host, path).alias("grams"))
    return Pipeline(
        stages=[
            HashingTF(inputCol="grams", outputCol="features", numFeatures=buckets, binary=True),
            LogisticRegression(maxIter=40, regParam=0.01, probabilityCol="probability"),
        ]
    ).fit(rows)


def judge_urls(pages: DataFrame, model: PipelineModel, rules: list[tuple[str, str]] | None = None, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """Verdict of each row's url: (id, host, path, rule, verdict, block_score).

    The longest fitting rule decides; without one the model does (block from a score of 0.5).  Null urls and urls
    without ``://`` have an empty host and path, no rule, and the model's verdict on nothing.  Repeated rows are
    judged each; other columns of the input are ignored, so their names cannot clash; an empty table gives none.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url"))
    parts = parts.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    scored = model.transform(parts.withColumn("grams", grams(F.col("host"), F.col("path"))))
    score = vector_to_array("probability")[1]
    return scored.select(
        F.col("page_id").alias(id_column),
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(said, F.when(score >= 0.5, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        score.alias("block_score"),
    )


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url under the registered rules."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), train(spark))
