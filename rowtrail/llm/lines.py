"""Line dedup: later copies of repeated line runs are deleted.  DataFrame functions only, no Python in the tasks.

Lines get names (their first place in the corpus); blocks of 2, 4, 8, ... lines get names from pairs of shorter ones by
prefix doubling, one shuffle of names a round over what still repeats.  A run of any length is then named by two
overlapping blocks, so the suffixes that share a run form one interval of equal names; the first in the corpus stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hot_join, written

#: Words that a run holds at least to be deleted as a copy.
MIN_WORDS = 50
_LAST_ID = 2**63 - 1


def word_count(line: Column) -> Column:
    return F.size(F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda x: x != ""))


def _named(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Written rows whose ``by`` values occur more than once, with the first place of those values as ``name``.

    The first places come from a partial aggregate; they are joined back with frequent values broadcast, so the rows
    of a value are never gathered.
    """
    firsts = rows.groupBy(*by).agg(F.min("place").alias(name), F.count("*").alias("many")).where("many > 1")
    return hot_join(rows, written(firsts, "lines"), by, "many").drop("many")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, gone): numbers of the lines to delete, per document; th is the text's hash, as repeated ids may differ.

    A line goes if it lies in a run of consecutive lines of at least ``min_words`` words that also starts earlier: in a
    document of smaller doc_id, or earlier in the same one.  Runs are judged on the input and may overlap.

    Two kinds of runs decide for all: the shortest that starts at a line and the shortest that ends at one.  Say a line
    lies in a repeated run that ends at e: if enough words follow from the line up to e, the shortest run from the line
    lies inside the repeated one; else the shortest that ends at e reaches back over the line and lies inside as well.
    A document has at most two such runs a line.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(
        "doc_id", F.xxhash64("text").alias("th"), F.monotonically_increasing_id().alias("row"), F.split("text", "\n").alias("lines")
    ).withColumn("last", F.size("lines"))
    # one more entry, null, closes each text
    split = texts.select("doc_id", "th", "row", "last", F.posexplode(F.concat("lines", F.array(F.lit(None).cast("string")))).alias("idx", "line"))
    split = split.select("doc_id", "th", "row", "last", "idx", F.when(F.col("line").isNotNull(), F.xxhash64("line")).alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.coalesce(word_count(F.col("line")), F.lit(0)).alias("words"))
    by_row = W.partitionBy("row")
    before = F.coalesce(F.sum("words").over(by_row.orderBy("idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    # the first line with so many words before it; in falling order the frame only grows, so each row is taken in once
    stop = F.min("idx").over(by_row.orderBy(F.desc("before")).rangeBetween(W.unboundedPreceding, -min_words))
    # m: lines of the shortest run from here; most: of the longest run for which no later start makes a shorter one
    until = F.coalesce(F.lead("stop").over(by_row.orderBy("idx")), F.col("last") + 1) - 1
    lines = split.withColumn("before", before).withColumn("stop", stop).withColumn("until", F.greatest("stop", until))
    lines = lines.withColumn("m", F.col("stop") - F.col("idx")).withColumn("most", F.when(F.col("m").isNotNull(), F.col("until") - F.col("idx"))).where("h1 is not null").drop("before", "words", "stop", "until", "last")
    lines = written(lines.withColumn("place", F.struct("doc_id", "idx")), "lines")
    level = written(_named(lines, ["h1", "h2"], "name").drop("h1", "h2"), "lines")
    deepest = level.agg(F.coalesce(F.max("most"), F.lit(0))).first()[0]
    runs, size = [], 1
    while size <= deepest:
        at = level.select("row", F.col("idx").alias("end"), F.col("name").alias("tail"))
        here = level.where((F.col("m") < 2 * size) & (F.col("most") >= size)).withColumn("m", F.explode(F.sequence(F.greatest("m", F.lit(size)), F.least("most", F.lit(2 * size - 1)))))
        here = here.withColumn("end", F.col("idx") + F.col("m") - size)
        runs.append(here.join(at, ["row", "end"]).select("doc_id", "th", "idx", "m", "place", F.col("name").alias("head"), "tail"))
        if 2 * size <= deepest:
            after = level.select("row", (F.col("idx") - size).alias("idx"), F.col("name").alias("next"))
            pairs = written(level.join(after, ["row", "idx"]).withColumnRenamed("name", "first"), "lines")
            level = written(_named(pairs, ["first", "next"], "name").drop("first", "next"), "lines")
        size *= 2
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("th", T.LongType()), T.StructField("gone", T.ArrayType(T.IntegerType()))])
    if not runs:
        return spark.createDataFrame([], schema)
    found = runs[0]
    for r in runs[1:]:
        found = found.unionByName(r)
    later = _named(written(found, "lines"), ["m", "head", "tail"], "origin").where(F.col("place") > F.col("origin"))
    # each line once: a run adds what the runs that start before it leave
    ends = later.groupBy("doc_id", "th", "idx").agg((F.col("idx") + F.max("m")).alias("end"))
    done = F.coalesce(F.max("end").over(W.partitionBy("doc_id", "th").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fresh = ends.withColumn("from", F.greatest("idx", done)).where(F.col("from") < F.col("end"))
    gone = fresh.select("doc_id", "th", F.explode(F.sequence("from", F.col("end") - 1)).alias("line"))
    return gone.groupBy("doc_id", "th").agg(F.collect_list(F.col("line").cast("int")).alias("gone"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every document with ``text`` as it remains, and n_lines and n_removed, which replace columns of those names.

    Other columns come through unchanged.  A null text stays null and has no lines; an empty text is one empty line;
    repeated rows of a doc_id are no earlier than each other at equal places, so they lose the same lines; a null
    doc_id comes after all others; a text that loses all its lines is empty; an empty table gives an empty result.
    """
    gone = repeated_lines(docs, min_words).toDF("_line_dedup_id", "_line_dedup_th", "_line_dedup_gone")
    keyed = docs.drop("n_lines", "n_removed").withColumns({"_line_dedup_k": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID)), "_line_dedup_h": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    joined = keyed.join(gone, (F.col("_line_dedup_k") == F.col("_line_dedup_id")) & (F.col("_line_dedup_h") == F.col("_line_dedup_th")), "left")
    lines = F.split("text", "\n")
    stay = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("_line_dedup_lines") - 1), "_line_dedup_gone"))
    cut = F.when(F.col("_line_dedup_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("_line_dedup_lines"), i)), "\n"))
    counted = joined.withColumn("_line_dedup_lines", lines).withColumns(
        {"n_lines": F.coalesce(F.when(F.col("text").isNotNull(), F.size("_line_dedup_lines")), F.lit(0)).cast("long"), "n_removed": F.coalesce(F.when(F.col("_line_dedup_gone").isNotNull(), F.size("_line_dedup_gone")), F.lit(0)).cast("long")}
    )
    return counted.withColumn("text", cut).drop("_line_dedup_k", "_line_dedup_h", "_line_dedup_id", "_line_dedup_th", "_line_dedup_gone", "_line_dedup_lines")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document: doc_id, n_lines, n_removed, kept_sha256, text."""
    kept = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), "text")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without later copies of line runs; one that loses all its lines goes."""
    kept = dedup_lines(docs).where("n_removed = 0 or n_removed < n_lines")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


#: The same in plain SQL by another way: all pairs of equal lines, in runs along their diagonals; a run of 50 words that
#: also starts earlier goes.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
e AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d),
w AS (SELECT doc_id, i, l[i] AS line, len(list_filter(string_split_regex(l[i], '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words FROM e),
p AS (SELECT b.doc_id, b.i, a.doc_id AS other, b.i - a.i AS shift, b.words FROM w a JOIN w b ON a.line = b.line AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.i < b.i))),
r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, other, shift ORDER BY i) AS run FROM p),
h AS (SELECT doc_id, i, sum(words) OVER (PARTITION BY doc_id, other, shift, run) AS held FROM r),
g AS (SELECT DISTINCT doc_id, i FROM h WHERE held >= 50),
k AS (SELECT w.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(CASE WHEN g.i IS NULL THEN line END, chr(10) ORDER BY w.i), '') AS text
      FROM w LEFT JOIN g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.text, '')) END AS kept_sha256, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM d LEFT JOIN k USING (doc_id)
"""
