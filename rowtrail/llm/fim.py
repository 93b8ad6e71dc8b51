"""Fill-in-middle examples, made and undone by DuckDB over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches

#: Code points of a coarse unit: a text is a list of such pieces, and only the two pieces that a cut falls in are taken
#: apart further, so a text's lists stay about as long as the text itself.
UNIT = 64
#: Share, in hundredths, of texts that are cut, and of those that put the suffix first.
CUT, SUFFIX_FIRST = 90, 20

_MADE = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string()), ("output_sha256", pa.string())]
)
_RESTORED = pa.schema([*_MADE, ("restored", pa.string()), ("restored_sha256", pa.string())])

#: c: pieces of the text; h: hex digits of the draw; x and y: the cuts in code points; a and b: whole pieces before them;
#: u: the pieces with those at the cuts taken apart; i and j: units before each cut.
_MAKE = r"""
WITH pieces AS (
    SELECT doc_id, t, regexp_extract_all(t, '(?s).{{1,{unit}}}') AS c, sha256('{salt}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM batch)),
draws AS (
    SELECT doc_id, t, c, CASE WHEN len(c) = 0 THEN 0 ELSE {unit} * (len(c) - 1) + len(regexp_extract_all(c[len(c)], '(?s).')) END AS n,
           list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS d
    FROM pieces),
cuts AS (
    SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS x, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS y,
           CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d[3] % 100 >= {cut} THEN 'plain'
                WHEN d[4] % 100 < {first} THEN 'spm' ELSE 'psm' END AS form
    FROM draws),
places AS (SELECT *, x // {unit} AS a, y // {unit} AS b FROM cuts),
units AS (
    SELECT *, a + x % {unit} AS i, CASE WHEN a = b THEN a + y % {unit} ELSE b - 1 + {unit} + y % {unit} END AS j,
           CASE WHEN form = 'plain' THEN []
                ELSE list_slice(c, 1, a) || coalesce(regexp_extract_all(c[a + 1], '(?s).'), [])
                     || CASE WHEN a = b THEN [] ELSE list_slice(c, a + 2, b) || coalesce(regexp_extract_all(c[b + 1], '(?s).'), []) END
                     || list_slice(c, b + 2, len(c)) END AS u
    FROM places),
parts AS (
    SELECT doc_id, n, form, t, x, y, array_to_string(list_slice(u, 1, i), '') AS p, array_to_string(list_slice(u, i + 1, j), '') AS m,
           array_to_string(list_slice(u, j + 1, len(u)), '') AS s
    FROM units),
made AS (
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
           CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output
    FROM parts)
SELECT *, sha256(output) AS output_sha256 FROM made
"""

#: A mark has no border and stands in no text that was cut, so each of the three is found once.
_RESTORE = r"""
WITH split AS (SELECT *, CASE form WHEN 'psm' THEN string_split(output, '<S>') WHEN 'spm' THEN string_split(output, '<P>') END AS halves FROM batch),
parts AS (SELECT *, list_slice(halves, 1, 1) AS f, string_split(halves[2], '<M>') AS g FROM split),
back AS (
    SELECT * EXCLUDE (halves, f, g),
           CASE form WHEN 'plain' THEN output WHEN 'psm' THEN array_to_string([substr(f[1], 4), g[2], g[1]], '') ELSE array_to_string([g[1], g[2], substr(f[1], 4)], '') END AS restored
    FROM parts)
SELECT *, sha256(restored) AS restored_sha256 FROM back
"""


def _runner(sql: str, column: str, schema: pa.Schema):
    """A function for mapInArrow that runs ``sql`` over each batch as the table ``batch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1}) as db:
            for batch in batches:
                for part, _, _ in slices(batch, column):
                    db.register("batch", pa.Table.from_batches([part]))
                    found = db.sql(sql).to_arrow_table()
                    db.unregister("batch")
                    yield from found.select(schema.names).cast(schema).to_batches()

    return run


def fill_in_middle(docs: DataFrame, salt: str = "1:", cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, output_sha256): each text cut in three and put in a new order.

    The cuts and the form are drawn from sha256 of ``salt`` and the decimal doc_id (nothing, where it is null), so they
    depend on no partition.  Null counts as empty; empty texts and those with one of the marks ``<P> <S> <M>`` stay plain.
    Repeated rows come out each, alike where their ids are; extra columns are ignored; an empty table gives an empty
    result.  Memory is a small multiple of 1 MB of texts, or of the longest text.
    """
    small_batches(docs.sparkSession)
    sql = _MAKE.format(unit=UNIT, salt=salt.replace("'", "''"), cut=int(cut), first=int(suffix_first))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_runner(sql, "text", _MADE), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string")


def restore(made: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with ``restored``, rebuilt from output and form alone, and its sha256."""
    small_batches(made.sparkSession)
    rows = made.select(*_MADE.names)
    return rows.mapInArrow(
        _runner(_RESTORE, "output", _RESTORED), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored string, restored_sha256 string"
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's example, by its digests, and the digest of the text rebuilt from it."""
    return restore(fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("output", "restored")


#: The same in plain SQL, by substrings.
OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT doc_id, t, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS c2,
             CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS r3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS r4 FROM d),
f AS (SELECT *, least(c1, c2) AS x, greatest(c1, c2) AS y,
             CASE WHEN n = 0 OR t LIKE '%<P>%' OR t LIKE '%<S>%' OR t LIKE '%<M>%' OR r3 >= 90 THEN 'plain' WHEN r4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(x AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(y - x AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || t[1:x] || '<S>' || t[y + 1:] || '<M>' || t[x + 1:y]
                        ELSE '<S>' || t[y + 1:] || '<P>' || t[1:x] || '<M>' || t[x + 1:y] END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""
