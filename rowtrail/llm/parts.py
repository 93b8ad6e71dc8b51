"""Queries that show the columns of operators which SQL can work out, where it can't give the whole result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .media import op2_media_columns
from .secrets import op8_secret_scans
from .urls import op6_url_filters


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2 stored and read back of every text."""
    return op2_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of every url, as op6 finds them."""
    return op6_url_filters(spark, sf_dir).select("page_id", "host", "path", "rule")


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of op8."""
    return op8_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


#: crc32 is worked out bit by bit.
MEDIA_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, octet_length(b) AS n, CAST(greatest(1, ceil(octet_length(b) / 192)) * 192 AS BIGINT) AS size, hex(b) AS h FROM d),
f AS (SELECT doc_id, n, size, h || repeat('20', size - n) AS h FROM p),
t AS (SELECT *, list_prepend(4294967295, flatten(list_transform(range(16), lambda k: list_transform(range(8), lambda j: (CAST('0x' || substr(h, length(h) - 31 + 2 * k, 2) AS BIGINT) >> j) & 1)))) AS bits FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, size AS payload_bytes, sha256(unhex(h)) AS payload_sha256,
       xor(list_reduce(bits, lambda c, x: xor(c >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) AS tail_crc32
FROM t
"""

URL_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT unnest(['net/', 'example.net/en/', 'example.com/de/', 'org/fr/']) AS rule),
f AS (SELECT page_id, max_by(rule, length(rule)) AS rule FROM p, r
      WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY page_id)
SELECT page_id, host, path, rule FROM p LEFT JOIN f USING (page_id)
"""

_EITHER = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
#: Matches and what lies between them give each match's place.
SECRET_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT unnest([0, 1, 2]) AS o, unnest(['assign', 'access', 'hex']) AS kind, unnest([8, 16, 32]) AS least),
m AS (SELECT doc_id, 0 AS o, string_split_regex(t, '(?:{_EITHER})["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS gaps,
             regexp_extract_all(t, '(?:{_EITHER})["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS found,
             regexp_extract_all(t, '(?:{_EITHER})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) AS value FROM d
      UNION ALL SELECT doc_id, 1, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM d
      UNION ALL SELECT doc_id, 2, string_split_regex(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+') FROM d),
e AS (SELECT doc_id, o, unnest(range(1, len(found) + 1)) AS i, unnest(found) AS found, unnest(value) AS value, unnest(gaps[1:len(found)]) AS gap FROM m),
s AS (SELECT doc_id, o, length(found) AS n, length(value) AS v, sum(length(gap) + length(found)) OVER (PARTITION BY doc_id, o ORDER BY i) AS stop FROM e),
b AS (SELECT doc_id, o, kind, stop - n AS start, stop FROM s JOIN k USING (o) WHERE v >= least),
g AS (SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
             string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, o) AS spans FROM b GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
