"""Periodic runs of words: branching tandem repeats from a suffix tree's smaller halves, merged into maximal runs.

A text's words are the letters.  The suffix tree is kept as the suffix order with its common prefixes: an inner node is
an interval of that order, its children lie on both sides of a place where the common prefix is shortest.  At each such
place only the leaves of the smaller side are looked at (Stoye and Gusfield), so a text of n words costs n log n.  Two
suffixes q apart that part after exactly q words are a tandem repeat that can't be moved to the right; moved to the left
as far as it goes it is a whole run, and each run holds exactly one such repeat of its period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches, word_spans

#: Least words of a run; a run also holds its period twice.
LEAST = 12
#: Leaves looked at together.
_AT_ONCE = 1 << 20
RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def suffix_order(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, rank, common prefix of each suffix with the one before it) by prefix doubling.

    The last name must be unique, and a name that ends a text too: then no common prefix leaves its text.  A level names
    the blocks of 2^k words by their first place in the order, exactly; only blocks that are not yet alone are sorted on.
    """
    n = len(names)
    order = np.argsort(names)
    at = np.arange(n, dtype=np.int32)
    new = np.ones(n, bool)
    new[1:] = names[order[1:]] != names[order[:-1]]
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    levels, h = [rank], 1
    alone = new & np.append(new[1:], True)
    left = order[~alone]
    while len(left):
        key = rank[left].astype(np.int64) * n + rank[left + h]
        sort = np.argsort(key)
        left, key = left[sort], key[sort]
        m = np.arange(len(left), dtype=np.int32)
        group, new = np.ones(len(left), bool), np.ones(len(left), bool)
        group[1:] = rank[left[1:]] != rank[left[:-1]]
        new[1:] = key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(new, m, 0))
        more = first - np.maximum.accumulate(np.where(group, m, 0))
        rank = rank.copy()
        rank[left] += more
        levels.append(rank)
        left = left[~(new & np.append(new[1:], True))]
        h *= 2
    order = np.empty(n, np.int32)
    order[rank] = at
    common = np.zeros(n, np.int32)
    pair = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b, c = order[pair - 1], order[pair], np.zeros(len(pair), np.int32)
    for k in range(len(levels) - 1, -1, -1):
        c[levels[k][a + c] == levels[k][b + c]] += 1 << k
    common[pair] = c
    return order, rank, common


def _nodes(common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, low, high) of every place with a common prefix: its node's leaves are [low, place) and [place, high).

    Of several places with the same depth in a node the first is taken for the parent, so any two leaves part at one.
    """
    n = len(common)
    near = common > 0
    use = near.copy()
    use[:-1] |= near[1:]
    use[1:] |= near[:-1]
    places = np.flatnonzero(use)
    low, high = [0] * len(places), [n] * len(places)
    open_at, open_depth, open_k = [0], [-1], [0]
    for k, (p, d) in enumerate(zip(places.tolist(), common[places].tolist())):
        while open_depth[-1] > d:
            open_depth.pop()
            open_at.pop()
            high[open_k.pop()] = p
        low[k] = open_at[-1]
        open_at.append(p)
        open_depth.append(d)
        open_k.append(k)
    inner = near[places]
    return places[inner], np.array(low, np.int64)[inner], np.array(high, np.int64)[inner]


def branching_repeats(order: np.ndarray, rank: np.ndarray, common: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, period) of all branching tandem repeats, in parts: the leaves of each node's smaller side are held against
    the other side, one period to the right and one to the left."""
    place, low, high = _nodes(common)
    depth = common[place]
    size = np.minimum(place - low, high - place)
    begin = np.where(place - low <= high - place, low, place)
    other_low, other_high = np.where(begin == low, place, low), np.where(begin == low, high, place)
    total = np.concatenate([[0], np.cumsum(size)])
    i = 0
    while i < len(place):
        j = max(i + 1, int(np.searchsorted(total, total[i] + _AT_ONCE, side="right")) - 1)
        node = np.repeat(np.arange(i, j), size[i:j])
        leaf = order[begin[node] + np.arange(total[i], total[j]) - total[node]].astype(np.int64)
        d = depth[node].astype(np.int64)
        to, of = other_low[node], other_high[node]
        r = rank[leaf + d]
        right = np.flatnonzero((r >= to) & (r < of))
        r = rank[np.maximum(leaf - d, 0)]
        left = np.flatnonzero((r >= to) & (r < of) & (leaf >= d))
        yield np.concatenate([leaf[right], leaf[left] - d[left]]), np.concatenate([d[right], d[left]])
        i = j


def _moved_left(names: np.ndarray, start: int, period: int) -> int:
    """Where the run of a repeat begins: as far left as words a period apart are alike, in steps that double."""
    step = 16
    while start > 0:
        a = max(0, start - step)
        differ = np.flatnonzero(names[a:start] != names[a + period : start + period])
        if len(differ):
            return a + int(differ[-1]) + 1
        start, step = a, step * 2
    return 0


def maximal_runs(names: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period), by start and period, of all maximal runs of ``least`` words or more.

    ``names`` holds one number a word, and a unique one after each text.  Of the repeats that end at one word those whose
    half is a power of a shorter one belong to the shorter one's run and are left out, so periods are the smallest.
    """
    if len(names) < least:
        return np.zeros((0, 3), np.int64)
    found = list(branching_repeats(*suffix_order(names)))
    start, period = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    for t in range(1, least - 1):  # repeats shorter than a run must go on to the left
        short = 2 * period + t <= least
        at = start - t
        keep = ~short | ((at >= 0) & (names[np.maximum(at, 0)] == names[np.maximum(at, 0) + period]))
        start, period = start[keep], period[keep]
    sort = np.lexsort((period, start + 2 * period))
    runs, last, here = [], -1, []
    for s, q in zip(start[sort].tolist(), period[sort].tolist()):
        end = s + 2 * q
        if end != last:
            last, here = end, []
        if any(q % p == 0 and end - b >= 2 * q for b, p in here):
            continue
        b = _moved_left(names, s, q)
        here.append((b, q))
        runs.append((b, end - b, q))
    out = np.array(runs, np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _words(raw: np.ndarray, off: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of texts laid end to end, and each text's first word and their number."""
    starts, ends, first = word_spans(raw, off)
    inside = np.zeros(len(raw) + 1, np.int32)
    inside[starts] += 1
    np.subtract.at(inside, ends, 1)
    letters = raw[np.cumsum(inside)[: len(raw)] > 0]
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(letters)])
    return words.dictionary_encode(), first


def _runs_of(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, off in slices(batch, "text"):
                words, first = _words(raw, off)
                n, texts = len(words), part.num_rows
                ids = np.asarray(words.indices).astype(np.int64)
                text = np.repeat(np.arange(texts), np.diff(first))
                width = len(words.dictionary) + 1
                names = np.empty(n + texts, np.int64)
                names[np.arange(n) + text] = text * width + ids
                names[first[1:] + np.arange(texts)] = np.arange(texts) * width + width - 1
                runs = maximal_runs(names, least)
                of = np.searchsorted(first[1:] + np.arange(texts), runs[:, 0])
                fields = [pa.array(runs[:, 0] - first[of] - of), pa.array(runs[:, 1]), pa.array(runs[:, 2])]
                found = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(texts + 1)), pa.int32()), pa.StructArray.from_arrays(fields, fields=list(RUN.value_type)))
                again = np.zeros(n + texts + 1, np.int64)
                np.add.at(again, runs[:, 0] + runs[:, 2], 1)
                np.subtract.at(again, runs[:, 0] + runs[:, 1], 1)
                kept = np.cumsum(again)[np.arange(n) + text] == 0
                bounds = pa.array(np.concatenate([[0], np.cumsum(kept)])[first], pa.int64())
                lists = pa.LargeListArray.from_arrays(bounds, words.dictionary.take(pa.array(ids[kept])))
                joined = pc.binary_join(lists, pa.scalar(b" ", pa.large_binary())).cast(pa.large_string()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first), pa.int64()), found, joined], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the maximal periodic runs of each whole text, and the text without them.

    A run is (start, length, period) in words, numbered from 0: a longest stretch in which words a period apart are the
    same, with its smallest period, of ``least`` words and two periods or more.  ``collapsed`` holds the words outside
    runs and each run's first period, joined by one space.  Words are stretches without white space (0x20, 0x09-0x0D).

    A text lies in one task and costs about n log n; memory follows 1 MB of texts or the longest text (about 4 bytes a
    word and doubling level).  Null and empty texts have no runs and collapse to ""; a null id stays null; repeated rows
    come out each; of runs that overlap all are listed; extra columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_runs_of(least), "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def _planted() -> Column:
    """The text that the query looks at: in a tenth of the documents, by a hash of the id, the end repeats a stretch."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    n = F.size(words)
    a = F.pmod(g, n).cast("int")
    p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    text = F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")
    return F.when((h % 10 == 0) & (F.coalesce(F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), F.lit("")) != ""), text).otherwise(F.col("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs, by digests, and its longest one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", _planted().alias("text"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    found = find_runs(docs).withColumn("longest", longest)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: The same in plain SQL: equal runs of six words a distance apart, joined to islands.  crc32 is worked out bit by bit.
OP11_SQL = r"""
WITH bits AS (
    SELECT doc_id, text, list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
           lambda c: list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda k: CAST((ascii(c) >> k) & 1 AS BIGINT))))) AS b FROM documents),
crc AS (
    SELECT doc_id, text, xor(list_reduce(b, lambda c, x: xor(c >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) AS h FROM bits),
w AS (
    SELECT doc_id, coalesce(h, 1) AS h, coalesce(h, 1) // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM crc),
c AS (SELECT row_number() OVER () AS row, *, len(w) AS n, CASE WHEN len(w) > 0 THEN g % len(w) END AS a FROM w),
m AS (
    SELECT row, doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE w END AS w, n
    FROM c),
six AS (SELECT row, i, array_to_string(w[i + 1:i + 6], ' ') AS t FROM (SELECT row, w, unnest(range(n - 5)) AS i FROM m WHERE n >= 6)),
lists AS (SELECT row, list(i ORDER BY i) AS js FROM six GROUP BY row, t HAVING count(*) > 1),
pair AS (SELECT row, i, unnest(js) - i AS q FROM (SELECT row, js, unnest(js) AS i FROM lists)),
isle AS (SELECT row, q, min(i) AS s, count(*) + 5 + q AS len
         FROM (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS k FROM pair WHERE q > 0) GROUP BY row, q, k),
run AS (SELECT row, s, len, min(q) AS q FROM isle WHERE len >= 12 AND len >= 2 * q GROUP BY row, s, len),
per AS (SELECT row, count(*) AS n_runs, max(struct_pack(l := len, s := -s, q := -q)) AS top, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM run GROUP BY row),
gone AS (SELECT DISTINCT row, unnest(range(s + q, s + len)) AS i FROM run),
kept AS (SELECT row, string_agg(x, ' ' ORDER BY i) AS t
         FROM (SELECT row, unnest(w) AS x, unnest(range(n)) AS i FROM m WHERE row IN (SELECT row FROM run)) ANTI JOIN gone USING (row, i) GROUP BY row)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(-top.s AS BIGINT) AS start, CAST(top.l AS BIGINT) AS length, CAST(-top.q AS BIGINT) AS period,
       CAST(1000 * top.l // -top.q AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(t, array_to_string(w, ' '))) AS collapsed_sha256
FROM m LEFT JOIN per USING (row) LEFT JOIN kept USING (row)
"""
