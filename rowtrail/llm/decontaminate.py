"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows, one pass over the texts.

The automaton holds every fifth run of five words of an item: any ten consecutive words contain one whole.  Around a hit
the windows that hold it are looked up by a hash of their words among the benchmark's windows and compared word by word,
so a hit costs the same however often its words stand in an item.  That takes a tenth of the states of all windows.  The
automaton reads numbers of words, not their letters: each word of the benchmark is two or three digits, the first of an
alphabet of its own, so that a match begins with a word; other words match nothing.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, small_batches, written

#: Words of a text before A-Z is lower-cased, and the byte map that turns everything else into a space.
ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TO_WORDS = bytes(ord(chr(b).lower()) if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
WINDOW = 10
#: Words of a seed; a window holds one that begins at a multiple of so many words in its item.
SEED = WINDOW // 2
#: Words of the benchmark in one automaton, some 200 bytes each; a larger benchmark is scanned for in several passes.
WORDS = 1_000_000
#: Digits of a word's number.
BASE = 64
SCHEMA = "doc_id long, row long, n_words long, hits array<struct<start:int,end:int>>, items array<string>, spans array<struct<start:int,end:int>>"


def normalise(text: str | None) -> list[bytes]:
    """The words of a text: A-Z lower-cased, runs of digits, letters and non-ASCII characters.  Null has none."""
    return text.encode("utf-8", "surrogatepass").translate(TO_WORDS).split() if text else []


class Windows:
    """The automaton over the items' seeds, and the distinct windows by hash with the items that hold them."""

    def __init__(self, items: list[tuple[str | None, str]]):
        import ahocorasick

        self.names = [i for i, _ in items]
        number: dict[bytes, int] = {}
        texts = [[number.setdefault(w, len(number)) for w in normalise(t)] for _, t in items]
        self.digits = 2 if len(number) <= BASE**2 else 3 if len(number) <= BASE**3 else 5
        codes = [self._code(i) for i in range(len(number))]
        self.number, self.code = number, {w: codes[i] for w, i in number.items()}
        self.other = "\x01" * self.digits
        self.lengths = np.array([min(WINDOW, len(t)) for t in texts], np.int64)
        seeds: dict[str, list[bool]] = {}  # is it part of longer windows, is it a whole item
        for words, whole in zip(texts, self.lengths.tolist()):
            n = SEED if whole == WINDOW else whole  # a short item is its own seed
            for at in range(0, len(words) - n + 1, n) if n else ():
                seeds.setdefault("".join([codes[w] for w in words[at : at + n]]), [False, False])[whole < WINDOW] = True
        self._index(texts)
        self.found = ahocorasick.Automaton() if seeds else None
        for seed, (part, short) in seeds.items():
            self.found.add_word(seed, (len(seed) // self.digits, part, short))
        if seeds:
            self.found.make_automaton()

    def _code(self, i: int) -> str:
        low = [chr(32 + i // BASE**k % BASE) for k in range(self.digits - 1)]
        return chr(128 + i // BASE ** (self.digits - 1)) + "".join(low)

    @staticmethod
    def _hash(words: np.ndarray, salt: int) -> np.ndarray:
        """One number a row of word numbers (-1 beyond a short one's end)."""
        h = np.full(len(words), salt, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(words.shape[1]):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[:, k].astype(np.uint64))
        return h

    @staticmethod
    def _rows(flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        place = np.arange(WINDOW)
        inside = place < n[:, None]
        return np.where(inside, flat[np.where(inside, at[:, None] + place, 0)], -1)

    def _index(self, texts: list[list[int]]) -> None:
        """Distinct windows: hashes in order, a place of each in the items laid end to end, and the items of each."""
        self.flat = np.array([w for t in texts for w in t] or [0], np.int64)
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        many = np.where(self.lengths > 0, np.diff(first) - self.lengths + 1, 0) if len(texts) else np.zeros(0, np.int64)
        item = np.repeat(np.arange(len(texts)), many)
        at = np.repeat(first[:-1], many) + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
        n = self.lengths[item]
        rows = self._rows(self.flat, at, n)
        for salt in range(1, 100):  # two windows of one hash: take another salt
            h = self._hash(rows, salt)
            order = np.lexsort((item, h))
            new = np.ones(len(h), bool)
            new[1:] = h[order][1:] != h[order][:-1]
            lead = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
            if (rows[lead] == rows[order]).all():
                break
        self.salt, heads = salt, np.flatnonzero(new)
        self.hashes, self.place, self.size = h[order][heads], at[order][heads], n[order][heads]
        again = np.zeros(len(h), bool)
        again[1:] = ~new[1:] & (item[order][1:] == item[order][:-1])
        self.items = item[order][~again]
        self.bounds = np.concatenate([[0], np.cumsum(~again)])[np.append(heads, len(h))]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str | None]]:
        """(words, merged hit ranges in words, items) of a text in one pass."""
        words = normalise(text)
        starts: list[int] = []
        sizes: list[int] = []
        if words and self.found is not None:
            code, other = self.code.get, self.other
            last = -1
            for end, (n, part, short) in self.found.iter("".join([code(w, other) for w in words])):
                stop = end // self.digits + 1
                if part:  # of a window the seed begins in one of the first places
                    low, high = max(stop - WINDOW, last + 1, 0), min(stop - n, len(words) - WINDOW)
                    starts.extend(range(low, high + 1))
                    sizes.extend([WINDOW] * (high + 1 - low))
                    last = max(last, high)
                if short:
                    starts.append(stop - n)
                    sizes.append(n)
        if not starts:
            return len(words), [], []
        number = self.number.get
        ids = np.array([number(w, -2) for w in words], np.int64)
        at, n = np.array(starts, np.int64), np.array(sizes, np.int64)
        rows = self._rows(ids, at, n)
        known = (rows != -2).all(axis=1)
        at, n, rows = at[known], n[known], rows[known]
        h = self._hash(rows, self.salt)
        k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = (self.hashes[k] == h) & (self._rows(self.flat, self.place[k], self.size[k]) == rows).all(axis=1)
        at, n, k = at[hit], n[hit], np.unique(k[hit])
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.subtract.at(edge, at + n, 1)
        inside = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
        turns = np.flatnonzero(inside[1:] != inside[:-1]).tolist()
        names = {self.names[i] for j in k.tolist() for i in self.items[self.bounds[j] : self.bounds[j + 1]].tolist()}
        return len(words), list(zip(turns[::2], turns[1::2])), sorted(names, key=lambda x: (x is None, x))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching [start, end) joined."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def original_spans(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Hit word ranges as code-point ranges of the text as it was."""
    at = [m.span() for m in ORIGINAL_WORD.finditer(text)]
    return [(at[s][0], at[e - 1][1]) for s, e in hits]


_BUILT: dict[str, Windows] = {}


class Shared:
    """A block of items on every executor; a worker builds its automaton once, and forgets that of the block before."""

    def __init__(self, spark: SparkSession, items: list[tuple[str | None, str]]):
        self.name, self.items = uuid.uuid4().hex, spark.sparkContext.broadcast(items)

    def get(self) -> Windows:
        if self.name not in _BUILT:
            _BUILT.clear()
            _BUILT[self.name] = Windows(self.items.value)
        return _BUILT[self.name]


def _scanner(block: Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = block.get()
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("hits", span), ("items", pa.list_(pa.string())), ("spans", span)])
        as_struct = lambda spans: [{"start": s, "end": e} for s, e in spans]
        for batch in batches:
            counts, hits, names, spans = [], [], [], []
            for text in batch.column("text"):
                t = text.as_py()
                n, found, ids = windows.scan(t)
                counts.append(n)
                hits.append(as_struct(found))
                names.append(ids)
                spans.append(as_struct(original_spans(t, found)) if found else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(counts, pa.int64()), pa.array(hits, span), pa.array(names, pa.list_(pa.string())), pa.array(spans, span)], schema=schema
            )

    return run


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = {n: batch.column(n) for n in batch.schema.names}
        for name in ("hits", "spans"):
            joined = [[{"start": s, "end": e} for s, e in merge([(x["start"], x["end"]) for x in row or []])] for row in cols[name].to_pylist()]
            cols[name] = pa.array(joined, cols[name].type)
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def item_blocks(benchmark: DataFrame, id_column: str, text_column: str, words: int) -> Iterator[Shared]:
    """The benchmark in blocks of bounded size, one at a time on the driver; the usual benchmark is one block."""
    items = benchmark.select(F.col(id_column).cast("string").alias("item"), F.col(text_column).cast("string").alias("text")).where("text is not null")
    block, held = [], 0
    for row in items.toLocalIterator():
        block.append((row.item, row.text))
        held += len(normalise(row.text))
        if held >= words:
            yield Shared(benchmark.sparkSession, block)
            block, held = [], 0
    yield Shared(benchmark.sparkSession, block)


def find_contamination(docs: DataFrame, benchmark: DataFrame, item_column: str = "item_id", words: int = WORDS) -> DataFrame:
    """Benchmark windows in every text: doc_id, n_words, n_hit, n_items, items, spans (code points of the original).

    A window is ``WINDOW`` consecutive item words, or the whole of a shorter item.  A word inside any occurrence is
    hit.  Null and empty texts have no words; items without words match nothing; items with a null id count as one item
    without a name; items that share a window are all reported; repeated documents are judged each; extra columns are
    ignored.  The texts are scanned once per automaton of ``words`` benchmark words, and nothing of them is shuffled unless there are
    several.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    blocks = list(item_blocks(benchmark, item_column, "text", words))
    if len(blocks) > 1:  # every pass must see the same numbers
        rows = written(rows, "numbered")
    passes = [rows.mapInArrow(_scanner(block), SCHEMA) for block in blocks]
    found = passes[0]
    if len(passes) > 1:
        for p in passes[1:]:
            found = found.unionByName(p)
        found = found.groupBy("doc_id", "row", "n_words").agg(
            F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans")
        )
        found = found.mapInArrow(_merge_batches, found.schema)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["start"]).cast("long"))
    return found.select("doc_id", "row", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans")


def _clean(block: Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = block.get()
        for batch in batches:
            yield batch.filter(pa.array([not windows.scan(t.as_py())[1] for t in batch.column("text")], pa.bool_()))

    return run


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without any benchmark window, with their columns as they came."""
    small_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    for block in item_blocks(benchmark, "item_id", "text", WORDS):
        docs = docs.mapInArrow(_clean(block), docs.schema)
    return docs


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document."""
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The same over whole tables in plain SQL: windows joined by their words.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
       FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
