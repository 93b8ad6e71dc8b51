"""Shared pieces of the corpus operators: scratch tables, side tables by block of rows, and byte-level batch tools.

Executors share no local disk.  Whatever one stage leaves for another lies in the folder named by
``spark.checkpoint.dir`` and is written by Spark itself, so a lost executor costs only its running tasks.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into numpy arrays at a time; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Rows that Spark packs into an Arrow batch for the operators here, whose rows may be long texts.
ARROW_ROWS = 500


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder; on a cluster, whose machines share no such folder,
    it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="rowtrail-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a scratch table and read it back: the lineage ends there."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Texts are long rows: keep Arrow batches small unless the session asks for smaller ones already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def spread(spark: SparkSession) -> int:
    """The session's shuffle parallelism, for exchanges that name a number of partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_join(rows: DataFrame, keyed: DataFrame, by: list[str], many: str) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row a key and, as ``many``, how many of ``rows`` hold it.

    A key of more than a ten-thousandth of all rows would load one task, so such keys, 10,000 at most by that bound,
    are broadcast and their rows stay where they are; the others are shuffled.  Both inputs must be written tables.
    """
    limit = rows.count() // 10_000
    hot = keyed.where(F.col(many) > limit)
    few = F.broadcast(hot)
    rest = rows.join(F.broadcast(hot.select(*by)), by, "left_anti").join(keyed.where(F.col(many) <= limit), by)
    return rows.join(few, by).unionByName(rest)


# ---------------------------------------------------------------- side tables by block of rows


#: Rows of a file that form a block.  A block is the same whatever splits a scan cuts the file into.
BLOCK_ROWS = 8192


def scanned(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` as a plain Parquet scan, whose rows have a fixed place in a file: itself where it is one (with
    projections and filters), else written first."""
    plan = docs._jdf.queryExecution()
    nodes = re.findall(r"^[\s:+*()\d-]*(\w+ ?\w*)", plan.executedPlan().toString(), re.M)
    plain = all(n.split()[0] in ("Project", "Filter", "ColumnarToRow") or n == "FileScan parquet" for n in nodes)
    return docs if plain and nodes.count("FileScan parquet") == 1 and plan.analyzed().deterministic() else written(docs, name)


def placed(docs: DataFrame) -> DataFrame:
    """``scanned`` rows with ``block``, a hash of file and block of rows, and ``ord``, the row's number in the block.

    Both come from the row's place in its file, so they are the same in every scan, however it is split.
    """
    at = F.col("_metadata.row_index")
    block = F.xxhash64(F.col("_metadata.file_path"), F.floor(at / BLOCK_ROWS))
    return docs.select("*", block.alias("block"), (at % BLOCK_ROWS).cast("int").alias("ord"))


def filesystem(uri: str):
    """(file system, path) of a folder as Spark names it; what pyarrow doesn't know by that name goes by Hadoop's client."""
    import pyarrow.fs as pafs

    scheme = uri.split("://")[0]
    if scheme in ("s3a", "s3n"):
        uri = "s3" + uri[len(scheme) :]
    try:
        return pafs.FileSystem.from_uri(uri)
    except pa.ArrowInvalid:
        host = uri.split("/", 3)
        return pafs.HadoopFileSystem("/".join(host[:3])), "/" + host[3]


class SideTable:
    """Rows keyed by block, written once and read by whichever task scans that block.

    It stands in for a join that would shuffle the texts: the small side travels to the blocks instead.  Many blocks
    share a bucket folder; within it they are sorted, in small row groups, so a task reads little besides its block.
    A table that isn't there, or isn't whole, is an error in the task, never an empty answer.
    """

    def __init__(self, rows: DataFrame, name: str, order: list[str] | None = None):
        spark = rows.sparkSession
        self.path = scratch(spark, name)
        self.buckets = 4 * spread(spark)
        self.columns = [c for c in rows.columns if c != "block"]
        self.whole = False
        (
            rows.withColumn("bucket", F.pmod("block", F.lit(self.buckets)).cast("int"))
            .repartition(spread(spark), "bucket")
            .sortWithinPartitions("bucket", "block", *(order or []))
            .write.partitionBy("bucket")
            .option("compression", "zstd")
            .option("parquet.block.size", 2 << 20)
            .parquet(self.path)
        )

    def load(self, block: int) -> pa.Table | None:
        """The rows of one block, in a task; None where there are none."""
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        fs, root = filesystem(self.path)
        if not self.whole:
            if fs.get_file_info(f"{root}/_SUCCESS").type == pafs.FileType.NotFound:
                raise FileNotFoundError(f"no whole side table at {self.path}: is spark.checkpoint.dir shared by all machines?")
            self.whole = True
        found = fs.get_file_info(pafs.FileSelector(f"{root}/bucket={block % self.buckets}", allow_not_found=True))
        parts = []
        for f in sorted((x for x in found if x.path.endswith(".parquet")), key=lambda x: x.path):
            with fs.open_input_file(f.path) as stream:
                file = pq.ParquetFile(stream)
                at = file.schema_arrow.get_field_index("block")
                for g in range(file.num_row_groups):
                    held = file.metadata.row_group(g).column(at).statistics
                    if held is None or not held.has_min_max or held.min <= block <= held.max:
                        t = file.read_row_group(g)
                        parts.append(t.filter(pc.equal(t.column("block"), block)).select(self.columns))
        parts = [p for p in parts if p.num_rows]
        return pa.concat_tables(parts) if parts else None


def by_block(batch: pa.RecordBatch, column: str = "block") -> Iterator[pa.RecordBatch]:
    """Runs of rows of one block (a task may scan several, one after the other)."""
    b = np.asarray(batch.column(column))
    cuts = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
    for i, j in zip(cuts, cuts[1:]):
        if j > i:
            yield batch.slice(i, j - i)


# ---------------------------------------------------------------- texts as bytes


def lower_table() -> np.ndarray:
    """Byte values with A-Z lower-cased."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_table()
#: White space as the contracts give it: 0x20 and 0x09-0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array laid end to end, and the n+1 offsets.  Nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, off, data = texts.buffers()
    if off is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(off, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch whose texts together stay within ``limit`` bytes (or are one text), with their bytes."""
    raw, off = buffers(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield batch.slice(i, j - i), raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and odd multipliers), in place of raw polynomial values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: The prime of the polynomial hashes and two bases, drawn once; two different strings of n bytes have equal values
#: under at most n of all bases, so a pair is taken for equal with a chance of n / 2^61 in one lane, its square in two.
PRIME = (1 << 61) - 1
BASES = (0x1A6B5C3D7E8F9021, 0x0C3F7A915D2B6E47)
_P, _M31, _M30 = np.uint64(PRIME), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_31, _30, _61, _1 = np.uint64(31), np.uint64(30), np.uint64(61), np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Values worked on at a time, so that what lies between stays in the cache; so many products of 39 bits stay under 2^64.
_AT_ONCE = 1 << 14


def _reduced(x: np.ndarray) -> np.ndarray:
    """Under the prime; what is too small wraps round and loses the comparison."""
    x = (x & _P) + (x >> _61)
    return np.minimum(x, x - _P)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a1, a0, b1, b0 = a >> _31, a & _M31, b >> _31, b & _M31
    mid = a1 * b0
    mid += a0 * b1
    a1 *= b1
    a1 <<= _1
    a0 *= b0
    a1 += a0
    a1 += mid >> _30
    mid &= _M30
    mid <<= _31
    a1 += mid
    return _reduced(a1)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, for values under it: halves of 31 bits, of which no sum of products passes 2^64."""
    out = np.empty(len(a), np.uint64)
    for i in range(0, len(a), _AT_ONCE):
        out[i : i + _AT_ONCE] = _times(a[i : i + _AT_ONCE], b if b.ndim == 0 else b[i : i + _AT_ONCE])
    return out


def powers(n: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo the prime for i < n; kept for the next call of a task."""
    if lane not in _POWERS or len(_POWERS[lane][0]) < n:
        size = max(n, (SLICE_BYTES >> 1) + 1)
        both = []
        for base in (BASES[lane], pow(BASES[lane], -1, PRIME)):
            p, k = np.ones(size, np.uint64), 1
            while k < size:
                p[k : 2 * k] = times(p[: min(k, size - k)], np.array(pow(base, k, PRIME), np.uint64))
                k *= 2
            both.append(p)
        _POWERS[lane] = (both[0], both[1])
    up, down = _POWERS[lane]
    return up[:n], down[:n]


def prefix_hashes(raw: np.ndarray, lane: int = 0) -> np.ndarray:
    """S[i] = sum of (byte j + 1) * B^j for j < i, modulo the prime: any substring's hash is one difference away.

    Of a matrix, each row's.
    """
    n = raw.shape[-1]
    up, _ = powers(n + 1, lane)
    s = np.zeros((*raw.shape[:-1], n + 1), np.uint64)
    for a in range(0, n, _AT_ONCE):
        part, u = raw[..., a : a + _AT_ONCE].astype(np.uint64) + _1, up[a : min(n, a + _AT_ONCE)]
        high = _reduced(np.cumsum(part * (u >> _31), axis=-1, dtype=np.uint64))
        low = np.cumsum(part * (u & _M31), axis=-1, dtype=np.uint64)
        high = ((high & _M30) << _31) + (high >> _30)  # times 2^31
        s[..., a + 1 : a + 1 + part.shape[-1]] = _reduced(high + _reduced(low) + s[..., a : a + 1])
    return s


def span_hashes(s: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hashes of the byte spans [start, end), independent of where they lie."""
    _, down = powers(len(s), lane)
    out = np.empty(len(start), np.uint64)
    for i in range(0, len(start), _AT_ONCE):
        x, y = start[i : i + _AT_ONCE], end[i : i + _AT_ONCE]
        d = s[y] + (_P - s[x])
        out[i : i + _AT_ONCE] = mix(_times(np.minimum(d, d - _P), down[x]))
    return out


def word_spans(raw: np.ndarray, off: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts laid end to end (a text's border ends a word), and each text's first word."""
    n = len(raw)
    word = ~space[raw]
    first, last = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    first[0], last[0] = True, True
    first[1:n] = ~word[:-1] if n else False
    edges = off[(off >= 0) & (off < n)]
    first[edges] = True
    starts = np.flatnonzero(word & first[:n])
    last[1 : n + 1] = True
    last[1:n] = ~word[1:] if n else False
    last[off[1:]] = True
    ends = np.flatnonzero(word & last[1 : n + 1]) + 1
    return starts, ends, np.searchsorted(starts, off)
