"""Media columns: texts stored losslessly as 8-bit grey images in archives, read back through a Spark data source.

Writing: each task packs its rows as PNG members (192 samples a line) into one uncompressed zip archive and renames it
into place, so a repeated task replaces its own archive.  Reading: the source plans byte ranges over the archive files
from their sizes alone; a task finds the members whose headers lie in its range, reads each by its offset with retries
of its own, and streams them as Arrow batches.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import filesystem, scratch, small_batches

#: Samples a line; payloads are padded with spaces to whole lines, at least one.
LINE = 192
RANGE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
RETRIES = 3
_MAGIC = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, those bytes with spaces up to a positive multiple of the line)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data.ljust(max(1, -(-len(data) // LINE)) * LINE)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """An 8-bit grey PNG of the payload, one sample a byte; depends on the payload alone."""
    lines = np.zeros((len(payload) // LINE, LINE + 1), np.uint8)  # the first column is each line's filter, none
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, LINE)
    head = struct.pack(">IIBBBBB", LINE, len(lines), 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of ``encode_png``; raises ValueError where a checksum, the header or the size is wrong."""
    if media[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, shape, packed = 8, None, []
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if len(data) != n or media[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + data)):
            raise ValueError("broken chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            packed.append(data)
        at += 12 + n
    if shape is None or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("unexpected image kind")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("unexpected line filter")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Size, mean and deviation in thousandths, and a 64-bit difference hash over an 8 x 9 grid of means."""
    a = np.frombuffer(payload, np.uint8).reshape(-1, LINE)
    n, total, squares = a.size, int(a.sum(dtype=np.int64)), int((a.astype(np.int64) ** 2).sum())
    rows = np.linspace(0, len(a), 9).astype(int)
    columns = np.linspace(0, LINE, 10).astype(int)
    grid = [[a[min(r, len(a) - 1) : max(q, min(r, len(a) - 1) + 1), c:d].sum(dtype=np.int64) * 1000 // max(1, (max(q, min(r, len(a) - 1) + 1) - min(r, len(a) - 1)) * (d - c)) for c, d in zip(columns, columns[1:])] for r, q in zip(rows, rows[1:])]
    bits = sum(1 << (8 * i + j) for i in range(8) for j in range(8) if grid[i][j] < grid[i][j + 1])
    mean = total * 1000 // n
    deviation = int(max(0, squares / n - (total / n) ** 2) ** 0.5 * 1000)
    return f"gray8 {LINE}x{len(a)} mean={mean} sd={deviation} dhash={bits:016x}"


# ---------------------------------------------------------------- writing


def _packer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = filesystem(folder)
        part, attempt = task.partitionId(), task.taskAttemptId()
        archive, count, hidden = None, 0, f"{root}/_part-{part:06d}-{attempt}"
        try:
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                    if archive is None:
                        stream = fs.open_output_stream(hidden)
                        archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                    n, payload = payload_of(text.as_py())
                    archive.writestr(zipfile.ZipInfo(f"{'null' if doc_id is None else doc_id}.{n}.png"), encode_png(payload))
                    count += 1
        except BaseException:
            if archive is not None:
                stream.close()
                fs.delete_file(hidden)
            raise
        if archive is not None:
            archive.close()
            stream.close()
            fs.move(hidden, f"{root}/part-{part:06d}.zip")
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], names=["members"])

    return run


def write_archives(docs: DataFrame, folder: str) -> int:
    """Store every row's text as a member of an archive in ``folder`` (a URI all executors reach); the members written.

    A task writes under a hidden name and renames at its end, so readers see whole archives only and a lost or
    repeated task leaves one.  Null texts are stored as one line of spaces; null ids as ``null``.
    """
    small_batches(docs.sparkSession)
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_packer(folder), "members long").agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]


# ---------------------------------------------------------------- reading


class ByteRange(InputPartition):
    """Members whose local headers start in [start, end) of one archive."""

    def __init__(self, path: str, start: int, end: int):
        super().__init__(None)
        self.path, self.start, self.end = path, start, end


class MediaSource(DataSource):
    """``spark.read.format("media_archive").load(folder)``: a row per archive member (name, offset, media)."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "name string, offset long, media binary"

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options)


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))

    def partitions(self) -> list[ByteRange]:
        """Byte ranges from names and sizes; no archive is opened here."""
        import pyarrow.fs as pafs

        fs, root = filesystem(self.folder)
        files = [f for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.is_file and f.base_name.endswith(".zip") and f.base_name[0] not in "._"]
        ranges = [ByteRange(f.path, s, min(f.size, s + self.range_bytes)) for f in sorted(files, key=lambda f: f.path) for s in range(0, f.size, self.range_bytes)]
        return ranges or [ByteRange("", 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, _ = filesystem(self.folder)
        with fs.open_input_file(part.path) as stream:
            with zipfile.ZipFile(stream) as archive:
                members = sorted(((m.header_offset, m) for m in archive.infolist() if part.start <= m.header_offset < part.end), key=lambda x: x[0])
            names, offsets, media, held = [], [], [], 0
            for offset, member in members:
                data = self._member(fs, part.path, stream, member)
                names.append(member.filename)
                offsets.append(offset)
                media.append(data)
                held += len(data)
                if held >= BATCH_BYTES:
                    yield self._batch(names, offsets, media)
                    names, offsets, media, held = [], [], [], 0
            if names:
                yield self._batch(names, offsets, media)

    @staticmethod
    def _batch(names: list[str], offsets: list[int], media: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(media, pa.binary())], names=["name", "offset", "media"])

    @staticmethod
    def _member(fs, path: str, stream, member: zipfile.ZipInfo) -> bytes:
        """One stored member by its offset, checked by its sum; a retry opens the file anew and reads there alone."""
        for attempt in range(RETRIES + 1):
            try:
                if not attempt:
                    return read_at(stream, member)
                with fs.open_input_file(path) as again:
                    return read_at(again, member)
            except (OSError, zipfile.BadZipFile):
                if attempt == RETRIES:
                    raise
                time.sleep(0.2 * 2**attempt)
        raise AssertionError


def read_at(stream, member: zipfile.ZipInfo) -> bytes:
    """The bytes of a stored member: behind its local header, whose names may differ in length from the directory's."""
    stream.seek(member.header_offset)
    head = stream.read(30)
    if len(head) < 30 or head[:4] != b"PK\3\4" or member.compress_type != zipfile.ZIP_STORED:
        raise zipfile.BadZipFile(f"no stored member at {member.header_offset}")
    name, extra = struct.unpack("<HH", head[26:30])
    stream.seek(member.header_offset + 30 + name + extra)
    data = stream.read(member.file_size)
    if len(data) != member.file_size or zlib.crc32(data) != member.CRC:
        raise zipfile.BadZipFile(f"damaged member at {member.header_offset}")
    return data


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for name, cell in zip(batch.column("name").to_pylist(), batch.column("media")):
            media = cell.as_py()
            payload = decode_png(media)
            doc_id, n, _ = name.split(".")
            values = (None if doc_id == "null" else int(doc_id), int(n), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload))
            for column, v in zip(rows.values(), values):
                column.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)], names=list(rows))


def read_media(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The members of all archives in a folder: name, offset, media."""
    spark.dataSource.register(MediaSource)
    return spark.read.format("media_archive").option("rangeBytes", range_bytes).load(folder)


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Store every text as media, read the archives back, and describe each: see the column names.

    Equal texts have equal values.  Null and empty texts are one line of spaces with n_bytes 0; null ids come back
    null; repeated rows are stored each; extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "media")
    write_archives(docs, folder)
    return read_media(spark, folder).mapInArrow(
        _digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as media."""
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
