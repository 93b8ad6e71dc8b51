"""A Spark data source over folders of EDF and WFDB recordings: a long file is several tasks.

Partitions are ranges of a file's bytes, planned from the listing alone; a task reads the header and the records (or
frames) that begin in its range, so any size of range gives the same samples, and a lost task reads only its own again.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import recordings

#: Bytes of a file that a task reads unless told otherwise.
RANGE_BYTES = 8 << 20
SCHEMA = "path string, signal int, channel string, rate double, start long, samples array<double>"
#: Fixed value: the label of an EDF+ signal that holds annotations, not samples.
ANNOTATIONS = "EDF Annotations"


def filesystem(uri: str):
    """(file system, path) of a folder as Spark names it; what pyarrow doesn't know by that name goes by Hadoop's client."""
    import pyarrow.fs as pafs

    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    scheme = uri.split("://")[0]
    if scheme in ("s3a", "s3n"):
        uri = "s3" + uri[len(scheme) :]
    try:
        return pafs.FileSystem.from_uri(uri)
    except pa.ArrowInvalid:
        host = uri.split("/", 3)
        return pafs.HadoopFileSystem("/".join(host[:3])), "/" + host[3]


@dataclass
class Range(InputPartition):
    """The bytes [begin, end) of a file's data; ``header`` names the header file of a WFDB record."""

    path: str
    begin: int
    end: int
    header: str = ""


def _within(begin: int, end: int, first: int, width: int, size: int) -> tuple[int, int]:
    """Whole records (of ``width`` bytes, from ``first`` on) that begin in a range of bytes."""
    number = lambda at: max(0, -(-(at - first) // width))
    whole = max(0, (size - first) // width)
    return min(number(begin), whole), min(number(end), whole)


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("rangeBytes", RANGE_BYTES))
        if self.step < 1:
            raise ValueError("rangeBytes must be 1 or more")

    def partitions(self) -> list[Range]:
        import pyarrow.fs as pafs

        fs, root = filesystem(self.path)
        found = {f.path: f.size for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File}
        out = []
        for path in sorted(found):
            stem, end = posixpath.splitext(path)
            if end.lower() in (".edf", ".rec"):
                data, header = path, ""
            elif end == ".hea" and f"{stem}.dat" in found:
                data, header = f"{stem}.dat", path
            else:
                continue
            out += [Range(data, a, min(found[data], a + self.step), header) for a in range(0, found[data], self.step)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.path:
            fs, _ = filesystem(self.path)
            yield from (self._wfdb if partition.header else self._edf)(fs, partition)

    @staticmethod
    def _edf(fs, p: Range) -> Iterator[tuple]:
        with fs.open_input_file(p.path) as f:
            size = f.size()
            start = f.read_at(256, 0)
            if len(start) < 256:
                raise ValueError(f"{p.path}: no whole header")
            h = recordings.edf_header(f.read_at(256 * (int(start[252:256]) + 1), 0))
            sizes = [s["samples"] for s in h["signals"]]
            width = sum(sizes)
            first, last = _within(p.begin, p.end, h["header_bytes"], 2 * width, size)
            if last <= first:
                return
            body = np.frombuffer(f.read_at(2 * width * (last - first), h["header_bytes"] + 2 * width * first), "<i2").reshape(-1, width)
        at = 0
        for i, s in enumerate(h["signals"]):
            if s["label"] != ANNOTATIONS and s["samples"]:
                x = recordings.edf_scaled(body[:, at : at + s["samples"]].ravel(), s)
                yield p.path, i, s["label"], s["samples"] / h["seconds"] if h["seconds"] else 0.0, first * s["samples"], x.tolist()
            at += s["samples"]

    @staticmethod
    def _wfdb(fs, p: Range) -> Iterator[tuple]:
        with fs.open_input_file(p.header) as f:
            header = f.read().decode("latin-1")
        _, rate, samples, signals = recordings.wfdb_header(header)
        if {s["file"] for s in signals} != {posixpath.basename(p.path)}:
            raise ValueError(f"{p.header}: signals must lie in {posixpath.basename(p.path)} alone")
        k = len(signals)
        with fs.open_input_file(p.path) as f:
            first, last = _within(p.begin, p.end, 0, 2 * k, f.size())
            last = min(last, samples) if samples else last
            data = f.read_at(2 * k * max(0, last - first), 2 * k * first)
        if last > first:
            x = recordings.wfdb16(header, data)
            for i, s in enumerate(signals):
                yield p.path, i, s["name"], rate, first, [None if v != v else v for v in x[i].tolist()]


class RecordingSource(DataSource):
    """``spark.read.format("recording")``: a row a signal and range, with its first sample's number; NULL for missing."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(self.options)


def read_recordings(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, signal, channel, rate, start, samples) of all EDF and WFDB (format 16) recordings under a folder.

    Other files are left alone, a header without its data too; a folder without recordings gives an empty table.
    """
    spark.dataSource.register(RecordingSource)
    return spark.read.format("recording").option("rangeBytes", range_bytes).load(folder)


def write_files(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> int:
    """Write each row's bytes as a file of a shared folder, in the tasks; the number of files.

    A repeated task writes the same bytes under the same name.
    """
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, base = filesystem(folder)
        for frame in frames:
            for n, c in zip(frame[name], frame[content]):
                with out.open_output_stream(f"{base}/{n}") as f:
                    f.write(bytes(c))
            yield pd.DataFrame({"files": [len(frame)]})

    return sum(r.files for r in rows.select(name, content).mapInPandas(run, "files long").groupBy().sum("files").withColumnRenamed("sum(files)", "files").collect() if r.files)
