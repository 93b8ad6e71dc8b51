"""Recordings in common file formats, read with Spark's own readers and decoded row by row or batch by batch.

Binary formats come in through ``spark.read.format("binaryFile")`` (one row a file); decoding is a small function on a
file's bytes inside an Arrow-fed task, so files spread over the cluster and none passes through the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# ---------------------------------------------------------------- entity-attribute-value text


def eav_rows(lines: DataFrame, record: str = "record_id", line: str = "value") -> DataFrame:
    """(record_id, hour, minute, parameter, value) of ``HH:MM,parameter,value`` lines; others are skipped, -1 is missing."""
    parts = F.split(F.trim(line), ",")
    clock = F.regexp_extract(parts[0], r"^(\d+):(\d\d)$", 1), F.regexp_extract(parts[0], r"^(\d+):(\d\d)$", 2)
    rows = lines.where(F.size(parts) == 3).select(
        record, clock[0].alias("_h"), clock[1].alias("_m"), F.trim(parts[1]).alias("parameter"), F.trim(parts[2]).alias("_v")
    )
    value = F.col("_v").try_cast("double")
    return rows.where((F.col("_h") != "") & (F.col("parameter") != "") & value.isNotNull()).select(
        record, F.col("_h").cast("int").alias("hour"), F.col("_m").cast("int").alias("minute"), "parameter", F.when(value != -1, value).alias("value")
    )


def eav_statics(rows: DataFrame, names: list[str], record: str = "record_id") -> DataFrame:
    """One column a static parameter: its first value of hour 0 in the order of time."""
    first = rows.where((F.col("hour") == 0) & F.col("parameter").isin(*names) & F.col("value").isNotNull())
    place = W.partitionBy(record, "parameter").orderBy("minute", "value")
    picked = first.withColumn("_r", F.row_number().over(place)).where("_r = 1")
    return picked.groupBy(record).pivot("parameter", names).agg(F.first("value"))


def eav_series(rows: DataFrame, statics: list[str], hours: int = 48, record: str = "record_id") -> DataFrame:
    """(record, parameter, t, value): hourly means of the other parameters, late hours counted into the last one."""
    return (
        rows.where(~F.col("parameter").isin(*statics)).groupBy(record, "parameter", F.least(F.col("hour"), F.lit(hours - 1)).alias("t")).agg(F.avg("value").alias("value")).where("value is not null")
    )


# ---------------------------------------------------------------- waveforms


def wfdb_header(text: str) -> tuple[str, float, int, list[dict]]:
    """(record, sampling rate, samples, signals) of a WFDB header: each signal's file, format, gain, baseline and name."""
    lines = [x for x in text.splitlines() if x.strip() and not x.startswith("#")]
    head = lines[0].split()
    rate = float(re.split(r"[/(]", head[2])[0]) if len(head) > 2 else 250.0
    signals = []
    for line in lines[1 : 1 + int(head[1])]:
        f = line.split()
        gain, baseline = 200.0, int(f[4]) if len(f) > 4 and re.fullmatch(r"-?\d+", f[4]) else 0
        if len(f) > 2 and (m := re.match(r"([-\d.eE+]+)(?:\((-?\d+)\))?", f[2])):
            gain = float(m[1]) or 200.0
            baseline = int(m[2]) if m[2] else baseline
        signals.append({"file": f[0], "format": f[1], "gain": gain, "baseline": baseline, "name": " ".join(f[8:]) or f"ch{len(signals)}"})
    return head[0].split("/")[0], rate, int(head[3]) if len(head) > 3 else 0, signals


def wfdb16(header: str, data: bytes) -> np.ndarray:
    """(signals, samples) of a format-16 record: interleaved little-endian 16-bit numbers in physical units."""
    _, _, samples, signals = wfdb_header(header)
    if any(s["format"].split("x")[0].split("+")[0] != "16" for s in signals):
        raise ValueError("only format 16 is supported")
    k = len(signals)
    raw = np.frombuffer(data[: len(data) // (2 * k) * 2 * k], "<i2").reshape(-1, k)[: samples or None].T.astype(float)
    raw[raw == -32768] = np.nan
    return (raw - np.array([[s["baseline"]] for s in signals])) / np.array([[s["gain"]] for s in signals])


def wfdb_annotations(data: bytes) -> list[tuple[int, int]]:
    """(sample, code) of an annotation stream: 16-bit words of a 6-bit code and a 10-bit step; long steps and texts skipped over."""
    out, at, now = [], 0, 0
    while at + 1 < len(data):
        word = data[at] | data[at + 1] << 8
        code, step = word >> 10, word & 1023
        at += 2
        if code == 0 and step == 0:
            break
        if code == 59:  # a long step: four bytes, high word first
            if at + 4 > len(data):
                break
            now += int.from_bytes(bytes([data[at + 2], data[at + 3], data[at], data[at + 1]]), "little", signed=True)
            at += 4
        elif code == 63:
            at += step + (step & 1)
        elif code < 60:
            now += step
            out.append((now, code))
    return out


def edf_header(data: bytes) -> dict:
    """The fixed-width header of an EDF file: records, seconds a record, and each signal's label, ranges and samples."""
    text = lambda a, n: data[a : a + n].decode("latin-1").strip()
    k = int(text(252, 4))
    names = [("label", 16), ("transducer", 80), ("unit", 8), ("pmin", 8), ("pmax", 8), ("dmin", 8), ("dmax", 8), ("filter", 80), ("samples", 8), ("reserved", 32)]
    at, signals = 256, [{} for _ in range(k)]
    for name, width in names:
        for s in signals:
            s[name] = text(at, width)
            at += width
    for s in signals:
        s |= {n: float(s[n]) for n in ("pmin", "pmax", "dmin", "dmax")} | {"samples": int(s["samples"])}
    return {"patient": text(8, 80), "start": text(168, 16), "header_bytes": int(text(184, 8)), "records": int(text(236, 8)), "seconds": float(text(244, 8)), "signals": signals}


def edf_signal(data: bytes, index: int) -> np.ndarray:
    """One signal in physical units."""
    h = edf_header(data)
    sizes = [s["samples"] for s in h["signals"]]
    width = sum(sizes)
    body = np.frombuffer(data[h["header_bytes"] :], "<i2")
    body = body[: len(body) // width * width].reshape(-1, width)
    at = sum(sizes[:index])
    return edf_scaled(body[:, at : at + sizes[index]].ravel(), h["signals"][index])


def edf_scaled(x: np.ndarray, signal: dict) -> np.ndarray:
    """Digital numbers in physical units; a signal without a digital range is taken as it is."""
    span = signal["dmax"] - signal["dmin"] or 1.0
    return (x.astype(float) - signal["dmin"]) * (signal["pmax"] - signal["pmin"]) / span + signal["pmin"]


def edf_file(labels: list[str], samples: list[int], records: np.ndarray, seconds: float = 1.0, unit: str = "") -> bytes:
    """An EDF file of 16-bit numbers (records, sum of samples), their physical values the numbers themselves."""
    if records.shape[1] != sum(samples):
        raise ValueError(f"records of {records.shape[1]} numbers for signals of {samples}")
    k = len(labels)
    field = lambda v, n: str(v)[:n].ljust(n).encode("latin-1", "replace")
    head = field("0", 8) + field("", 80) + field("", 80) + field("01.01.0000.00.00", 16) + field(256 * (k + 1), 8) + field("", 44) + field(len(records), 8) + field(f"{seconds:g}", 8) + field(k, 4)
    for values, width in ((labels, 16), ([""] * k, 80), ([unit] * k, 8), ([-32768] * k, 8), ([32767] * k, 8), ([-32768] * k, 8), ([32767] * k, 8), ([""] * k, 80), (samples, 8), ([""] * k, 32)):
        head += b"".join(field(v, width) for v in values)
    return head + records.astype("<i2").tobytes()


def edf_annotations(data: bytes) -> list[tuple[float, float, str]]:
    """(onset, duration, label) of the time-stamped lists in an EDF+ file."""
    found = re.findall(rb"([+-]\d+(?:\.\d*)?)(?:\x15(\d+(?:\.\d*)?))?\x14([^\x00\x14]+)\x14", data)
    return [(float(a), float(b or 0), c.decode("utf-8", "replace")) for a, b, c in found]


def decode_files(files: DataFrame, decode, schema: str, path: str = "path", content: str = "content") -> DataFrame:
    """Rows of ``decode(path, bytes) -> iterable of tuples`` over a table of files, a few files at a time in a task."""

    names = StructType.fromDDL(schema).names

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, c in zip(frame[path], frame[content]):
                yield pd.DataFrame(list(decode(p, bytes(c))), columns=names)

    return files.select(path, content).mapInPandas(run, schema)


def demographics(text: Column) -> tuple[Column, Column]:
    """(age, sex) from a free text: ``63 yr``, and 0 for female, which is looked for first, or 1 for male."""
    low = F.lower(text)
    age = F.regexp_extract(low, r"(\d+)\s*yr", 1)
    return F.when(age != "", age.cast("double")), F.when(low.contains("female"), F.lit(0.0)).when(low.contains("male"), F.lit(1.0))
