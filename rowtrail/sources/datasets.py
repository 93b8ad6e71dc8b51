"""Data sets assembled from files as rows with ``static``, ``series`` and ``label``: one plan each, no driver loops.

Files come in through ``binaryFile`` (one row a file, with its content) or as tables; members of archives through
``zip_members``.  Decoding is a small function on one file's bytes inside an Arrow-fed task.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from fnmatch import fnmatch

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.etl import interval_join, observed_with_outcome, trim_around, tumbling_in_islands
from . import recordings, series
from .recording_source import read_recordings
from .workbooks import workbook_rows

# ---------------------------------------------------------------- files


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of the files under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")


def zip_members(archives: DataFrame, pattern: str = "*") -> DataFrame:
    """(path, content) of the members that fit a pattern, archives inside archives included; paths joined by ``!/``."""

    def members(path: str, data: bytes) -> Iterator[tuple[str, bytes]]:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for name in sorted(z.namelist()):
                if name.endswith("/"):
                    continue
                inner = f"{path}!/{name}"
                if name.lower().endswith(".zip"):
                    yield from members(inner, z.read(name))
                elif fnmatch(name, pattern) or fnmatch(name.rsplit("/", 1)[-1], pattern):
                    yield inner, z.read(name)

    return recordings.decode_files(archives, members, "path string, content binary")


def beside(left: DataFrame, right: DataFrame, key: Callable[[Column], Column], how: str = "inner") -> DataFrame:
    """Files joined with those that lie beside them: equal ``key`` of the file's name (a prefix, or the name's stem)."""
    name = lambda c: F.element_at(F.split(F.regexp_replace(c, r"!/", "/"), "/"), -1)
    a = left.withColumn("_key", key(name(F.col("path"))))
    b = right.select(key(name(F.col("path"))).alias("_key"), F.col("path").alias("beside_path"), F.col("content").alias("beside_content"))
    return a.join(b, "_key", how).drop("_key")


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def matrix_rows(texts: DataFrame, content: str = "content") -> DataFrame:
    """(path, row, values) of text files that hold a matrix of numbers parted by white space; empty lines don't count."""
    words = F.transform(F.split(F.col(content).cast("string"), "\r?\n"), lambda line: F.filter(F.split(line, r"\s+"), lambda w: w != ""))
    rows = F.filter(words, lambda w: F.size(w) > 0)
    return texts.select("path", F.posexplode(rows).alias("row", "words")).select("path", "row", F.col("words").cast("array<double>").alias("values"))


def workbook(archives: DataFrame, names: list[str], header: int = 1, pattern: str = "*.xls*") -> DataFrame:
    """The named columns, as texts, of workbooks, binary or of XML, inside zip archives."""
    schema = ", ".join(f"`{n}` string" for n in names)
    return recordings.decode_files(zip_members(archives, pattern), lambda _, data: [tuple(r.get(n) for n in names) for r in workbook_rows(data, header)], schema)


# ---------------------------------------------------------------- assemblies


def wide_table(rows: DataFrame, statics: list[str], channels: dict[str, list[str]], label: str, row_id: str | None = None) -> DataFrame:
    """Rows of a table whose months (or other steps) are columns: a channel is a list of columns, oldest first."""
    number = lambda c: F.col(f"`{c}`").cast("double")
    blocks = F.array(*[F.array(*[number(c) for c in cs]) for cs in channels.values()])
    key = F.col(row_id) if row_id else F.monotonically_increasing_id()
    return rows.select(key.alias("row_id"), F.array(*[number(s) for s in statics]).alias("static"), blocks.alias("series"), F.col(f"`{label}`").cast("int").alias("label"))


def by_channel_files(matrices: DataFrame, channels: list[str], labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """Rows whose channels lie in files of their own, a line a row: (split, row, static = subject, series, label, is_train).

    ``matrices``: (split, channel, row, values); ``labels`` and ``subjects``: (split, row, values).  A row without all
    its channels is left out.
    """
    pairs = F.array_sort(F.collect_list(F.struct(F.array_position(F.array(*[F.lit(c) for c in channels]), F.col("channel")).alias("i"), "values")))
    x = matrices.where(F.col("channel").isin(*channels)).groupBy("split", "row").agg(F.transform(pairs, lambda p: p["values"]).alias("series")).where(F.size("series") == len(channels))
    one = lambda d, name: d.select("split", "row", F.get("values", F.lit(0)).alias(name))
    all_ = x.join(one(labels, "label"), ["split", "row"]).join(one(subjects, "subject"), ["split", "row"])
    return all_.select("split", "row", F.array("subject").alias("static"), "series", (F.col("label").cast("int") - 1).alias("label"), F.col("subject").cast("int").alias("group"), (F.col("split") == "train").alias("is_train"))


def ts_rows(texts: DataFrame, content: str = "content") -> DataFrame:
    """(path, row, series, label) of ``.ts`` archives: after ``@data``, channels parted by colons, the label last; ``?`` is missing."""
    body = F.regexp_replace(F.col(content).cast("string"), r"(?is)^.*?@data\s*\n", "")
    lines = F.filter(F.transform(F.split(body, "\r?\n"), F.trim), lambda x: x != "")
    parts = F.split("line", ":")
    channels = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda c: F.transform(F.split(c, ","), lambda v: v.try_cast("double")))
    return texts.select("path", F.posexplode(lines).alias("row", "line")).select("path", "row", channels.alias("series"), F.element_at(parts, -1).alias("label"))


def train_and_test(train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """Both parts with ``is_train`` and the labels as places among the sorted classes of both."""
    both = train.withColumn("is_train", F.lit(True)).unionByName(test.withColumn("is_train", F.lit(False)))
    classes = both.select(F.col(label).alias("_c")).distinct().withColumn("code", F.row_number().over(W.orderBy("_c")) - 1)  # a row a class
    return both.join(F.broadcast(classes), F.col(label) == F.col("_c")).withColumn(label, F.col("code")).drop("_c", "code")


def train_first(rows: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Training rows before the others, in the order of their ids within each."""
    return rows.orderBy(~F.col("is_train"), row_id)


def train_first_places(rows: DataFrame, row_id: str = "row_id", bucket: int = 4096, out: str = "place") -> DataFrame:
    """The rows with their places, from 1, in the order of ``train_first``; ids are whole numbers.

    A place is the count of the buckets of ids before, plus the place within the bucket: no window sees all rows.
    """
    cut = rows.withColumn("_b", F.floor(F.col(row_id) / bucket))
    counts = cut.groupBy("is_train", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy(F.col("is_train").desc(), "_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a bucket
    within = F.row_number().over(W.partitionBy("is_train", "_b").orderBy(row_id))
    placed = cut.withColumn("_r", within).join(counts.select("is_train", "_b", before.alias("_before")), ["is_train", "_b"])
    return placed.withColumn(out, F.col("_before") + F.col("_r")).drop("_b", "_r", "_before")


def unseen_labels(known: DataFrame, rows: DataFrame, label: str = "label") -> DataFrame:
    """The labels of ``rows`` that ``known`` doesn't have, each once: an evaluation set must have none."""
    return rows.select(label).where(F.col(label).isNotNull()).distinct().join(known.select(label).distinct(), label, "left_anti")


def eav_dataset(lines: DataFrame, outcomes: DataFrame, statics: list[str], parameters: list[str], hours: int = 48, record: str = "record_id") -> DataFrame:
    """Records of ``HH:MM,parameter,value`` lines with an outcome: (record_id, static, series of hourly means, label)."""
    rows = recordings.eav_rows(lines, record)
    known = recordings.eav_statics(rows, statics, record)
    keys = observed_with_outcome(lines.select(record).distinct(), outcomes, rows.where("value is not null").select(record), record)
    long = series.dense(recordings.eav_series(rows, statics, hours, record).withColumnRenamed("parameter", "channel"), keys.select(record), [record], parameters, hours)
    arrays = series.to_arrays(long, [record, "channel"])
    place = F.array_position(F.array(*[F.lit(p) for p in parameters]), F.col("channel"))
    x = arrays.groupBy(record).agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("i"), "series"))), lambda p: p["series"]).alias("series"))
    return keys.join(known, record, "left").join(x, record).select(record, F.array(*[F.col(f"`{s}`") for s in statics]).alias("static"), "series", F.col("label").cast("int").alias("label"))


def coded_record(header: str, data: bytes) -> tuple[np.ndarray, float | None, float | None, list[str]]:
    """(samples by channel, age, sex, codes) of a record whose header's comments say who it is of.

    The signal is 16-bit numbers from the byte that the format column names (``16x1+24``); sex is 1 for male, 0 for
    female; what isn't said is None.
    """
    lines = header.splitlines()
    fields = lines[0].split()
    channels, samples = int(fields[1]), int(fields[3])
    offset, gains = 0, []
    for line in lines[1 : 1 + channels]:
        part = line.split()
        offset = int(part[1].split("+")[1]) if "+" in part[1] else offset
        gains.append(float(re.match(r"[-\d.eE]+", part[2])[0]) or 1000.0)
    raw = np.frombuffer(data, "<i2", offset=offset)
    block = raw[: len(raw) // channels * channels].reshape(-1, channels).T[:, :samples] / np.array(gains)[:, None]
    said = {m[1].lower(): m[2].strip() for m in re.finditer(r"^#\s*(\w+)\s*:(.*)$", "\n".join(lines[channels + 1 :]), re.M)}
    age = float(said["age"]) if re.fullmatch(r"\d+(\.\d*)?", said.get("age", "")) else None
    sex = {"m": 1.0, "f": 0.0}.get(said.get("sex", "")[:1].lower())
    return block, age, sex, [c.strip() for c in said.get("dx", "").split(",") if c.strip()]


def coded_records(headers: DataFrame, signals: DataFrame, steps: int, unreadable: str = "raise") -> DataFrame:
    """(path, static = [age, sex], series of ``steps`` samples, codes) of headers joined with their signal files.

    Series are cut at ``steps``; shorter ones are padded with missing steps.  Records that can't be read end the job,
    or are left out with ``unreadable="skip"``.
    """
    pairs = beside(headers, signals, stem)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, head, data in zip(frame["path"], frame["content"], frame["beside_content"]):
                try:
                    block, age, sex, codes = coded_record(bytes(head).decode(), bytes(data))
                except (ValueError, IndexError, TypeError):
                    if unreadable != "skip":
                        raise
                    continue
                out.append((path, [age, sex], [[*c[:steps].tolist(), *[None] * max(0, steps - len(c))] for c in block], codes))
            yield pd.DataFrame(out, columns=["path", "static", "series", "codes"])

    return pairs.mapInPandas(run, "path string, static array<double>, series array<array<double>>, codes array<string>")


def single_label(rows: DataFrame, row_id: str, codes: str, least: int) -> DataFrame:
    """Rows with exactly one code among those that ``least`` rows carry, as ``label``, a place among those codes."""
    long = rows.select(row_id, F.explode(F.array_distinct(codes)).alias("_code"))
    frequent = long.groupBy("_code").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    placed = frequent.withColumn("_place", F.row_number().over(W.orderBy("_code")) - 1).select("_code", "_place")  # a row a code
    one = long.join(F.broadcast(placed), "_code").groupBy(row_id).agg(F.count(F.lit(1)).alias("_k"), F.first("_place").alias("label")).where("_k = 1").drop("_k")
    return rows.join(one, row_id)


def official_folds(rows: DataFrame, fold: str, train: list[int], test: list[int]) -> DataFrame:
    """Rows of the named folds with ``is_train``; others are left out."""
    return rows.where(F.col(fold).isin(*train, *test)).withColumn("is_train", F.col(fold).isin(*train))


def sleep_epochs(signals: DataFrame, stages: DataFrame, names: dict[str, int], step: float = 30.0, margin: int = 60) -> DataFrame:
    """(record, t, series, label): epochs of a signal with the stage that covers them, cut around sleep.

    ``signals``: (record, t, series) of whole epochs; ``stages``: (record, start, length, label).  Stages that ``names``
    doesn't hold are left out, and so is what lies further than ``margin`` epochs from any epoch of a code over 0.
    """
    code = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)])
    known = stages.withColumn("label", F.element_at(code, F.col("label"))).where("label is not null")
    labelled = interval_join(known, ["record"], step).select("record", "t", "label")
    kept = trim_around(labelled, ["record"], "t", F.col("label") > 0, margin)
    return signals.join(kept, ["record", "t"])


def apnea_group(record: Column) -> Column:
    """The subject's number: the record's, plus 100 for the letter b and 200 for c."""
    return F.substring(record, 2, 9).cast("int") + F.when(F.substring(record, 1, 1) == "b", 100).when(F.substring(record, 1, 1) == "c", 200).otherwise(0)


def body_mass(weight: Column, height_cm: Column) -> Column:
    return weight / F.pow(height_cm / 100, 2)


def apnea_people(text: DataFrame, column: str = "value") -> DataFrame:
    """(record, static = [age, sex, height, weight, bmi], group) of lines parted by tabs, one a record of letter and number."""
    f = F.split(column, "\t")
    n = F.size(f)
    at = lambda k: F.get(f, n - 4 + k)
    rows = text.where(F.regexp_like(column, F.lit(r"^[abc]\d\d\t.*\t\d+\t[MF]\t\d+\t\d+\s*$")))
    age, height, weight = (at(k).cast("double") for k in (0, 2, 3))
    sex = F.when(at(1) == "M", F.lit(1.0)).otherwise(F.lit(0.0))
    return rows.select(f[0].alias("record"), F.array(age, sex, height, F.trim(at(3)).cast("double"), body_mass(F.trim(at(3)).cast("double"), height)).alias("static"), apnea_group(f[0]).alias("group"))


def minute_segments(signals: DataFrame, rate: int = 100, keep: int = 2) -> DataFrame:
    """(record, start, series, label): annotated minutes that lie wholly in the signal, ``keep`` samples averaged to one.

    ``signals``: (record, samples array<double>, marks array<struct<start int, label int>>).
    """
    span = 60 * rate
    rows = signals.select("record", "samples", F.explode("marks").alias("m")).where(F.col("m.start") + span <= F.size("samples"))
    cut = F.slice("samples", F.col("m.start") + 1, span)
    means = F.transform(F.sequence(F.lit(0), F.lit(span // keep - 1)), lambda i: F.aggregate(F.slice(cut, i * keep + 1, keep), F.lit(0.0), lambda a, x: a + x) / keep)
    return rows.select("record", F.col("m.start").alias("start"), F.array(means).alias("series"), F.col("m.label").alias("label"))


def activity_windows(rows: DataFrame, channels: list[str], length: int = 96) -> DataFrame:
    """(subject, activity, island, window, series): whole windows inside unbroken runs of one activity of a subject.

    ``rows``: (subject, activity, t, one column a channel), t in steps; activity 0 is no activity.
    """
    cut = tumbling_in_islands(rows.where("activity <> 0"), ["subject", "activity"], "t", length)
    step = F.array_sort(F.collect_list(F.struct("place", *channels)))
    pick = lambda c: lambda p: p[c]
    arrays = F.array(*[F.transform(step, pick(c)) for c in channels])
    return cut.groupBy("subject", "activity", "island", "window").agg(arrays.alias("series"))


# ---------------------------------------------------------------- data sets from a folder

#: The columns of the credit table, its channels oldest first.
CREDIT_STATICS = ["LIMIT_BAL", "SEX", "EDUCATION", "MARRIAGE", "AGE"]
CREDIT_CHANNELS = {
    "repay_status": ["PAY_6", "PAY_5", "PAY_4", "PAY_3", "PAY_2", "PAY_0"],
    "bill_amount": ["BILL_AMT6", "BILL_AMT5", "BILL_AMT4", "BILL_AMT3", "BILL_AMT2", "BILL_AMT1"],
    "payment_amount": ["PAY_AMT6", "PAY_AMT5", "PAY_AMT4", "PAY_AMT3", "PAY_AMT2", "PAY_AMT1"],
}
CREDIT_LABEL = "default payment next month"
#: The inertial channels of the smartphone recordings.
HAR_CHANNELS = ["body_acc_x", "body_acc_y", "body_acc_z", "body_gyro_x", "body_gyro_y", "body_gyro_z", "total_acc_x", "total_acc_y", "total_acc_z"]
#: What is recorded once at admission, besides the number of the record.
ICU_STATICS = ["Age", "Gender", "Height", "ICUType", "Weight"]
#: Stages of sleep by their names in the annotations.
SLEEP_STAGES = {"Sleep stage W": 0, "Sleep stage 1": 1, "Sleep stage 2": 2, "Sleep stage 3": 3, "Sleep stage 4": 3, "Sleep stage R": 4}
#: The annotation codes of minutes without and with apnea.
APNEA_CODES = {1: 0, 8: 1}
#: Sex, age, height in cm, weight in kg, resting and greatest heart rate of each subject of the wearables.
PAMAP_SUBJECTS = {
    101: [1.0, 27.0, 182.0, 83.0, 75.0, 193.0],
    102: [0.0, 25.0, 169.0, 78.0, 74.0, 195.0],
    103: [1.0, 31.0, 187.0, 92.0, 68.0, 189.0],
    104: [1.0, 24.0, 194.0, 95.0, 58.0, 196.0],
    105: [1.0, 26.0, 180.0, 73.0, 70.0, 194.0],
    106: [1.0, 26.0, 183.0, 69.0, 60.0, 194.0],
    107: [1.0, 23.0, 173.0, 86.0, 60.0, 197.0],
    108: [1.0, 32.0, 179.0, 87.0, 66.0, 188.0],
    109: [1.0, 31.0, 168.0, 65.0, 54.0, 189.0],
}
#: The columns of the accelerometers of hand, chest and ankle, and the activities that count.
PAMAP_COLUMNS = {"hand_x": 4, "hand_y": 5, "hand_z": 6, "chest_x": 21, "chest_y": 22, "chest_z": 23, "ankle_x": 38, "ankle_y": 39, "ankle_z": 40}
PAMAP_ACTIVITIES = [1, 2, 3, 4, 5, 6, 7, 12, 13, 16, 17, 24]


def block_mean(values: Column, k: int) -> Column:
    """Means of k entries of an array at a time; a shorter rest is left out."""
    n = F.floor(F.size(values) / k).cast("int")
    means = F.transform(F.sequence(F.lit(1), n), lambda i: F.aggregate(F.slice(values, (i - 1) * k + 1, k), F.lit(0.0), lambda a, x: a + x) / k)
    return F.when(n > 0, means).otherwise(F.array().cast("array<double>"))


def as_codes(rows: DataFrame, label: str = "label") -> DataFrame:
    """The label as its place among the sorted labels that occur."""
    classes = rows.select(F.col(label).alias("_c")).distinct().withColumn("_k", F.row_number().over(W.orderBy("_c")) - 1)  # a row a class
    return rows.join(F.broadcast(classes), F.col(label) == F.col("_c")).withColumn(label, F.col("_k")).drop("_c", "_k")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def load_credit(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with five attributes and three channels of six months, from the workbook in the zip archive."""
    channels = [c for cs in CREDIT_CHANNELS.values() for c in cs]
    rows = workbook(files(spark, folder, "*.zip"), ["ID", *CREDIT_STATICS, *channels, CREDIT_LABEL])
    return wide_table(rows.withColumn("_row", F.col("ID").cast("double").cast("long")), CREDIT_STATICS, CREDIT_CHANNELS, CREDIT_LABEL, "_row")


def load_har(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of nine raw channels from the (nested) archive, with the subject as static and group, split as published."""
    members = zip_members(files(spark, folder, "*.zip"), "*_t[re]*.txt")
    part = F.regexp_extract("path", r"(\w+?)_(train|test)\.txt$", 1)
    wanted = members.where(part.isin(*HAR_CHANNELS, "y", "subject")).withColumn("path", F.regexp_extract("path", r"(\w+_(train|test))\.txt$", 1))
    name = F.regexp_extract("path", r"^(.*)_(train|test)$", 1).alias("channel")
    values = matrix_rows(wanted).select(F.regexp_extract("path", r"(train|test)$", 1).alias("split"), name, "row", "values")
    side = {k: values.where(F.col("channel") == k).drop("channel") for k in ("y", "subject")}
    rows = by_channel_files(values, HAR_CHANNELS, side["y"], side["subject"])
    return rows.select(F.concat_ws("/", "split", "row").alias("row_id"), "static", "series", "label", "group", "is_train")


def load_icu(spark: SparkSession, folder: str) -> DataFrame:
    """Stays of 48 hours: set-a and set-b of files of lines, outcomes beside them; set-a trains.

    Every parameter but the admission attributes is a channel, in sorted order; their names are few and come to the
    driver.  A later reading of an admission attribute isn't a channel.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(folder).select("value", F.col("_metadata.file_path").alias("path"))
    lines = text.where(F.regexp_like("path", F.lit(r"/set-[ab]/\d+\.txt$"))).select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long").alias("record_id"), "value", F.col("path").contains("/set-a/").alias("is_train"))
    field = F.split("value", ",")
    outcomes = text.where(F.regexp_like("path", F.lit(r"/Outcomes-\w+\.txt$")) & (F.size(field) >= 6)).select(field[0].try_cast("long").alias("record_id"), field[5].try_cast("int").alias("label")).dropna()
    once = [*ICU_STATICS, "RecordID"]
    seen = recordings.eav_rows(lines).where(~F.col("parameter").isin(*once)).where("value is not null")
    parameters = [r[0] for r in seen.select("parameter").distinct().orderBy("parameter").collect()]
    rows = eav_dataset(lines, outcomes, ICU_STATICS, parameters).join(lines.select("record_id", "is_train").distinct(), "record_id")
    return rows.join(seen.select("record_id").distinct(), "record_id", "left_semi").withColumnRenamed("record_id", "row_id")


def load_ptbxl(spark: SparkSession, folder: str) -> DataFrame:
    """Heart recordings of one diagnostic superclass: age, sex, height, weight; twelve leads at 100 Hz; folds 1-8 and 10.

    Ages over 89 are coded otherwise in the file and become 90.  Recordings of no or several superclasses are left out,
    and so are rows without both files.
    """
    table = lambda name: spark.read.option("header", True).option("escape", '"').option("recursiveFileLookup", "true").option("pathGlobFilter", name).csv(folder)
    about = table("scp_statements.csv")
    diagnostic = about.where(F.col("diagnostic").try_cast("double") == 1).select(F.col(f"`{about.columns[0]}`").alias("code"), F.col("diagnostic_class").alias("class"))
    people = table("ptbxl_database.csv").withColumn("row_id", F.col("ecg_id").cast("long"))
    codes = people.select("row_id", F.explode(F.regexp_extract_all("scp_codes", F.lit(r"'([^']+)'\s*:"), 1)).alias("code"))
    single = codes.join(F.broadcast(diagnostic), "code").groupBy("row_id").agg(F.count_distinct("class").alias("n"), F.min("class").alias("label")).where("n = 1").drop("n")
    number = lambda c: F.col(c).try_cast("double")
    age = F.when(number("age") > 89, 90.0).otherwise(number("age"))
    folds = official_folds(people.withColumn("fold", number("strat_fold").cast("int")), "fold", list(range(1, 9)), [10])
    known = folds.join(single, "row_id").select("row_id", F.array(age, *[number(c) for c in ("sex", "height", "weight")]).alias("static"), "label", "is_train", F.col("filename_lr").alias("_file"))
    pairs = beside(files(spark, folder, "*.hea"), files(spark, folder, "*.dat"), stem).where(stem(F.col("path")) == stem(F.col("beside_path")))

    def leads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, head, data in zip(frame["path"], frame["content"], frame["beside_content"]):
                x = recordings.wfdb16(bytes(head).decode(), bytes(data))
                out.append((path, [[None if v != v else v for v in c] for c in x.tolist()]))
            yield pd.DataFrame(out, columns=["path", "series"])

    wave = pairs.mapInPandas(leads, "path string, series array<array<double>>").withColumn("_file", F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+)\.hea$", 1))
    return as_codes(known.join(wave, "_file").select("row_id", "static", "series", "label", "is_train"))


def load_cpsc(spark: SparkSession, folder: str, seconds: int = 10, rate: int = 500, k: int = 5, least: int = 200) -> DataFrame:
    """Heart recordings of one frequent code: age and sex; the first ten seconds, five samples averaged to one.

    Shorter and unreadable recordings are left out, and those of no or several codes that ``least`` recordings carry.
    """
    steps = seconds * rate
    rows = coded_records(files(spark, folder, "A*.hea"), files(spark, folder, "*.mat"), steps, unreadable="skip")
    whole = rows.where(F.size("series") > 0).where(F.get(F.get("series", F.lit(0)), F.lit(steps - 1)).isNotNull()).withColumn("row_id", stem(file_name(F.col("path"))))
    one = single_label(whole, "row_id", "codes", least)
    return one.select("row_id", "static", F.transform("series", lambda c: block_mean(c, k)).alias("series"), "label")


def load_sleep(spark: SparkSession, folder: str, channel: str = "EEG Fpz-Cz", step: float = 30.0, k: int = 2, margin: int = 60) -> DataFrame:
    """Epochs of sleep with their stages: age and sex; one channel at half its rate; the subject and night as group.

    Signals come by ranges of bytes, so a night is several tasks.  Age and sex are those of the annotations' file, whose
    patient field is the night's own.  The first annotations' file by name counts where a night has several.
    """
    night = F.substring(file_name(F.col("path")), 1, 6).alias("record")
    notes = files(spark, folder, "*-Hypnogram.edf")
    notes = notes.select(night, "path", "content").groupBy("record").agg(F.min(F.struct("path", "content")).alias("f")).select("record", F.col("f.path").alias("path"), F.col("f.content").alias("content"))
    decoded = recordings.decode_files(
        notes, lambda p, b: [(p.rsplit("/", 1)[-1][:6], recordings.edf_header(b)["patient"], *a) for a in recordings.edf_annotations(b)], "record string, patient string, start double, length double, label string"
    )
    whole = read_recordings(spark, folder).where(F.col("channel") == channel).where(F.col("path").contains("-PSG"))
    size = F.round(F.col("rate") * step).cast("int")
    pieces = F.sequence(F.lit(0), F.floor(F.size("samples") / size).cast("int") - 1)
    cut = whole.where(F.size("samples") >= size).select(night, F.explode(F.transform(pieces, lambda i: F.struct((F.col("start") / size + i).cast("int").alias("t"), F.slice("samples", i * size + 1, size).alias("x")))).alias("e"))
    epochs = cut.select("record", "e.t", F.array(block_mean(F.col("e.x"), k)).alias("series"))
    age, sex = recordings.demographics(F.col("patient"))
    people = decoded.select("record", F.array(age, sex).alias("static")).distinct()
    rows = sleep_epochs(epochs, decoded.drop("patient"), SLEEP_STAGES, step, margin).join(people, "record")
    return rows.select(F.concat_ws("/", "record", "t").alias("row_id"), "static", "series", "label", F.substring("record", 3, 4).cast("int").alias("group"))


def load_apnea(spark: SparkSession, folder: str, rate: int = 100, k: int = 2) -> DataFrame:
    """Annotated minutes of one lead with age, sex, height, weight and body mass; the subject as group.

    A recording (some six megabytes) and its annotations are one task's row and leave it as minutes.
    """
    span = 60 * rate
    hea, dat, apn = (files(spark, folder, f"*.{e}").select(stem(file_name(F.col("path"))).alias("record"), F.col("content").alias(e)) for e in ("hea", "dat", "apn"))

    def minutes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for record, head, data, marks in zip(frame["record"], frame["hea"], frame["dat"], frame["apn"]):
                x = recordings.wfdb16(bytes(head).decode(), bytes(data))[0]
                found = [(s, APNEA_CODES[c]) for s, c in recordings.wfdb_annotations(bytes(marks)) if c in APNEA_CODES and s + span <= len(x)]
                yield pd.DataFrame([(record, s, [x[s : s + span].reshape(-1, k).mean(1)], c) for s, c in found], columns=["record", "start", "series", "label"])

    cut = hea.join(dat, "record").join(apn, "record").mapInPandas(minutes, "record string, start int, series array<array<double>>, label int")
    people = apnea_people(spark.read.text(f"{folder}/additional-information.txt"))
    seen = F.transform("series", lambda c: F.transform(c, lambda v: F.nullif(v, F.lit(float("nan"))))).alias("series")
    return cut.join(F.broadcast(people), "record").select(F.concat_ws("/", "record", "start").alias("row_id"), "static", seen, "label", "group")  # people: a row a recording


def load_pamap(spark: SparkSession, folder: str, every: int = 3, length: int = 96) -> DataFrame:
    """Windows of three accelerometers inside unbroken runs of an activity; body measures; the subject as group."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "subject*.dat").text(folder).select("value", F.col("_metadata.file_path").alias("path"))
    subject = F.regexp_extract("path", r"subject(\d+)\.dat$", 1).try_cast("int")
    field = F.split(F.trim("value"), r"\s+")
    number = lambda i: F.nullif(field[i].try_cast("double"), F.lit(float("nan")))
    lines = text.where(F.col("path").contains("/Protocol/")).select(subject.alias("subject"), number(0).alias("clock"), number(1).cast("int").alias("activity"), *[number(i).alias(c) for c, i in PAMAP_COLUMNS.items()])
    known = lines.where(F.col("subject").isin(*PAMAP_SUBJECTS)).where("clock is not null")
    placed = known.withColumn("_p", F.row_number().over(W.partitionBy("subject").orderBy("clock")) - 1).where(F.col("_p") % every == 0)
    steps = placed.withColumn("t", F.floor(F.col("_p") / every).cast("int")).where(F.col("activity").isin(*PAMAP_ACTIVITIES))
    cut = activity_windows(steps, list(PAMAP_COLUMNS), length)
    body = F.element_at(F.create_map(*[F.lit(x) if isinstance(x, int) else F.array(*map(F.lit, x)) for k, v in PAMAP_SUBJECTS.items() for x in (k, v)]), F.col("subject"))
    rows = cut.select(F.concat_ws("/", "subject", "activity", "island", "window").alias("row_id"), body.alias("static"), "series", F.col("activity").alias("label"), F.col("subject").alias("group"))
    return as_codes(rows)


def load_uea(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of an archive's ``*_TRAIN.ts`` and ``*_TEST.ts``; no attributes."""
    part = lambda name: ts_rows(files(spark, folder, f"*_{name}.ts")).withColumn("row_id", F.concat_ws("/", F.lit(name.lower()), "row"))
    rows = train_and_test(part("TRAIN"), part("TEST"))
    return rows.select("row_id", F.array().cast("array<double>").alias("static"), "series", F.col("label").cast("int").alias("label"), "is_train")


#: Name -> how the data set is put together from the files of a folder, as (spark, folder) -> rows.
LOADERS: dict[str, Callable[..., DataFrame]] = {
    "credit": load_credit,
    "har": load_har,
    "icu": load_icu,
    "ptbxl": load_ptbxl,
    "cpsc2018": load_cpsc,
    "sleepedf": load_sleep,
    "apnea": load_apnea,
    "pamap2": load_pamap,
    "uea": load_uea,
}


def loader(name: str) -> Callable[..., DataFrame]:
    if name not in LOADERS:
        raise ValueError(f"unknown data set {name!r}; known: {', '.join(LOADERS)}")
    return LOADERS[name]


def load(spark: SparkSession, name: str, folder: str, **options) -> DataFrame:
    """A data set by its name: row_id, static, series (channels of steps), label, and group and is_train where it has them."""
    return loader(name)(spark, folder, **options)
