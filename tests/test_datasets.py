import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowtrail.sources import datasets


def packed(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_members_of_archives_and_workbooks(spark, tmp_path):
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda ref, v: f'<c r="{ref}"><v>{v}</v></c>'
    sheet = f'<worksheet {space}><sheetData><row><c r="A1"><v>top</v></c></row><row><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c></row><row>{cell("A3", 5)}{cell("B3", 7.5)}</row><row>{cell("B4", 1)}</row></sheetData></worksheet>'
    book = packed({"xl/sharedStrings.xml": f"<sst {space}><si><t>AGE</t></si><si><r><t>BI</t></r><r><t>LL</t></r></si></sst>", "xl/worksheets/sheet1.xml": sheet})
    (tmp_path / "a.zip").write_bytes(packed({"d/book.xlsx": book, "inner.zip": packed({"x/m.txt": "1 2\n\n 3  4 \n"}), "d/": ""}))
    found = datasets.files(spark, str(tmp_path), "*.zip")
    assert [(r.AGE, r.BILL) for r in datasets.workbook(found, ["AGE", "BILL"]).collect()] == [("5", "7.5"), (None, "1")]
    rows = datasets.matrix_rows(datasets.zip_members(found, "m.txt")).orderBy("row").collect()
    assert [(r.row, r["values"]) for r in rows] == [(0, [1.0, 2.0]), (1, [3.0, 4.0])] and rows[0].path.endswith("inner.zip!/x/m.txt")


def test_channel_files(spark):
    m = [("train", c, r, [float(r), float(k)]) for k, c in enumerate(["x", "y"]) for r in range(2)] + [("test", "x", 0, [9.0, 9.0])]
    matrices = spark.createDataFrame(m, "split string, channel string, row int, values array<double>")
    one = spark.createDataFrame([("train", 0, [1.0]), ("train", 1, [2.0]), ("test", 0, [1.0])], "split string, row int, values array<double>")
    got = datasets.by_channel_files(matrices, ["x", "y"], one, one).orderBy("row").collect()
    assert [(r.row, r.series, r.label, r.group, r.is_train) for r in got] == [(0, [[0.0, 0.0], [0.0, 1.0]], 0, 1, True), (1, [[1.0, 0.0], [1.0, 1.0]], 1, 2, True)]


def test_archive_format(spark):
    text = "@problemName p\n@classLabel true b a\n@data\n1,?,3:4,5,6:b\n7,8,9:1,1,1:a\n"
    train = datasets.ts_rows(spark.createDataFrame([("p", text)], "path string, content string"))
    both = datasets.train_first(datasets.train_and_test(train, train.where("row = 1")), "row").collect()
    assert [(r.series[0], r.label, r.is_train) for r in both] == [([1.0, None, 3.0], 1, True), ([7.0, 8.0, 9.0], 0, True), ([7.0, 8.0, 9.0], 0, False)]


def test_coded_records(spark):
    data = np.arange(12, dtype="<i2")
    header = "A1 2 500 6\nA1.mat 16x1+24 1000/mV 16 0 0 0 0 I\nA1.mat 16x1+24 500(0)/mV 16 0 0 0 0 II\n# Age: 63\n# Sex: Female\n# Dx: 10, 20\n"
    headers = spark.createDataFrame([("x/A1.hea", bytearray(header.encode())), ("x/B2.hea", bytearray(header.replace("63", "NaN").replace("Female", "M").encode()))], "path string, content binary")
    signals = spark.createDataFrame([(f"x/{n}.mat", bytearray(b"\0" * 24 + data.tobytes())) for n in ("A1", "B2")], "path string, content binary")
    got = {r.path[-6:-4]: r for r in datasets.coded_records(headers, signals, 8).collect()}
    assert got["A1"].static == [63.0, 0.0] and got["B2"].static == [None, 1.0] and got["A1"].codes == ["10", "20"]
    assert got["A1"].series[0] == [0.0, 0.002, 0.004, 0.006, 0.008, 0.01, None, None] and got["A1"].series[1][1] == 3 / 500
    rows = spark.createDataFrame([(i, [str(i % 2), "z"] if i == 5 else [str(i % 2)]) for i in range(7)], "row_id int, codes array<string>")
    one = datasets.single_label(rows, "row_id", "codes", 2).orderBy("row_id").collect()
    assert [(r.row_id, r.label) for r in one] == [(i, i % 2) for i in range(7)]


def test_minutes_and_people(spark):
    lines = ["a01\t489\t+470\tx\t51\tM\t175\t102", "b02\t1\ty\t40\tF\t160\t64", "no such line"]
    people = {r.record: r for r in datasets.apnea_people(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert people["a01"].static[:4] == [51.0, 1.0, 175.0, 102.0] and people["a01"].static[4] == pytest.approx(102 / 1.75**2)
    assert (people["a01"].group, people["b02"].group) == (1, 102) and len(people) == 2
    samples = [float(i) for i in range(250)]
    rows = spark.createDataFrame([("r", samples, [(0, 1), (120, 0), (200, 1)])], "record string, samples array<double>, marks array<struct<start:int,label:int>>")
    got = datasets.minute_segments(rows, rate=2, keep=4).orderBy("start").collect()
    assert [(r.start, r.label, len(r.series[0])) for r in got] == [(0, 1, 30), (120, 0, 30)] and got[1].series[0][0] == 121.5


def test_record_assemblies(spark):
    lines = [("r1", x) for x in ("00:00,Age,50", "00:00,HR,80", "00:30,HR,90", "02:10,HR,70", "garbled", "01:00,SP,-1")] + [("r2", "00:00,Age,20"), ("r3", "00:00,HR,60")]
    outcomes = spark.createDataFrame([("r1", 1), ("r2", 0)], "record_id string, label int")
    got = {r.record_id: r for r in datasets.eav_dataset(spark.createDataFrame(lines, "record_id string, value string"), outcomes, ["Age"], ["HR", "SP"], 3).collect()}
    assert got["r1"].static == [50.0] and got["r1"].series == [[85.0, None, 70.0], [None] * 3] and got["r1"].label == 1 and set(got) == {"r1", "r2"}
    epochs = spark.createDataFrame([("s", t, [float(t)]) for t in range(10)], "record string, t int, series array<double>")
    stages = spark.createDataFrame([("s", 0.0, 120.0, "W"), ("s", 120.0, 60.0, "1"), ("s", 180.0, 30.0, "?"), ("s", 210.0, 90.0, "W")], "record string, start double, length double, label string")
    kept = datasets.sleep_epochs(epochs, stages, {"W": 0, "1": 1}, margin=2).orderBy("t").collect()
    assert [(r.t, r.label) for r in kept] == [(2, 0), (3, 0), (4, 1), (5, 1), (7, 0), (8, 0)]
    steps = spark.createDataFrame([("p", 1 if t < 5 else 0, t, float(t), -float(t)) for t in range(8)], "subject string, activity int, t int, a double, b double")
    w = datasets.activity_windows(steps, ["a", "b"], 2).orderBy("window").collect()
    assert [r.series for r in w] == [[[0.0, 1.0], [-0.0, -1.0]], [[2.0, 3.0], [-2.0, -3.0]]]
    folds = datasets.official_folds(spark.createDataFrame([(i,) for i in range(1, 11)], "fold int"), "fold", list(range(1, 9)), [10]).collect()
    assert [(r.fold, r.is_train) for r in folds] == [*((i, True) for i in range(1, 9)), (10, False)]
    assert datasets.loader("icu") is datasets.load_icu
    with pytest.raises(ValueError, match="unknown data set"):
        datasets.loader("other")
    near = datasets.beside(spark.createDataFrame([("d/SC4001E0-PSG.edf", bytearray(b"a"))], "path string, content binary"), spark.createDataFrame([("d/SC4001EC-Hyp.edf", bytearray(b"b"))], "path string, content binary"), lambda n: F.substring(n, 1, 6)).collect()
    assert len(near) == 1 and bytes(near[0].beside_content) == b"b"
