"""Whole data sets, each from files made here in the published layout."""

import io
import struct
import zipfile

import numpy as np
import pytest

from rowtrail.sources import datasets, recordings


def packed(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def written(root, name, data):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def load(spark, name, root, **options):
    rows = datasets.load(spark, name, str(root), **options).collect()
    assert len({r.row_id for r in rows}) == len(rows)
    return {r.row_id: r for r in rows}


def test_har(spark, tmp_path):
    lines = lambda m: "\n".join(" ".join(f"{v:e}" for v in r) for r in m) + "\n"
    base, members = "UCI HAR Dataset", {}
    for split, n in (("train", 3), ("test", 2)):
        for k, c in enumerate(datasets.HAR_CHANNELS):
            members[f"{base}/{split}/Inertial Signals/{c}_{split}.txt"] = lines([[10 * i + k, -i] for i in range(n)])
        members[f"{base}/{split}/X_{split}.txt"] = lines([[9, 9]])
        members[f"{base}/{split}/y_{split}.txt"] = "".join(f"{i % 2 + 1}\n" for i in range(n))
        members[f"{base}/{split}/subject_{split}.txt"] = "".join(f"{i + n}\n" for i in range(n))
    written(tmp_path, "har.zip", packed({"UCI HAR Dataset.zip": packed(members), "read.me": "x"}))
    got = load(spark, "har", tmp_path)
    assert set(got) == {"train/0", "train/1", "train/2", "test/0", "test/1"}
    r = got["train/1"]
    assert r.series == [[10.0 + k, -1.0] for k in range(9)] and (r.static, r.group, r.label, r.is_train) == ([4.0], 4, 1, True)
    assert not got["test/0"].is_train and got["test/0"].group == 2


def test_icu(spark, tmp_path):
    head = "Time,Parameter,Value\n"
    written(tmp_path, "set-a/7.txt", head + "00:00,RecordID,7\n00:00,Age,50\n00:00,Gender,-1\n00:07,HR,80\n00:50,HR,90\n60:00,Temp,37\n")
    written(tmp_path, "set-b/8.txt", head + "00:00,RecordID,8\n00:00,Age,60\n01:00,Temp,36\n")
    written(tmp_path, "set-a/9.txt", head + "00:00,RecordID,9\n00:00,Age,70\n")  # nothing observed
    written(tmp_path, "set-a/10.txt", head + "00:00,RecordID,10\n02:00,HR,70\n")  # no outcome
    for s, ids in (("a", (7, 9)), ("b", (8,))):
        written(tmp_path, f"Outcomes-{s}.txt", "RecordID,SAPS-I,SOFA,Length_of_stay,Survival,In-hospital_death\n" + "".join(f"{i},1,1,5,-1,{i % 2}\n" for i in ids))
    got = load(spark, "icu", tmp_path)
    assert set(got) == {7, 8} and got[7].is_train and not got[8].is_train and (got[7].label, got[8].label) == (1, 0)
    assert got[7].static == [50.0, None, None, None, None]
    assert got[7].series == [[85.0] + [None] * 47, [None] * 47 + [37.0]] and got[8].series[1][1] == 36.0


def test_ptbxl(spark, tmp_path):
    written(tmp_path, "scp_statements.csv", ",description,diagnostic,diagnostic_class\nNORM,normal,1.0,NORM\nIMI,x,1.0,MI\nAMI,x,1.0,MI\nSR,rhythm,,\n")
    rows, x = [], np.arange(24, dtype="<i2").reshape(12, 2)
    for i, (fold, codes, age) in enumerate([(1, "{'NORM': 100.0, 'SR': 0.0}", 56.0), (10, "{'IMI': 15.0, 'AMI': 0.0}", 300.0), (2, "{'NORM': 80.0, 'IMI': 1.0}", 5), (9, "{'NORM': 1.0}", 5), (3, "{'SR': 0.0}", 5), (8, "{'AMI': 1.0}", 70)], 1):
        name = f"records100/00000/{i:05d}_lr"
        rows.append(f'{i},{age},{i % 2},,60.5,"{codes}",{fold},{name},records500/00000/{i:05d}_hr')
        if i != 6:  # its files are missing
            written(tmp_path, f"{name}.hea", f"{i:05d}_lr 2 100 12\n" + "".join(f"{i:05d}_lr.dat 16 {g}(0)/mV 16 0 0 0 0 L\n" for g in (1000, 500)))
            written(tmp_path, f"{name}.dat", x.tobytes())
    written(tmp_path, "ptbxl_database.csv", "ecg_id,age,sex,height,weight,scp_codes,strat_fold,filename_lr,filename_hr\n" + "\n".join(rows) + "\n")
    got = load(spark, "ptbxl", tmp_path)
    assert set(got) == {1, 2} and got[1].static == [56.0, 1.0, None, 60.5] and got[2].static[0] == 90.0
    assert (got[1].label, got[1].is_train, got[2].label, got[2].is_train) == (1, True, 0, False)
    assert got[1].series[0] == [v / 1000 for v in range(0, 24, 2)] and got[1].series[1] == [v / 500 for v in range(1, 24, 2)]


def test_cpsc(spark, tmp_path):
    def record(i, samples, codes, age="47"):
        written(tmp_path, f"g1/A{i:04d}.hea", f"A{i:04d} 2 500 {samples}\n" + f"A{i:04d}.mat 16x1+24 1000/mV 16 0 0 0 0 I\n" * 2 + f"# Age: {age}\n# Sex: Male\n# Dx: {codes}\n")
        written(tmp_path, f"g1/A{i:04d}.mat", bytes(24) + np.repeat(np.arange(samples), 2).astype("<i2").tobytes())

    for i in range(6):
        record(i, 20, "30" if i % 2 else "20,99")  # 99 is rare: it occurs thrice
    record(6, 20, "20,30")
    record(7, 9, "20")  # too short
    record(8, 25, "30", "NaN")
    record(9, 20, "")
    written(tmp_path, "g1/A0100.hea", "nothing of the kind\n")
    written(tmp_path, "g1/A0100.mat", b"")
    got = load(spark, "cpsc2018", tmp_path, seconds=2, rate=10, k=5, least=4)
    assert set(got) == {f"A{i:04d}" for i in (0, 1, 2, 3, 4, 5, 8)}
    assert got["A0000"].label == 0 and got["A0001"].label == 1 and got["A0008"].static == [None, 1.0] and got["A0001"].static == [47.0, 1.0]
    assert np.allclose(got["A0008"].series, [[0.002, 0.007, 0.012, 0.017]] * 2)


def test_sleep(spark, tmp_path):
    body = np.array([[10 * e + v for v in (0, 1, 2, 3)] + [7] for e in range(8)])
    night = recordings.edf_file(["EEG Fpz-Cz", "EMG"], [4, 1], body, seconds=2.0)
    written(tmp_path, "SC4011E0-PSG.edf", night)
    notes = bytearray(recordings.edf_file(["EDF Annotations"], [1], np.zeros((0, 1), int)))
    notes[8:88] = b"X F X Female_33yr".ljust(80)
    marks = [(0, 6, "Sleep stage W"), (6, 2, "Sleep stage 4"), (8, 2, "Movement time"), (10, 2, "Sleep stage R"), (12, 90, "Sleep stage W")]
    written(tmp_path, "SC4011EC-Hypnogram.edf", bytes(notes) + b"".join(f"+{a}\x15{b}\x14{c}\x14\0".encode() for a, b, c in marks))
    written(tmp_path, "SC4021E0-PSG.edf", night)  # no annotations
    got = load(spark, "sleepedf", tmp_path, step=2.0, k=2, margin=1)
    assert {k: r.label for k, r in got.items()} == {"SC4011/2": 0, "SC4011/3": 3, "SC4011/5": 4, "SC4011/6": 0}
    assert got["SC4011/3"].series == [[30.5, 32.5]] and got["SC4011/3"].static == [33.0, 0.0] and got["SC4011/3"].group == 4011


def test_apnea(spark, tmp_path):
    word = lambda code, step: struct.pack("<H", code << 10 | step)
    for name in ("a01", "b02", "c03"):
        written(tmp_path, f"{name}.hea", f"{name} 1 1 200\n{name}.dat 16 100 12 0 0 0 0 ECG\n")
        written(tmp_path, f"{name}.dat", np.arange(200, dtype="<i2").tobytes())
        if name != "c03":
            written(tmp_path, f"{name}.apn", word(8, 1) + word(1, 60) + word(9, 10) + word(8, 110) + word(0, 0))
    written(tmp_path, "additional-information.txt", "header\na01\t489\t+470\tx\t51\tM\t175\t102\nb02\t1\ty\tz\t40\tF\t160\t64\nc03\t1\ty\tz\t40\tF\t160\t64\n")
    got = load(spark, "apnea", tmp_path, rate=1, k=2)
    assert {k: (r.label, r.group) for k, r in got.items()} == {"a01/1": (1, 1), "a01/61": (0, 1), "b02/1": (1, 102), "b02/61": (0, 102)}
    assert np.allclose(got["a01/61"].series, [[(61.5 + 2 * i) / 100 for i in range(30)]]) and got["b02/1"].static == pytest.approx([40.0, 0.0, 160.0, 64.0, 25.0])


def test_pamap(spark, tmp_path):
    def line(i, activity, gap=0):
        return " ".join([f"{i / 100:.2f}", str(activity), "NaN", *(str(c + i) if (c, i) != (4, 3) else "NaN" for c in range(3, 54))])

    plan = [1] * 12 + [0] * 3 + [1] * 9 + [24] * 6 + [9] * 30
    text = "\n".join(line(i, a) for i, a in enumerate(plan)) + "\n"
    written(tmp_path, "PAMAP2_Dataset/Protocol/subject101.dat", text)
    written(tmp_path, "PAMAP2_Dataset/Protocol/subject200.dat", text)
    written(tmp_path, "PAMAP2_Dataset/Optional/subject102.dat", text)
    got = list(load(spark, "pamap2", tmp_path, every=3, length=2).values())
    # steps 0..3 and 5..7 of activity 1 (two windows and one), 8..9 of activity 24 (one)
    assert sorted((r.label, r.series[8][0]) for r in got) == [(0, 40.0), (0, 46.0), (0, 55.0), (1, 64.0)]
    first = min(got, key=lambda r: r.series[8][0])
    assert first.series[0] == [4.0, None] and len(first.series) == 9 and first.static == datasets.PAMAP_SUBJECTS[101] and first.group == 101


def test_uea(spark, tmp_path):
    text = "@problemName p\n@data\n1,?,3:4,5,6:b\n7,8,9:1,1,1:a\n"
    written(tmp_path, "P_TRAIN.ts", text)
    written(tmp_path, "P_TEST.ts", "@data\n0,0,0:0,0,0:b\n")
    got = load(spark, "uea", tmp_path)
    assert {k: (r.label, r.is_train, r.static) for k, r in got.items()} == {"train/0": (1, True, []), "train/1": (0, True, []), "test/0": (1, False, [])}
    assert got["train/0"].series == [[1.0, None, 3.0], [4.0, 5.0, 6.0]]


def test_unknown_names(spark):
    with pytest.raises(ValueError, match="unknown data set"):
        datasets.load(spark, "other", "/nowhere")
