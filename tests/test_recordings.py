import struct

import numpy as np
import pytest

from rowtrail.sources import recording_source, recordings


def test_wfdb16_and_annotations(spark, tmp_path):
    header = "r1 2 100 4\nr1.dat 16 200(10)/mV 16 0 0 0 0 I\nr1.dat 16 100/mV 16 0 0 0 0 II\n# note\n"
    data = np.array([[210, 100], [410, -100], [-32768, 0], [10, 50]], "<i2").tobytes()
    x = recordings.wfdb16(header, data)
    assert np.allclose(x[0, [0, 1, 3]], [1, 2, 0]) and np.isnan(x[0, 2]) and np.allclose(x[1], [1, -1, 0, 0.5])
    with pytest.raises(ValueError):
        recordings.wfdb16(header.replace(" 16 200", " 212 200"), data)
    word = lambda code, step: struct.pack("<H", code << 10 | step)
    stream = word(8, 100) + word(59, 0) + struct.pack("<HH", 1, 2) + word(1, 5) + word(63, 3) + b"abc\0" + word(62, 7) + word(8, 1) + word(0, 0)
    assert recordings.wfdb_annotations(stream) == [(100, 8), (100 + 65538 + 5, 1), (100 + 65538 + 6, 8)]
    (tmp_path / "a.atr").write_bytes(stream)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = recordings.decode_files(files, lambda p, b: [(s, c) for s, c in recordings.wfdb_annotations(b)], "sample long, code int")
    assert [tuple(r) for r in got.orderBy("sample").collect()] == recordings.wfdb_annotations(stream)


def test_edf():
    field = lambda v, n: str(v).ljust(n).encode()
    head = field("0", 8) + field("patient", 80) + field("rec", 80) + field("01.01.2400.00.00", 16) + field(256 + 512, 8) + field("", 44) + field(2, 8) + field(1, 8) + field(2, 4)
    per = [("A", "B"), ("", ""), ("uV", "uV"), (-100, -1), (100, 1), (-1000, -10), (1000, 10), ("", ""), (3, 1), ("", "")]
    widths = [16, 80, 8, 8, 8, 8, 8, 80, 8, 32]
    for pair, w in zip(per, widths):
        head += b"".join(field(v, w) for v in pair)
    body = np.array([0, 1000, -1000, 5, 10, 20, 30, -10], "<i2").tobytes()
    h = recordings.edf_header(head + body)
    assert h["records"] == 2 and [s["samples"] for s in h["signals"]] == [3, 1]
    assert np.allclose(recordings.edf_signal(head + body, 0), [0, 100, -100, 1, 2, 3]) and np.allclose(recordings.edf_signal(head + body, 1), [0.5, -1])
    tal = b"+0\x14\x14\x00+30\x1560\x14Stage W\x14\x00+90.5\x14Stage 2\x14\x00"
    assert recordings.edf_annotations(tal) == [(30.0, 60.0, "Stage W"), (90.5, 0.0, "Stage 2")]


@pytest.mark.parametrize("step", [1, 7, 300, 1 << 20])
def test_ranges_of_any_size_give_the_same_samples(spark, tmp_path, step):
    r = np.random.default_rng(1)
    body = r.integers(-3000, 3000, (9, 5))
    (tmp_path / "sub").mkdir()
    edf = recordings.edf_file(["A", "EDF Annotations", "B"], [3, 1, 1], body, seconds=2.0)
    (tmp_path / "sub" / "x.edf").write_bytes(edf + b"\x01")  # half a number too many
    wave = r.integers(-500, 500, (40, 2)).astype("<i2")
    wave[7, 1] = -32768
    header = "r 2 50 38\nr.dat 16 200(10)/mV 16 0 0 0 0 I\nr.dat 16 100/mV 16 0 0 0 0 II\n"
    (tmp_path / "r.hea").write_text(header)
    (tmp_path / "r.dat").write_bytes(wave.tobytes())
    (tmp_path / "lonely.hea").write_text(header)
    (tmp_path / "note.txt").write_text("no recording")
    rows = recording_source.read_recordings(spark, str(tmp_path), step).collect()
    found: dict = {}
    for x in sorted(rows, key=lambda x: x.start):
        held = found.setdefault((x.path.split("/")[-1], x.channel, x.rate), [])
        assert x.start == len(held)
        held += x.samples
    assert found.keys() == {("x.edf", "A", 1.5), ("x.edf", "B", 0.5), ("r.dat", "I", 50.0), ("r.dat", "II", 50.0)}
    assert np.allclose(found["x.edf", "A", 1.5], recordings.edf_signal(edf, 0)) and np.allclose(found["x.edf", "A", 1.5], body[:, :3].ravel())
    assert np.allclose(found["x.edf", "B", 0.5], body[:, 4])
    want = recordings.wfdb16(header, wave.tobytes())
    for i, c in enumerate(("I", "II")):
        assert np.allclose([np.nan if v is None else v for v in found["r.dat", c, 50.0]], want[i], equal_nan=True) and len(want[i]) == 38
    if step == 7:
        assert len(rows) > 20  # many tasks had a part


def test_folders_without_recordings(spark, tmp_path):
    assert recording_source.read_recordings(spark, str(tmp_path)).count() == 0
    (tmp_path / "empty.edf").write_bytes(b"too short")
    with pytest.raises(Exception, match="no whole header"):
        recording_source.read_recordings(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError, match="numbers for signals"):
        recordings.edf_file(["A"], [2], np.zeros((3, 3)))
    flat = dict(dmin=0.0, dmax=0.0, pmin=0.0, pmax=5.0)
    assert recordings.edf_scaled(np.array([1, 2]), flat).tolist() == [5.0, 10.0]
