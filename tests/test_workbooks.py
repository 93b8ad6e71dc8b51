"""Binary workbooks made here byte by byte: sector chains, small streams, continued texts, packed numbers."""

import io
import struct
import zipfile

import pytest

from rowtrail.sources import datasets, workbooks


def compound(stream, name="Workbook", sector=512):
    """A compound file with one stream, its sectors chained back to front so that order comes from the chain alone."""
    small = len(stream) < 4096
    end, free, table = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD
    body = stream.ljust(-(-len(stream) // 64) * 64, b"\0") if small else stream
    k = -(-len(body) // sector)
    parts = [body[i * sector : (i + 1) * sector].ljust(sector, b"\0") for i in range(k)]
    # sectors: k of the stream in reverse, then the listing, then the table of small chains
    links = [i - 1 if i else end for i in range(k)] + [end, end]
    tables = 1
    while tables * (sector // 4) < len(links) + tables:
        tables += 1
    links += [table] * tables
    fat = struct.pack(f"<{len(links)}I", *links).ljust(tables * sector, b"\xff")
    entry = lambda n, kind, start, size: n.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB3I", 2 * len(n) + 2, kind, 1, free, free, free) + bytes(36) + struct.pack("<IQ", start, size)
    listing = entry("Root Entry", 5, k - 1 if small else end, len(body) if small else 0) + entry(name, 2, 0 if small else k - 1, len(stream)) + bytes(256)
    pieces = len(body) // 64
    mini = struct.pack(f"<{pieces}I", *[*range(1, pieces), end]) if small else b""
    head = workbooks.SIGNATURE + bytes(16) + struct.pack("<5H", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<9I", 0, tables, k, 0, 4096, k + 1 if small else end, int(small), end, 0)
    head += struct.pack("<109I", *[k + 2 + i for i in range(tables)], *[free] * (109 - tables))
    return head + b"".join(reversed(parts)) + listing + mini.ljust(sector, b"\xff") + fat


def record(number, body=b""):
    return struct.pack("<HH", number, len(body)) + body


def cell(number, row, column, body):
    return record(number, struct.pack("<HHH", row, column, 0) + body)


def packed_number(value, hundredths=False):
    return struct.pack("<I", (value << 2 & 0xFFFFFFFF) | 2 | hundredths)


def book(sheet_records, texts=(), sst=None):
    bof = record(workbooks.BOF, struct.pack("<HH", 0x600, 5) + bytes(12))
    if sst is None:
        sst = record(workbooks.SST, struct.pack("<II", len(texts), len(texts)) + b"".join(struct.pack("<HB", len(t), 0) + t.encode("latin-1") for t in texts))
    bound = lambda at: record(workbooks.BOUNDSHEET, struct.pack("<IBB", at, 0, 0) + b"\x01\x00S")
    at = len(bof) + len(bound(0)) + len(sst) + 4
    sheet = record(workbooks.BOF, struct.pack("<HH", 0x600, 16) + bytes(12)) + b"".join(sheet_records) + record(workbooks.EOF)
    return bof + bound(at) + sst + record(workbooks.EOF) + sheet


def test_all_kinds_of_cells():
    cells = [
        cell(workbooks.LABELSST, 0, 0, struct.pack("<I", 1)), cell(workbooks.LABEL, 0, 1, struct.pack("<HB", 2, 1) + "é€".encode("utf-16-le")),
        cell(workbooks.NUMBER, 1, 0, struct.pack("<d", 2.5)), cell(workbooks.RK, 1, 1, packed_number(-7)), cell(workbooks.RK, 1, 2, packed_number(1234, True)),
        cell(workbooks.RK, 1, 3, struct.pack("<I", struct.unpack("<Q", struct.pack("<d", 1.5))[0] >> 32)),
        record(workbooks.MULRK, struct.pack("<HH", 3, 2) + b"".join(b"\0\0" + packed_number(v) for v in (4, 5)) + struct.pack("<H", 3)),
        cell(workbooks.FORMULA, 4, 0, struct.pack("<d", 9.0) + bytes(8)), cell(workbooks.FORMULA, 4, 1, b"\0\0\0\0\0\0\xff\xff" + bytes(8)), record(workbooks.STRING, struct.pack("<HB", 3, 0) + b"sum"),
        cell(workbooks.BOOLERR, 4, 2, b"\x01\x00"), cell(workbooks.BOOLERR, 4, 3, b"\x2a\x01"), cell(workbooks.NUMBER, 4, 4, struct.pack("<d", float("nan"))),
    ]
    data = compound(book(cells, ["no", "AGE"]))
    assert workbooks.xls_cells(data) == [{0: "AGE", 1: "é€"}, {0: "2.5", 1: "-7", 2: "12.34", 3: "1.5"}, {}, {2: "4", 3: "5"}, {0: "9", 1: "sum", 2: "1"}]


def test_texts_continued_in_the_next_record():
    first = struct.pack("<II", 3, 3) + struct.pack("<HB", 2, 0) + b"ab" + struct.pack("<HBH", 5, 8, 1) + b"cd"
    second = b"\x01" + "e€f".encode("utf-16-le") + b"\0\0"  # the rest is wide now, and the formatting run is cut too
    third = b"\0\0" + struct.pack("<HB", 1, 0) + b"z"
    sst = record(workbooks.SST, first) + record(workbooks.CONTINUE, second) + record(workbooks.CONTINUE, third)
    data = compound(book([cell(workbooks.LABELSST, 0, k, struct.pack("<I", k)) for k in range(3)], sst=sst))
    assert workbooks.xls_cells(data) == [{0: "ab", 1: "cde€f", 2: "z"}]


def test_long_streams_and_damage():
    rows = 12_000
    stream = book([cell(workbooks.NUMBER, i, 0, struct.pack("<d", i + 0.5)) for i in range(rows)])
    data = compound(stream)
    assert [float(x[0]) for x in workbooks.xls_cells(data)] == [i + 0.5 for i in range(rows)]
    with pytest.raises(ValueError):
        workbooks.xls_cells(data[: len(data) // 2])
    with pytest.raises(ValueError, match="no stream"):
        workbooks.xls_cells(compound(stream, "Other"))
    with pytest.raises(ValueError, match="encrypted"):
        workbooks.xls_cells(compound(book([], sst=record(workbooks.FILEPASS, bytes(6)))))
    with pytest.raises(ValueError, match="not a compound"):
        workbooks.compound_stream(b"PK", "Workbook")
    assert workbooks.workbook_rows(compound(book([])), 1) == []
    loop = bytearray(compound(book([cell(workbooks.NUMBER, 0, 0, bytes(8))] * 500)))
    at = struct.unpack_from("<I", loop, 76)[0]
    struct.pack_into("<I", loop, (at + 1) * 512, 1)  # the last sector's link leads back
    with pytest.raises(ValueError, match="damaged"):
        workbooks.xls_cells(bytes(loop))


def credit_book(n):
    names = ["ID", "LIMIT_BAL", "SEX", "EDUCATION", "MARRIAGE", "AGE", "PAY_0", *[f"PAY_{i}" for i in range(2, 7)], *[f"BILL_AMT{i}" for i in range(1, 7)], *[f"PAY_AMT{i}" for i in range(1, 7)], "default payment next month"]
    texts = ["X", *names]
    head = [cell(workbooks.LABELSST, 0, 0, struct.pack("<I", 0))] + [cell(workbooks.LABELSST, 1, k, struct.pack("<I", k + 1)) for k in range(len(names))]
    lines = [cell(workbooks.RK, 2 + i, k, packed_number(i % 2 if k == 24 else 100 * i + k)) for i in range(n) for k in range(25)]
    return compound(book(head + lines, texts))


def test_credit_from_an_archive(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("default of credit card clients.xls", credit_book(40))
    (tmp_path / "credit.zip").write_bytes(out.getvalue())
    rows = datasets.load(spark, "credit", str(tmp_path)).orderBy("row_id").collect()
    assert len(rows) == 40 and rows[3].row_id == 300 and rows[3].label == 1
    assert rows[0].static == [1, 2, 3, 4, 5] and rows[0].series == [[11, 10, 9, 8, 7, 6], [17, 16, 15, 14, 13, 12], [23, 22, 21, 20, 19, 18]]
