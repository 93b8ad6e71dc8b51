"""Rows of spreadsheets: old binary workbooks (sheet records in a compound file) and those made of XML.

A workbook is one row of a table of files and is decoded within its task; ``datasets.workbook`` runs this over archives.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

#: Fixed values of the compound-file format: its first bytes, the end of a chain, the size under which a stream is small.
SIGNATURE = bytes.fromhex("D0CF11E0A1B11AE1")
NO_SECTOR = 0xFFFFFFFA  # this and all above are marks, not sectors

#: The numbers of the sheet records that are read.
BOF, EOF, FILEPASS, BOUNDSHEET, SST, CONTINUE = 0x809, 0x0A, 0x2F, 0x85, 0xFC, 0x3C
NUMBER, RK, MULRK, LABELSST, LABEL, FORMULA, STRING, BOOLERR = 0x203, 0x27E, 0xBD, 0xFD, 0x204, 0x06, 0x207, 0x205


def compound_stream(data: bytes, *names: str) -> bytes:
    """The stream of the first of the names that a compound file holds; damaged chains and unknown names are errors."""
    if not data.startswith(SIGNATURE) or len(data) < 512:
        raise ValueError("not a compound file")
    size, small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    first_dir, _, limit, first_small = struct.unpack_from("<4I", data, 48)

    def sector(i: int) -> bytes:
        part = data[(i + 1) * size : (i + 2) * size]
        if not part:
            raise ValueError(f"sector {i} lies behind the end of the file")
        return part

    def chain(start: int, links: tuple[int, ...]) -> Iterator[int]:
        seen = 0
        while start < NO_SECTOR:
            if start >= len(links) or seen > len(links):
                raise ValueError("damaged chain of sectors")
            yield start
            start, seen = links[start], seen + 1

    # the sectors that hold the table of chains: 109 in the header, the rest in a list of sectors of its own
    numbers = lambda raw: struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])
    tables, more, seen = list(numbers(data[76:512])), struct.unpack_from("<I", data, 68)[0], 0
    while more < NO_SECTOR:
        *own, more = numbers(sector(more))
        tables += own
        seen += 1
        if seen * size > len(data):
            raise ValueError("damaged list of tables")
    links = numbers(b"".join(sector(t) for t in tables if t < NO_SECTOR))
    whole = lambda start: b"".join(sector(i) for i in chain(start, links))

    entries = {}
    listing = whole(first_dir)
    for at in range(0, len(listing) - 127, 128):
        length, kind = struct.unpack_from("<HB", listing, at + 64)
        if kind in (2, 5):
            name = "" if kind == 5 else listing[at : at + max(0, length - 2)].decode("utf-16-le").lower()
            entries[name] = struct.unpack_from("<II", listing, at + 116)
    found = next((entries[n.lower()] for n in names if n.lower() in entries), None)
    if found is None:
        raise ValueError(f"no stream {' or '.join(names)}")
    start, length = found
    if length >= limit:
        return whole(start)[:length]
    held, small_links = whole(entries[""][0]), numbers(whole(first_small))
    return b"".join(held[i * small : (i + 1) * small] for i in chain(start, small_links))[:length]


def sheet_records(stream: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(number, parts) of the records from a place to the end of their substream; parts after the first are continuations."""
    depth, kind, parts = 0, None, []
    while at + 4 <= len(stream):
        number, length = struct.unpack_from("<HH", stream, at)
        body = stream[at + 4 : at + 4 + length]
        at += 4 + length
        if number == CONTINUE:
            parts.append(body)
            continue
        if kind is not None:
            yield kind, parts
        depth += (number == BOF) - (number == EOF)
        kind, parts = number, [body]
        if depth <= 0:
            break
    if kind is not None:
        yield kind, parts


class _Parts:
    """Reads over the parts of a continued record; a text that goes on in the next part has its width said again there."""

    def __init__(self, parts: list[bytes]) -> None:
        self.parts, self.part, self.at = parts, 0, 0

    def _left(self) -> int:
        while self.part < len(self.parts) - 1 and self.at >= len(self.parts[self.part]):
            self.part, self.at = self.part + 1, 0
        left = len(self.parts[self.part]) - self.at
        if left <= 0:
            raise ValueError("a record of texts ends too early")
        return left

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            k = min(n - len(out), self._left())
            out += self.parts[self.part][self.at : self.at + k]
            self.at += k
        return out

    def text(self) -> str:
        length, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = "", flags & 1
        while length:
            before = self.part
            left = self._left()
            if self.part != before:
                wide = self.take(1)[0] & 1
                left = self._left()
            k = min(length, left // (2 if wide else 1))
            if not k:
                raise ValueError("a character is cut in two")
            out += self.take(k * 2).decode("utf-16-le", "replace") if wide else self.take(k).decode("latin-1")
            length -= k
        self.take(4 * runs + extra)
        return out


def _short(value: int) -> float:
    """A number packed in 32 bits: the upper bits of a double or 30 bits of an integer, times one or a hundredth."""
    whole = float((value - (1 << 32) if value & 1 << 31 else value) >> 2) if value & 2 else struct.unpack("<d", struct.pack("<Q", (value & ~3) << 32))[0]
    return whole / 100 if value & 1 else whole


def _shown(value: float) -> str | None:
    if value - value != 0:  # not a number, or infinite
        return None
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def xls_cells(data: bytes) -> list[dict[int, str]]:
    """The lines of the first sheet of a binary workbook (version 8), each its cells' texts by column; empty lines are {}."""
    stream = compound_stream(data, "Workbook", "Book")
    texts, sheet = [], None
    for number, parts in sheet_records(stream):
        if number == BOF and parts[0][:2] != b"\x00\x06":
            raise ValueError("only workbooks of version 8 are read")
        if number == FILEPASS:
            raise ValueError("the workbook is encrypted")
        if number == BOUNDSHEET and sheet is None and parts[0][5] == 0:
            sheet = struct.unpack_from("<I", parts[0])[0]
        if number == SST:
            r = _Parts(parts)
            texts = [r.text() for _ in range(struct.unpack("<II", r.take(8))[1])]
    if sheet is None:
        raise ValueError("no sheet in the workbook")
    lines: dict[int, dict[int, str]] = {}
    waiting = None  # the cell of a formula whose text is the next record
    for number, parts in sheet_records(stream, sheet):
        b = parts[0]
        if number == STRING and waiting:
            lines.setdefault(waiting[0], {})[waiting[1]] = _Parts(parts).text()
        if number not in (NUMBER, RK, MULRK, LABELSST, LABEL, FORMULA, BOOLERR):
            continue
        row, column = struct.unpack_from("<HH", b)
        put = lambda text, k=column: lines.setdefault(row, {}).update({k: text}) if text is not None else None  # noqa: B023, E731
        waiting = None
        if number == NUMBER:
            put(_shown(struct.unpack_from("<d", b, 6)[0]))
        elif number == RK:
            put(_shown(_short(struct.unpack_from("<I", b, 6)[0])))
        elif number == MULRK:
            for k in range((len(b) - 6) // 6):
                put(_shown(_short(struct.unpack_from("<I", b, 6 + 6 * k)[0])), column + k)
        elif number == LABELSST:
            put(texts[struct.unpack_from("<I", b, 6)[0]])
        elif number == LABEL:
            put(_Parts([b[6:], *parts[1:]]).text())
        elif number == BOOLERR:
            put(None if b[7] else str(b[6]))
        elif b[12:14] != b"\xff\xff":
            put(_shown(struct.unpack_from("<d", b, 6)[0]))
        elif b[6] == 0:
            waiting = (row, column)
        elif b[6] == 1:
            put(str(b[8]))
    return [lines.get(i, {}) for i in range(max(lines, default=-1) + 1)]


def xlsx_cells(data: bytes) -> list[dict[str, str]]:
    """The lines of the first sheet of a workbook made of XML, each its cells' texts by the column's letters."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(space + "t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(space + "si")]
        sheet = min(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        lines = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(space + "row"):
            cells = {}
            for c in row.iter(space + "c"):
                v = c.find(space + "v")
                text = "".join(t.text or "" for t in c.iter(space + "t")) if v is None else v.text
                cells[re.match(r"[A-Z]+", c.get("r"))[0]] = shared[int(text)] if c.get("t") == "s" else text
            lines.append(cells)
    return lines


def workbook_rows(data: bytes, header: int = 0) -> list[dict[str, str]]:
    """Rows of a workbook's first sheet as dictionaries by the names in line ``header``; all values as texts."""
    lines = xls_cells(data) if data.startswith(SIGNATURE) else xlsx_cells(data)
    if header >= len(lines):
        return []
    names = lines[header]
    return [{names[k]: v for k, v in line.items() if k in names} for line in lines[header + 1 :] if line]
