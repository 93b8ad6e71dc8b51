"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier are removed.

Every string of ``LENGTH`` bytes holds an anchor, a position chosen by content alone, at the same place in each of its
occurrences.  So it is enough to compare the surroundings of equal anchors:

1. each task finds its anchors and drops those whose whole surroundings it has seen before;
2. equal anchors meet in one shuffle of hashes; equal surroundings are settled there, by two independent hashes modulo
   a prime of 61 bits: two different ones of 176 bytes pass for equal with a chance of (176 / 2^61)^2, about 6e-33;
3. anchors that meet in different surroundings are fetched as bytes, and their suffixes and reversed prefixes are
   sorted by a mergesort whose comparisons find the common extension by binary search over prefix polynomial hashes;
   the extensions of neighbours are then verified on the bytes;
4. what is covered goes back to the splits that hold the texts, and is cut out there.

Texts are scanned three times and never shuffled.  Memory in a task depends on the anchors it holds, not on a text's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK_ROWS, PRIME, SideTable, by_block, hot_join, mix, placed, powers, prefix_hashes, scanned, slices, small_batches, span_hashes, spread, times, written

#: Length of a string that counts, of the piece that is an anchor, and the most bytes of a string before its anchor.
LENGTH, ANCHOR = 100, 24
LEFT = LENGTH - ANCHOR
_TOP = np.uint64(2**64 - 1)
_STEP = 1 << 18


def _sliding(a: np.ndarray, width: int, best) -> np.ndarray:
    """best over a[i : i + width] for each i (shorter at the end), by doubling."""
    a, done = a.copy(), 1
    while 2 * done <= width:
        a[:-done] = best(a[:-done], a[done:])
        done *= 2
    if width > done and len(a) > width - done:
        a[: len(a) - (width - done)] = best(a[: len(a) - (width - done)], a[width - done :])
    return a


def find_anchors(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes of the anchors, two hashes of their surroundings) in texts laid end to end.

    A position is an anchor if its piece has the least hash of some string of ``LENGTH`` bytes (all, on ties).  The
    surroundings are the bytes that a string around the anchor can reach, cut at the text's borders.
    """
    n = len(raw)
    if n < LENGTH:
        return np.zeros(0, np.int64), *(np.zeros(0, np.uint64),) * 3
    s = prefix_hashes(raw)
    lens = np.diff(off)
    begin, end = np.repeat(off[:-1], lens), np.repeat(off[1:], lens)
    i = np.arange(n)
    g = np.full(n, _TOP, np.uint64)
    g[: n - ANCHOR + 1] = span_hashes(s, i[: n - ANCHOR + 1], i[: n - ANCHOR + 1] + ANCHOR)
    whole = i + ANCHOR <= end
    g[~whole] = _TOP
    least = _sliding(g, LEFT + 1, np.minimum)
    least[i + LENGTH > end] = 0
    most = _sliding(least[::-1], LEFT + 1, np.maximum)[::-1]
    at = np.flatnonzero((most == g) & whole)
    lo, hi = np.maximum(at - LEFT, begin[at]), np.minimum(at + LENGTH, end[at])
    place = (at - lo).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    around = [mix(span_hashes(prefix_hashes(raw, lane) if lane else s, lo, hi, lane) + place) for lane in (0, 1)]
    return at, g[at], *around


def anchors_of(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``find_anchors`` of any amount of text in bounded memory: a long text is seen through windows of ``_STEP`` bytes.

    What decides about a position lies within ``LENGTH`` bytes of it, so windows that reach so far beyond what they
    answer for give what the whole text would.
    """
    n = int(off[-1])
    if n <= 2 * _STEP:
        yield find_anchors(raw, off)
        return
    for a in range(0, n, _STEP):
        lo, hi = max(0, a - LENGTH), min(n, a + _STEP + LENGTH)
        inner = off[(off > lo) & (off < hi)]
        at, *hashes = find_anchors(raw[lo:hi], np.concatenate([[0], inner - lo, [hi - lo]]))
        mine = (at + lo >= a) & (at + lo < a + _STEP)
        yield at[mine] + lo, *(h[mine] for h in hashes)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(block, rows' numbers, rows, bytes, offsets) of bounded parts of a batch, each within one block."""
    for same in by_block(batch):
        block = same.column("block")[0].as_py()
        for part, raw, off in slices(same, "text", _STEP):
            yield block, np.asarray(part.column("ord")).astype(np.int64), part, raw, off


_HITS = ["h", "around", "again", "doc_id", "block", "ord", "start", "end"]
_HITS_SCHEMA = "h long, around long, again long, doc_id long, block long, ord int, start int, end int"
_HITS_TYPES = [*[pa.int64()] * 5, *[pa.int32()] * 3]
_LAST_ID = 2**63 - 1
#: Anchors that a task holds before it settles them among themselves.
_HELD = 1 << 20


def _batch(columns: list, names: list[str] = _HITS, types: list = _HITS_TYPES) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _join_spans(ords: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of each row joined; the input in any order."""
    if not len(ords):
        return ords, start, end
    base = ords.astype(np.int64) << 32
    order = np.lexsort((start, ords))
    a, b = (base + start)[order], (base + end)[order]
    reach = np.maximum.accumulate(b)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a)) - 1
    mask = (1 << 32) - 1
    return (a[first] >> 32).astype(np.int64), a[first] & mask, reach[last] & mask


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: anchors (end 0), the first of each surroundings among up to ``_HELD``; spans of the others (start < end)."""
    held: list[tuple] = []
    count = 0

    def settle() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        h, around, again, doc, block, ords, pos = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((pos, doc, again, around, h))
        h, around, again, doc, block, ords, pos = (x[order] for x in (h, around, again, doc, block, ords, pos))
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (around[1:] != around[:-1]) | (again[1:] != again[:-1])
        head = np.flatnonzero(first)[np.cumsum(first) - 1]
        later = ~first & ((doc != doc[head]) | (pos != pos[head]))  # a repeated id's equal start isn't earlier
        blocks, number = np.unique(block[later], return_inverse=True)
        k, lo, hi = _join_spans(number << 13 | ords[later], np.maximum(pos[later] - LEFT, 0), pos[later] + LENGTH)
        zero = np.zeros(len(k), int)
        yield _batch([mix(k.astype(np.uint64)).view(np.int64), zero, zero, zero, blocks[k >> 13] if len(k) else zero, k & (BLOCK_ROWS - 1), lo, hi])
        stay = np.flatnonzero(~later)
        for i in range(0, len(stay), 50_000):
            q = stay[i : i + 50_000]
            yield _batch([*(x[q].view(np.int64) for x in (h, around, again)), doc[q], block[q], ords[q], pos[q], np.zeros(len(q), int)])

    for batch in batches:
        for block, ords, part, raw, off in _parts(batch):
            ids = np.asarray(part.column("doc_id").fill_null(_LAST_ID))
            for at, h, around, again in anchors_of(raw, off):
                if len(at):
                    text = np.searchsorted(off, at, side="right") - 1
                    held.append((h, around, again, ids[text], np.full(len(at), block), ords[text], at - off[text]))
                    count += len(at)
                    if count >= _HELD:
                        yield from settle()
                        count = 0
    yield from settle()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task over rows sorted by (h, around, again, doc_id, start): spans of repeated surroundings, and anchors to look into.

    A stream: of a key's rows only the first is kept.  Out come spans (start < end) and wanted anchors (end 0): the
    first of each surroundings, where the anchor has several.
    """
    last = None  # h, around, again of the last row; doc and pos of the first with them
    pending, pending_h = None, None  # the last surroundings' first row, not yet wanted
    for batch in batches:
        c = {n: np.asarray(batch.column(n)) for n in _HITS}
        spans = c["end"] > 0
        yield batch.filter(pa.array(spans))
        c = {n: v[~spans] for n, v in c.items()}
        m = len(c["h"])
        if not m:
            continue
        h, key = c["h"], (c["h"], c["around"], c["again"])
        new = np.ones(m, bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in key], axis=0)
        if last is not None:
            new[0] = tuple(x[0] for x in key) != last[:3]
        reps = np.flatnonzero(new)
        group = np.cumsum(new) - 1  # -1: goes on from the batch before
        doc0 = np.where(group >= 0, c["doc_id"][reps[np.maximum(group, 0)]] if len(reps) else 0, last[3] if last else 0)
        pos0 = np.where(group >= 0, c["start"][reps[np.maximum(group, 0)]] if len(reps) else 0, last[4] if last else 0)
        later = ~new & ((c["doc_id"] != doc0) | (c["start"] != pos0))
        q = np.flatnonzero(later)
        yield _batch([*(c[n][q] for n in _HITS[:6]), np.maximum(c["start"][q] - LEFT, 0), c["start"][q] + LENGTH])
        same = ~new & ~later  # another row of the same id: as good as the first
        take = np.zeros(m, bool)
        if len(reps):
            rh = h[reps]
            before = np.concatenate([[pending_h is not None and rh[0] == pending_h], rh[1:] == rh[:-1]])
            after = np.append(rh[1:] == rh[:-1], False)
            take[reps[before | after]] = True
            if before[0] and pending is not None:
                yield pending
            tail = reps[-1]
            pending = None if take[tail] else _batch([c[n][tail : tail + 1] for n in _HITS[:-1]] + [np.zeros(1, int)])
            pending_h = h[tail]
        take |= same
        w = np.flatnonzero(take)
        yield _batch([c[n][w] for n in _HITS[:-1]] + [np.zeros(len(w), int)])
        last = (*(x[-1] for x in key), doc0[-1], pos0[-1])


_SIDES = ["h", "doc_id", "block", "ord", "pos", "before", "piece"]
_SIDES_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
#: Anchors with so many different surroundings aren't sorted as one group, which would grow with the corpus: each of
#: their strings goes to the task of its own hash instead, and two independent hashes of 61 bits decide there.
CROWD = 8192


def _strings(pieces: np.ndarray, at: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which anchor, start in its row, two hashes) of every whole string around anchors, whose surroundings are rows."""
    start = at[:, None] - np.arange(LEFT + 1)
    fits = (start >= 0) & (start + LENGTH <= lens[:, None])
    which, start = np.nonzero(fits)[0], start[fits]
    width = pieces.shape[1] + 1
    flat = [prefix_hashes(pieces, lane).ravel() for lane in (0, 1)]
    down = which * width + start
    # every row's sums begin at its own first byte, so a span is taken back to that by its start within the row
    return which, start, *(row_spans(flat[lane], down, start, lane) for lane in (0, 1))


def row_spans(flat: np.ndarray, at: np.ndarray, start: np.ndarray, lane: int) -> np.ndarray:
    """Hashes of the strings at ``at`` in the laid-out sums of many rows, at ``start`` within their rows."""
    diff = flat[at + LENGTH] + (np.uint64(PRIME) - flat[at])
    return mix(times(np.minimum(diff, diff - np.uint64(PRIME)), powers(LENGTH + LEFT + 1, lane)[1][start]))


def _wanted_here(table: dict[str, np.ndarray], ords: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of a table sorted by ord, positions in ``ords``) of those that lie in a part of a scan."""
    i, j = np.searchsorted(table["ord"], [ords[0], ords[-1] + 1])
    text = np.minimum(np.searchsorted(ords, table["ord"][i:j]), len(ords) - 1)
    found = ords[text] == table["ord"][i:j]
    return np.arange(i, j)[found], text[found]


def _fetch(wanted: SideTable, crowd: bool):
    """Task: the bytes around the wanted anchors of its blocks; or, for crowded anchors, the hashes of their strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_block, table = None, None
        for batch in batches:
            for block, ords, part, raw, off in _parts(batch):
                if block != at_block:
                    at_block, t = block, wanted.load(block)
                    table = None
                    if t is not None:
                        c = {n: np.asarray(t.column(n)) for n in ("h", "doc_id", "ord", "start", "crowd")}
                        order = np.argsort(c["ord"], kind="stable")
                        order = order[c["crowd"][order] == crowd]
                        table = {n: v[order] for n, v in c.items()}
                if table is None:
                    continue
                rows, text = _wanted_here(table, ords)
                for k in range(0, len(rows), 2048):
                    q, own = rows[k : k + 2048], text[k : k + 2048]
                    at = off[own] + table["start"][q]
                    lo, hi = np.maximum(at - LEFT, off[own]), np.minimum(at + LENGTH, off[own + 1])
                    if not crowd:
                        piece = [raw[a:b].tobytes() for a, b in zip(lo.tolist(), hi.tolist())]
                        yield _batch([table["h"][q], table["doc_id"][q], np.full(len(q), block), table["ord"][q], table["start"][q], at - lo, piece], _SIDES, _SIDES_TYPES)
                        continue
                    bytes_ = raw[np.minimum(lo[:, None] + np.arange(LENGTH + LEFT), len(raw) - 1)]
                    which, start, h, again = _strings(bytes_, at - lo, hi - lo)
                    doc, number, begin = table["doc_id"][q][which], table["ord"][q][which], start + (lo - off[own])[which]
                    first = np.lexsort((begin, doc, again, h))  # neighbouring anchors share strings: each once
                    h, again, doc, number, begin = (x[first] for x in (h, again, doc, number, begin))
                    new = np.append(True, (h[1:] != h[:-1]) | (again[1:] != again[:-1]) | (doc[1:] != doc[:-1]) | (begin[1:] != begin[:-1]) | (number[1:] != number[:-1]))
                    m = int(new.sum())
                    yield _batch([h[new].view(np.int64), np.zeros(m, int), again[new].view(np.int64), doc[new], np.full(m, block), number[new], begin[new], np.zeros(m, int)])

    return run


def _repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task over strings sorted by (h, again, doc_id, start): spans of all but the first of each.  A stream, too."""
    last = None
    for batch in batches:
        h, again, doc, start, block, ords = (np.asarray(batch.column(n)) for n in ("h", "again", "doc_id", "start", "block", "ord"))
        if not len(h):
            continue
        new = np.append(last is None or (h[0], again[0]) != last[:2], (h[1:] != h[:-1]) | (again[1:] != again[:-1]))
        head = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
        doc0 = np.where(head >= 0, doc[head], last[2] if last else 0)
        pos0 = np.where(head >= 0, start[head], last[3] if last else 0)
        q = np.flatnonzero((doc != doc0) | (start != pos0))
        last = (h[-1], again[-1], doc0[-1], pos0[-1])
        yield pa.RecordBatch.from_arrays([pa.array(block[q]), pa.array(ords[q]), pa.array(start[q], pa.int32()), pa.array(start[q] + LENGTH, pa.int32())], names=["block", "ord", "start", "end"])


# ---------------------------------------------------------------- suffix sorting by hashes


class Suffixes:
    """Rows of bytes with prefix polynomial hashes: common extensions by binary search, order by mergesort."""

    def __init__(self, rows: np.ndarray, lens: np.ndarray):
        self.rows, self.lens = rows, lens
        self.hashes = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
        for i in range(0, len(rows), 128):
            self.hashes[i : i + 128] = prefix_hashes(rows[i : i + 128])

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common prefix lengths of rows x and y: a logarithmic number of hash comparisons each."""
        lo, hi = np.zeros(len(x), np.int64), np.minimum(self.lens[x], self.lens[y])
        while (open_ := lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = self.hashes[x, mid] == self.hashes[y, mid]
            lo, hi = np.where(open_ & same, mid, lo), np.where(open_ & ~same, mid - 1, hi)
        return lo

    def before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether suffix x comes before suffix y; equal ones by their numbers."""
        k = self.extension(x, y)
        ends = k >= np.minimum(self.lens[x], self.lens[y])
        at = np.minimum(k, self.rows.shape[1] - 1)
        differ = self.rows[x, at] < self.rows[y, at]
        ended = np.where(self.lens[x] == self.lens[y], x < y, self.lens[x] < self.lens[y])
        return np.where(ends, ended, differ)

    def sort(self, first: np.ndarray) -> np.ndarray:
        """The order of the rows within groups; ``first[i]`` is where row i's group begins (groups lie end to end)."""
        n = len(first)
        order = np.arange(n)
        begins = np.flatnonzero(first == np.arange(n))
        size = np.diff(np.append(begins, n))
        stop = np.repeat(begins + size, size)
        width = 1
        while width < (size.max() if n else 0):
            p = np.flatnonzero(stop - first > width)
            local = p - first[p]
            run = local // width
            other = first[p] + (run ^ 1) * width
            other_end = np.minimum(other + width, stop[p])
            lo, hi = np.minimum(other, other_end), other_end
            x = order[p]
            base = lo.copy()
            while (open_ := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_] + hi[open_]) >> 1
                less = self.before(order[mid], x[open_])
                lo[open_] = np.where(less, mid + 1, lo[open_])
                hi[open_] = np.where(less, hi[open_], mid)
            new = order.copy()
            new[first[p] + (run & ~1) * width + (local - run * width) + (lo - base)] = x
            order, width = new, 2 * width
        return order

    def neighbours(self, order: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Common extension of each row in the order with the one before it (-1 at a group's begin), verified on the bytes."""
        lcp = np.full(len(order), -1, np.int64)
        p = np.flatnonzero(first[order] != np.arange(len(order)))
        x, y = order[p], order[p - 1]
        lcp[p] = self.extension(x, y)
        width = self.rows.shape[1]
        equal = self.rows[x] == self.rows[y]
        equal &= np.arange(width) < np.minimum(self.lens[x], self.lens[y])[:, None]
        true = np.where(equal.all(1), width, np.argmin(equal, 1))
        if (true != lcp[p]).any():
            raise ValueError("hash collision")
        return lcp


def sorted_suffixes(rows: np.ndarray, lens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common extensions of neighbours); on a hash collision the rows are sorted by their bytes instead."""
    try:
        s = Suffixes(rows, lens)
        order = s.sort(first)
        return order, s.neighbours(order, first)
    except ValueError:
        order = np.lexsort([np.arange(len(rows)), lens, *rows.T[::-1], first])
        lcp = np.full(len(order), -1, np.int64)
        for p in np.flatnonzero(first[order] != np.arange(len(order))):
            a, b = rows[order[p]][: lens[order[p]]].tobytes(), rows[order[p - 1]][: lens[order[p - 1]]].tobytes()
            lcp[p] = next((i for i, (u, v) in enumerate(zip(a, b)) if u != v), min(len(a), len(b)))
        return order, lcp


def solve(first: np.ndarray, rank: np.ndarray, right: np.ndarray, right_len: np.ndarray, left: np.ndarray, left_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) bytes before the anchor of a repeated string around each anchor; most is -1 where there is none.

    Rows lie in groups of equal anchors, in each by rank (equal ranks are one position).  A string with o bytes
    before the anchor is equal for two rows if their suffixes agree over ``LENGTH - o`` bytes and their reversed
    prefixes over o: both are intervals of the sorted orders, so equal strings have equal pairs of intervals.
    """
    n = len(first)
    orders = [sorted_suffixes(right, right_len, first), sorted_suffixes(left, left_len, first)]
    least, most = np.full(n, LENGTH), np.full(n, -1)
    for o in range(LEFT + 1):
        fits = np.flatnonzero((left_len >= o) & (right_len >= LENGTH - o))
        if len(fits) < 2:
            continue
        names = []
        for (order, lcp), depth in zip(orders, (LENGTH - o, o)):
            name = np.empty(n, np.int64)
            name[order] = np.cumsum(lcp < depth)
            names.append(name[fits])
        both = names[0] * (n + 1) + names[1]
        by = np.argsort(both, kind="stable")  # keeps ranks rising within equal pairs
        head = np.ones(len(by), bool)
        head[1:] = both[by][1:] != both[by][:-1]
        start = np.flatnonzero(head)[np.cumsum(head) - 1]
        again = rank[fits[by]] > rank[fits[by[start]]]
        hit = fits[by[again]]
        least[hit] = np.minimum(least[hit], o)
        most[hit] = np.maximum(most[hit], o)
    return least, most


#: Anchors that a task sorts at a time; a larger group is sorted as one.
_GROUP_ROWS = 8192


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task over fetched anchors sorted by (h, doc_id, pos): spans of the strings that started earlier."""
    held: list[pa.RecordBatch] = []

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        h, doc, pos = (np.asarray(t.column(c)) for c in ("h", "doc_id", "pos"))
        before = np.asarray(t.column("before")).astype(np.int64)
        n = len(h)
        first = np.maximum.accumulate(np.where(np.append(True, h[1:] != h[:-1]), np.arange(n), 0))
        rank = np.cumsum(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])))
        right, left = np.zeros((n, LENGTH), np.uint8), np.zeros((n, LEFT), np.uint8)
        right_len = np.zeros(n, np.int64)
        for i, (b, piece) in enumerate(zip(before.tolist(), t.column("piece").to_pylist())):
            data = np.frombuffer(piece, np.uint8)
            right_len[i] = len(data) - b
            right[i, : len(data) - b] = data[b:]
            left[i, :b] = data[:b][::-1]
        least, most = solve(first, rank, right, right_len, left, before)
        q = np.flatnonzero(most >= 0)
        yield pa.RecordBatch.from_arrays(
            [t.column("block").combine_chunks().take(pa.array(q)), t.column("ord").combine_chunks().take(pa.array(q)), pa.array(pos[q] - most[q], pa.int32()), pa.array(pos[q] - least[q] + LENGTH, pa.int32())],
            names=["block", "ord", "start", "end"],
        )

    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= _GROUP_ROWS:
            t = pa.Table.from_batches(held)
            h = np.asarray(t.column("h"))
            cut = int(np.flatnonzero(h == h[-1])[0])  # the last group may go on
            if cut:
                yield from run(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                count = t.num_rows - cut
    if held:
        yield from run(pa.Table.from_batches(held))


# ---------------------------------------------------------------- cutting out


def _cut(spans: SideTable, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_block, table = None, None
        for batch in batches:
            for block, ords, part, raw, off in _parts(batch):
                if block != at_block:
                    at_block, t = block, spans.load(block)
                    o, a, b = _join_spans(*(np.asarray(t.column(n)).astype(np.int64) for n in ("ord", "start", "end"))) if t else (np.zeros(0, np.int64),) * 3
                    table = {"ord": o, "start": a, "end": b}
                rows, text = _wanted_here(table, ords)
                lens = np.diff(off)
                a, b = table["start"][rows], np.minimum(table["end"][rows], lens[text])
                runs = np.bincount(text, minlength=len(lens))
                removed = np.bincount(text, b - a, minlength=len(lens)).astype(np.int64)
                kept, k = [], 0
                for i, (x, y, n) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), runs.tolist())):
                    cuts = [x, *np.stack([a[k : k + n], b[k : k + n]], 1).ravel().tolist(), y]
                    cuts[1:-1] = [c + x for c in cuts[1:-1]]
                    kept.append(b"".join(raw[u:v].tobytes() for u, v in zip(cuts[::2], cuts[1::2])))
                    k += n
                out = [part.column("doc_id"), pa.array(lens, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                yield pa.RecordBatch.from_arrays([*out, pa.array(kept, pa.binary())] if texts else out, names=[*names, "kept"] if texts else names)

    return run


def dedup_substrings(docs: DataFrame, with_bytes: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the remaining bytes, if asked for).

    A byte goes if a string of ``LENGTH`` bytes around it also starts earlier: in a document of smaller doc_id, or
    earlier in the same one.  Strings are judged on the input, may overlap, and never cross documents.  Null texts
    are empty; shorter texts than ``LENGTH`` keep all; a null doc_id comes after all others; rows that share a doc_id
    are no earlier than each other at equal starts; extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "suffix")
    rows = placed(docs)
    order = ["h", "around", "again", "doc_id", "start"]
    met = written(rows.mapInArrow(_anchors, _HITS_SCHEMA).repartition(spread(spark), "h").sortWithinPartitions(*order).mapInArrow(_meet, _HITS_SCHEMA), "suffix")
    ask = met.where("end = 0").select("h", "doc_id", "block", "ord", "start")
    counts = written(ask.groupBy("h").agg(F.count("*").alias("many")), "suffix")
    crowds = counts.where(F.col("many") > CROWD)
    wanted = SideTable(hot_join(ask, counts, ["h"], "many").select("h", "doc_id", "block", "ord", "start", (F.col("many") > CROWD).alias("crowd")), "suffix")
    pieces = rows.mapInArrow(_fetch(wanted, False), "h long, doc_id long, block long, ord int, pos int, before int, piece binary")
    spans_schema = "block long, ord int, start int, end int"
    more = pieces.repartition(spread(spark), "h").sortWithinPartitions("h", "doc_id", "pos").mapInArrow(_extend, spans_schema)
    found = met.where("end > 0").select("block", "ord", "start", "end").unionByName(more)
    if not crowds.isEmpty():
        strings = rows.mapInArrow(_fetch(wanted, True), _HITS_SCHEMA).repartition(spread(spark), "h").sortWithinPartitions("h", "again", "doc_id", "start")
        found = found.unionByName(strings.mapInArrow(_repeat, spans_schema))
    spans = SideTable(found, "suffix")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else "")
    return rows.mapInArrow(_cut(spans, with_bytes), schema)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 100 bytes cut out of every document."""
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same in plain SQL: all windows of 100 bytes, each but its first occurrence removed.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, b[i + 1:i + 100] AS win FROM (SELECT doc_id, b, unnest(range(octet_length(b) - 99)) AS i FROM d WHERE octet_length(b) >= 100)),
again AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1),
edge AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 1 ELSE 0 END AS new FROM again),
span AS (SELECT doc_id, min(i) AS s, max(i) + 100 AS e FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM edge) GROUP BY doc_id, k),
cut AS (SELECT doc_id, s, e FROM span UNION ALL SELECT doc_id, octet_length(b), octet_length(b) FROM d),
piece AS (SELECT doc_id, s, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s, e), 0) AS a FROM cut),
kept AS (SELECT doc_id, string_agg(hex(b[a + 1:s]), '' ORDER BY s) AS h FROM piece JOIN d USING (doc_id) WHERE s > a GROUP BY doc_id),
n AS (SELECT doc_id, sum(e - s) AS removed, count(*) AS spans FROM span GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(h, ''))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
