import hashlib
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from rowtrail.llm import suffix
from rowtrail.llm.common import SideTable

LAST = 2**63 - 1


def brute(rows):
    """Per (doc_id, text): (n_bytes, n_removed, n_spans, sha), every string against all that start earlier."""
    n = suffix.LENGTH
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - n + 1):
            key = (LAST if i is None else i, s)
            w = b[s : s + n]
            first[w] = min(first.get(w, key), key)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - n + 1):
            if first[b[s : s + n]] < (LAST if i is None else i, s):
                gone[s : s + n] = b"\1" * n
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i, len(b), hashlib.sha256(b).hexdigest()] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [8192, 2])
def test_against_brute_force(spark, documents, corpus, monkeypatch, crowd):
    monkeypatch.setattr(suffix, "CROWD", crowd)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.dedup_substrings(documents(corpus)).collect())
    truth = brute(corpus)
    want = sorted((i is None, i or 0, *truth[i, len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest()]) for i, t in corpus)
    assert got == want


def test_kept_bytes_and_empty_table(spark, documents):
    rows = [(1, "q" * 30 + "abcdefghij" * 15), (2, "zz" + "abcdefghij" * 15 + "yy")]
    kept = {r.doc_id: bytes(r.kept) for r in suffix.dedup_substrings(documents(rows), with_bytes=True).collect()}
    assert kept[2] == b"zzyy"
    assert suffix.dedup_substrings(documents([]).limit(0)).count() == 0


def test_suffix_order_and_extensions():
    rng = np.random.default_rng(1)
    rows = rng.integers(97, 99, (300, 12)).astype(np.uint8)
    lens = rng.integers(0, 13, 300)
    rows[np.arange(12) >= lens[:, None]] = 0
    first = np.repeat(np.arange(0, 300, 50), 50)
    order, lcp = suffix.sorted_suffixes(rows, lens, first)
    key = [(first[i], rows[i, : lens[i]].tobytes(), i) for i in range(300)]
    assert [key[i] for i in order] == sorted(key)
    for p in range(1, 300):
        a, b = key[order[p]], key[order[p - 1]]
        if a[0] == b[0]:
            want = next((k for k, (x, y) in enumerate(zip(a[1], b[1])) if x != y), min(len(a[1]), len(b[1])))
            assert lcp[p] == want
        else:
            assert lcp[p] == -1


def test_collision_falls_back_to_bytes(monkeypatch):
    monkeypatch.setattr(suffix.Suffixes, "extension", lambda self, x, y: np.minimum(self.lens[x], self.lens[y]))
    rows = np.array([[98, 97], [97, 97], [97, 98]], np.uint8)
    order, lcp = suffix.sorted_suffixes(rows, np.array([2, 2, 2]), np.zeros(3, int))
    assert order.tolist() == [1, 2, 0] and lcp.tolist() == [-1, 1, 0]


def test_equal_first_hashes_of_surroundings_do_no_harm(spark, documents, corpus, monkeypatch):
    """With the first lane blind, the second keeps different surroundings apart."""
    whole = suffix.find_anchors

    def blind(raw, off):
        at, h, around, again = whole(raw, off)
        return at, h, np.zeros_like(around), again

    monkeypatch.setattr(suffix, "find_anchors", blind)
    batch = [(i, t) for i, t in corpus if t]
    raw = np.frombuffer("".join(t for _, t in batch).encode(), np.uint8)
    off = np.cumsum([0, *(len(t.encode()) for _, t in batch)])
    tables = pa.table({"doc_id": pa.array([i for i, _ in batch], pa.int64()), "text": [t for _, t in batch], "block": [7] * len(batch), "ord": pa.array(range(len(batch)), pa.int32())})
    out = pa.Table.from_batches(list(suffix._anchors(iter(tables.to_batches()))))
    stay = [(a, b, c) for a, b, c, e in zip(*(out.column(n).to_pylist() for n in ("h", "around", "again", "end"))) if e == 0]
    at, h, _, again = blind(raw, off)
    assert {(x, 0, y) for x, y in zip(h.view(np.int64).tolist(), again.view(np.int64).tolist())} == set(stay)


def test_windows_over_long_texts(monkeypatch):
    rng = np.random.default_rng(3)
    text = np.concatenate([rng.integers(97, 99, 3000), np.full(5000, 120), np.tile([97, 98, 99], 1500), rng.integers(0, 256, 4000)]).astype(np.uint8)
    off = np.array([0, 50, 50, 2100, 9000, len(text)])
    want = list(zip(*suffix.find_anchors(text, off)))
    monkeypatch.setattr(suffix, "_STEP", 700)
    got = [x for part in suffix.anchors_of(text, off) for x in zip(*part)]
    assert got == want


def test_one_byte_over_and_over_stays_small():
    """20 MB of one byte, within 1 GB."""
    code = """
import resource, numpy as np, pyarrow as pa
from rowtrail.llm import suffix
from rowtrail.llm.common import SideTable
t = pa.table({"doc_id": [1], "text": ["x" * 20_000_000], "block": [5], "ord": pa.array([0], pa.int32())})
spans = [b for b in suffix._anchors(iter(t.to_batches()))]
print(sum(b.num_rows for b in spans), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True).stdout.split()
    assert int(out[0]) < 2000 and int(out[1]) < 1_000_000


def test_other_splits_between_scans(spark, tmp_path, monkeypatch):
    """The answer doesn't change when the later scans cut the file otherwise than the first one did."""
    docs = "/root/testdata/sf0.01/documents.parquet"
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = suffix.dedup_substrings(spark.read.parquet(docs)).orderBy("doc_id").collect()
    try:
        cut = suffix.dedup_substrings(spark.read.parquet(docs))
        spark.conf.set(key, "100k")
        assert cut.orderBy("doc_id").collect() == want
    finally:
        spark.conf.set(key, before)


def test_missing_side_table_is_an_error(spark, tmp_path):
    side = SideTable(spark.createDataFrame([(5, 1)], "block long, x int"), "test")
    assert side.load(5).column("x").to_pylist() == [1] and side.load(6) is None
    side.path, side.whole = f"file://{tmp_path}/none", False
    with pytest.raises(FileNotFoundError):
        side.load(5)
