import re

import pytest

from rowtrail.llm import jaccard
from rowtrail.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, num, den, k):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return [(d, len(sets[i]), low.get(root(i), d) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def key(rows):
    return sorted((d is None, d or 0, n, c is None, c or 0) for d, n, c in rows)


@pytest.mark.parametrize("num,k", [(90, 3), (80, 5), (60, 2)])
def test_against_brute_force(documents, corpus, num, k):
    got = jaccard.jaccard_components(documents(corpus), jaccard.Likeness(num, 100, k)).collect()
    assert key((r.doc_id, r.n_shingles, r.component_id) for r in got) == key(brute(corpus, num, 100, k))


def test_light_and_heavy_groups(documents):
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 30):
        w = list(base)
        for j in range(i % 6):
            w[(7 * i + 17 * j) % 120] = f"x{i}.{j}"
        rows.append((i, " ".join(w)))
    for i in range(30, 60):
        w = [f"s{k}" for k in range(13)]
        w[-1] = f"t{i % 4}"
        rows.append((i, " ".join(w[: 8 + i % 6])))
    got = jaccard.jaccard_components(documents(rows)).collect()
    assert key((r.doc_id, r.n_shingles, r.component_id) for r in got) == key(brute(rows, 90, 100, 3))


def test_one_of_each_stays(spark, documents, corpus):
    rows = [r for r in corpus if r[0] is not None]
    plain = documents(rows)
    kept = jaccard.keep_one_of_each(plain, jaccard.Likeness(80, 100, 5))
    assert kept.columns == plain.columns
    got = sorted(r.doc_id for r in kept.collect())
    groups = brute(rows, 80, 100, 5)
    want = {d for d, n, c in groups if n == 0 or d == c}
    assert set(got) == want
    assert got.count(30) == 1 and sum(d in (80, 81, 82, 83) for d in got) == 4


def test_empty_table(documents):
    assert jaccard.jaccard_components(documents([]).limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(5, 5), (None, 3), (1, 0)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_border_follows_cost():
    like = jaccard.Likeness()
    assert jaccard.choose_border({}, like) == 0
    assert 9 <= jaccard.choose_border({n: 10 for n in range(1, 41)}, like) < 40


def brute_links(rows, num, den, k):
    """Each row's number of different sets that its own is linked with."""
    sets = [shingles(t, k) for _, t in rows]
    kinds = set(sets) - {frozenset()}
    links = {a: sum(a != b and den * len(a & b) >= num * len(a | b) for b in kinds) for a in kinds}
    return sorted((d is None, d or 0, links.get(s, 0)) for (d, _), s in zip(rows, sets))


@pytest.mark.parametrize("sets", [200, 7])
def test_every_link_is_counted(documents, corpus, monkeypatch, sets):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", sets)
    base = [f"w{i}" for i in range(120)]
    rows = list(corpus)
    for i in range(1000, 1060):
        w = list(base) + [f"more{j}" for j in range(i % 25)]
        for j in range(i % 4):
            w[(7 * i + 17 * j) % 120] = f"x{i}.{j}"
        rows.append((i, " ".join(w)))
    rows += [(2000 + i, " ".join([f"s{k}" for k in range(12 + i)])) for i in range(6)]
    rows += [(3000, "p q r s t u v w x y z a b"), (3001, "p q r s t u v w x y z a c"), (3002, "p q r s t u v w x y z a d")]
    got = jaccard.jaccard_components(documents(rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_links) for r in got) == brute_links(rows, 90, 100, 3)


def test_words_that_collide_modulo_a_power_of_two(documents):
    """A Thue-Morse word of 1,024 letters and its complement: equal sums modulo 2^64 under every odd base."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    rows = [(1, "".join("ab"[b] for b in bits)), (2, "".join("ba"[b] for b in bits)), (3, "other")]
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard.jaccard_components(documents(rows)).collect()}
    assert got == {1: (1, 0), 2: (2, 0), 3: (3, 0)}


def test_all_white_space_parts_words(documents):
    words = [f"w{i}" for i in range(30)]
    rows = [(i, s.join(words)) for i, s in enumerate(" \t\n\x0b\x0c\r")] + [(9, "\x1c".join(words))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(documents(rows)).collect()}
    assert got == {**{i: (28, 0) for i in range(6)}, 9: (1, 9)}


def test_other_splits_between_scans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    key_, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    sizes = iter(["200k", "1m", "90k", "128m"] * 20)
    whole = jaccard.keep_one_of_each(docs, jaccard.Likeness(80, 100, 5))
    want = sorted(whole.select("doc_id").collect())
    real = jaccard.written

    def cut(df, name):
        spark.conf.set(key_, next(sizes))
        return real(df, name)

    try:
        jaccard.written = cut
        assert sorted(jaccard.keep_one_of_each(docs, jaccard.Likeness(80, 100, 5)).select("doc_id").collect()) == want
    finally:
        jaccard.written = real
        spark.conf.set(key_, before)
