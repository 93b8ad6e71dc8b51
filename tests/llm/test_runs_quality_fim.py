import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from rowtrail.llm import fim, periodic, quality

TEXTS = ["", None, " \t\n ", "a", "<P>in<S>it", "x" * 63, "x" * 64, "é" * 65, "a\x00b\nc\r漢字\U0001f600 " * 40, "́́é " * 50, "< <P <S> <M", "<" * 200, "S>M>P>" * 30]


# ---------------------------------------------------------------- periodic runs


def brute_runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def kept_words(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_by_brute_force():
    r = random.Random(4)
    for _ in range(1500):
        names, want = [], []
        for d in range(r.randint(1, 3)):
            n, k, p = r.randint(0, 60), r.randint(1, 3), r.randint(1, 9)
            w = [r.randrange(k) for _ in range(n)]
            if n and r.random() < 0.6:
                a = r.randrange(n)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            want += [(s + len(names), m, q) for s, m, q in brute_runs(w)]
            names += [10 * d + x for x in w] + [10 * d + 9]
        assert [tuple(x) for x in periodic.maximal_runs(np.array(names)).tolist()] == sorted(want, key=lambda x: (x[0], x[2]))


@pytest.mark.parametrize("make", [lambda n: np.zeros(n, int), lambda n: np.arange(n) % 7, lambda n: np.random.default_rng(1).integers(0, 2, n), lambda n: np.concatenate([np.arange(n // 2)] * 2)])
def test_runs_take_about_linear_time(make):
    def seconds(n):
        start = time.perf_counter()
        periodic.maximal_runs(np.append(make(n), 1 << 40))
        return time.perf_counter() - start

    seconds(1000)
    assert min(seconds(160_000) for _ in range(2)) < 3.5 * min(seconds(80_000) for _ in range(2)) + 0.1


def test_runs_of_documents(spark, documents, corpus):
    r = random.Random(6)
    loops = [(200 + k, " ".join(r.choice("abcd") for _ in range(5)) + " " + " ".join([r.choice("xyz") for _ in range(k)] * 9) + " é") for k in range(1, 12)]
    rows = corpus + loops + [(300, "w " * 30_000), (301, "b\tb\n" * 20)]
    got = sorted(map(str, periodic.find_runs(documents(rows)).collect()))
    want = []
    for d, t in rows:
        w = [x for x in re.split("[ \t-\r]+", t or "") if x]
        runs = [(0, 30_000, 1)] if d == 300 else brute_runs(w) if len(w) < 1000 else []
        want.append((d, len(w), sorted(runs, key=lambda x: (x[0], x[2])), kept_words(w, runs)))
    plain = [(x.doc_id, x.n_words, [tuple(y) for y in x.runs], x.collapsed) for x in periodic.find_runs(documents(rows)).collect()]
    assert sorted(map(str, plain)) == sorted(map(str, want)) and len(got) == len(want)
    assert periodic.find_runs(documents(rows).limit(0)).count() == 0


def test_planted_texts(spark, documents):
    rows = [(k, "a b  c\td\ne f g h i j k l m n o p" if k % 3 else " ") for k in range(60)] + [(None, "a b"), (7, None)]
    got = {(x.doc_id, x.was): x.text for x in documents(rows).selectExpr("doc_id", "text as was", "text").withColumn("text", periodic._planted()).collect()}
    for d, t in rows:
        w, h = (t or "").split(), zlib.crc32(str(d).encode())
        if d is not None and w and h % 10 == 0:
            a, g = (h // 10) % len(w), h // 10
            p = 1 + (len(w) - a) // (3 + g % 8)
            assert got[d, t].split() == [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        else:
            assert got[d, t] == t


# ---------------------------------------------------------------- fill in the middle


def example(d, t, salt="1:", cut=90, first=20):
    t = t or ""
    h = hashlib.sha256(f"{salt}{'' if d is None else d}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= cut:
        return (d, len(t), "plain", None, None, t)
    x, y = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    p, m, s = t[:x], t[x:y], t[y:]
    spm = h4 % 100 < first
    return (d, len(t), "spm" if spm else "psm", x, y - x, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("salt", ["1:", "it's "])
def test_fill_in_middle(spark, documents, corpus, salt):
    rows = corpus + [(1000 + i * 50 + k, t) for i, t in enumerate(TEXTS) for k in range(50)] + [(5000, "a\U0001f600" * 300_000)]
    made = fim.restore(fim.fill_in_middle(documents(rows), salt)).collect()
    want = sorted(((*example(d, t, salt), t or "") for d, t in rows), key=str)
    assert sorted(((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output, x.restored) for x in made), key=str) == want
    assert {x.form for x in made} == {"plain", "psm", "spm"}
    for x in made:
        assert x.output_sha256 == hashlib.sha256(x.output.encode()).hexdigest() and x.restored_sha256 == hashlib.sha256(x.restored.encode()).hexdigest()
    assert fim.restore(fim.fill_in_middle(documents(rows).limit(0))).count() == 0


def test_shares_of_forms(spark, documents):
    got = fim.fill_in_middle(documents([(k, "some words") for k in range(400)]), cut=50, suffix_first=100)
    forms = {r.form: r["count"] for r in got.groupBy("form").count().collect()}
    assert set(forms) == {"plain", "spm"} and 150 < forms["plain"] < 250


# ---------------------------------------------------------------- quality


def test_interactions_are_those_of_all_pairs():
    r = np.random.default_rng(3)
    w, v = r.normal(size=50), r.normal(size=(50, quality.RANK))
    feature = np.concatenate([r.choice(50, 9, False), r.choice(50, 6, False)])
    text, value = np.repeat([0, 2], [9, 6]), r.normal(size=15)
    z, _ = quality.margins(0.3, w, v, text, feature, value, 3)
    for t in range(3):
        at = np.flatnonzero(text == t)
        pairs = sum(v[feature[i]] @ v[feature[j]] * value[i] * value[j] for i in at for j in at if i < j)
        assert np.isclose(z[t], 0.3 + sum(w[feature[i]] * value[i] for i in at) + pairs)


def test_factors_learn_an_interaction():
    """Label: exactly one of two features, which no linear weight can tell."""
    r = np.random.default_rng(5)
    on = r.integers(0, 2, (400, 2))
    text, which = np.nonzero(on)
    bias, w, v = quality.fit(text, which, np.ones(len(text)), (on.sum(axis=1) == 1).astype(float), 4)
    z, _ = quality.margins(bias, w, v, text, which, np.ones(len(text)), 400)
    assert ((z > 0) == (on.sum(axis=1) == 1)).all() and (v[2:] == 0).all()


def test_features_do_not_depend_on_neighbours():
    texts = [b"", b"One two two.\nOne two two.\n\nTHREE | four!", b" \n", "é漢 12 ###".encode(), b"x" * 3000, b"a b " * 400]
    meta = np.array([[np.nan], [3.0], [0.0], [-5.0], [1e30], [7.0]])
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    text, feature, value = quality.features(np.frombuffer(b"".join(texts), np.uint8), off, meta)
    assert feature.max() < quality.width(1)
    for k, t in enumerate(texts):
        _, f, v = quality.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]), meta[k : k + 1])
        at = text == k
        assert (feature[at] == f).all() and np.allclose(value[at], v)


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.1"
    got = quality.op12_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out and quality is not null").toPandas()
    good, low = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > low).mean() > 0.99 and (good >= 0.5).mean() > 0.99 and (low < 0.5).mean() > 0.95


def test_quality_of_odd_tables(spark, documents, corpus):
    docs = documents(corpus)
    for rows, want in (([], 0.5), ([(5, 1), (6, 1)], None), ([(None, 1), (3, None), (4, 0), (4, 1), (5, 1), (6, 1), (7, 0), (9, 0)], None)):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        got = quality.score_quality(docs, quality.train(docs, labels)).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in corpus)
        assert all(0 <= r.score <= 1 for r in got) and (want is None or {r.score for r in got} == {want})
    model = quality.train(docs, spark.createDataFrame([(5, 1), (6, 0)], "doc_id long, quality int"), metadata=())
    assert quality.score_quality(docs.limit(0), model).count() == 0
