import hashlib
import random
import re
import time

import pytest

from rowtrail.llm import decontaminate, secrets, toxicity, urls
from rowtrail.llm.html_text import decode, extract_text, labelled_nodes, log_odds, main_texts, parse, train

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("size", [1 << 20, 60])
def test_decontamination_against_brute_force(spark, documents, corpus, size):
    texts = [t for _, t in corpus if t]
    r = random.Random(3)
    items = [(k, " ".join(texts[k].split()[:14])) for k in range(0, 30, 3)] + [(100, "A"), (101, ""), (102, None), (103, texts[4]), (104, "no such words here at all, really none of them")]
    items += [(105, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for row in decontaminate.find_contamination(documents(corpus), bench, words=size).collect():
        got.setdefault(row.doc_id, []).append((row.n_words, row.n_hit, sorted(row["items"]), [tuple(s) for s in row.spans]))
    for d, t in corpus:
        w, hit, names = words(t), set(), set()
        for item, it in items:
            iw = words(it)
            n = min(10, len(iw))
            for i in range(len(iw) - n + 1) if iw else []:
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == iw[i : i + n]:
                        hit |= set(range(p, p + n))
                        names.add(str(item))
        found = [g for g in got[d] if g[:3] == (len(w), len(hit), sorted(names))]
        assert found, (d, len(w), len(hit), names, got[d])
        for s, e in found[0][3]:
            assert set(words(t[s:e])) <= {w[k] for k in hit}
    assert r


def test_windows_by_brute_force():
    r = random.Random(2)
    for _ in range(300):
        some = ["a", "b", "c", "d"][: r.randint(1, 4)]
        line = lambda n: [r.choice(some) for _ in range(n)]
        items = [line(r.choice([0, 1, 4, 5, 9, 10, 11, 23])) for _ in range(4)]
        text = line(30) + items[2] + items[3][2:] + line(3)
        hit, names = set(), set()
        for k, iw in enumerate(items):
            n = min(10, len(iw))
            for i in range(len(iw) - n + 1) if iw else []:
                for p in range(len(text) - n + 1):
                    if text[p : p + n] == iw[i : i + n]:
                        hit |= set(range(p, p + n))
                        names.add(str(k))
        n, spans, found = decontaminate.Windows([(str(k), " ".join(x)) for k, x in enumerate(items)]).scan(" ".join(text))
        assert (n, {p for s, e in spans for p in range(s, e)}, found) == (len(text), hit, sorted(names))


def test_item_without_a_name_hits(spark, documents):
    bench = spark.createDataFrame([(None, "some words of it"), (7, "words of")], "item_id long, text string")
    row = decontaminate.find_contamination(documents([(1, "here are some words of it")]), bench).first()
    assert (row.n_hit, row.n_items, row["items"]) == (4, 2, ["7", None])


def test_decontamination_stage(spark, documents, tmp_path):
    text = " ".join(f"w{i}" for i in range(12))
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents([(1, "x " + text), (2, "clean"), (3, None), (4, "")])
    out = decontaminate.drop_contaminated(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [2, 3, 4]


def base_spans(t):
    out = []
    kinds = [("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), ("access", "AKIA[A-Z0-9]+", 0), ("hex", "[0-9a-f]+", 0)]
    for rank, (kind, p, f) in enumerate(kinds):
        for m in re.finditer(p, t or "", f):
            size = len(m[2]) if kind == "assign" else len(m[0])
            if size >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


def test_secrets(spark, documents):
    key, live = "AKIA" + "A1B2C3D4E5F6G7H8", "zQ9xV7mK2pL8wR4tY6uB1nC3"
    rows = [
        (1, f"é password = \"hunter22x\" and {key}", "a"), (2, f"token:{'ab12' * 10} {live}", "a"), (3, f"PassWord: short {live}", "a"), (4, None, "b"), (5, "", None), (6, f"api_key='{'0f' * 20}'", "b"),
        (7, f"copied {live[::-1]}", "a"), (8, f"copied {live[::-1]}", "b"), (9, "ſecret=abcdefghij secret=abcdefghij", "c"), (9, "ſecret=abcdefghij secret=abcdefghij", "c"), (10, "tokentoken=====12345678", "c"),
    ]
    got = {}
    for r in secrets.scan_secrets(documents(rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t, _ in rows:
        base = base_spans(t)
        for r in got[i]:
            assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex"))
            assert set(base) <= set(r.spans.split(",")) | {""}
    assert any("opaque" in r.spans for r in got[2]) and any("opaque" in r.spans for r in got[3])  # one owner
    assert not any("opaque" in r.spans for i in (7, 8) for r in got[i])  # two owners: a copied example
    assert len(got[9]) == 2
    assert secrets.scan_secrets(documents([]).limit(0)).count() == 0


def test_value_in_many_documents_of_one_owner_is_copied(documents):
    value = "Qx7bZ9kLm2Rt5Vw8Yp3Nc6Hd1Jf4Gs0"
    rows = [(i, f'password = "{value}"', "hot") for i in range(40)] + [(100 + i, 'password = "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7"', "hot") for i in range(2)]
    got = {r.doc_id: r for r in secrets.scan_secrets(documents(rows)).collect()}
    assert all((got[i].n_live, got[i].n_copied) == (0, 1) for i in range(40))
    assert all((got[i].n_live, got[i].n_copied) == (1, 0) for i in (100, 101))


def test_urls(spark):
    rows = [
        (1, "http://A.Example.NET/en/x?y#z"), (2, "https://example.net/EN/"), (3, "ftp://shop.example.com/de/1#a/b"), (4, "x://sub.org/fr/"), (5, "x://sub.org/fr"), (6, "http://net"), (7, "http://a.net/"), (8, None), (9, "no scheme"),
        (10, "http://badnet/"), (11, "http://u@h.net:80/p"), (12, "a://b://c.net/x"), (13, "://net/q"), (13, "://net/q"),
    ]
    model = urls.train(spark)
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, host string"), model).collect()}
    for i, u in rows:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = host.lower()
        fits = [(len(r), v, r) for v, r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        want = max(fits) if fits else None
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, want[2] if want else None)
        assert got[i].verdict in ("allow", "block") and (not want or got[i].verdict == want[1])
    other = [("http://new-casino.test/bet/win", "block"), ("http://adserver.test/banner/click", "block"), ("https://www.village-news.test/en/article/77.html", "allow"), ("https://docs.garden.test/en/guide/soil", "allow")]
    judged = urls.judge_urls(spark.createDataFrame(list(enumerate(u for u, _ in other)), "page_id long, url string"), model)
    assert [r.verdict for r in judged.orderBy("page_id").collect()] == [v for _, v in other]
    assert judged.limit(0).count() == 0


def test_toxicity(spark, documents):
    r = random.Random(2)
    clean_words = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(600):
        sentences = [" ".join(r.choice(clean_words) for _ in range(8)) for _ in range(r.randint(1, 6))]
        bad = i % 3 == 0
        if bad:
            k = r.randrange(len(sentences))
            sentences[k] += " " + r.choice(["idiot", "grumblyxx", "grumblyish"])
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "..."), (1003, "you idiot"), (1003, "you idiot")]
    docs = documents(rows)
    model = toxicity.train(docs, spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int"))
    got = {x.doc_id: x for x in toxicity.score_toxicity(docs, model).collect()}
    wrong = [i for i, y in labels if (got[i].score >= 0.5) != (y == 1)]
    assert len(wrong) <= 6
    assert all(got[i].score < 0.5 and 0 <= got[i].score <= 1 for i in (1000, 1001, 1002)) and got[1003].score >= 0.5
    for i, t in rows[:90]:
        for s in got[i].sentences or []:
            assert re.search("idiot|grumbly", t[s.start : s.end])
    untrained = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(x.score < 0.5 for x in toxicity.score_toxicity(docs, untrained).collect())
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_toxicity_of_wordless_sentences(documents):
    """Dot leaders and blank lines add nothing, however many they are."""
    import numpy as np
    import pyarrow as pa

    from rowtrail.llm.common import buffers

    h, _, _ = toxicity.features(*buffers(pa.array(["idiot"])))
    model = toxicity.Model(h, np.full(len(h), 9.0, np.float32), toxicity.BIAS)
    fill = "." * 400_000 + "\n" * 400_000 + " . ! ?\n-- \n" * 300_000  # over 4 MB
    rows = [(1, "A chapter" + fill + "its page"), (2, "A chapter\nits page"), (3, fill), (4, "A chapter" + fill + "you idiot"), (5, "A chapter\nyou idiot")]
    got = {r.doc_id: r for r in toxicity.score_toxicity(documents(rows), model).collect()}
    assert got[1].score == pytest.approx(got[2].score) and got[1].score < 0.5 and got[3].score == 0
    assert got[4].score == pytest.approx(got[5].score) and got[4].score >= 0.5 and len(got[4].sentences) == 1


def test_noisy_or_by_brute_force(documents):
    """Scores against sentences judged one by one, from the words' weights alone."""
    import math

    import numpy as np
    import pyarrow as pa

    from rowtrail.llm.common import buffers

    weights = {"idiot": 9.0, "bad": 4.0, "grumbl": 3.0, "fool": 2.5}
    hashes = {w: toxicity.features(*buffers(pa.array([w + ("e" if len(w) == 6 else "")])))[0] for w in weights}
    # the whole word, or, for the six letters, the prefix of that length, which only longer words have
    keys = np.array([h[-1] if w == "grumbl" else h[0] for w, h in hashes.items()], np.uint64)
    model = toxicity.Model(keys, np.array(list(weights.values()), np.float32), -7.0)
    r = random.Random(8)
    vocabulary = ["IDIOT", "bad", "fool", "grumbly", "grumblings", "grumbl", "fine", "is", "é", "baddest"]
    rows = [(i, "".join(r.choice(vocabulary) + r.choice([" ", " ", ". ", "!", "\n", "?"]) for _ in range(r.randint(0, 40)))) for i in range(60)]
    got = {x.doc_id: x.score for x in toxicity.score_toxicity(documents(rows), model).collect()}
    for i, t in rows:
        total = 0.0
        for sentence in re.split(r"[.!?\n]", t.lower()):
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", sentence)
            z = -7.0 + sum(weights.get(w, 0) for w in words if w != "grumbl") + sum(3.0 for w in words if w.startswith("grumbl") and len(w) > 6)
            total += max(0.0, math.log1p(math.exp(z)) - toxicity.FLOOR) if words else 0.0
        assert got[i] == pytest.approx(-math.expm1(-total), abs=1e-6)


def test_long_clean_texts_stay_clean(documents):
    import numpy as np
    import pyarrow as pa

    from rowtrail.llm.common import buffers

    h, _, _ = toxicity.features(*buffers(pa.array(["idiot"])))
    model = toxicity.Model(h, np.full(len(h), 9.0, np.float32), toxicity.BIAS)
    long = "Some words of a harmless sentence. " * 150_000  # over 5 MB
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(documents([(1, long), (2, long + "idiot")]), model).collect()}
    assert got[1] == 0 and got[2] >= 0.5


def test_toxicity_batches_do_not_matter(documents):
    """A text's score is its own, whatever lies beside it in a batch, empty texts included."""
    import numpy as np
    import pyarrow as pa

    from rowtrail.llm.common import buffers

    texts = ["", "bad one. fine", None, "", "fine. fine", "", "bad"]
    raw, off = buffers(pa.array(["bad"]))
    h, _, _ = toxicity.features(raw, off)
    model = toxicity.Model(h, np.full(len(h), 9.0, np.float32), -5.0)

    def scores(batch):
        z, first = model.sentences(*buffers(pa.array(batch, pa.string())))
        return np.add.reduceat(toxicity.softplus(z), first[:-1])

    assert np.allclose(scores(texts), [scores([t])[0] for t in texts])


def test_html(spark):
    trees = train(spark)
    right = total = 0
    for seed in range(10_000, 10_060):
        x, y = labelled_nodes(seed)
        right += int(((log_odds(trees, x) > 0) == (y == 1)).sum())
        total += len(y)
    assert right / total > 0.95
    page = (
        "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a><li><a href=/b>More</a></ul></nav><div class='cookie-notice'>We use cookies.</div>"
        "<article><h1>A &amp; B</h1><p>First  paragraph <b>bold</b>text\n of some length, with words.<p>Second &eacute; paragraph, which goes on for a while.<br>And on.</article>"
        "<div class=comments><div class=comment>I do not agree with this.</div></div><footer>&copy; all</footer></body></html>"
    )
    assert main_texts([page], trees) == ["A & B First paragraph boldtext of some length, with words. Second é paragraph, which goes on for a while. And on."]
    assert main_texts([None, "", "<p>"], trees) == [""] * 3
    assert main_texts(["<div>" * 3000 + "deep"], trees)[0] in ("", "deep")
    open_head = page.replace("</head><body>", "")
    assert main_texts([open_head, page.replace("</head>", "")], trees) == main_texts([page, page], trees)
    shown = page.replace("of some length", "of <noscript>some</noscript> <math><mi>x</mi><mo>=</mo><mn>1</mn></math> length")
    assert "x=1 length" in main_texts([shown], trees)[0]
    rows = [(1, "u", page, "x", 5), (1, "u", page, "x", 5), (2, None, None, "x", 5), (3, "v", "", None, None), (4, "w", page * 400, "x", 5), (None, "n", page, "x", 5)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = sorted(extract_text(frame, trees).collect(), key=str)
    assert extract_text(frame, trees).columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((str(r.page_id), r.url) for r in got) == sorted((str(r[0]), r[1]) for r in rows) or len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    assert texts[1] == texts[None] == main_texts([page], trees)[0] and texts[2] == texts[3] == ""
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract_text(frame.limit(0), trees).count() == 0


def test_parsing_is_linear():
    """End tags without a partner don't search the open elements."""
    for page in (lambda n: "<div>" * n + "</b>" * n, lambda n: "<b><body>" + "<div>" * n + "</b>" * n):
        times = []
        for n in (5_000, 40_000):
            start = time.process_time()
            parse(page(n))
            times.append(time.process_time() - start)
        assert times[1] < 24 * max(times[0], 0.01)


@pytest.mark.parametrize("piece", ["<a ", "<!-- ", "<!-- >", "<a x='", "<![CDATA[ ", "<![CDATA[ >", "<![if ", "<![if >", "</a ", "<? ", "<![foo[ >", "<a <!--\">"])
def test_unfinished_markup_is_linear(piece):
    times = []
    for n in (10_000, 80_000):
        start = time.process_time()
        parse(piece * n)
        times.append(time.process_time() - start)
    assert times[1] < 24 * max(times[0], 0.01)


def test_unfinished_markup_is_text():
    lines = lambda page: [t for t in parse(page).text if t]
    assert lines("<p>a</p><!-- b <p>c</p>") == ["a", "<!-- b <p>c"]
    assert lines("<p>a &amp; b</p>x < y <a b &am") == ["a & b", "x < y <a b &am"]
    assert lines("<p>a<![CDATA[x]]>b<!-- no -->c<![if x]>d<![endif]>e") == ["abcde"]
    assert lines("<p>a<![foo[ x ]]> b</p>")[0].startswith("a") and lines("<p>a<![%[ x") == ["a<![%[ x"]


@pytest.mark.parametrize("make", [lambda n: "a " * n, lambda n: "a b " * (n // 2), lambda n: "a a a a a b " * (n // 6), lambda n: " ".join("a" * 5 * (k % 7 + 1) + f" w{k} a a a a a" for k in range(n // 7))])
def test_decontamination_is_linear(make):
    seconds = []
    for n in (4_000, 32_000):
        found = decontaminate.Windows([("i", make(n)), ("j", "c " + make(n))])
        start = time.process_time()
        words, spans, names = found.scan("x " + make(n) + " y")
        seconds.append(time.process_time() - start)
        assert spans[0][0] == 1 and spans[-1][1] == words - 1 and names == ["i", "j"]
    assert seconds[1] < 24 * max(seconds[0], 0.01)


def test_secret_spans_are_linear():
    token = "Qx7bZ9kLm2Rt5Vw8Yp3Nc6Hd1Jf4Gs0 "
    times = []
    for n in (2_000, 16_000):
        start = time.process_time()
        assert len(secrets.scan_text(token * n)) == n
        times.append(time.process_time() - start)
    assert times[1] < 24 * max(times[0], 0.01)


def test_decoding_by_trying_all_sets():
    import numpy as np

    r = random.Random(4)
    for _ in range(200):
        n = r.randint(1, 9)
        parent = [-1] + [r.randrange(k) for k in range(1, n)]
        score = np.array([r.uniform(-2, 2) for _ in range(n)])
        sets = [s for s in range(1 << n) if all(not s >> k & 1 or s >> parent[k] & 1 for k in range(1, n))]
        best = max(sum(score[k] for k in range(n) if s >> k & 1) for s in sets)
        kept = decode(parent, score)
        assert all(not kept[k] or kept[parent[k]] for k in range(1, n)) and score[kept].sum() == pytest.approx(best)


def test_decoding_is_hierarchical():
    kept = decode([-1, 0, 1, 1, 0], __import__("numpy").array([0.1, -1.0, 3.0, -0.5, -2.0]))
    assert kept.tolist() == [True, True, True, False, False]
