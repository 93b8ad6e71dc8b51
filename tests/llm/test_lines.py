import random
import re
import time

from rowtrail.llm.lines import dedup_lines, drop_repeated_lines

LAST = 2**63 - 1


def brute(rows, least):
    count = lambda line: len(re.findall(r"[^\x20\x09-\x0D]+", line))
    runs, first = [], {}
    for n, (i, t) in enumerate(rows):
        if t is None:
            continue
        lines = t.split("\n")
        for s in range(len(lines)):
            words, e = 0, s
            while e < len(lines) and words < least:
                words += count(lines[e])
                e += 1
            if words >= least:
                run, at = tuple(lines[s:e]), (LAST if i is None else i, s)
                first[run] = min(first.get(run, at), at)
                runs.append((n, s, e, run, at))
    gone = {}
    for n, s, e, run, at in runs:
        if first[run] < at:
            gone.setdefault(n, set()).update(range(s, e))
    return [None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(n, ())) for n, (_, t) in enumerate(rows)]


def test_against_brute_force(documents, corpus):
    for least in (50, 20, 1):
        want = sorted((i is None, i or 0, t is None, t or "") for (i, _), t in zip(corpus, brute(corpus, least)))
        got = sorted((r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "") for r in dedup_lines(documents(corpus), least).collect())
        assert got == want


def test_runs_of_several_lines(documents):
    a = [f"line {i} has five words" for i in range(40)]
    rows = [(1, "\n".join(a)), (2, "\n".join(["own text", *a[3:17], "more of it"])), (3, "\n".join(a[5:9])), (4, "\n".join(a[:30] + ["x"] + a[:30]))]
    got = {r.doc_id: (r.text, r.n_removed) for r in dedup_lines(documents(rows)).collect()}
    assert got[2] == ("own text\nmore of it", 14)
    assert got[3][1] == 0 and got[4] == ("x", 60)


def test_stage_keeps_columns_and_drops_emptied(spark, documents, corpus):
    docs = documents(corpus)
    out = drop_repeated_lines(spark, docs, "")
    assert out.columns == docs.columns
    ids = {r.doc_id for r in out.collect()}
    assert {80, 81, 82}.issubset(ids)
    assert drop_repeated_lines(spark, docs.limit(0), "").count() == 0


def every_run(rows, least):
    """What stays where every repeated run of ``least`` words is deleted, by trying all runs."""
    count = lambda line: len(re.findall(r"[^\x20\x09-\x0D]+", line))
    runs, first = [], {}
    for n, (i, t) in enumerate(rows):
        lines = t.split("\n")
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                if sum(map(count, lines[s:e])) >= least:
                    run, at = tuple(lines[s:e]), (i, s)
                    first[run] = min(first.get(run, at), at)
                    runs.append((n, s, e, run, at))
    gone = [set() for _ in rows]
    for n, s, e, run, at in runs:
        if first[run] < at:
            gone[n].update(range(s, e))
    return [(i, len(g), "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g)) for (i, t), g in zip(rows, gone)]


def test_whole_runs_go(documents):
    long = " ".join(f"a{i}" for i in range(60))
    copied = "\n".join([long, "ten words " * 5, "five words in this line", "", ""])
    rows = [(1, copied), (2, copied), (3, "own\n" + copied + "\nother"), (4, "\n" + copied[:-2])]
    got = sorted((r.doc_id, r.n_removed, r.text) for r in dedup_lines(documents(rows)).collect())
    assert got == every_run(rows, 50)
    assert got[1] == (2, 5, "") and got[2] == (3, 5, "own\nother")


def test_every_run_by_brute_force(documents):
    r = random.Random(11)
    line = lambda: " ".join(r.choice("ab") for _ in range(r.choice([0, 0, 1, 2, 5, 9, 30])))
    pool = [[line() for _ in range(r.randint(1, 14))] for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [x[r.randrange(len(x)) :][: r.randint(1, 14)] for x in (r.choice(pool) for _ in range(r.randint(1, 3)))]
        rows.append((i, "\n".join(sum(parts, []) + [line() for _ in range(r.randint(0, 2))])))
    for least in (50, 12, 1):
        got = sorted((d.doc_id, d.n_removed, d.text) for d in dedup_lines(documents(rows), least).collect())
        assert got == every_run(rows, least)


def test_very_many_lines_in_one_text(spark, documents):
    """Time grows with the number of lines, not with its square."""
    def seconds(n):
        text = "\n".join(f"line {i} of a very long text" for i in range(n))
        docs = documents([(1, text), (2, "\n".join(text.split("\n")[5:25]))])
        start = time.time()
        assert {r.doc_id: r.n_removed for r in dedup_lines(docs).select("doc_id", "n_removed").collect()} == {1: 0, 2: 20}
        return time.time() - start

    seconds(1000)
    assert seconds(300_000) < 60
