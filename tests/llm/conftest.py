import random

import pytest

#: A document table with extra columns whose names the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block long, row long, name string, score double, h long, crowd boolean"


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), 1, 2, "x", 0.5, 3, True) for i, t, s in ((r if len(r) == 3 else (*r, f"src{k % 3}")) for k, r in enumerate(rows))]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) rows with copies, near copies, repeated passages and lines, nulls, empties and repeated rows."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 7))) for _ in range(90)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, line = text(70), text(60)
    rows = [(i, text(r.choice([3, 12, 40, 150]))) for i in range(40)]
    for i in range(40, 60):
        base = rows[r.randrange(40)][1].split(" ")
        for _ in range(r.randint(0, 3)):
            base[r.randrange(len(base))] = r.choice(words)
        rows.append((i, " ".join(base)))
    for i in range(60, 72):
        rows.append((i, text(20) + " " + passage + " " + text(15)))
    for i in range(72, 80):
        rows.append((i, text(10) + "\n" + line + "\n" + text(12) + ("\n" + line if i % 3 == 0 else "")))
    rows += [(80, ""), (81, None), (82, None), (83, " \t\n "), (84, "a"), (85, "ab cd"), (86, "x" * 900), (87, "x" * 350), (88, "ab" * 300 + "\n" * 5), (None, text(50)), (30, rows[30][1]), (31, text(25)), (89, "Ünïcödé ▁ 漢字 \u3000 \x00 \U0001f600 end")]
    rows.append((90, text(4000)))
    r.shuffle(rows)
    return rows
