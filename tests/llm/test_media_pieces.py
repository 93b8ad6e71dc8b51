import hashlib
import random
import zlib

import pytest

from rowtrail.llm import media, pieces
from rowtrail.llm.common import scratch


def test_media_round_trip(spark, documents, corpus):
    got = sorted(tuple(r) for r in media.media_columns(documents([r for r in corpus if r[0] is not None])).collect())
    want = []
    for i, t in corpus:
        if i is None:
            continue
        data = (t or "").encode()
        payload = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        png = media.encode_png(payload)
        assert media.decode_png(png) == payload
        want.append((i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(png), hashlib.sha256(png).hexdigest(), media.feature_of(payload)))
    assert got == sorted(want)
    assert media.media_columns(documents([(None, "a")])).first().doc_id is None
    assert media.media_columns(documents([]).limit(0)).count() == 0


def test_byte_ranges_cover_each_member_once(spark, documents):
    folder = scratch(spark, "media")
    assert media.write_archives(documents([(i, "text " * i) for i in range(200)]).repartition(3), folder) == 200
    for size in (100, 5000, 1 << 30):
        assert sorted(int(r.name.split(".")[0]) for r in media.read_media(spark, folder, size).collect()) == list(range(200))


def test_members_are_retried(spark, documents, monkeypatch):
    folder = scratch(spark, "media")
    media.write_archives(documents([(1, "a"), (2, "b")]).coalesce(1), folder)
    reader = media.MediaReader({"path": folder})
    part = reader.partitions()[0]
    real, asked = media.read_at, []

    def flaky(stream, member):
        asked.append(member.header_offset)
        if len(asked) <= 2:
            raise OSError("lost")
        return real(stream, member)

    monkeypatch.setattr(media, "read_at", flaky)
    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    assert sum(b.num_rows for b in reader.read(part)) == 2
    assert asked[:3] == [asked[0]] * 3 and len(asked) == 4  # the lost member alone is read again


def test_broken_media_is_refused():
    png = bytearray(media.encode_png(b" " * 192))
    png[40] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(png))


def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_pieces_equal_the_library(documents, corpus):
    sp = library()
    rows = [r for r in corpus if r[0] is not None] + [(200, "aaaa" * 60 + " b"), (201, "  two  spaces \n\n x"), (202, " " * 80), (203, "word.\nNext 12,5 (a)b")]
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    for r in pieces.encode_texts(documents(rows)).collect():
        assert r.text in texts[r.doc_id]
        assert r.pieces == sp.encode(r.text or "")
        assert r.decoded == (r.text or "").replace("▁", " ")
    assert pieces.encode_texts(documents([]).limit(0)).count() == 0


def test_decode_pieces(spark):
    sp = library()
    rows = [(1, sp.encode("Grüße, 世界 ① done")), (2, []), (3, None), (4, [3 + 0xFF])]
    got = {r.i: r.decoded for r in pieces.decode_pieces(spark.createDataFrame(rows, "i int, pieces array<int>")).collect()}
    assert got == {1: "Grüße, 世界 ① done", 2: "", 3: None, 4: "\ufffd"}


def test_viterbi_fold_against_brute_force(spark):
    r = random.Random(4)
    texts = list({"".join(r.choice("abc▁") if k else r.choice("abc▁") for k in range(n)) for n in (1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 4) for _ in range(4)})
    texts = [t for t in texts if "▁" not in t.lstrip("▁")]
    model = pieces.Pieces(texts, [-round(r.uniform(0.5, 6), 3) for _ in texts], "unigram", None)
    words = list({"".join(r.choice("abcd") for _ in range(r.randint(1, 9))) for _ in range(60)})
    frame = spark.createDataFrame([(w,) for w in words], "word string").repartition(3, "word")
    scores = dict(zip(model.texts, model.scores))
    lowest = min(scores.values()) - 10

    def best(w):
        paths = [(0.0, [])]
        out = []

        def walk(at, score, parts):
            if at == len(w):
                out.append((score, parts))
                return
            for e in range(at + 1, len(w) + 1):
                s = scores.get(w[at:e], lowest if e == at + 1 else None)
                if s is not None:
                    walk(e, score + s, [*parts, w[at:e]])

        walk(0, *paths[0])
        return max(x for x, _ in out)

    found = {x.word: x.mask for x in pieces.segment_words(frame, model).collect()}
    encoder = pieces.Encoder(model)
    for w in words:
        mask = found.get(w)
        cuts = [i for i in range(len(w) + 1) if mask >> i & 1] if mask is not None else list(range(len(w) + 1))
        got = [w[a:b] for a, b in zip(cuts, cuts[1:])]
        assert abs(sum(scores.get(p, lowest) for p in got) - best(w)) < 1e-9
        assert abs(sum(scores.get(p, lowest) for p in pieces.best_path(w, scores, model.longest, lowest)) - best(w)) < 1e-9
    assert encoder.of_segments(["d"]) == (model.unknown,)


def test_a_block_of_many_words_takes_little_room():
    """A task's table of 120,000 distinct words, all asked for twice, in and out of their order."""
    import tracemalloc

    import pyarrow as pa

    r = random.Random(3)
    model = pieces.Pieces(["▁", *"abcdefghij", "▁a", "bc"], [-float(k) for k in range(13)], "bpe", None)
    words = sorted({"▁" + "".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(120_000)})
    cuts = [1 | 1 << r.randint(1, 9) | 1 << 10 for _ in words]

    class Side:
        def load(self, block):
            if block == 2:
                return None
            at = list(range(len(words)))
            if block == 1:
                r.shuffle(at)
            return pa.table({"word": [words[i] for i in at], "mask": pa.array([cuts[i] for i in at], pa.int64())})

    encoder = pieces.Encoder(model)
    for block in (0, 1):
        tracemalloc.start()
        got = pieces._Words(encoder, Side())
        got.open(block)
        for _ in range(2):
            for i, w in enumerate(words):
                x = got[w.replace("▁", " ")]
                if i % 50 == 0:
                    assert x == encoder_bytes(encoder, w, cuts[i])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 24e6, peak
        assert got.mask("zz") is None and got.mask(" a") is None and got.mask("") is None
    got.open(2)
    assert got.mask(words[5].replace("▁", " ")) is None


def encoder_bytes(encoder, word, mask):
    import numpy as np

    return np.array(encoder.of_word(word.replace("▁", " "), mask), np.int32).tobytes()


def test_words_of_many_texts_against_a_pattern():
    """Words cut in step, over slices, nulls, empty texts, odd signs and the model's own space mark."""
    import re

    import pyarrow as pa

    r = random.Random(8)
    model = pieces.Pieces.load(pieces.MODEL)
    signs = " \n.,!?ab1é世▁\t\r" + model.odd + model.marks
    texts = [None, "", " ", "\n", "a", "  ", "\n\n ", "▁"] + ["".join(r.choice(signs[: r.choice((6, 20, 99))]) for _ in range(r.randint(0, 30))) for _ in range(2000)] + [""]

    def words(text):
        marks = re.escape(model.marks)
        fine = not re.search(f"[{re.escape(model.odd)}]", text)
        pattern = rf" *[^ \n{marks}]+| *[{marks}]+| +|\n" if fine else r" *[^ \n]+| +|\n"
        return re.findall(pattern, " " + text.replace("▁", " ")) if text else []

    for part in (pa.array(texts, pa.string()), pa.array(texts, pa.string()).slice(3, 50), pa.array([""], pa.string()), pa.array([], pa.string())):
        cut, at = model.words(part)
        cut.validate(full=True)
        got = cut.to_pylist()
        assert [got[a:b] for a, b in zip(at, at[1:])] == [words(t or "") for t in part.to_pylist()]


def test_words_are_looked_up_in_step():
    """2,000 texts over a block of 60,000 words: ids equal the library's, in less time than single words of a tenth of the texts."""
    import time

    import numpy as np
    import pyarrow as pa

    sp = library()
    r = random.Random(9)
    model = pieces.Pieces.load(pieces.MODEL)
    encoder = pieces.Encoder(model)
    stock = ["".join(r.choice("aeiounrstlé世") for _ in range(r.randint(2, 9))) for _ in range(60_000)] + ["x" * 70, "\U0001f9ff", "q"]
    texts = [" ".join(r.choice(stock) for _ in range(200)) + r.choice(["", "\n", " \n", "  "]) for _ in range(2000)] + [None, "", " ", "x" * 70, "\U0001f9ff" * 3]
    words = sorted({w.replace(" ", "▁") for w in set(model.words(pa.array(texts, pa.string()))[0].to_pylist()) if 1 < len(w) <= pieces.FOLD_CHARS})
    masks = []
    for w in words:
        ends = np.cumsum([len(s) for s in pieces.merge_long(w, encoder.scores)])
        masks.append(1 + sum(1 << int(e) for e in ends))
    whole = [i for i, m in enumerate(masks) if m != (1 << len(words[i]) + 1) - 1]  # words without edges aren't in the table

    class Side:
        def load(self, block):
            return pa.table({"word": [words[i] for i in whole], "mask": pa.array([masks[i] for i in whole], pa.int64())}) if block else None

    got = pieces._Words(encoder, Side())
    got.open(0)
    assert got.of_texts(pa.array([None, "", "\U0001f9ff"], pa.string()))[0].tolist() == sp.encode("\U0001f9ff")
    got.open(1)
    began = time.process_time()
    ids, at = got.of_texts(pa.array(texts, pa.string()))
    decoded = encoder.decode_all(ids, at).to_pylist()
    in_step = time.process_time() - began
    assert decoded == [t or "" for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [sp.encode(t or "") for t in texts]
    began = time.process_time()
    single = [b"".join(map(got.__getitem__, model.words(pa.array([t], pa.string()))[0].to_pylist())) for t in texts[::10]]
    assert in_step < time.process_time() - began
    assert single == [ids[a:b].tobytes() for a, b in zip(at, at[1:])][::10]


def test_decode_all_repairs_bytes():
    import numpy as np

    encoder = pieces.Encoder(pieces.Pieces.load(pieces.MODEL))
    rows = [[], [3 + 0xFF], library().encode("Grüße, 世界 ① done"), [3 + 0xC3, 3 + 0xBC]]
    at = np.cumsum([0, *map(len, rows)])
    flat = np.array([i for row in rows for i in row], np.int32)
    assert encoder.decode_all(flat, at).to_pylist() == [encoder.decode(row) for row in rows]
    assert encoder.decode_all(flat[:0], np.zeros(3, np.int64)).to_pylist() == ["", ""]
