"""Results held against ways of working them out that share no code with the operators."""

import hashlib
import random
import time
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from rowtrail.llm import media, secrets, urls


def test_url_grams_by_brute_force_and_linear(spark):
    rows = ["", "a", "A.b", "/é😀x/Y\n%20", "/" + "q" * 12]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate((a, b) for a in rows for b in rows)], "i int, a string, b string")
    for r in frame.withColumn("g", urls.grams(F.col("a"), F.col("b"))).collect():
        want = []
        for text, part in ((r.a, "h"), (r.b, "p")):
            t = "^" + text.lower() + "$"
            want += [part + t[k : k + n] for n in (3, 4, 5) for k in range(max(1, len(t) - n + 1))]
        assert r.g == want

    def seconds(n):
        page = spark.createDataFrame([(1, "http://a.b/" + "xyz%20é" * n)], "page_id long, url string")
        host, path = urls.url_parts(F.col("url"))
        began = time.time()
        page.select(F.size(urls.grams(host, path))).collect()
        return time.time() - began

    seconds(10)
    assert seconds(60_000) < 4 * seconds(15_000) * 2.5 + 1  # 420,000 characters


def test_media_by_plain_arithmetic(documents):
    r = random.Random(8)
    texts = ["", "a", "ab" * 96, "Grüße " * 70, "".join(r.choice("abc \n") for _ in range(4000))]
    for row in media.media_columns(documents(list(enumerate(texts)))).collect():
        data = texts[row.doc_id].encode()
        size = max(192, -(-len(data) // 192) * 192)
        payload = data + b" " * (size - len(data))
        lines = [payload[k : k + 192] for k in range(0, size, 192)]
        mean = sum(payload) / size
        deviation = max(0.0, sum(v * v for v in payload) / size - mean * mean) ** 0.5
        feature = dict(x.split("=") for x in row.feature.split(" ")[2:])
        assert row.feature.startswith(f"gray8 192x{len(lines)} ")
        assert int(feature["mean"]) == sum(payload) * 1000 // size and abs(int(feature["sd"]) - deviation * 1000) <= 1
        # a PNG from the format's own description: signature, header, filtered lines, end
        chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
        head = (192).to_bytes(4, "big") + len(lines).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + x for x in lines), 6)) + chunk(b"IEND", b"")
        assert (row.media_bytes, row.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())


def test_ownership_by_brute_force(documents):
    r = random.Random(9)
    values = ["".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGH23456789") for _ in range(28)) for _ in range(12)]
    rows = [(i, " ".join(f'password = "{v}";' for v in r.sample(values, r.randint(0, 3))), None if i % 9 == 0 else f"o{r.randrange(4)}") for i in range(60)]
    rows += [(100 + i, f'token: "{values[0][::-1]}"', "solo") for i in range(9)] + [(200 + i, f'token: "{values[1][::-1]}"', "solo") for i in range(10)]
    owners, repos, held = defaultdict(set), defaultdict(set), defaultdict(list)
    for i, text, owner in rows:
        for v in text.split('"')[1::2]:
            owners[v].add(owner)
            repos[v].add((owner, i))
            held[i].append(v)
    for row in secrets.scan_secrets(documents(rows)).collect():
        mine = held[row.doc_id]
        assert row.n_live == sum(len(owners[v]) == 1 and len(repos[v]) < 10 for v in mine)
        assert row.n_copied == sum(len(owners[v]) >= 3 or len(repos[v]) >= 10 for v in mine)
        assert row.n_assign == len(mine)
