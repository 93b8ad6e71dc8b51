import corpus_pipeline
from rowtrail.llm.queries import ORACLE_SQL, QUERIES


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding"]


def test_pipeline_runs_and_stages_act(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    out = corpus_pipeline.run(spark, sf)
    rows = out.collect()
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids)) and set(ids) < {r.doc_id for r in docs.select("doc_id").collect()}
    assert len(set(ids) & toxic) <= max(1, len(toxic) // 4)
    assert all(r.n_pieces == len(r.pieces) for r in rows)


def test_toxic_stage_by_brute_force(spark, documents, tmp_path):
    """The stage keeps exactly the rows whose score, from the sentences' weights one by one, is under a half."""
    import math
    import random
    import re

    import numpy as np
    import pyarrow as pa

    from rowtrail.llm import toxicity
    from rowtrail.llm.common import buffers

    r = random.Random(1)
    text = lambda bad: ". ".join(" ".join(r.choice(["sun", "tree", "river", "stone", "cloud"]) for _ in range(6)) + (" vile" if bad and k == 1 else "") for k in range(3))
    rows = [(i, text(i % 4 == 0)) for i in range(200)]
    labels = [(i, int(i % 4 == 0)) for i in range(200)]
    rows += [(500, None), (501, ""), (502, "vile"), (502, "vile"), (503, "vile tree. " * 30), (None, "sun vile")]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(rows)
    out = toxicity.drop_toxic(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    known = dict(zip(model.keys.tolist(), model.weights.tolist()))

    def score(t):
        total = 0.0
        for s in re.split(r"[.!?\n]", t or ""):
            words = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", s)
            z = model.bias
            for w in words:
                h = toxicity.features(*buffers(pa.array([w])))[0]
                z += sum(known.get(x, 0.0) for x in h.tolist())
            total += max(0.0, float(np.logaddexp(0, z)) - toxicity.FLOOR) if words else 0.0
        return -math.expm1(-total)

    want = sorted(str((i, t)) for i, t in rows if score(t) < 0.5)
    assert sorted(str((x.doc_id, x.text)) for x in out.collect()) == want and 140 < len(want) < 160
    assert toxicity.drop_toxic(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_encoding_stage_against_the_library(spark, documents, corpus):
    import sentencepiece

    from rowtrail.llm import pieces

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    docs = documents([(i, t) for i, t in corpus if not t or "▁" not in t] + [(900, "w" * 500 + " " + "straße" * 40)])
    got = pieces.encode_documents(spark, docs, "").collect()
    assert {x for x in pieces.encode_documents(spark, docs, "").columns} == {"doc_id", "text", "n_pieces", "pieces"}
    assert len(got) == docs.count()
    for x in got:
        assert x.pieces == library.encode(x.text or "") and x.n_pieces == len(x.pieces)
    assert pieces.encode_documents(spark, docs.limit(0), "").count() == 0
