"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, trained from document labels alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, buffers, prefix_hashes, slices, small_batches, span_hashes, word_spans

#: Bounds of the training sample: documents of each class, and bytes of one document (longer ones aren't trained on).
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_BYTES = 1500, 4500, 20_000
#: Word beginnings, in bytes, that are features beside the whole word.
PREFIXES = (4, 5, 6)
BIAS = -7.0
#: Share of labels taken to be wrong, the weight of the sum of weights, and a feature's least number of documents.
WRONG_LABELS, SPARSE, LEAST_DOCS = 0.02, 1e-5, 3
#: What a sentence must exceed, in the noisy-or's logarithm, to have a share: about a chance of 5 %.
FLOOR = 0.05
SENTENCE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

#: Bytes between words, and bytes that end a sentence.
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LAST = np.uint64(2**64 - 1)
_STOP = np.zeros(256, bool)
_STOP[[ord("."), ord("!"), ord("?"), ord("\n")]] = True


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: crc32 of the id's text modulo 5 is 0 (a null id counts as held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature hashes, their sentences, first sentence of each text and their number) for texts laid end to end.

    A sentence ends at ``. ! ?``, a line break or the text's end.  Each word gives its own hash and those of its
    first 4, 5 and 6 bytes where it is longer; letters A-Z count as lower case.
    """
    low = LOWER[raw]
    s = prefix_hashes(low)
    starts, ends, _ = word_spans(low, off, _BETWEEN)
    stops = np.concatenate([[0], np.cumsum(_STOP[raw])])
    sentence = stops[starts] + np.searchsorted(off, starts, side="right") - 1  # each text opens one, empty ones too
    with np.errstate(over="ignore"):
        parts, owner = [span_hashes(s, starts, ends)], [sentence]
        for k in PREFIXES:
            at = np.flatnonzero(ends - starts > k)
            parts.append(span_hashes(s, starts[at], starts[at] + k) ^ np.uint64(k))
            owner.append(sentence[at])
    return np.concatenate(parts), np.concatenate(owner), stops[off] + np.arange(len(off))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0.0, -z))


def shares(z: np.ndarray) -> np.ndarray:
    """Each sentence's part in -log(1 - P(document)): none up to ``FLOOR``, so harmless ones don't add up."""
    return np.maximum(0.0, softplus(z) - FLOOR)


def fit(ids: np.ndarray, sentence: np.ndarray, doc: np.ndarray, y: np.ndarray, n: int, rounds: int = 60, rate: float = 0.35) -> tuple[np.ndarray, float]:
    """Weights by Adam on the noisy-or likelihood: P(doc) = 1 - prod(1 - sigmoid(bias + sum of the sentence's weights)).

    ids/sentence: a feature and its sentence; doc: each sentence's document; y: each document's label.  Weights stay at
    0 or more: a word can make a sentence toxic, none can excuse it, so harmless words learn nothing by heart.  A label
    counts as wrong with a small chance, so one that nothing in its text explains doesn't bend the weights.
    """
    w, bias = np.zeros(n), BIAS
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    right = 1 - 2 * WRONG_LABELS
    for t in range(1, rounds + 1):
        z = bias + np.bincount(sentence, w[ids], len(doc))
        clean = np.exp(-np.bincount(doc, softplus(z), len(y)))
        said = WRONG_LABELS + right * (1 - clean)
        slope = np.where(y == 1, -1 / said, 1 / (1 - said)) * right * clean
        dz = slope[doc] * sigmoid(z) / len(y)
        g, gb = np.bincount(ids, dz[sentence], n) + SPARSE, dz.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, c = 1 - 0.9**t, 1 - 0.99**t
        w = np.maximum(0.0, w - rate * (m / a) / (np.sqrt(v / c) + 1e-6))
        bias -= 0.05 * (mb / a) / (np.sqrt(vb / c) + 1e-6)
    return w, bias


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, owners, docs, labels, n_sent = [], [], [], [], 0
    for batch in batches:
        raw, off = buffers(batch.column("text"))
        h, s, first = features(raw, off)
        count = int(first[-1])
        of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        hashes.append(h)
        owners.append(s + n_sent)
        docs.append(of + len(labels))
        n_sent += count
        labels += batch.column("toxic").to_pylist()
    if not labels or len(set(labels)) < 2:
        keys, weights, bias = np.zeros(0, np.uint64), np.zeros(0), BIAS if not labels or not labels[0] else 0.0
    else:
        h, s = np.concatenate(hashes), np.concatenate(owners)
        keys, ids = np.unique(h, return_inverse=True)
        seen = np.unique(ids.astype(np.int64) * len(labels) + np.concatenate(docs)[s])
        kept = np.bincount(seen // len(labels), minlength=len(keys)) >= LEAST_DOCS
        new = np.cumsum(kept) - 1
        use = kept[ids]
        worded, s = np.unique(s, return_inverse=True)  # sentences without words have no share
        weights, bias = fit(new[ids[use]], s[use], np.concatenate(docs)[worded], np.array(labels), int(kept.sum()))
        keys = keys[kept]
        strong = weights > 0.02
        keys, weights = keys[strong], weights[strong]
    yield pa.RecordBatch.from_arrays(
        [pa.array([keys.tobytes()], pa.binary()), pa.array([weights.astype(np.float32).tobytes()], pa.binary()), pa.array([float(bias)])], names=["keys", "weights", "bias"]
    )


class Model:
    """Weights by feature; one that isn't there has weight 0.  Bounded by the training sample, whatever the corpus."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(keys)
        self.keys, self.weights, self.bias = np.append(keys[order], _LAST), np.append(weights[order], 0).astype(float), bias

    def sentences(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(margin of each sentence, first sentence of each text); minus infinity, so no share, for one without words."""
        h, s, first = features(raw, off)
        at = np.searchsorted(self.keys, h)
        hit = np.flatnonzero(self.keys[at] == h)
        z = self.bias + np.bincount(s[hit], self.weights[at[hit]], int(first[-1]))
        z[np.bincount(s, minlength=len(z)) == 0] = -np.inf
        return z, first


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of labelled rows outside the held-out fold, in one task.

    The ids are the first of each class in the order of a hash, taken from the labels alone; the texts are then found
    in one scan with a broadcast of those ids.  Null labels and ids aren't used; an id with several labels is toxic
    if one of them says so.  Without two classes the model says the one it saw (clean, if none).
    """
    small_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = known.where("toxic = 1").orderBy(order, "doc_id").limit(TRAIN_TOXIC).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(TRAIN_CLEAN))
    sample = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .where(F.octet_length("text") <= TRAIN_BYTES)
        .join(F.broadcast(chosen), "doc_id")
        .repartition(1)
        .sortWithinPartitions("doc_id", "text")
    )
    row = sample.select("text", "toxic").mapInArrow(_train, "keys binary, weights binary, bias double").first()
    return Model(np.frombuffer(row.keys, np.uint64), np.frombuffer(row.weights, np.float32), row.bias) if row else Model(np.zeros(0, np.uint64), np.zeros(0, np.float32), BIAS)


def _sentence_spans(raw: np.ndarray, off: np.ndarray, d: int, wanted: np.ndarray, first: np.ndarray, scores: np.ndarray) -> list[dict]:
    """Code-point ranges of a text's wanted sentences (numbers within the text)."""
    part = raw[off[d] : off[d + 1]]
    points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
    cuts = np.concatenate([[0], np.flatnonzero(_STOP[part]) + 1, [len(part)]])
    return [{"start": int(points[cuts[k]]), "end": int(points[cuts[k + 1]]), "score": float(scores[first[d] + k])} for k in wanted if k + 1 < len(cuts)]


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part, raw, off in slices(batch, "text"):
                z, first = m.sentences(raw, off)
                total = np.add.reduceat(shares(z), first[:-1]) if part.num_rows else np.zeros(0)
                score = -np.expm1(-total)
                p = sigmoid(z)
                bad = np.flatnonzero(p >= 0.5)
                where: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for d in np.unique(np.searchsorted(first[:-1], bad, side="right") - 1):
                    mine = bad[(bad >= first[d]) & (bad < first[d + 1])]
                    where[d] = _sentence_spans(raw, off, d, mine - first[d], first, p)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in range(part.num_columns - 1)], pa.array(score, pa.float64()), pa.array(where, SENTENCE)],
                    names=[*part.schema.names[:-1], "score", "sentences"],
                )

    return run


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, sentences): the noisy-or of all sentences of the whole text, and the sentences of 0.5 or more.

    Sentence ranges are code points, end exclusive.  Sentences without words, and those under ``FLOOR``, have no share,
    so texts without words, null and empty ones included, score 0, and a clean text scores low however long it is.  Repeated rows score alike; extra columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scorer(shared), "doc_id long, score double, sentences array<struct<start:int,end:int,score:double>>")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score under the model trained on the labelled rows outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("sentences").alias("n_sentences"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents whose score is under 0.5, with their columns as they came."""
    small_batches(spark)
    model = spark.sparkContext.broadcast(train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, off in slices(batch, "text"):
                z, first = model.value.sentences(raw, off)
                clean = -np.expm1(-np.add.reduceat(shares(z), first[:-1])) < 0.5
                yield part.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)
