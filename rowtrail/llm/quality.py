"""Quality by a factorisation machine: hashed words, structure and metadata with low-rank pairwise interactions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, prefix_hashes, slices, small_batches, span_hashes, word_spans

#: Bounds of the training sample: labelled documents of each class, whole texts.
TRAIN_LOW, TRAIN_GOOD = 1500, 4500
#: Buckets of the hashed words, and rank of the interactions.
BUCKETS, RANK = 1 << 15, 8
#: Passes of the fit, its rate, and the weight of the squared weights (linear, interactions).
ROUNDS, RATE, SHRINK = 60, 0.05, (1e-5, 1e-4)
#: Shares (0 to 1) that describe a text's structure; each is a number and one of ``STEPS`` + 1 steps.
STATS = (
    "upper", "symbols", "shouts", "bars", "digits", "other_bytes", "spaces", "word_length", "distinct", "twice", "commonest", "capitals",
    "line_words", "line_stops", "lines_again", "size",
)
STEPS = 12
#: Steps of a metadata number: sign and power of two, and one for null.
META_STEPS = 130

_KIND = np.zeros((6, 256), bool)
_KIND[0, 65:91] = True
_KIND[1, [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-()!?|"]] = True
_KIND[2, [33, 63]] = True
_KIND[3, 124] = True
_KIND[4, 48:58] = True
_KIND[5, 128:] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[[46, 33, 63, 58, 59]] = True


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: crc32 of the id's text modulo 3 is 1 (a null id counts as held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many of the bytes (or words) of each text are flagged."""
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[off])


def structure(raw: np.ndarray, off: np.ndarray, starts: np.ndarray, first: np.ndarray, words: np.ndarray) -> np.ndarray:
    """``STATS`` of each text; ``words`` are hashes of the words that begin at ``starts``, ``first`` each text's first."""
    size, n = np.diff(off), np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    count = [_per_text(k[raw], off) for k in _KIND]
    letters, spaces = _per_text(_LETTER[raw], off), _per_text(_SPACE[raw], off)
    order = np.lexsort((words, text))
    t, w = text[order], words[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (w[1:] != w[:-1])
    heads = np.flatnonzero(new)
    times = np.diff(np.append(heads, len(t)))
    most = np.zeros(len(n), np.int64)
    np.maximum.at(most, t[heads], times)
    twice = np.zeros(len(words), bool)
    twice[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    breaks = np.flatnonzero(raw == 10)
    s = prefix_hashes(raw)
    begin = np.union1d(off[:-1], breaks + 1)
    begin = begin[begin < len(raw)]
    end = np.append(begin, len(raw))[1:]
    end = end - (raw[end - 1] == 10)
    at = np.searchsorted(off, begin, side="right") - 1
    full = end > begin
    begin, end, at = begin[full], end[full], at[full]
    lines = np.bincount(at, minlength=len(n))
    which = np.lexsort((h := span_hashes(s, begin, end), at))
    again = np.zeros(len(h), bool)
    again[1:] = (h[which][1:] == h[which][:-1]) & (at[which][1:] == at[which][:-1])
    stats = [
        _share(count[0], letters), *(_share(c, size) for c in count[1:]), _share(spaces, size),
        np.minimum(1.0, _share(size - spaces, n) / 32), _share(np.bincount(t[heads], minlength=len(n)), n), _share(_per_text(twice, first), n),
        _share(most, n), _share(_per_text(_KIND[0][raw[starts]], first), n), np.minimum(1.0, _share(n, lines) / 256),
        _share(np.bincount(at, _STOP[raw[end - 1]], minlength=len(n)), lines), _share(np.bincount(at[which], again, minlength=len(n)), lines),
        np.minimum(1.0, np.log2(size + 1.0) / 32),
    ]
    return np.stack(stats, axis=1)


def features(raw: np.ndarray, off: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of texts laid end to end, by text; ``meta`` has a column a metadata number, NaN for null.

    Words weigh by the root of their count, all of a text's together 1; a number is itself, one of its steps, and of a
    metadata number the power of two.
    """
    texts = len(off) - 1
    starts, ends, first = word_spans(raw, off)
    words = span_hashes(prefix_hashes(raw), starts, ends)
    stats = structure(raw, off, starts, first, words)
    n = np.diff(first)
    key, count = np.unique(np.repeat(np.arange(texts), n) * BUCKETS + (words % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    of = key // BUCKETS
    k = len(STATS)
    steps = np.floor(STEPS * np.sqrt(stats)).astype(np.int64) + (STEPS + 1) * np.arange(k)
    power = np.clip(np.floor(np.log2(np.maximum(np.abs(np.nan_to_num(meta)), 1))), 0, 63) + np.where(np.nan_to_num(meta) < 0, 65, 0)
    power = np.where(np.isnan(meta), 64, power).astype(np.int64) + META_STEPS * np.arange(meta.shape[1])
    numbers = np.concatenate([np.tile(np.arange(k), (texts, 1)), k + steps, k + (STEPS + 1) * k + power], axis=1)
    values = np.concatenate([stats, np.ones((texts, k + meta.shape[1]))], axis=1)
    text = np.concatenate([of, np.repeat(np.arange(texts), numbers.shape[1])])
    feature = np.concatenate([key % BUCKETS, BUCKETS + numbers.ravel()])
    value = np.concatenate([np.sqrt(count / np.maximum(n, 1)[of]), values.ravel()])
    order = np.argsort(text, kind="stable")
    return text[order], feature[order], value[order]


def width(metadata: int) -> int:
    """Number of features."""
    return BUCKETS + len(STATS) * (STEPS + 2) + META_STEPS * metadata


def margins(bias: float, w: np.ndarray, v: np.ndarray, text: np.ndarray, feature: np.ndarray, value: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(bias + linear part + all pairs' interactions, sums of the factors) of each text.

    The pairs are half of (square of the sum - sum of the squares) a factor, so a text costs its features, not pairs.
    """
    x = v[feature] * value[:, None]
    s = np.stack([np.bincount(text, x[:, f], texts) for f in range(v.shape[1])], axis=1)
    squares = np.bincount(text, (x * x).sum(axis=1), texts)
    return bias + np.bincount(text, w[feature] * value, texts) + 0.5 * ((s * s).sum(axis=1) - squares), s


def fit(text: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray, n: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by Adam on the logistic loss over all rows; features never seen stay at 0."""
    w = np.zeros(n)
    v = np.random.default_rng(7).normal(0, 0.05, (n, RANK))
    v[np.bincount(feature, minlength=n) == 0] = 0
    bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    state = [(np.zeros_like(a), np.zeros_like(a)) for a in (np.zeros(1), w, v)]
    for t in range(1, ROUNDS + 1):
        z, s = margins(bias, w, v, text, feature, value, len(y))
        slope = (1 / (1 + np.exp(-z)) - y) / len(y)
        g = slope[text] * value
        square = np.bincount(feature, g * value, n)
        gv = np.stack([np.bincount(feature, g * s[text, f], n) for f in range(RANK)], axis=1) - v * square[:, None]
        steps = []
        for (m1, m2), grad in zip(state, (np.array([slope.sum()]), np.bincount(feature, g, n) + SHRINK[0] * w, gv + SHRINK[1] * v)):
            m1 += 0.1 * (grad - m1)
            m2 += 0.01 * (grad * grad - m2)
            steps.append(RATE * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8))
        bias -= float(steps[0][0])
        w -= steps[1]
        v -= steps[2]
    return bias, w, v


def _numbers(batch: pa.RecordBatch, metadata: int) -> np.ndarray:
    """The metadata columns, which follow the id and the text, as numbers."""
    columns = [np.asarray(batch.column(2 + k).to_numpy(zero_copy_only=False), float) for k in range(metadata)]
    return np.stack(columns, axis=1) if columns else np.zeros((batch.num_rows, 0))


def _featured(metadata: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, off in slices(batch, "text"):
                text, feature, value = features(raw, off, _numbers(part, metadata))
                at = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(part.num_columns - 1), pa.ListArray.from_arrays(at, pa.array(feature, pa.int32())), pa.ListArray.from_arrays(at, pa.array(value))],
                    names=["doc_id", "good", "feature", "value"],
                )

    return run


def _fitted(metadata: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        y = np.concatenate([np.asarray(b.column("good"), float) for b in tables]) if tables else np.zeros(0)
        n = width(metadata)
        if len(set(y.tolist())) < 2:
            bias, w, v = (0.0 if not len(y) else 4.0 if y[0] else -4.0), np.zeros(n), np.zeros((n, RANK))
        else:
            size = np.concatenate([b.column("feature").value_lengths().to_numpy(zero_copy_only=False) for b in tables])
            feature, value = (np.concatenate([b.column(c).flatten().to_numpy(zero_copy_only=False) for b in tables]) for c in ("feature", "value"))
            bias, w, v = fit(np.repeat(np.arange(len(y)), size), feature.astype(np.int64), value, y, n)
        yield pa.RecordBatch.from_arrays([pa.array([bias]), pa.array([w.astype(np.float32).tobytes()], pa.binary()), pa.array([v.astype(np.float32).tobytes()], pa.binary())], names=["bias", "w", "v"])

    return run


class Model:
    """Bias, weights and factors: about 1.2 MB, whatever the corpus; and the names of the metadata columns."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray, metadata: Sequence[str]):
        self.bias, self.w, self.v, self.metadata = bias, w, v, tuple(metadata)

    def score(self, raw: np.ndarray, off: np.ndarray, meta: np.ndarray) -> np.ndarray:
        z, _ = margins(self.bias, self.w, self.v, *features(raw, off, meta), len(off) - 1)
        return np.exp(-np.logaddexp(0.0, -z))


def _rows(docs: DataFrame, metadata: Sequence[str]) -> DataFrame:
    named = [F.col(c).cast("double").alias(f"m{k}") for k, c in enumerate(metadata)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *named)


def train(docs: DataFrame, labels: DataFrame, metadata: Sequence[str] = ("n_chars",)) -> Model:
    """Fit on a bounded sample of labelled rows outside the held-out fold.

    The ids are the first ``TRAIN_LOW`` and ``TRAIN_GOOD`` of the classes in the order of a hash, taken from the labels
    alone; the tasks that hold their texts turn them into features, and one task fits on those.  Null labels and ids
    aren't used; an id with several labels is good if all say so; of a repeated id the least text is used, so the bound holds.  Without two
    classes the model says the one it saw (a half, if none).
    """
    small_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("good"))
    order = F.xxhash64("doc_id")
    chosen = known.where("good = 0").orderBy(order, "doc_id").limit(TRAIN_LOW).unionByName(known.where("good = 1").orderBy(order, "doc_id").limit(TRAIN_GOOD))
    found = _rows(docs, metadata).join(F.broadcast(chosen), "doc_id")
    of_id = F.struct(*[c for c in found.columns if c != "doc_id"])
    sample = found.groupBy("doc_id").agg(F.min(of_id).alias("row")).select("doc_id", "row.*").mapInArrow(_featured(len(metadata)), "doc_id long, good int, feature array<int>, value array<double>")
    one = sample.repartition(1).sortWithinPartitions("doc_id", "feature", "value").select("good", "feature", "value")
    row = one.mapInArrow(_fitted(len(metadata)), "bias double, w binary, v binary").first()
    if row is None:
        return Model(0.0, np.zeros(width(len(metadata))), np.zeros((width(len(metadata)), RANK)), metadata)
    return Model(row.bias, np.frombuffer(row.w, np.float32), np.frombuffer(row.v, np.float32).reshape(-1, RANK), metadata)


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): the chance that a whole text is of good quality.

    Null texts count as empty; those score by their structure and metadata, null metadata by a step of its own.  What
    training never saw has no weight.  Repeated rows score alike; columns that the model doesn't name are ignored; an
    empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, raw, off in slices(batch, "text"):
                score = m.score(raw, off, _numbers(part, len(m.metadata)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], names=["doc_id", "score"])

    return _rows(docs, model.metadata).mapInArrow(run, "doc_id long, score double")


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score under the model trained on the labelled rows outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_quality(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
