import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowtrail.operators import boost
from rowtrail.operators.specs import Draws
from rowtrail.sources import datasets
from rowtrail.streaming.windows import score_windows, settle, stream_windows


def whole(steps, length, pad):
    """Windows of a table of steps."""
    out, runs = [], []
    for t in sorted(steps):
        if runs and runs[-1][-1] == t - 1:
            runs[-1].append(t)
        else:
            runs.append([t])
    for r in runs:
        for k in range(0, len(r), length):
            w = r[k : k + length]
            if len(w) == length or pad:
                out.append((r[0], k // length, w + [None] * (length - len(w))))
    return sorted(out, key=str)


@pytest.mark.parametrize("pad", [False, True])
def test_settling_in_any_order_gives_the_tables_windows(pad):
    r = random.Random(1)
    for _ in range(400):
        length, delay = r.randint(1, 4), r.randint(0, 6)
        steps = [t for t in range(40) if r.random() < 0.7]
        arrival = sorted((t + r.randint(0, delay), t) for t in steps)
        out, state, held = [], (-1, 0, -1), {}
        for now in range(0, 60, r.randint(1, 5)):
            for when, t in arrival:
                if when <= now and t not in held and not any(t in w for *_, w in out):
                    held[t] = t
            settled = max(0, now - delay)
            got, kept = settle(sorted(held), sorted(held), *state, settled, length, pad)
            out += got
            held, state = dict(zip(kept[0], kept[1])), kept[2:]
            assert all(max((x for x in w if x is not None)) < settled for *_, w in got)
        assert sorted(out, key=str) == whole(steps, length, pad) and not held and state == (-1, 0, -1)


def test_stream_gives_the_batchs_windows_and_scores(spark, tmp_path):
    r = np.random.default_rng(2)
    rows = []
    for s in range(5):
        t, activity = 1_000 * s + 1, 1
        for _ in range(4):
            for _ in range(int(r.integers(3, 15))):
                rows.append((f"s{s}", activity, t, float(r.normal() + 3 * (s % 2)), float(r.normal())))
                t += 1
            t += int(r.integers(1, 5))
    table = spark.createDataFrame(rows, "subject string, activity int, t long, a double, b double")
    want = datasets.activity_windows(table, ["a", "b"], 4)
    stamped = [(s, k, t * 10, a, b) for s, k, t, a, b in rows]
    stamped.sort(key=lambda x: x[2] + 10 * int(r.integers(0, 6)))  # out of order by up to five steps
    schema = "subject string, activity int, second long, a double, b double"
    parts = [*np.array_split(np.arange(len(stamped)), 7)]
    for k, part in enumerate(parts):
        spark.createDataFrame([stamped[i] for i in part], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    for k in (7, 8):  # a reading far ahead closes what is open
        spark.createDataFrame([("end", 1, 10_000_000 * k, 0.0, 0.0)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    train = boost.stored(want.select(F.monotonically_increasing_id().alias("row_id"), F.array().cast("array<double>").alias("static"), "series", F.substring("subject", 2, 1).cast("int").alias("n")).withColumn("label", F.col("n") % 2))
    model = boost.fit_classifier(train, boost.Params(rounds=2, depth=1, rate=1.0, draws=Draws(intervals=6, stats=("mean",))))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    windows = stream_windows(source.withColumn("ts", F.timestamp_seconds("second")), ["subject", "activity"], "ts", ["a", "b"], 10, 4, "70 seconds")
    q = score_windows(windows, model, ["subject", "activity"]).writeStream.format("memory").queryName("scored_windows").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table("scored_windows").collect()
    key = lambda x: (x.subject, str(x.series))
    assert sorted(map(key, got)) == sorted(map(key, want.collect())) and len(got) > 20
    scored = {key(x): x.prediction for x in model.predict(want.withColumns({"static": F.array().cast("array<double>")})).collect()}
    assert all(scored[key(x)] == x.prediction for x in got)
    assert np.mean([x.prediction == int(x.subject[1]) % 2 for x in got]) > 0.8
