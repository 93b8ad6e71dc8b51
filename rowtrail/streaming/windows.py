"""Windows of unbroken readings from an event stream, given out as soon as no reading can change them, and scored."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.boost import Booster

#: What is kept of a key: readings not given out yet, by step; the island that the last window given out belongs to (its
#: first step and number of windows), and the step behind that window, -1 for none.
STATE = "steps array<bigint>, readings array<array<double>>, island bigint, given int, next bigint"


def settle(steps: list[int], readings: list, island: int, given: int, after: int, settled: int, length: int, pad: bool) -> tuple[list[tuple], tuple]:
    """(windows as (island, window, readings), what is kept) once all steps under ``settled`` are known.

    Readings are sorted by step.  A run of consecutive steps is an island; one goes on from the last window given out if
    it begins at the step ``after`` it, and is closed when the step behind its end is known to be missing.
    """
    out, kept = [], ([], [], -1, 0, -1)
    cuts = [0, *(k for k in range(1, len(steps)) if steps[k] != steps[k - 1] + 1), len(steps)] if steps else [0]
    head = steps[0] if steps else None
    if after >= 0 and head != after and settled <= after:  # nothing new of an island that may go on
        kept = ([], [], island, given, after)
    for a, b in zip(cuts, cuts[1:]):
        start, number = (island, given) if steps[a] == after else (steps[a], 0)
        known = sum(1 for t in steps[a:b] if t < settled)
        closed = steps[b - 1] + 1 < settled
        whole = known // length
        for k in range(whole):
            out.append((start, number + k, readings[a + k * length : a + (k + 1) * length]))
        rest = a + whole * length
        if closed:
            if pad and rest < b:
                out.append((start, number + whole, readings[rest:b] + [None] * (length - (b - rest))))
        else:
            held = whole or steps[a] == after
            kept = (kept[0] + steps[rest:b], kept[1] + readings[rest:b], *((start, number + whole, steps[rest - 1] + 1 if whole else after) if held else kept[2:]))
    return out, kept


def stream_windows(events: DataFrame, keys: list[str], ts: str, channels: list[str], step: int, length: int, late: str = "1 minute", pad: bool = False) -> DataFrame:
    """(keys..., island, window, series) of a stream of readings, a step of so many seconds apart.

    As ``etl.tumbling_in_islands`` does over a table: a run of consecutive steps of a key is cut into windows of
    ``length`` readings; the rest of a run goes, or with ``pad`` is a window that NULLs fill up.  ``island`` is the run's
    first step, counted from the epoch.  A window is given out once the watermark, ``late`` behind the newest reading, has
    passed it, so readings may come in any order within that time; later ones are dropped.  Of several readings in one
    step the first that came counts.  The state of a key is what is behind the watermark by less than a window.
    """
    kinds = dict(events.dtypes)
    key_schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    stamped = events.select(*keys, F.col(ts).cast("timestamp").alias("_ts"), F.array(*[F.col(c).cast("double") for c in channels]).alias("_x")).withWatermark("_ts", late)
    stamped = stamped.withColumn("_t", F.floor(F.unix_micros("_ts") / (step * 1_000_000)))

    def run(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        steps, readings, island, given, after = state.get if state.exists else ([], [], -1, 0, -1)
        held = dict(zip(steps, readings))
        if not state.hasTimedOut:
            for f in frames:
                for t, x in zip(f["_t"], f["_x"]):
                    if t >= after:
                        held.setdefault(int(t), [None if v is None or v != v else float(v) for v in x])
        order = sorted(held)
        settled = state.getCurrentWatermarkMs() // (step * 1000)
        out, kept = settle(order, [held[t] for t in order], island, given, after, settled, length, pad)
        if kept[0] or kept[4] >= 0:
            state.update(kept)
            last = kept[0][-1] if kept[0] else kept[4] - 1
            state.setTimeoutTimestamp(max((last + 2) * step * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        rows = [(*key, i, w, [[None if x is None else x[c] for x in r] for c in range(len(channels))]) for i, w, r in out]
        yield pd.DataFrame(rows, columns=[*keys, "island", "window", "series"])

    return stamped.groupBy(*keys).applyInPandasWithState(run, f"{key_schema}, island bigint, window int, series array<array<double>>", STATE, "append", GroupStateTimeout.EventTimeTimeout)


def score_windows(windows: DataFrame, model: Booster, keys: list[str]) -> DataFrame:
    """Windows with a fitted model's predictions; a projection, so it works on the stream as it comes."""
    rows = windows.withColumns({"row_id": F.struct(*keys, "island", "window"), "static": F.array().cast("array<double>")})
    return model.predict(rows).drop("row_id", "static")
