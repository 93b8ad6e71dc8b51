"""The feature bank: specs that won splits, credited with their gains, to be tried again and multiplied with statics.

The bank is a small registry on the driver.  What it knows of values are their moments over all rows: tasks add up the
pairwise sums of ``Moments``, so no row comes to the driver.  Where a column is at hand it serves as well.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from .sampling import some_entries
from .specs import Spec

#: Beyond this correlation a new feature is the same as one that is banked.
SAME = 0.995
EPS = 1e-12


class Moments:
    """Of some features: for each pair, over the rows that have both, their number, sums, sums of squares and products;
    of each, the least and the largest value.  All less a fixed ``shift``, near the values, which keeps sums precise."""

    def __init__(self, specs: list[Spec], shift: np.ndarray, sums: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.place = {s: i for i, s in enumerate(specs)}
        self.n, self.s, self.ss, self.xy = sums  # s[i, j]: sum of i where j is there too
        self.shift, self.low, self.high = shift, low, high

    def missing(self, spec: Spec) -> bool:
        i = self.place[spec]
        return self.n[i, i] == 0

    def correlation(self, i: int, j: int) -> float:
        """Absolute correlation over what both have; 0 for fewer than three pairs or a flat side."""
        n = self.n[i, j]
        if n < 3:
            return 0.0
        a, b = self.s[i, j] / n, self.s[j, i] / n
        va, vb = (max(q / n - m * m, 0.0) for q, m in ((self.ss[i, j], a), (self.ss[j, i], b)))
        if va**0.5 <= EPS or vb**0.5 <= EPS:
            return 0.0
        return abs(float((self.xy[i, j] / n - a * b) / (va * vb) ** 0.5))

    def alike(self, a: Spec, b: Spec) -> float:
        return self.correlation(self.place[a], self.place[b])

    def frozen(self, spec: Spec) -> tuple[float, float, float, float]:
        """Centre, scale and standardised bounds over all rows."""
        i = self.place[spec]
        n = self.n[i, i]
        if not n:
            return 0.0, 1.0, 0.0, 0.0
        mean = self.s[i, i] / n
        scale = float(max(self.ss[i, i] / n - mean * mean, 0.0)) ** 0.5
        scale = scale if scale > EPS else 1.0
        return float(self.shift[i] + mean), scale, float((self.low[i] - mean) / scale), float((self.high[i] - mean) / scale)


@dataclass
class Entry:
    spec: Spec
    column: np.ndarray | None = None
    gain: float = 0.0
    last_round: int = -1
    stats: tuple[float, float, float, float] | None = None

    def frozen(self) -> tuple[float, float, float, float]:
        """Centre, scale and standardised bounds."""
        return self.stats if self.stats is not None else frozen(self.column)


def frozen(column: np.ndarray) -> tuple[float, float, float, float]:
    seen = column[np.isfinite(column)]
    if not len(seen):
        return 0.0, 1.0, 0.0, 0.0
    center, scale = float(seen.mean()), float(seen.std())
    scale = scale if scale > EPS else 1.0
    return center, scale, float((seen.min() - center) / scale), float((seen.max() - center) / scale)


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Absolute correlation over what both have; 0 for fewer than three pairs or a flat side."""
    both = np.isfinite(a) & np.isfinite(b)
    x, y = a[both], b[both]
    if len(x) < 3 or x.std() <= EPS or y.std() <= EPS:
        return 0.0
    return abs(float(((x - x.mean()) * (y - y.mean())).mean() / (x.std() * y.std())))


@dataclass
class Bank:
    cap: int = 64
    entries: list[Entry] = field(default_factory=list)

    def promote(self, spec: Spec, column: np.ndarray, gain: float, round_: int) -> Entry | None:
        """Credit the entry that is this spec, or that is as good as equal to it; else bank it and evict down to the cap.

        A feature that is missing throughout the sample is not banked.
        """
        return self._credit(Entry(spec, column), not np.isfinite(column).any(), lambda e: correlation(e.column, column), gain, round_)

    def promote_by(self, moments: Moments, spec: Spec, gain: float, round_: int) -> Entry | None:
        """The same by the moments of the entries and the spec over all rows."""
        return self._credit(Entry(spec, stats=moments.frozen(spec)), moments.missing(spec), lambda e: moments.alike(e.spec, spec), gain, round_)

    def credit(self, spec: Spec, gain: float, round_: int) -> Entry | None:
        """The same by the spec alone, where no other entry can be alike."""
        return self._credit(Entry(spec), False, lambda e: 0.0, gain, round_)

    def _credit(self, new: Entry, missing: bool, alike: Callable[[Entry], float], gain: float, round_: int) -> Entry | None:
        found = next((e for e in self.entries if e.spec == new.spec), None)
        if found is None:
            if missing:
                return None
            found = next((e for e in self.entries if alike(e) > SAME), None)
        if found is None:
            found = new
            self.entries.append(found)
        found.gain += gain
        found.last_round = max(found.last_round, round_)
        while len(self.entries) > self.cap:
            self.entries.remove(min(self.entries, key=lambda e: (e.gain, e.last_round)))
        return found if found in self.entries else None

    def drawn(self, share: float, rng) -> list[Entry]:
        return some_entries(self.entries, share, rng)

    def screened(self, target: np.ndarray, fold: np.ndarray, top: int, least: int) -> list[Entry]:
        """The ``top`` entries by correlation with the target on rows of the fold; all where too few rows lie outside it."""
        if not top or top >= len(self.entries) or (~fold).sum() < 2 * least:
            return list(self.entries)
        ranked = sorted(self.entries, key=lambda e: -correlation(e.column[fold], target[fold]))
        return ranked[:top]

    def summary(self) -> list[dict]:
        """What is banked, the largest gain first."""
        return [{"feature": e.spec.name, "family": e.spec.family, "gain": e.gain, "last_round": e.last_round} for e in sorted(self.entries, key=lambda e: -e.gain)]
