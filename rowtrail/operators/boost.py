"""Second-order gradient boosting over statics and series, grown level by level.

Every node draws candidates of its own, with templates from its own rows.  A level is one job: tasks add up gradients by
(tree, node, candidate, bin), those sums meet by candidate, and a row a candidate comes to the driver.  Bins come from
mergeable sketches and only guide the search: where a cut within a bin could still beat the best cut between bins, the
values of that bin are looked at one by one, so the cuts are those of the exact scan.  Rows are never shuffled, and none
comes to the driver; what is written are the rows' scores every few rounds.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.losses import Loss, logistic, softmax_loss, squared_error
from ..functions.stats import STAT_NAMES
from . import growth
from .bank import Bank, Moments
from .growth import Level, Node, Piece
from .kernel import blocks, evaluate
from .sampling import exact_subsample, some_columns, thinned
from .specs import Draws, Spec, draw_interval, draw_piece, shapelets
from .split import ScanRules, best_splits, permuted_gradients
from .tables import stored
from .temporal import dct_basis, pyramid_levels, solved_template, unit_snippet

#: Rounds between tables of scores; the trees since the last one are applied anew.
KEPT = 10
#: Values of a problem, counted beforehand, up to which one task scans it; beyond, ranges of its values are scanned.
SMALL = 200_000


@dataclass
class Params:
    """Settings of a fit; ``check`` says what is out of range.

    bins: how many bins guide the search for a cut; sample: about so many rows give the bins' borders.  Neither changes a
    cut.  charge: weight of the gain that the best of many useless candidates would show, which a split has to beat;
    null: permutations of a node's gradients whose best gains, at ``null_quantile``, a split has to beat (they look at
    cuts between bins).  thin and columns: shares of drawn candidates and of static columns that a node tries.  bank:
    features kept to be tried again (0 for none), a share of them a node; with ``screen`` only so many of them, the best
    by correlation with the residuals on a share of the rows that then don't count for that tree.  products: candidates
    that multiply a banked feature with a static.
    """

    rounds: int = 20
    depth: int = 3
    rate: float = 0.1
    rules: ScanRules = field(default_factory=lambda: ScanRules(l2=1.0, min_child_weight=1.0, min_samples_leaf=5))
    draws: Draws = field(default_factory=Draws)
    stale: int = 0  # rounds without improvement before stopping; 0 for none
    subsample: float = 1.0
    seed: int = 0
    bins: int = 4096
    sample: int = 50_000
    charge: float = 0.0
    null: int = 0
    null_quantile: float = 1.0
    thin: float = 1.0
    columns: float = 1.0
    bank: int = 0
    bank_share: float = 1.0
    screen: int = 0
    screen_share: float = 0.25
    products: int = 0

    def check(self) -> None:
        ok = {
            "rounds": self.rounds >= 1, "depth": self.depth >= 1, "rate": 0 < self.rate <= 1, "subsample": 0 < self.subsample <= 1, "l2": self.rules.l2 >= 0, "stale": self.stale >= 0,
            "bins": 2 <= self.bins < growth.MISSING, "sample": self.sample >= 1, "charge": self.charge >= 0, "thin": 0 < self.thin <= 1, "columns": 0 < self.columns <= 1, "bank": self.bank >= 0,
            "bank_share": 0 < self.bank_share <= 1, "screen": self.screen >= 0, "products": self.products >= 0, "gamma": self.rules.gamma >= 0, "min_samples_leaf": self.rules.min_samples_leaf >= 1,
            "null": self.null >= 0, "null_quantile": 0 <= self.null_quantile <= 1, "screen_share": 0 < self.screen_share < 1, "shapelet_min": self.draws.shapelet_min >= 2, "ridge": self.draws.ridge >= 0,
        }
        bad = [n for n, good in ok.items() if not good]
        if bad:
            raise ValueError(f"out of range: {', '.join(bad)}")
        unknown = [s for s in self.draws.stats if s not in STAT_NAMES]
        if unknown:
            raise ValueError(f"unknown statistics: {', '.join(unknown)}")


# ---------------------------------------------------------------- trees over batches


def tree_values(tree: list[Node], x: np.ndarray, at: dict[Spec, int]) -> np.ndarray:
    """The value of the leaf that each row reaches; all rows go down in step."""
    node = np.zeros(len(x), np.int64)
    inner = np.array([n.spec is not None for n in tree])
    column = np.array([at[n.spec] if n.spec is not None else 0 for n in tree])
    cut, left, right = (np.array([getattr(n, k) for n in tree]) for k in ("threshold", "left", "right"))
    lost = np.array([n.missing_left for n in tree])
    while (go := np.flatnonzero(inner[node])).size:
        k = node[go]
        v = x[go, column[k]]
        node[go] = np.where(np.where(np.isfinite(v), v <= cut[k], lost[k]), left[k], right[k])
    return np.array([n.value for n in tree])[node]


def _specs_of(trees: list[list[list[Node]]]) -> list[Spec]:
    return list(dict.fromkeys(n.spec for r in trees for t in r for n in t if n.spec is not None))


class Scorer:
    """Trees applied to Arrow batches of rows."""

    def __init__(self, trees: list[list[list[Node]]], rate: float, shape: tuple[int, int, int]):
        self.trees, self.rate, self.shape = trees, rate, shape
        self.specs = _specs_of(trees)
        self.at = {s: i for i, s in enumerate(self.specs)}

    def add(self, raw: np.ndarray, static: np.ndarray, series: np.ndarray) -> np.ndarray:
        x = evaluate(self.specs, static, series)
        raw = raw.copy()
        for r in self.trees:
            for k, t in enumerate(r):
                raw[:, k] += self.rate * tree_values(t, x, self.at)
        return raw

    def blocks(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return blocks(batch.column("static"), batch.column("series"), self.shape)


def _lists(values: np.ndarray, kind: pa.DataType = pa.float64()) -> pa.ListArray:
    n, w = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * w, pa.int32()), pa.array(values.ravel(), kind))


# ---------------------------------------------------------------- growing


class Grower:
    """One round: the trees of all outputs, level by level, over ``work`` (row_id, id, static, series, d)."""

    def __init__(self, params: Params, shape: tuple[int, int, int], work: DataFrame, rows: int, totals: list[tuple[float, float]], round_: int, bank: Bank | None, edges: dict[Spec, np.ndarray], statics: list[tuple[float, float, float, float]]):
        self.params, self.shape, self.work, self.rows, self.totals, self.round, self.bank, self.edges, self.statics = params, shape, work, rows, totals, round_, bank, edges, statics
        self.level = Level([[Node(self._leaf(*t))] for t in totals], shape, params.rules, params.seed, round_, [0.0] * len(totals))
        self.sums = {(k, 0): t for k, t in enumerate(totals)}
        self.drawn: dict[tuple[int, int], tuple[list[Spec], list[Piece]]] = {}
        self.shortlist: list[list] = [list(bank.entries) if bank is not None else []] * len(totals)

    def _leaf(self, g: float, h: float) -> float:
        return -g / max(h + self.params.rules.l2, 1e-16)

    def _rng(self, *parts: int) -> random.Random:
        return random.Random(":".join(map(str, (self.params.seed, self.round, *parts))))

    def grow(self) -> list[list[Node]]:
        p = self.params
        self._screen()
        open_ = {(k, 0): 1 for k in range(len(self.totals))}  # with each node's number in a full tree, which its draws follow
        won: list[tuple[Spec, float]] = []
        for depth in range(p.depth):
            least = 2 * p.rules.min_child_weight
            open_ = {key: n for key, n in open_.items() if self.sums[key][1] >= least}
            if not open_:
                break
            self._draw(open_)
            found, whole = self._cuts()
            bars = self._bars(found, whole)
            at: dict[tuple[int, int], int] = {}
            for (k, i), number in open_.items():
                mine = [c for c in found if c[:2] == (k, i) and c[3] > 0]
                tree = self.level.trees[k]
                if (k, i) in whole:
                    self.sums[k, i] = (whole[k, i].g, whole[k, i].h)
                    if depth == 0:
                        tree[0].value = self._leaf(*self.sums[k, i])
                best = min(mine, key=lambda c: (-c[3], c[2]), default=None)
                if best is None or best[3] <= bars.get((k, i), 1e-12):
                    continue
                _, _, j, gain, left, cut, gl, hl, gr, hr = best
                node = tree[i]
                node.spec, node.threshold, node.missing_left, node.gain = self.level.pools[k, i][j], cut, left, gain
                node.left, node.right = len(tree), len(tree) + 1
                tree += [Node(self._leaf(gl, hl)), Node(self._leaf(gr, hr))]
                self.sums |= {(k, node.left): (gl, hl), (k, node.right): (gr, hr)}
                at |= {(k, node.left): 2 * number, (k, node.right): 2 * number + 1}
                if node.spec.kind not in ("static", "product", "comparison"):
                    won.append((node.spec, gain))
            open_ = at
        self._promote(won)
        return self.level.trees

    # ------------------------------------------------------------ candidates

    def _drawn(self, k: int, number: int) -> tuple[list[Spec], list[Piece]]:
        """A node's candidates but for templates, and where those are to be cut."""
        p, (width, channels, steps) = self.params, self.shape
        d, rng, pieces = p.draws, self._rng(k, number), []
        pool = [Spec("static", column=c) for c in (some_columns(width, p.columns, rng) if p.columns < 1 else range(width))]
        entries = self.shortlist[k]
        if entries:
            entries = entries if p.screen else Bank(entries=entries).drawn(p.bank_share, rng)
            pool += [e.spec for e in entries]
            for _ in range(p.products if width else 0):
                e, c = rng.choice(entries), rng.randrange(width)
                pool.append(Spec("product", column=c, inner=e.spec, frozen=(*e.frozen(), *self.statics[c])))
        if channels and steps:
            pool += [draw_interval(rng, channels, steps, d) for _ in range(thinned(d.intervals, p.thin))]
            pieces = [Piece(c, 0, start, n) for c, start, n in (draw_piece(rng, channels, steps, d) for _ in range(thinned(d.shapelets, p.thin)))]
            lengths = pyramid_levels(steps, d.filter_length)
            for _ in range(thinned(d.filters, p.thin)):
                scale = rng.randrange(len(lengths))
                n = min(d.filter_length, lengths[scale])
                pieces.append(Piece(rng.randrange(channels), scale, rng.randint(0, lengths[scale] - n), n, True))
        return pool, pieces

    def _draw(self, open_: dict[tuple[int, int], int]) -> None:
        """A fresh pool for each open node, and points for the bins of what has none yet.

        What needs no donors is drawn, and gets its points, for all nodes of the round's trees at once.
        """
        p = self.params
        if not self.drawn:
            self.drawn = {(k, number): self._drawn(k, number) for k in range(len(self.totals)) for number in range(1, 1 << p.depth)}
            self._points(list(dict.fromkeys(s for pool, _ in self.drawn.values() for s in pool if s not in self.edges)))
        pools = {(k, i): list(self.drawn[k, number][0]) for (k, i), number in open_.items()}
        pieces = {(k, i): self.drawn[k, number][1] for (k, i), number in open_.items()}
        self.level.pools = pools
        self.level.means = {key: -self.sums[key][0] / max(self.sums[key][1], 1e-16) for key in open_}
        for key, specs in self._templates(pieces).items():
            pools[key] += specs
        for key in pools:
            pools[key] = list(dict.fromkeys(pools[key]))
        self._points(list(dict.fromkeys(s for pool in pools.values() for s in pool if s not in self.edges)))
        self.level.edges = {s: self.edges[s] for pool in pools.values() for s in pool}

    def _templates(self, pieces: dict[tuple[int, int], list[Piece]]) -> dict[tuple[int, int], list[Spec]]:
        """Candidates from pieces of each node's own rows; filters that are to be refitted see all rows of the node."""
        d = self.params.draws
        if not any(pieces.values()):
            return {}
        races = self.work.mapInArrow(growth.donor_races(self.level, pieces), growth.DONORS)
        won = {(r.output, r.node, r.slot): r.piece for r in races.groupBy("output", "node", "slot").agg(F.min_by("piece", "key").alias("piece")).collect()}
        fitted: dict[tuple[int, int, int], tuple[int, int, list[float]]] = {}
        units = {}
        for (k, i), cuts in pieces.items():
            filters = [s for s, c in enumerate(cuts) if c.residual]
            for s in filters:
                unit = unit_snippet(won[k, i, s]) if (k, i, s) in won else None
                if unit is not None:
                    units[k, i, s] = unit
                    if s in filters[: thinned(d.fitted, self.params.thin)] and len(unit) > 1:
                        fitted[k, i, s] = (cuts[s].channel, cuts[s].scale, unit)
        for _ in range(d.refits if fitted else 0):
            fitted = {**fitted, **self._refits(fitted)}
        units |= {key: t for key, (_, _, t) in fitted.items()}
        out: dict[tuple[int, int], list[Spec]] = {}
        for (k, i), cuts in pieces.items():
            for s, c in enumerate(cuts):
                if c.residual and (k, i, s) in units:
                    made = [Spec(kind, channel=c.channel, template=tuple(units[k, i, s]), scale=c.scale) for kind in ("filter_resp", "filter_pos")]
                elif not c.residual and (k, i, s) in won:
                    made = shapelets(c.channel, won[k, i, s], d.normalise)
                else:
                    continue
                out.setdefault((k, i), []).extend(made)
        return out

    def _refits(self, fitted: dict) -> dict:
        """One refit of all templates: their normal equations over the nodes' rows, in one job."""
        d = self.params.draws
        sums = self.work.mapInArrow(growth.normal_equations(self.level, fitted, d.components), growth.EQUATIONS)
        got: dict[tuple, dict[int, float]] = {}
        for r in sums.groupBy("output", "node", "slot", "place").agg(F.sum("value").alias("value")).collect():
            got.setdefault((r.output, r.node, r.slot), {})[r.place] = r.value
        out = {}
        for key, values in got.items():
            channel, scale, t = fitted[key]
            v = np.array([values[i] for i in range(len(values))])
            basis = dct_basis(len(t), d.components)
            m = len(basis) + 1
            if v[0] >= len(basis) + 2:
                new = solved_template(v[1 : 1 + m * m].reshape(m, m), v[1 + m * m :], basis, d.ridge)
                if new is not None:
                    out[key] = (channel, scale, new)
        return out

    def _points(self, specs: list[Spec]) -> None:
        if specs:
            p = self.params
            made = self.work.select("id", "static", "series", "d").mapInArrow(growth.sketch_values(specs, self.shape, p.seed, min(1.0, p.sample / max(self.rows, 1))), growth.SKETCHES)
            points = made.groupBy("candidate").applyInArrow(growth.merge_sketches(p.bins), growth.POINTS).collect()
            self.edges |= {s: np.zeros(0) for s in specs}
            self.edges |= {specs[r.candidate]: np.frombuffer(r.points) for r in points}

    # ------------------------------------------------------------ cuts

    def _cuts(self) -> tuple[list[tuple], dict]:
        """(the best cut of each node and candidate, the nodes' sums): between bins first, within bins where one could win."""
        problem = ["output", "node", "candidate"]
        sums = self.work.mapInArrow(growth.bin_sums(self.level), growth.BINS).repartition(*problem)
        bins = sums.groupBy(*problem, "code").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n", "a", "b", "c")], F.min("low").alias("low"), F.max("high").alias("high"))
        rows = bins.groupBy(*problem).applyInArrow(growth.best_of_bins(self.params.rules), growth.FOUND).collect()
        whole = {(r.output, r.node): r for r in rows if r.candidate < 0}
        rows = [r for r in rows if r.candidate >= 0]
        found = {(r.output, r.node, r.candidate): (r.gain, r.missing_left, r.threshold, r.gl, r.hl, r.gr, r.hr) for r in rows}
        top: dict[tuple[int, int], float] = {}
        for (k, i, _), c in found.items():
            top[k, i] = max(top.get((k, i), 0.0), c[0])
        again = [r for r in rows if r.bounds and any(b >= max(top[r.output, r.node] - 1e-9, 1e-12) for b in r.bounds)]
        for key, c in self._within(again, whole, top).items():
            found[key] = max(found[key], c, key=lambda c: (c[0], c[1], -c[2] if c[2] == c[2] else -math.inf))
        return [(*key, *c) for key, c in found.items()], whole

    def _within(self, rows: list, whole: dict, top: dict) -> dict[tuple[int, int, int], tuple]:
        """The exact scan of candidates that could still win: values of their open bins, the rest as it was summed.

        A closed segment stands for a value at its end, with an empty one at its start, so that the cut before it lies
        where it lay; a cut between those two repeats that gain higher up and is never taken.
        """
        if not rows:
            return {}
        wanted: dict[tuple[int, int], list] = {}
        known: list[tuple] = []
        for problem, r in enumerate(rows):
            limit = max(top[r.output, r.node] - 1e-9, 1e-12)
            lows, highs = [], []
            for low, high, g, h, n, bound in zip(r.lows, r.highs, r.gs, r.hs, r.ns, r.bounds):
                if bound >= limit:
                    lows.append(low)
                    highs.append(high)
                else:
                    known += [(problem, low, 0.0, 0.0, 0)] * (low < high) + [(problem, high, g, h, int(n))]
            lost = (r.g - sum(r.gs), r.h - sum(r.hs), r.n - int(sum(r.ns)))
            if lost[2]:
                known.append((problem, None, *lost))
            wanted.setdefault((r.output, r.node), []).append((problem, self.level.pools[r.output, r.node][r.candidate], np.array(lows), np.array(highs)))
        values = self.work.mapInArrow(growth.value_sums(self.level, wanted), growth.VALUES)
        if known:
            values = values.unionByName(values.sparkSession.createDataFrame(known, growth.VALUES))
        if max(int(sum(n for n, b in zip(r.ns, r.bounds) if b > -math.inf)) for r in rows) <= SMALL:
            sums = values.repartition("problem").groupBy("problem", "f").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])
            best = sums.groupBy("problem").applyInArrow(growth.best_of_values(self.params.rules), growth.CUT).where("gain > 0").collect()
        else:
            best = best_splits(values, ["problem"], self.params.rules, n="n").collect()
        return {(rows[b.problem].output, rows[b.problem].node, rows[b.problem].candidate): (round(b.gain, 9), b.missing_left, b.threshold, b.gl, b.hl, b.gr, b.hr) for b in best}

    def _bars(self, found: list[tuple], whole: dict) -> dict[tuple[int, int], float]:
        """What a node's best gain has to beat."""
        p = self.params
        bars = {}
        for key, r in whole.items():
            tried = sum(1 for c in found if c[:2] == key and c[3] > 0)
            bars[key] = max(1e-12, p.charge * r.scale * (math.log(max(tried, 1)) + 0.4 * math.log(max(r.n, 2))))
        if p.null:
            for key, gain in self.chance().items():
                bars[key] = max(bars.get(key, 1e-12), gain)
        return bars

    def chance(self) -> dict[tuple[int, int], float]:
        """The gain that each open node's pool reaches on permuted gradients: one job for all nodes and permutations.

        Only ids, bins and gradients are shuffled; within each permutation the best candidate counts.
        """
        p = self.params
        run, schema = growth.node_rows(self.level, f"row_id {dict(self.work.dtypes)['row_id']}")
        rows = self.work.mapInArrow(run, schema)
        moved = permuted_gradients(rows.select("output", "node", "row_id", "g", "h"), ["output", "node"], "row_id", p.null, p.seed)
        mixed = rows.drop("g", "h").join(moved, ["output", "node", "row_id"]).select("output", "node", "perm", "codes", "g", "h")
        problem = ["output", "node", "perm", "candidate"]
        sums = mixed.mapInArrow(growth.null_sums, growth.NULL_SUMS).repartition(*problem)
        bins = sums.groupBy(*problem, "code").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])
        best = bins.groupBy(*problem).applyInArrow(growth.null_best(p.rules), growth.NULL_BEST)
        gains: dict[tuple[int, int], list[float]] = {}
        for r in best.groupBy("output", "node", "perm").agg(F.max("gain").alias("gain")).collect():
            gains.setdefault((r.output, r.node), []).append(r.gain)
        return {key: float(np.quantile(v, p.null_quantile)) for key, v in gains.items()}

    # ------------------------------------------------------------ the bank

    def _middle(self, spec: Spec) -> float:
        e = self.edges.get(spec, ())
        return float(e[len(e) // 2]) if len(e) else 0.0

    def moments(self, specs: list[Spec], target: int | None = None) -> Moments:
        """Moments over all rows, or those of an output's screening fold with its residual as a last feature: one pass."""
        shift = np.array([*map(self._middle, specs), *([0.0] if target is not None else [])])
        made = self.work.select("id", "static", "series", "d").mapInArrow(growth.moment_sums(specs, self.level, shift, target), growth.MOMENTS)
        rows = sorted(made.groupBy("place").agg(F.sum("value").alias("value"), F.min("low").alias("low"), F.max("high").alias("high")).collect())
        m = len(shift)
        return Moments(specs, shift, np.array([r.value for r in rows]).reshape(4, m, m), np.array([r.low for r in rows[:m]]), np.array([r.high for r in rows[:m]]))

    def _screen(self) -> None:
        """Where the bank is screened: each output's entries by correlation with its residuals, on a fold of the rows that
        is then left out of that tree.  All rows and entries stay where too few rows would be left."""
        p = self.params
        if self.bank is None or not p.screen or p.screen >= len(self.bank.entries):
            return
        size = round(p.screen_share * self.rows)
        if size < 1 or self.rows - size < 2 * p.rules.min_samples_leaf:
            return
        self.level.folds = [p.screen_share] * len(self.totals)
        specs = [e.spec for e in self.bank.entries]
        for k in range(len(self.totals)):
            found = self.moments(specs, k)
            self.shortlist[k] = sorted(self.bank.entries, key=lambda e: -round(found.correlation(found.place[e.spec], len(specs)), 9))[: p.screen]

    def _promote(self, won: list[tuple[Spec, float]]) -> None:
        if self.bank is None or not won:
            return
        specs = list(dict.fromkeys([*(e.spec for e in self.bank.entries), *(s for s, _ in won)]))
        found = self.moments(specs)
        for spec, gain in won:
            self.bank.promote_by(found, spec, gain, self.round)


# ---------------------------------------------------------------- the model


@dataclass
class Booster:
    """Fitted trees: ``trees[round][output]``."""

    loss: Loss
    params: Params
    base: list[float] = field(default_factory=list)
    trees: list[list[list[Node]]] = field(default_factory=list)
    history: list[dict[str, float]] = field(default_factory=list)
    best_round: int = -1
    labels: list | None = None
    shape: tuple[int, int, int] = (0, 0, 0)
    bank: Bank | None = None

    # ------------------------------------------------------------ training

    def fit(self, rows: DataFrame, evaluation: DataFrame | None = None, start: str | None = None) -> Booster:
        """``rows``: row_id, y (double), static (array), series (array of channels of one length).

        ``start`` names an array column of margins, one an output, from which the scores begin (a base's held-out
        margins, say); without it they begin at the loss's own first score.
        """
        self.params.check()
        p, rng = self.params, random.Random(self.params.seed)
        rows = rows.withColumns({"static": F.col("static").cast("array<double>"), "series": F.col("series").cast("array<array<double>>")})
        first = rows.agg(F.max(F.size("static")).alias("p"), F.max(F.size("series")).alias("c"), F.max(F.coalesce(F.size(F.get("series", F.lit(0))), F.lit(0))).alias("t"), F.count(F.lit(1)).alias("n")).first()
        if not first.n:
            raise ValueError("no rows to fit on")
        self.shape = (max(first.p, 0), max(first.c, 0), max(first.t, 0))
        self.base = [0.0] * self.loss.outputs if start else self.loss.init_scores(rows)
        begin = F.col(start).cast("array<double>") if start else F.array(*[F.lit(float(b)) for b in self.base])
        keep = ["row_id", "y", "static", "series", "raw"]
        state = stored(rows.withColumn("raw", begin).select(*keep))
        judged = stored(evaluation.withColumn("raw", begin).select(*keep)) if evaluation is not None else None
        self.bank = Bank(p.bank) if p.bank or p.products else None
        statics = self._statics(state) if p.products else []
        edges: dict[Spec, np.ndarray] = {}  # bins of statics and of the bank are kept over rounds
        best, waited, since = math.inf, 0, 0
        for r in range(p.rounds):
            scorer = Scorer(self.trees[since:], p.rate, self.shape)
            work = _scored(state, scorer, len(self.base), "raw").withColumns({"d": self.loss.gradients(F.col("y"), F.col("raw")), "id": F.xxhash64("row_id")})
            if p.subsample < 1:
                used = exact_subsample(state.select("row_id"), "row_id", p.subsample, p.seed * 7919 + r)
                work = work.join(used, "row_id", "left_semi")
            work = work.persist()
            try:
                told = self._told(work)
                if r:
                    self.history[-1]["train"] = told[0] if p.subsample == 1 else self._told_by(state, scorer)
                totals = [(told[2 + 2 * k], told[3 + 2 * k]) for k in range(len(self.base))]
                grower = Grower(p, self.shape, work.drop("y", "raw"), told[1], totals, r, self.bank, edges, statics)
                self.trees.append(grower.grow())
                kept = {e.spec for e in self.bank.entries} if self.bank is not None else set()
                edges = {s: v for s, v in grower.edges.items() if s.kind == "static" or s in kept}
            finally:
                work.unpersist()
            self.history.append({"train": math.nan})
            if judged is not None:
                self.history[-1]["eval"] = self._told_by(judged, Scorer(self.trees[since:], p.rate, self.shape))
            if len(self.trees) - since >= KEPT:
                state, judged = (self._advanced(f, since) if f is not None else None for f in (state, judged))
                since = len(self.trees)
            now = self.history[-1].get("eval", -r)
            if now < best - 1e-12:
                best, waited, self.best_round = now, 0, r
            else:
                waited += 1
                if judged is not None and p.stale and waited >= p.stale:
                    break
        if self.history:
            self.history[-1]["train"] = self._told_by(state, Scorer(self.trees[since:], p.rate, self.shape))
        return self

    def _told(self, work: DataFrame) -> tuple:
        """(metric, rows, then each output's sums of gradients and hessians) in one pass, which also fills the cache."""
        sums = [F.coalesce(F.sum(F.get("d", F.lit(k))[c]), F.lit(0.0)) for k in range(len(self.base)) for c in ("g", "h")]
        return tuple(work.agg(self.loss.metric(F.col("y"), F.col("raw")), F.count(F.lit(1)), *sums).first())

    def _told_by(self, state: DataFrame, scorer: Scorer) -> float:
        scored = _scored(state.select("y", "static", "series", "raw"), scorer, len(self.base), "raw")
        return scored.agg(self.loss.metric(F.col("y"), F.col("raw"))).first()[0]

    def _advanced(self, state: DataFrame, since: int) -> DataFrame:
        return stored(_scored(state, Scorer(self.trees[since:], self.params.rate, self.shape), len(self.base), "raw"))

    def _statics(self, state: DataFrame) -> list[tuple[float, float, float, float]]:
        """Centre, scale and standardised bounds of every static column, in one pass."""
        if not self.shape[0]:
            return []
        out = []
        columns = [F.get("static", F.lit(c)) for c in range(self.shape[0])]
        found = state.agg(*[f(F.when(~F.isnan(c), c)) for c in columns for f in (F.avg, F.stddev_pop, F.min, F.max)]).first()
        for c in range(self.shape[0]):
            mean, scale, low, high = (x if x is not None else 0.0 for x in found[4 * c : 4 * c + 4])
            scale = scale if scale > 1e-12 else 1.0
            out.append((mean, scale, (low - mean) / scale, (high - mean) / scale))
        return out

    # ------------------------------------------------------------ prediction

    def _fitted(self) -> None:
        if not self.base:
            raise RuntimeError("fit the model first")

    @property
    def rounds_used(self) -> int:
        return self.best_round + 1 if any("eval" in h for h in self.history) else len(self.trees)

    def curve(self, name: str = "train") -> list[float]:
        """The metric after each round; an error before the fit, or where it wasn't measured."""
        self._fitted()
        if not all(name in h for h in self.history):
            raise RuntimeError(f"no {name} history")
        return [h[name] for h in self.history]

    def raw(self, rows: DataFrame, rounds: int | None = None, out: str = "raw", start: str | None = None) -> DataFrame:
        """The rows with their scores after so many rounds: one narrow pass over Arrow batches.

        Blocks must have the shape of the fit; shorter series are padded with missing steps.
        """
        self._fitted()
        trees = self.trees[: self.rounds_used if rounds is None else rounds]
        begin = F.col(start).cast("array<double>") if start else F.array(*[F.lit(float(b)) for b in self.base])
        none = F.array().cast("array<array<double>>")
        kinds = dict(rows.dtypes)
        series = F.col("series").cast("array<array<double>>") if "series" in kinds else none
        static = F.col("static").cast("array<double>") if "static" in kinds else F.array().cast("array<double>")
        wide = rows.withColumns({"_static": static, "_series": series, "_raw": begin})
        scored = _scored(wide, Scorer(trees, self.params.rate, self.shape), len(self.base), "_raw", "_static", "_series")
        done = scored.drop("_static", "_series")
        return done if out == "_raw" else done.drop(out).withColumnRenamed("_raw", out)

    def predict(self, rows: DataFrame, start: str | None = None) -> DataFrame:
        """Adds prediction, and probability for classifiers."""
        scored = self.raw(rows, out="_raw", start=start)
        if self.loss.name == "squared":
            return scored.withColumn("prediction", F.get("_raw", F.lit(0))).drop("_raw")
        p = scored.withColumn("probability", self.loss.transform(F.col("_raw"))).drop("_raw")
        best = (F.array_position("probability", F.array_max("probability")) - 1).cast("int")
        return p.withColumn("prediction", F.get(F.array(*[F.lit(x) for x in self.labels]), best) if self.labels is not None else best)

    def splits(self, top: int | None = None) -> list[dict]:
        """The splits of the rounds used, the largest gain first."""
        self._fitted()
        out = [
            {"round": r, "output": k, "feature": n.spec.name, "family": n.spec.family, "gain": n.gain, "text": n.spec.describe(n.threshold, n.missing_left)}
            for r, trees in enumerate(self.trees[: self.rounds_used]) for k, t in enumerate(trees) for n in t if n.spec is not None
        ]
        return sorted(out, key=lambda s: -s["gain"])[:top]


def _scored(rows: DataFrame, scorer: Scorer, outputs: int, raw: str, static: str = "static", series: str = "series") -> DataFrame:
    """The rows with the trees' values added to the array column ``raw``."""
    if not scorer.trees:
        return rows
    names = rows.columns
    at = names.index(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                columns = list(b.columns)
                held = np.asarray(b.column(at).flatten(), float).reshape(b.num_rows, outputs)
                columns[at] = _lists(scorer.add(held, *blocks(b.column(static), b.column(series), scorer.shape)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, rows.schema)


def correlations(rows: DataFrame, specs: list[Spec], loss: Loss) -> dict[Spec, float]:
    """Of each feature the absolute correlation with the first residuals over all rows: one pass of sums."""
    raw = F.array(*[F.lit(float(b)) for b in loss.init_scores(rows)])
    work = rows.withColumns({"d": loss.gradients(F.col("y"), raw), "id": F.xxhash64("row_id")})
    shape = tuple(max(x or 0, 0) for x in rows.agg(F.max(F.size("static")), F.max(F.size("series")), F.max(F.size(F.get("series", F.lit(0))))).first())
    grower = Grower(Params(), shape, work, 0, [(0.0, 0.0)] * loss.outputs, 0, None, {}, [])
    grower.level.folds = [1.0] * loss.outputs
    grower._points(specs)
    found = grower.moments(specs, 0)
    return {s: found.correlation(found.place[s], len(specs)) for s in specs}


def fit_regressor(rows: DataFrame, params: Params | None = None, evaluation: DataFrame | None = None, start: str | None = None) -> Booster:
    return Booster(squared_error(), params or Params()).fit(rows, evaluation, start)


def coded_labels(rows: DataFrame, labels: list, label: str = "label") -> DataFrame:
    """The rows with y, the place of each label among ``labels``; an error for one that isn't there."""
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label))
    return rows.withColumn("y", F.when(place > 0, (place - 1).cast("double")).otherwise(F.raise_error(F.concat(F.lit("unseen class "), F.col(label).cast("string")))))


def fit_classifier(rows: DataFrame, params: Params | None = None, evaluation: DataFrame | None = None, label: str = "label", start: str | None = None) -> Booster:
    """Classes are the sorted distinct labels; two give the logistic loss, more the softmax."""
    labels = sorted(r[0] for r in rows.select(label).distinct().collect())
    if len(labels) < 2:
        raise ValueError("at least two classes are needed")
    loss = logistic() if len(labels) == 2 else softmax_loss(len(labels))
    return Booster(loss, params or Params(), labels=labels).fit(coded_labels(rows, labels, label), coded_labels(evaluation, labels, label) if evaluation is not None else None, start)
