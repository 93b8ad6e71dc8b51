"""What tasks do while trees grow: rows go down to the open nodes, and sums over them leave the task.

A node has a pool of candidates of its own.  Its rows give donors for templates (races of exponential keys), the normal
equations of refitted templates, points that guide bins, sums by bin, and, for the few bins whose best possible gain
could still win, sums by value.  All of these add up, so no row is shuffled or sent to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from .kernel import blocks, evaluate, pooled
from .specs import Spec
from .split import ScanRules
from .temporal import dct_basis, match_template

#: The bin of a missing value.
MISSING = 1 << 30
#: Values a level of a sketch holds before every other one goes to the next.
SKETCH = 4096
FLAT = 1e-12
Key = tuple[int, int]  # (output, node)


@dataclass
class Node:
    """A node of a tree; a leaf has no spec."""

    value: float = 0.0
    spec: Spec | None = None
    threshold: float = 0.0
    missing_left: bool = True
    gain: float = 0.0
    left: int = -1
    right: int = -1


@dataclass(frozen=True)
class Piece:
    """A template to be cut from a donor: a shapelet from any row, a filter from one that stands out (``residual``)."""

    channel: int
    scale: int
    start: int
    length: int
    residual: bool = False


@dataclass
class Level:
    """What a level's tasks know: the trees so far, and each open node's pool, bins' lowest values and mean step.

    ``folds`` has, per output, the share of rows that screened the bank and don't count for that output's tree.
    """

    trees: list[list[Node]]
    shape: tuple[int, int, int]
    rules: ScanRules
    seed: int
    round: int
    folds: list[float]
    pools: dict[Key, list[Spec]] = field(default_factory=dict)
    edges: dict[Spec, np.ndarray] = field(default_factory=dict)
    means: dict[Key, float] = field(default_factory=dict)


# ---------------------------------------------------------------- rows


def hashed(ids: np.ndarray, *parts: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the ids and the parts alone."""
    h = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        for p in (*parts, 0):
            h = (h ^ np.uint64(p & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
    return ((h >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def in_fold(ids: np.ndarray, level: Level, output: int) -> np.ndarray:
    """The rows that screen for an output's tree in this round; another part in every round."""
    return hashed(ids, level.seed, level.round, output, 77) < level.folds[output]


@dataclass
class Block:
    """A batch of rows: ids, statics, series, gradients and hessians (rows, outputs)."""

    ids: np.ndarray
    static: np.ndarray
    series: np.ndarray
    g: np.ndarray
    h: np.ndarray


def read_blocks(batches: Iterator[pa.RecordBatch], shape: tuple[int, int, int]) -> Iterator[tuple[pa.RecordBatch, Block]]:
    for b in batches:
        if b.num_rows:
            static, series = blocks(b.column("static"), b.column("series"), shape)
            d = b.column("d").flatten()
            g, h = (np.asarray(d.field(i), float).reshape(b.num_rows, -1) for i in (0, 1))
            yield b, Block(np.asarray(b.column("id")).view(np.uint64), static, series, g, h)


def go_left(node: Node, v: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(v), v <= node.threshold, node.missing_left)


def leaves(tree: list[Node], static: np.ndarray, series: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, its rows): a node's feature is worked out for the rows that reach it."""
    todo = [(0, rows)]
    while todo:
        i, q = todo.pop()
        node = tree[i]
        if node.spec is None or not len(q):
            yield i, q
            continue
        left = go_left(node, evaluate([node.spec], static[q], series[q])[:, 0])
        todo += [(node.left, q[left]), (node.right, q[~left])]


def open_rows(level: Level, block: Block) -> Iterator[tuple[Key, np.ndarray]]:
    """(open node, its rows of a block), without the rows of the output's screening fold."""
    for k, tree in enumerate(level.trees):
        if any((k, i) in level.pools for i in range(len(tree))):
            rows = np.flatnonzero(~in_fold(block.ids, level, k)) if level.folds[k] else np.arange(len(block.ids))
            for i, q in leaves(tree, block.static, block.series, rows):
                if len(q) and (k, i) in level.pools:
                    yield (k, i), q


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    fields = [f.rsplit(" ", 1) for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


# ---------------------------------------------------------------- donors and refits


DONORS = "output int, node int, slot int, key double, piece array<double>"


def donor_races(level: Level, pieces: dict[Key, list[Piece]]) -> Callable:
    """Task: per node and slot the piece of the row with the least key, -log(u) / weight.

    The least key over all rows falls to a row with a chance in proportion to its weight, whatever the tasks; slots are
    draws of their own.  A row whose piece misses a step or is flat has no weight.  A filter's weight is how far the
    row's step -g / h stands out from the node's, times h.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int, int], tuple[float, list[float]]] = {}
        for _, b in read_blocks(batches, level.shape):
            for (k, i), q in open_rows(level, b):
                h = b.h[q, k]
                stand = h * (-b.g[q, k] / np.maximum(h, 1e-16) - level.means[k, i]) ** 2
                x: dict[tuple[int, int], np.ndarray] = {}
                for s, p in enumerate(pieces.get((k, i), ())):
                    at = (p.channel, p.scale)
                    if at not in x:
                        x[at] = scaled(b.series[q, p.channel], p.scale)
                    cut = x[at][:, p.start : p.start + p.length]
                    low, high = cut.min(axis=1), cut.max(axis=1)  # NaN where a step is missing
                    weight = np.where(high - low > FLAT, stand if p.residual else 1.0, 0.0)
                    with np.errstate(divide="ignore"):
                        key = np.where(weight > 0, -np.log(hashed(b.ids[q], level.seed, level.round, k, i, s)) / weight, np.inf)
                    j = int(key.argmin())
                    if np.isfinite(key[j]) and key[j] < best.get((k, i, s), (np.inf,))[0]:
                        best[k, i, s] = (float(key[j]), cut[j].tolist())
        if best:
            yield _batch(DONORS, [*map(list, zip(*best)), [v[0] for v in best.values()], [v[1] for v in best.values()]])

    return run


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    for _ in range(scale):
        x = pooled(x)
    return x


EQUATIONS = "output int, node int, slot int, place int, value double"


def normal_equations(level: Level, templates: dict[tuple[int, int, int], tuple[int, int, list[float]]], components: int) -> Callable:
    """Task: per template (channel, scale, values) the weighted sums that its refit needs, over the node's rows.

    Place 0 counts rows, then come the matrix of (components + 1) squared and the right side.  A row's window is the best
    match, centred; rows without one don't count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for _, b in read_blocks(batches, level.shape):
            for (k, i), q in open_rows(level, b):
                for (k2, i2, s), (channel, scale, t) in templates.items():
                    if (k2, i2) == (k, i):
                        x = scaled(b.series[q, channel], scale)
                        _, place = match_template(x, t, "correlation")
                        seen = np.flatnonzero(np.isfinite(place))
                        if not len(seen):
                            continue
                        at = np.round(place[seen] * (x.shape[1] - len(t))).astype(int)
                        w = x[seen[:, None], at[:, None] + np.arange(len(t))]
                        z = np.column_stack([np.ones(len(seen)), (w - w.mean(1, keepdims=True)) @ np.asarray(dct_basis(len(t), components)).T])
                        h = b.h[q[seen], k]
                        r = -b.g[q[seen], k] / np.maximum(h, 1e-16)
                        got = np.concatenate([[len(seen)], (z.T @ (z * h[:, None])).ravel(), z.T @ (h * r)])
                        sums[k, i, s] = sums.get((k, i, s), 0) + got
        for (k, i, s), v in sums.items():
            n = len(v)
            yield _batch(EQUATIONS, [[k] * n, [i] * n, [s] * n, range(n), v])

    return run


# ---------------------------------------------------------------- points that guide bins


class Sketch:
    """Sorted values by weight 1, 2, 4, ...: a full level keeps none and gives every other value to the next.

    Two sketches merge by adding the values of each level, so tasks make them and any tree of merges joins them; the size
    grows with the logarithm of the rows.  Up to ``SKETCH`` values it holds them all.
    """

    def __init__(self) -> None:
        self.levels: list[list[np.ndarray]] = []
        self.second = False

    def add(self, values: np.ndarray, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(values)
        if sum(map(len, self.levels[level])) > SKETCH:
            v = np.sort(np.concatenate(self.levels[level]))
            self.levels[level] = [v[len(v) & ~1 :]]
            self.second = not self.second
            self.add(v[: len(v) & ~1][int(self.second) :: 2], level + 1)

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        for k, held in enumerate(self.levels):
            if held and sum(map(len, held)):
                yield k, np.concatenate(held)

    def points(self, most: int) -> np.ndarray:
        """At most so many distinct values at equal steps of rank; all distinct values where those are no more."""
        held = list(self.parts())
        if not held:
            return np.zeros(0)
        v, w = np.concatenate([x for _, x in held]), np.concatenate([np.full(len(x), 1 << k) for k, x in held])
        order = np.argsort(v)
        v, w = v[order], np.cumsum(w[order])
        distinct = np.unique(v)
        if len(distinct) <= most:
            return distinct
        return np.unique(v[np.searchsorted(w, np.linspace(1, w[-1], most))])


SKETCHES = "candidate int, level int, held binary"
POINTS = "candidate int, points binary"


def sketch_values(specs: list[Spec], shape: tuple[int, int, int], seed: int, share: float) -> Callable:
    """Task: a sketch of each candidate's values over a share of the rows, drawn by their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Sketch() for _ in specs]
        for _, b in read_blocks(batches, shape):
            q = np.flatnonzero(hashed(b.ids, seed, 99) < share) if share < 1 else slice(None)
            x = evaluate(specs, b.static[q], b.series[q])
            for j, s in enumerate(made):
                s.add(x[np.isfinite(x[:, j]), j])
        rows = [(j, k, v.tobytes()) for j, s in enumerate(made) for k, v in s.parts()]
        if rows:
            yield _batch(SKETCHES, [list(c) for c in zip(*rows)])

    return run


def merge_sketches(most: int) -> Callable:
    """Group: the sketches of one candidate from all tasks, as points."""

    def run(t: pa.Table) -> pa.Table:
        s = Sketch()
        for level, held in zip(t.column("level").to_pylist(), t.column("held").to_pylist()):
            s.add(np.frombuffer(held), level)
        return pa.Table.from_batches([_batch(POINTS, [[t.column("candidate")[0].as_py()], [s.points(most).tobytes()]])])

    return run


# ---------------------------------------------------------------- sums by bin


BINS = "output int, node int, candidate int, code int, g double, h double, n long, a double, b double, c double, low double, high double"


def bin_sums(level: Level) -> Callable:
    """Task: per open node, candidate and bin the sums g, h, n, the positive and the negative part of g, the least and the
    largest value.  Candidate -1 is the node itself, with the sums of gg, gh and hh in place of the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], np.ndarray] = {}  # rows g, h, n, a, b, low, high
        whole: dict[Key, np.ndarray] = {}
        for _, b in read_blocks(batches, level.shape):
            for (k, i), q in open_rows(level, b):
                g, h = b.g[q, k], b.h[q, k]
                whole[k, i] = whole.get((k, i), 0) + np.array([g.sum(), h.sum(), len(q), g @ g, g @ h, h @ h])
                pool = level.pools[k, i]
                x = evaluate(pool, b.static[q], b.series[q])
                x[~np.isfinite(x)] = np.nan
                parts = np.stack([g, h, np.ones(len(q)), np.maximum(g, 0), np.minimum(g, 0)])
                for j, spec in enumerate(pool):
                    e = level.edges[spec]
                    m = len(e) + 2
                    if (k, i, j) not in held:
                        held[k, i, j] = np.concatenate([np.zeros((5, m)), np.full((1, m), np.inf), np.full((1, m), -np.inf)])
                    into = held[k, i, j]
                    order = np.argsort(x[:, j])  # missing ones last
                    v = x[order, j]
                    some = int(np.isfinite(v).sum())
                    code = np.full(len(v), m - 1)
                    code[:some] = np.searchsorted(e, v[:some], side="right")
                    first = np.flatnonzero(np.diff(code, prepend=-1))
                    into[:5, code[first]] += np.add.reduceat(parts[:, order], first, axis=1)
                    seen = first[first < some]
                    last = np.append(first[1:], len(v))[: len(seen)] - 1
                    into[5, code[seen]] = np.minimum(into[5, code[seen]], v[seen])
                    into[6, code[seen]] = np.maximum(into[6, code[seen]], v[last])
        for (k, i, j), v in held.items():
            at = np.flatnonzero(v[2])
            n = len(at)
            code = np.where(at == v.shape[1] - 1, MISSING, at)
            yield _batch(BINS, [np.full(n, k), np.full(n, i), np.full(n, j), code, v[0, at], v[1, at], v[2, at].astype(np.int64), v[3, at], v[4, at], np.zeros(n), v[5, at], v[6, at]])
        for (k, i), (g, h, n, gg, gh, hh) in whole.items():
            yield _batch(BINS, [[k], [i], [-1], [0], [g], [h], [int(n)], [gg], [gh], [hh], [0.0], [0.0]])

    return run


def _score(g, h, l2: float):
    some = h + l2 > 0
    return np.where(some, g * g / np.where(some, h + l2, 1), 0.0)


def best_cut(c: dict[str, np.ndarray], rules: ScanRules) -> tuple[tuple, np.ndarray]:
    """(best cut between bins, the best gain that a cut within each bin could have).

    ``c``: a problem's bins by code, the missing one last.  The cut is (gain, missing left, threshold, gl, hl, gr, hr), by
    the rules of ``split.best_splits``: gains to nine digits, ties by missing-left first, then the lowest cut; gain 0 for
    none.  A side's score is convex in its sums, so within a bin no cut beats the corners of what the bin can add: its
    positive or negative gradients, none or all of its hessians.
    """
    seen = c["code"] != MISSING
    g, h, n = (float(c[k].sum()) for k in ("g", "h", "n"))
    lost = [float(c[k][~seen].sum()) for k in ("g", "h", "n")]
    low, high = c["low"][seen], c["high"][seen]
    gs, hs, ns, up, down = (c[k][seen] for k in ("g", "h", "n", "a", "b"))
    before = [np.concatenate([[0.0], np.cumsum(v)]) for v in (gs, hs, ns)]
    whole = float(_score(np.array(g), np.array(h), rules.l2))
    best, bound = (0.0, True, np.nan, 0.0, 0.0, 0.0, 0.0), np.full(len(low), -np.inf)
    for left in (True, False) if lost[2] else (True,):
        gl, hl, nl = (v[1:-1] + (x if left else 0.0) for v, x in zip(before, lost))
        gain = 0.5 * (_score(gl, hl, rules.l2) + _score(g - gl, h - hl, rules.l2) - whole) - rules.gamma
        ok = (hl >= rules.min_child_weight) & (h - hl >= rules.min_child_weight) & (nl >= rules.min_samples_leaf) & (n - nl >= rules.min_samples_leaf)
        gain = np.where(ok, np.round(gain, 9), 0.0)
        if len(gain) and gain.max() > best[0]:
            i = int(gain.argmax())
            best = (float(gain[i]), left, float(high[i] + (low[i + 1] - high[i]) / 2), float(gl[i]), float(hl[i]), float(g - gl[i]), float(h - hl[i]))
        gl, hl = (v[:-1] + (x if left else 0.0) for v, x in zip(before[:2], lost))
        least, most = (np.clip(v, 0, hs) for v in (rules.min_child_weight - hl, h - rules.min_child_weight - hl))
        with np.errstate(divide="ignore", invalid="ignore"):
            for x in (up, down):
                for y in (least, most):
                    sides = (gl + x) ** 2 / (hl + y + rules.l2) + (g - gl - x) ** 2 / (h - hl - y + rules.l2)
                    bound = np.maximum(bound, np.nan_to_num(0.5 * (sides - whole) - rules.gamma, nan=np.inf))
    bound[high <= low] = -np.inf
    return best, bound


FOUND = (
    "output int, node int, candidate int, gain double, missing_left boolean, threshold double, gl double, hl double, gr double, hr double, g double, h double, n long, scale double, upper double, "
    "lows array<double>, highs array<double>, gs array<double>, hs array<double>, ns array<double>, bounds array<double>"
)


def best_of_bins(rules: ScanRules) -> Callable:
    """Group: one candidate's bins in one node; its best cut between bins, and, where a cut within a bin could be better,
    the segments that a second look needs: such bins each, the others joined where they are neighbours.

    The row of candidate -1 has the node's sums and the scale of its gradients.
    """
    names = [f.split()[0] for f in FOUND.split(", ")]
    kinds = [pa.int32()] * 3 + [pa.float64(), pa.bool_()] + [pa.float64()] * 7 + [pa.int64()] + [pa.float64()] * 2 + [pa.list_(pa.float64())] * 6

    def run(t: pa.Table) -> pa.Table:
        c = {k: t.column(k).to_numpy() for k in ("code", "g", "h", "n", "a", "b", "c", "low", "high")}
        order = np.argsort(c["code"])
        c = {k: v[order] for k, v in c.items()}
        key = [t.column(k)[0].as_py() for k in ("output", "node", "candidate")]
        g, h, n = (float(c[k].sum()) for k in ("g", "h", "n"))
        segments: list[list[float]] = [[], [], [], [], [], []]
        scale, upper = 0.0, 0.0
        if key[2] < 0:
            mean = g / h if h else 0.0
            scale = (c["a"].sum() - 2 * mean * c["b"].sum() + mean * mean * c["c"].sum()) / max(h + rules.l2, 1e-16)
            best = (0.0, True, np.nan, 0.0, 0.0, 0.0, 0.0)
        else:
            best, bound = best_cut(c, rules)
            upper = max(best[0], float(bound.max(initial=0.0)))
            wide = bound >= max(best[0] - 1e-9, 1e-12)
            if wide.any():
                starts = np.flatnonzero(np.concatenate([[True], wide[1:] | wide[:-1]]))
                m = len(wide)
                ends = np.append(starts[1:], m) - 1
                segments = [c["low"][:m][starts], c["high"][:m][ends], *(np.add.reduceat(c[k][:m].astype(float), starts) for k in ("g", "h", "n")), np.where(wide[starts], bound[starts], -np.inf)]
        row = [*key, *best, g, h, int(n), float(scale), upper, *segments]
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

    return run


VALUES = "problem int, f double, g double, h double, n long"


def value_sums(level: Level, wanted: dict[Key, list[tuple[int, Spec, np.ndarray, np.ndarray]]]) -> Callable:
    """Task: g, h and n by value, for values within a problem's open segments (their lows and highs, sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in read_blocks(batches, level.shape):
            for (k, i), q in open_rows(level, b):
                todo = wanted.get((k, i), ())
                x = evaluate([s for _, s, _, _ in todo], b.static[q], b.series[q]) if todo else None
                for j, (problem, _, lows, highs) in enumerate(todo):
                    at = np.searchsorted(lows, x[:, j], side="right") - 1
                    inside = np.flatnonzero((at >= 0) & (x[:, j] <= highs[np.maximum(at, 0)]))
                    v, inverse = np.unique(x[inside, j], return_inverse=True)
                    sums = [np.bincount(inverse, w, len(v)) for w in (b.g[q[inside], k], b.h[q[inside], k])]
                    yield _batch(VALUES, [np.full(len(v), problem), v, *sums, np.bincount(inverse, minlength=len(v))])

    return run


CUT = "problem int, gain double, missing_left boolean, threshold double, gl double, hl double, gr double, hr double"


def best_of_values(rules: ScanRules) -> Callable:
    """Group: the best cut of one problem by its values' sums (f NULL for missing); gain 0 for none."""

    def run(t: pa.Table) -> pa.Table:
        f = t.column("f").to_numpy()
        c = {k: t.column(k).to_numpy() for k in ("g", "h", "n")}
        order = np.argsort(f)
        f, c = f[order], {k: v[order] for k, v in c.items()}
        best, _ = best_cut(c | {"code": np.where(np.isfinite(f), 0, MISSING), "a": c["g"], "b": c["g"], "low": f, "high": f}, rules)
        kinds = [pa.int32(), pa.float64(), pa.bool_(), *[pa.float64()] * 5]
        return pa.table([pa.array([v], k) for v, k in zip([t.column("problem")[0].as_py(), *best], kinds)], names=[x.split()[0] for x in CUT.split(", ")])

    return run


# ---------------------------------------------------------------- permuted gradients


NULL_SUMS = "output int, node int, perm int, candidate int, code int, g double, h double, n long"


def node_rows(level: Level, row_id: str) -> tuple[Callable, str]:
    """Task: (id, output, node, codes, g, h) of every row in an open node; codes are the bins of the node's candidates."""
    schema = f"{row_id}, output int, node int, codes binary, g double, h double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, b in read_blocks(batches, level.shape):
            for (k, i), q in open_rows(level, b):
                x = evaluate(level.pools[k, i], b.static[q], b.series[q])
                codes = np.full(x.shape, MISSING, np.int32)
                for j, spec in enumerate(level.pools[k, i]):
                    some = np.isfinite(x[:, j])
                    codes[some, j] = np.searchsorted(level.edges[spec], x[some, j], side="right")
                columns = [np.full(len(q), k, np.int32), np.full(len(q), i, np.int32), [r.tobytes() for r in codes], b.g[q, k], b.h[q, k]]
                yield pa.RecordBatch.from_arrays([batch.column("row_id").take(pa.array(q)), *map(pa.array, columns)], names=["row_id", "output", "node", "codes", "g", "h"])

    return run, schema


def null_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: sums by (output, node, permutation, candidate, bin) of rows with their permuted gradients."""
    for b in batches:
        keys = np.stack([np.asarray(b.column(c)) for c in ("output", "node", "perm")]) if b.num_rows else np.zeros((3, 0), int)
        g, h = np.asarray(b.column("g"), float), np.asarray(b.column("h"), float)
        group, inverse = np.unique(keys, axis=1, return_inverse=True)
        codes = b.column("codes")
        for u in range(group.shape[1]):
            q = np.flatnonzero(inverse.ravel() == u)
            m = np.frombuffer(b"".join(codes.take(pa.array(q)).to_pylist()), np.int32).reshape(len(q), -1)
            for j in range(m.shape[1]):
                code, at = np.unique(m[:, j], return_inverse=True)
                sums = [np.bincount(at, w, len(code)) for w in (g[q], h[q])]
                yield _batch(NULL_SUMS, [*(np.full(len(code), x) for x in group[:, u]), np.full(len(code), j), code, *sums, np.bincount(at, minlength=len(code))])


NULL_BEST = "output int, node int, perm int, gain double"


def null_best(rules: ScanRules) -> Callable:
    """Group: the best gain between the bins of one candidate under one permutation."""

    def run(t: pa.Table) -> pa.Table:
        c = {k: t.column(k).to_numpy() for k in ("code", "g", "h", "n")}
        order = np.argsort(c["code"])
        c = {k: v[order] for k, v in c.items()}
        c |= {"a": c["g"], "b": c["g"], "low": c["code"].astype(float), "high": c["code"].astype(float)}
        return pa.Table.from_batches([_batch(NULL_BEST, [*([t.column(k)[0].as_py()] for k in ("output", "node", "perm")), [best_cut(c, rules)[0][0]]])])

    return run


# ---------------------------------------------------------------- moments of features


MOMENTS = "place int, value double, low double, high double"


def moment_sums(specs: list[Spec], level: Level, shift: np.ndarray, target: int | None = None) -> Callable:
    """Task: the pairwise sums of ``Moments``, of the rows' features less ``shift``.

    With ``target`` over the rows of that output's screening fold, and with their Newton step as a last feature.
    """
    m = len(specs) + (target is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, low, high = np.zeros((4, m, m)), np.full(m, np.inf), np.full(m, -np.inf)
        for _, b in read_blocks(batches, level.shape):
            q = np.arange(len(b.ids)) if target is None else np.flatnonzero(in_fold(b.ids, level, target))
            x = evaluate(specs, b.static[q], b.series[q]) - shift[: len(specs)]
            if target is not None:
                x = np.column_stack([x, -b.g[q, target] / (b.h[q, target] + level.rules.l2)])
            some = np.isfinite(x)
            z, o = np.where(some, x, 0.0), some.astype(float)
            total += np.stack([o.T @ o, z.T @ o, (z * z).T @ o, z.T @ z])
            low, high = np.minimum(low, np.where(some, x, np.inf).min(0, initial=np.inf)), np.maximum(high, np.where(some, x, -np.inf).max(0, initial=-np.inf))
        n = total.size
        ends = np.full(n, np.inf), np.full(n, -np.inf)
        ends[0][:m], ends[1][:m] = low, high
        yield _batch(MOMENTS, [np.arange(n), total.ravel(), *ends])

    return run
