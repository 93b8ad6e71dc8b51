"""The ridge base: a linear model over wide fixed features with exact leave-one-row and leave-one-group-out margins.

Rows carry ``x`` (features to be penalised), ``t`` (targets) and, where wanted, ``z`` (a design that isn't, its first
column 1).  The data side runs in Spark: one pass adds up the cross products of [z | x | t] per Arrow batch and in a
tree.  From those sums the driver takes the features' part outside the design (a Schur complement), solves one
eigenproblem of the smaller side, and everything row-wise is one more pass: with u = [z L | r V] of a row, where r is
its feature row less what the design explains, the hat matrix under a penalty is U D U' with D diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import fourier_weights, permuted

#: Features and rows up to which the driver solves the whole eigenproblem of that side (8 bytes x size^2).
MOST_FEATURES, MOST_ROWS = 12_000, 4096
#: Axes that are looked for beyond that, and numbers (features x axes) that the driver and a worker hold at most.
AXES, MOST_CELLS = 1024, 1 << 26
#: Columns of one tile of the cross products; a task's sums are one tile.
TILE = 4096
PENALTIES = 13
EPS = 1e-12


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), width)


def _stack(column: pd.Series, width: int) -> np.ndarray:
    return np.array([np.asarray(v, float) for v in column]).reshape(len(column), width)


def summed(rows: DataFrame, columns: list[str], shape: tuple[int, int], of) -> tuple[np.ndarray, int]:
    """The sum over Arrow batches of ``of(batch)``, an array of a fixed shape, and the number of rows.

    Each task adds up its batches; the tasks' sums are added in a tree whose steps grow with their square root.
    """
    schema = "sums binary, n long"
    size = int(np.prod(shape))

    def out(total: np.ndarray, count: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([count], pa.int64())], names=["sums", "n"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(shape), 0
        for b in batches:
            if b.num_rows:
                total += of(b)
                count += b.num_rows
        yield out(total, count)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(size), 0
        for b in batches:
            for cell, n in zip(b.column(0), b.column(1).to_pylist()):
                total += np.frombuffer(cell.as_py())
                count += n
        yield out(total, count)

    parts = rows.select(*columns).mapInArrow(part, schema)
    fan = max(1, int(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    row = parts.repartition(fan).mapInArrow(added, schema).repartition(1).mapInArrow(added, schema).first()
    return np.frombuffer(row.sums).reshape(shape), row.n


def _blocks(b: pa.RecordBatch, widths: tuple[int, ...]) -> np.ndarray:
    return np.hstack([_matrix(b.column(i), w) for i, w in enumerate(widths)])


def cross_products(rows: DataFrame, columns: list[str], widths: tuple[int, ...]) -> tuple[np.ndarray, int]:
    """(V'V, rows) of the columns laid side by side, tile by tile where they are wider than one."""
    size = sum(widths)
    cuts = [*range(0, size, TILE), size]
    out, n = np.zeros((size, size)), 0
    for i in range(len(cuts) - 1):
        for j in range(i + 1):
            a, b = slice(cuts[i], cuts[i + 1]), slice(cuts[j], cuts[j + 1])

            def tile(batch: pa.RecordBatch, a=a, b=b) -> np.ndarray:
                v = _blocks(batch, widths)
                return v[:, a].T @ v[:, b]

            out[a, b], n = summed(rows, columns, (a.stop - a.start, b.stop - b.start), tile)
            out[b, a] = out[a, b].T
    return out, n


def random_fourier(x: Column, width: int, features: int, gamma: float = 1.0, seed: int = 0) -> Column:
    """``[x | sqrt(2 / D) cos(x W + b)]`` of standardised features: a kernel's curvature that stays linear to fit."""
    w, b = fourier_weights(width, features, gamma, seed)

    @F.pandas_udf("array<double>")
    def mapped(s: pd.Series) -> pd.Series:
        if not len(s):
            return pd.Series([], dtype=object)
        v = _stack(s, width)
        return pd.Series(list(np.hstack([v, np.sqrt(2 / features) * np.cos(v @ w + b)])))

    return mapped(x)


@dataclass
class RidgeBase:
    """A fitted base: ``margin = z . gamma + r . beta`` with r the standardised features outside the design."""

    center: np.ndarray
    scale: np.ndarray
    explained: np.ndarray  # design coefficients of each feature, (q, p)
    root: np.ndarray  # L with (Z'Z)^-1 = L L'
    vectors: np.ndarray
    values: np.ndarray
    design_targets: np.ndarray  # L'Z'T
    feature_targets: np.ndarray  # V'R'T
    n: int
    penalty: float = 1.0
    loo_error: float = np.nan
    loo_r2: float = np.nan
    null_r2: float = np.nan
    calibration: list[tuple[float, float]] = field(default_factory=list)
    has_design: bool = False
    captured: float = 1.0  # share of the features' variance that lies along the axes

    @property
    def width(self) -> int:
        return len(self.center)

    @property
    def design_width(self) -> int:
        return len(self.root)

    @property
    def declined(self) -> bool:
        """Whether held-out margins are no better than the mean, or than chance where that was measured."""
        return not self.loo_r2 > max(0.0, 0.0 if np.isnan(self.null_r2) else self.null_r2)

    def shrink(self, penalty: float) -> np.ndarray:
        """The diagonal D: 1 along the design, s / (s + penalty) along the features' axes."""
        return np.concatenate([np.ones(self.root.shape[1]), self.values / (self.values + penalty)])

    def axes(self, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        """u of each row: orthonormal over the rows of the fit."""
        r = (x - self.center) / self.scale - z @ self.explained
        return np.hstack([z @ self.root, r @ self.vectors / np.sqrt(self.values)])

    def weights(self, penalty: float) -> np.ndarray:
        """What u is multiplied with for the fitted values."""
        all_ = np.vstack([self.design_targets, self.feature_targets / np.sqrt(self.values)[:, None]])
        return self.shrink(penalty)[:, None] * all_

    @property
    def coef(self) -> np.ndarray:
        """Coefficients of the standardised features outside the design."""
        return self.vectors @ (self.feature_targets / (self.values + self.penalty)[:, None])

    def linear(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(coefficients of x, of z, offset) of the full-fit margins before calibration: all that prediction needs."""
        k = self.root.shape[1]
        w = self.weights(self.penalty)
        b = self.vectors @ (w[k:] / np.sqrt(self.values)[:, None])
        scaled = b / self.scale[:, None]
        return scaled, self.root @ w[:k] - self.explained @ b, -self.center @ scaled

    # ------------------------------------------------------------ row-wise results

    def _z(self, batch_rows: int, z) -> np.ndarray:
        return np.ones((batch_rows, 1)) if z is None else z

    def _per_row(self, rows: DataFrame, columns: list[str], out: str, of) -> DataFrame:
        """The rows with ``of(x, z, t)``, a matrix of a row each, as an array column."""
        widths = {"x": self.width, "z": self.design_width}

        @F.pandas_udf("array<double>")
        def made(*parts: pd.Series) -> pd.Series:
            if not len(parts[0]):
                return pd.Series([], dtype=object)
            got = {k: _stack(p, widths.get(k, len(p.iloc[0]))) for k, p in zip(keys, parts)}
            return pd.Series(list(of(got["x"], self._z(len(parts[0]), got.get("z")), got.get("t"))))

        keys = ["x", *(["z"] if self.has_design else []), *(["t"] if len(columns) > 2 else [])]
        use = [columns[0], *([columns[1]] if self.has_design else []), *columns[2:]]
        return rows.withColumn(out, made(*[F.col(c) for c in use]))

    def _calibrated(self, m: np.ndarray) -> np.ndarray:
        return m if not self.calibration else m * [a for a, _ in self.calibration] + [b for _, b in self.calibration]

    def margins(self, rows: DataFrame, x: str = "x", out: str = "margin", z: str = "z") -> DataFrame:
        """Full-fit margins as an array column, calibrated where that was fitted: for rows that the fit hasn't seen."""
        w = self.weights(self.penalty)
        return self._per_row(rows, [x, z], out, lambda a, b, _: self._calibrated(self.axes(a, b) @ w))

    def leave_one_out(self, rows: DataFrame, x: str = "x", y: str = "t", out: str = "margin", z: str = "z") -> DataFrame:
        """Adds each row's margin under a fit without that row, in closed form: (f - h t) / (1 - h)."""
        w, d = self.weights(self.penalty), self.shrink(self.penalty)

        def held(a: np.ndarray, b: np.ndarray, t: np.ndarray) -> np.ndarray:
            u = self.axes(a, b)
            h = (u * u) @ d
            return self._calibrated((u @ w - h[:, None] * t) / np.maximum(1 - h, 1e-3)[:, None])

        return self._per_row(rows, [x, z, y], out, held)

    def leave_group_out(self, rows: DataFrame, group: str, id_column: str, x: str = "x", y: str = "t", out: str = "margin", z: str = "z") -> DataFrame:
        """(id, margin): each row's margin under a fit without its whole group.

        Per group only sums over its rows are needed: with C = U'U, b = U'T and f the fit, the margin is
        f + u D (s - b) where (I - C D) s = U'f - C D b.  So a group of any size is a partial aggregate of fixed width
        and one small system; its rows never meet.  A group that the fit reproduces exactly gives 0 margins.
        """
        d, w = self.shrink(self.penalty), self.weights(self.penalty)
        solved = self._group_sums(rows, group, x, y, z, lambda c, b, _: _group_shift(c, b, w, d)[None])
        joined = rows.join(solved.select(group, F.col("found").alias("_shift")), group)
        use = [x, *([z] if self.has_design else []), "_shift"]

        @F.pandas_udf("array<double>")
        def held(*parts: pd.Series) -> pd.Series:
            if not len(parts[0]):
                return pd.Series([], dtype=object)
            b = _stack(parts[1], self.design_width) if self.has_design else None
            u = self.axes(_stack(parts[0], self.width), self._z(len(parts[0]), b))
            shift = _stack(parts[-1], w.size).reshape(len(u), *w.shape)
            m = u @ w + np.einsum("ij,ijk->ik", u * d, shift)
            return pd.Series(list(self._calibrated(np.where(np.isfinite(m), m, 0.0))))

        return joined.withColumn(out, held(*[F.col(c) for c in use])).select(id_column, out)

    def _group_sums(self, rows: DataFrame, group: str, x: str, y: str, z: str, solve) -> DataFrame:
        """(group, found): ``solve(C, b, T'T)`` of each group's sums, flattened."""
        outputs, k = self.design_targets.shape[1], self.root.shape[1] + len(self.values)
        kind = dict(rows.dtypes)[group]
        use = [group, x, *([z] if self.has_design else []), y]
        flush = max(1, (64 << 20) // (8 * (k + outputs) ** 2))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict = {}

            def out() -> pa.RecordBatch:
                t = pa.RecordBatch.from_arrays([pa.array(list(sums), keys), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=[group, "sums"])
                sums.clear()
                return t

            keys = None
            for b in batches:
                keys = b.column(0).type
                if not b.num_rows:
                    continue
                xs, ts = _matrix(b.column(1), self.width), _matrix(b.column(b.num_columns - 1), outputs)
                v = np.hstack([self.axes(xs, self._z(len(xs), _matrix(b.column(2), self.design_width) if self.has_design else None)), ts])
                coded = b.column(0).dictionary_encode()
                for i, name in enumerate(coded.dictionary.to_pylist()):
                    own = v[np.asarray(coded.indices) == i]
                    sums[name] = sums.get(name, 0) + own.T @ own
                if len(sums) >= flush:
                    yield out()
            if sums:
                yield out()

        def whole(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k + outputs) ** 2)
            for b in batches:
                for cell in b.column("sums"):
                    total += np.frombuffer(cell.as_py())
            s = total.reshape(k + outputs, k + outputs)
            found = solve(s[:k, :k], s[:k, k:], s[k:, k:]).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], key[0].type), pa.array([found.tolist()], pa.list_(pa.float64()))], names=[group, "found"])

        partial = rows.where(F.col(group).isNotNull()).select(*use).mapInArrow(part, f"`{group}` {kind}, sums binary")
        return partial.groupBy(group).applyInArrow(whole, f"`{group}` {kind}, found array<double>")


def _group_shift(c: np.ndarray, b: np.ndarray, w: np.ndarray, d: np.ndarray) -> np.ndarray:
    """s - b of a group; NaN where its system is singular."""
    try:
        s = np.linalg.solve(np.eye(len(c)) - c * d, c @ w - c @ (d[:, None] * b))
    except np.linalg.LinAlgError:
        return np.full(w.shape, np.nan)
    return s - b


def _inverse_root(a: np.ndarray) -> np.ndarray:
    """L with L L' the pseudo-inverse of a symmetric matrix; directions without weight are left out."""
    values, vectors = np.linalg.eigh(a)
    keep = values > max(values.max(initial=0), EPS) * 1e-12
    return vectors[:, keep] / np.sqrt(values[keep])


def _spectrum_by_rows(rows: DataFrame, x: str, z: str | None, id_column: str, base: RidgeBase) -> None:
    """Values and vectors where rows are fewer than features: the eigenproblem of R R', then R' times its vectors.

    A task takes a block of feature columns of all rows, which are few; the driver holds rows squared.
    """
    width, q = base.width, base.design_width
    ids = [r[0] for r in rows.select(id_column).orderBy(id_column).collect()]
    place = {v: i for i, v in enumerate(ids)}
    n, step = len(ids), max(64, min(width, (32 << 20) // (8 * max(len(ids), 1))))
    blocks = [(a, min(width, a + step)) for a in range(0, width, step)]
    use = [id_column, x, *([z] if z else [])]
    parts = F.array(*[F.struct(F.lit(i).alias("block"), F.slice(F.col(x), a + 1, b - a).alias("v")) for i, (a, b) in enumerate(blocks)])
    long = rows.select(id_column, *([z] if z else []), F.explode(parts).alias("p")).select(id_column, *([z] if z else []), "p.*")

    def block_rows(t: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
        i = t.column("block")[0].as_py()
        a, b = blocks[i]
        order = np.argsort([place[v] for v in t.column(id_column).to_pylist()])
        v = _matrix(t.column("v").combine_chunks(), b - a)[order]
        d = _matrix(t.column(z).combine_chunks(), q)[order] if z else np.ones((n, 1))
        return (v - base.center[a:b]) / base.scale[a:b] - d @ base.explained[:, a:b], np.arange(a, b), i

    def outer(t: pa.Table) -> pa.Table:
        r, _, i = block_rows(t)
        return pa.table({"block": pa.array([i], pa.int32()), "sums": pa.array([(r @ r.T).tobytes()], pa.binary())})

    total = np.zeros(n * n)
    for row in long.groupBy("block").applyInArrow(outer, "block int, sums binary").toLocalIterator():
        total += np.frombuffer(row.sums)
    values, u = np.linalg.eigh(total.reshape(n, n))
    keep = values > max(values.max(initial=0), EPS) * 1e-12
    values, u = values[keep], u[:, keep]

    def back(t: pa.Table) -> pa.Table:
        r, at, i = block_rows(t)
        return pa.table({"block": pa.array([i], pa.int32()), "sums": pa.array([(r.T @ u / np.sqrt(values)).tobytes()], pa.binary())})

    vectors = np.zeros((width, len(values)))
    for row in long.groupBy("block").applyInArrow(back, "block int, sums binary").toLocalIterator():
        a, b = blocks[row.block]
        vectors[a:b] = np.frombuffer(row.sums).reshape(b - a, len(values))
    base.vectors, base.values = vectors, values


def _spectrum_by_subspace(rows: DataFrame, x: str, z: str | None, base: RidgeBase, axes: int, trace: float, rounds: int = 12, tolerance: float = 1e-10, seed: int = 0) -> None:
    """The greatest values and their vectors by randomised subspace iteration: R'R is never formed.

    A round multiplies the axes with R'R in passes over the rows, each for as many axes as a task's sum (features x
    axes of the pass) may have, and makes them orthonormal on the driver, which holds features x axes.  It ends when
    the sum of the values stands still.  Axes as many as R's rank give the whole spectrum; with fewer, the rest of the
    features' variance has no weight (``base.captured`` says how much is left).
    """
    spark, width, q = rows.sparkSession, base.width, base.design_width
    step = max(1, TILE * TILE // width)
    use = [x, *([z] if z else [])]
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, axes)))[0]
    last = -1.0
    for _ in range(rounds):
        image = np.empty((width, axes))
        for a in range(0, axes, step):
            held = spark.sparkContext.broadcast(basis[:, a : a + step])

            def multiplied(b: pa.RecordBatch, held=held) -> np.ndarray:
                d = _matrix(b.column(1), q) if z else np.ones((b.num_rows, 1))
                r = (_matrix(b.column(0), width) - base.center) / base.scale - d @ base.explained
                return r.T @ (r @ held.value)

            image[:, a : a + step], _ = summed(rows, use, (width, min(step, axes - a)), multiplied)
            held.unpersist()
        values, turned = np.linalg.eigh(basis.T @ image)
        if abs(values.sum() - last) <= tolerance * max(trace, EPS):
            break
        last = values.sum()
        basis, image = np.linalg.qr(image)[0], basis
    else:
        basis = image  # the axes that the last values belong to
    keep = values > max(values.max(initial=0), EPS) * 1e-12
    base.values, base.vectors = values[keep], basis @ turned[:, keep]
    base.captured = float(min(1.0, base.values.sum() / max(trace, EPS)))


def fit_ridge(rows: DataFrame, x: str = "x", y: str = "t", penalties: int = PENALTIES, z: str | None = None, group: str | None = None, id_column: str | None = None, axes: int | None = None) -> RidgeBase:
    """Fit on array columns of features and targets, the penalty by exact leave-one-row or leave-one-group-out error.

    Features are centred and scaled (flat ones count as scale 1).  Penalties are log-spaced over six decades around
    the mean eigenvalue; those that use more than 0.9 of the rows' freedom, or all but 0.01 of any row's, are refused,
    and the strongest is taken if all are.  Up to ``MOST_FEATURES`` features are solved by their width; where an id is
    named and rows are fewer than features, by the rows (up to ``MOST_ROWS``).  Beyond both, or where ``axes`` is given,
    the fit is along the features' leading axes (``AXES`` of them unless given), and exact on those.
    """
    shape = rows.select(F.size(x).alias("w"), F.size(y).alias("k"), (F.size(z) if z else F.lit(1)).alias("q")).first()
    if shape is None:
        raise ValueError("no rows to fit on")
    width, outputs, q = shape.w, shape.k, shape.q
    few = rows.count() if id_column and width > 64 else None
    by_rows = axes is None and few is not None and few < width and few <= MOST_ROWS and few * width <= MOST_CELLS
    by_subspace = not by_rows and (axes is not None or width > MOST_FEATURES)
    if (axes or 16) * width > MOST_CELLS:
        raise ValueError(f"{axes or 16} axes of {width} features; at most {MOST_CELLS} numbers")
    one = rows if z else rows.withColumn("_one", F.array(F.lit(1.0)))
    zc = z or "_one"
    if by_rows or by_subspace:
        side, n = cross_products(one, [zc, y], (q, outputs))

        def beside(b: pa.RecordBatch) -> np.ndarray:
            v = _matrix(b.column(1), width)
            return np.vstack([_matrix(b.column(0), q).T @ v, _matrix(b.column(2), outputs).T @ v, (v * v).sum(0)])

        own, _ = summed(one, [zc, x, y], (q + outputs + 1, width), beside)
        zz, zt, zx, diagonal = side[:q, :q], side[:q, q:], own[:q], own[-1]
    else:
        g, n = cross_products(one, [zc, x, y], (q, width, outputs))
        zz, zx, zt, diagonal = g[:q, :q], g[:q, q : q + width], g[:q, q + width :], np.diag(g)[q : q + width]
    root = _inverse_root(zz)
    mean = zx[0] / n  # the design's first column is 1
    spread = np.sqrt(np.maximum(diagonal / n - mean**2, 0))
    scale = np.where(spread > EPS, spread, 1.0)
    zx = (zx - np.outer(zz[:, 0], mean)) / scale
    explained = root @ (root.T @ zx)
    base = RidgeBase(mean, scale, explained, root, np.zeros((width, 0)), np.zeros(0), root.T @ zt, np.zeros((0, outputs)), n, has_design=z is not None)
    if by_rows:
        _spectrum_by_rows(rows, x, z, id_column, base)
    elif by_subspace:
        trace = float(((diagonal - n * mean**2) / scale**2 - (zx * explained).sum(0)).sum())
        _spectrum_by_subspace(rows, x, z, base, min(axes or AXES, width, n, MOST_CELLS // width), trace)
        xt = (own[q : q + outputs].T - np.outer(mean, zt[0])) / scale[:, None] - explained.T @ zt
        base.feature_targets = base.vectors.T @ xt
    else:
        xx, xt = g[q : q + width, q : q + width], g[q : q + width, q + width :]
        xx = (xx - n * np.outer(mean, mean)) / np.outer(scale, scale) - zx.T @ explained
        xt = (xt - np.outer(mean, zt[0])) / scale[:, None] - explained.T @ zt
        values, vectors = np.linalg.eigh((xx + xx.T) / 2)
        keep = values > max(values.max(initial=0), EPS) * 1e-12
        base.values, base.vectors = values[keep], vectors[:, keep]
        base.feature_targets = base.vectors.T @ xt
    if by_rows:
        use = [x, y, *([z] if z else [])]
        ut, _ = summed(rows, use, (len(base.values), outputs), lambda b: base.axes(_matrix(b.column(0), width), _matrix(b.column(2), q) if z else np.ones((b.num_rows, 1)))[:, root.shape[1] :].T @ _matrix(b.column(1), outputs))
        base.feature_targets = ut * np.sqrt(base.values)[:, None]
    _choose_penalty(rows, x, y, z, group, base, penalties, outputs)
    return base


def _choose_penalty(rows: DataFrame, x: str, y: str, z: str | None, group: str | None, base: RidgeBase, penalties: int, outputs: int) -> None:
    width, q, n = base.width, base.design_width, base.n
    grid = np.logspace(-3, 3, penalties) * max(base.values.sum() / min(n, width), EPS)
    shrinks = [base.shrink(p) for p in grid]
    weights = [base.weights(p) for p in grid]
    use = [x, y, *([z] if z else [])]
    m = len(grid)

    def judged(b: pa.RecordBatch) -> np.ndarray:
        xs, ts = _matrix(b.column(0), width), _matrix(b.column(1), outputs)
        u = base.axes(xs, _matrix(b.column(2), q) if z else np.ones((len(xs), 1)))
        uu, out = u * u, np.zeros((m + 1, 2 + outputs))
        for i in range(m):
            h = uu @ shrinks[i]
            e = (u @ weights[i] - ts) / np.maximum(1 - h, 1e-3)[:, None]
            out[i] = [(e * e).sum(), (h > 0.99).sum(), *np.zeros(outputs)]
        out[m] = [(ts * ts).sum(), 0, *ts.sum(0)]
        return out

    got, _ = summed(rows, use, (m + 1, 2 + outputs), judged)
    errors, crowded = got[:m, 0], got[:m, 1]
    total = got[m, 0] - (got[m, 2:] ** 2).sum() / n
    allowed = [i for i in range(m) if base.values.size == 0 or ((shrinks[i].sum() - base.root.shape[1]) <= 0.9 * n and not crowded[i])]
    if group is not None:

        def lost(c: np.ndarray, b: np.ndarray, tt: np.ndarray) -> np.ndarray:
            out = np.full((m, 2), np.nan)
            for i in range(m):
                # with e = T - f - U D shift = T - U v, the group's squared error is a form in its sums
                v = weights[i] + shrinks[i][:, None] * _group_shift(c, b, weights[i], shrinks[i])
                out[i] = [np.trace(tt) - 2 * (v * b).sum() + (v * (c @ v)).sum(), 1]
            return out

        sums = base._group_sums(rows, group, x, y, z or "z", lost)
        found = np.array([r.found for r in sums.select("found").collect()]).reshape(-1, m, 2)
        errors = np.nansum(found[:, :, 0], 0)
        allowed = [i for i in allowed if np.isfinite(found[:, i, 0]).any()]
    best = min(allowed, key=lambda i: (errors[i], i)) if allowed else m - 1
    base.penalty, base.loo_error = float(grid[best]), float(errors[best] / (n * outputs))
    base.loo_r2 = float(1 - errors[best] / max(total, EPS))


def chance_r2(rows: DataFrame, base: RidgeBase, id_column: str, x: str = "x", y: str = "t", z: str | None = None, permutations: int = 32, quantile: float = 0.95, seed: int = 0) -> float:
    """The held-out R2 that shuffled targets reach at the fitted penalty; kept in ``base.null_r2``."""
    seeds = [seed * 1000 + i for i in range(permutations)]
    mixed = rows.join(permuted(rows, id_column, y, seeds, "_p"), id_column).withColumn("_flat", F.flatten("_p"))
    outputs = base.design_targets.shape[1]
    many = outputs * permutations
    k, d, q = base.root.shape[1] + len(base.values), base.shrink(base.penalty), base.design_width
    use = [x, "_flat", *([z] if z else [])]

    def axes(b: pa.RecordBatch) -> np.ndarray:
        return base.axes(_matrix(b.column(0), base.width), _matrix(b.column(2), q) if z else np.ones((b.num_rows, 1)))

    ut, _ = summed(mixed, use, (k, many), lambda b: axes(b).T @ _matrix(b.column(1), many))

    def errors(b: pa.RecordBatch) -> np.ndarray:
        u, t = axes(b), _matrix(b.column(1), many)
        h = (u * u) @ d
        e = (u @ (d[:, None] * ut) - t) / np.maximum(1 - h, 1e-3)[:, None]
        return np.stack([(e * e).sum(0), (t * t).sum(0), t.sum(0)])

    got, n = summed(mixed, use, (3, many), errors)
    e, tt, s = got.reshape(3, permutations, outputs)
    r2 = 1 - e.sum(1) / np.maximum((tt - s * s / n).sum(1), EPS)
    base.null_r2 = float(np.quantile(r2, quantile))
    return base.null_r2


def platt(rows: DataFrame, margin: Column, positive: Column, rounds: int = 50) -> tuple[float, float]:
    """(a, b) of sigmoid(a m + b) by Newton's method, one small aggregate a round; a slope under 0 gives (0, b).

    ``positive`` is 1 or 0.  A calibration may stretch a score but not turn it round.
    """
    a, b = 1.0, 0.0
    data = rows.select(margin.alias("m"), positive.cast("double").alias("y"))
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.lit(a) * F.col("m") + F.lit(b)))))
        w, e = F.greatest(p * (1 - p), F.lit(1e-9)), p - F.col("y")
        s = data.agg(*[F.sum(v) for v in (e * F.col("m"), e, w * F.col("m") * F.col("m"), w * F.col("m"), w)]).first()
        hessian = np.array([[s[2], s[3]], [s[3], s[4]]]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(hessian, np.array([s[0], s[1]]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-10:
            break
    return (float(a), float(b)) if a > 0 else (0.0, float(b))


def calibrate(rows: DataFrame, base: RidgeBase, id_column: str, y: str = "t", group: str | None = None, x: str = "x", z: str = "z") -> RidgeBase:
    """Fit ``base.calibration`` on held-out margins of rows whose targets are +1 or -1, one pair an output."""
    base.calibration = []
    if group:
        held = base.leave_group_out(rows, group, id_column, x, y, "_m", z).join(rows.select(id_column, y), id_column)
    else:
        held = base.leave_one_out(rows, x, y, "_m", z)
    outputs = base.design_targets.shape[1]
    held = held.select("_m", y).persist()
    try:
        base.calibration = [platt(held, F.get("_m", F.lit(k)), (F.get(F.col(y), F.lit(k)) > 0).cast("int")) for k in range(outputs)]
    finally:
        held.unpersist()
    return base


def signed_targets(label: Column, classes: list) -> Column:
    """An array of +1/-1, one per class (one number for two classes)."""
    if len(classes) == 2:
        return F.array(F.when(label == classes[1], F.lit(1.0)).otherwise(F.lit(-1.0)))
    return F.array(*[F.when(label == c, F.lit(1.0)).otherwise(F.lit(-1.0)) for c in classes])
