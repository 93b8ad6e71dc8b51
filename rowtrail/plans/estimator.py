"""The whole model as a ``pyspark.ml`` Estimator: a ridge base over convolutions that must beat chance, then trees.

The base is fitted on a convolution bank (with random Fourier features and, unpenalised, the statics, where wanted), its
penalty by exact hold-out of rows or of groups.  If its held-out margins beat what shuffled targets reach, they are
calibrated, laid behind the statics, and the trees start from them; rows that the fit hasn't seen get the full fit's
margins.  If not, the base is declined and the trees start from the loss's own first score.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, TypeConverters
from pyspark.ml.param import Params as MLParams
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.losses import logistic, softmax_loss, squared_error
from ..operators import boost, design, ridge
from ..operators.rocket import RocketBank
from ..operators.specs import Draws
from ..operators.split import ScanRules
from ..operators.tables import stored
from . import persistence

_I, _D, _B, _S = TypeConverters.toInt, TypeConverters.toFloat, TypeConverters.toBoolean, TypeConverters.toString
_R, _N, _C = boost.Params(), Draws(), ScanRules(l2=1.0, min_child_weight=1e-3, min_samples_leaf=5)
#: name, default, converter, meaning; in the order of what they set.
SETTINGS: list[tuple[str, Any, Any, str]] = [
    ("task", "classification", _S, "classification or regression"),
    ("labelCol", "label", _S, "column of the label or the target"),
    ("idCol", "row_id", _S, "column of unique ids"),
    ("staticCol", "static", _S, "array column of statics"),
    ("seriesCol", "series", _S, "array column of channels; empty for none"),
    ("groupCol", "", _S, "column of groups that the base is to be held out by; empty for rows"),
    ("validationIndicatorCol", "", _S, "boolean column of rows that stop the fit and are not learnt from; empty for none"),
    ("predictionCol", "prediction", _S, "column of predictions"),
    ("probabilityCol", "probability", _S, "array column of class probabilities"),
    ("rounds", 200, _I, "rounds of boosting"),
    ("rate", 0.1, _D, "learning rate"),
    ("depth", 4, _I, "depth of a tree"),
    ("l2", _C.l2, _D, "penalty on leaf values"),
    ("gamma", _C.gamma, _D, "cost of a split"),
    ("minChildWeight", _C.min_child_weight, _D, "least hessian of a side"),
    ("minSamplesLeaf", _C.min_samples_leaf, _I, "least rows of a side"),
    ("subsample", 1.0, _D, "share of the rows a round learns from"),
    ("columns", 1.0, _D, "share of the statics a node tries"),
    ("intervals", 16, _I, "interval candidates a node draws"),
    ("shapelets", 4, _I, "shapelet candidates a node draws"),
    ("stats", list(_N.stats), TypeConverters.toListString, "statistics of interval candidates"),
    ("whole", _N.whole, _D, "chance of an interval to be the whole series"),
    ("minLength", _N.min_length, _I, "least length of an interval"),
    ("shapeletMin", _N.shapelet_min, _I, "least length of a shapelet"),
    ("shapeletShare", _N.shapelet_share, _D, "largest length of a shapelet, as a share of the series"),
    ("normalise", True, _B, "whether shapelets and windows are z-normed"),
    ("filters", 0, _I, "filter candidates a node draws"),
    ("fitted", 4, _I, "how many of the filters are refitted to the residuals"),
    ("filterLength", _N.filter_length, _I, "length of a filter"),
    ("components", _N.components, _I, "cosine components of a refitted filter"),
    ("ridge", _N.ridge, _D, "penalty of a refit"),
    ("refits", 1, _I, "refits of a filter"),
    ("bank", 32, _I, "features kept to be tried again; 0 for none"),
    ("bankShare", 0.25, _D, "share of the bank a node tries"),
    ("screen", 0, _I, "entries of the bank that a tree's screening keeps; 0 for no screening"),
    ("screenShare", 0.25, _D, "share of the rows that screen the bank for a tree and are left out of it"),
    ("thin", 1.0, _D, "share of drawn candidates that a node tries"),
    ("products", 0, _I, "products of a banked feature and a static that a node tries"),
    ("null", 0, _I, "permutations whose best gain a split has to beat"),
    ("nullQuantile", 1.0, _D, "quantile of the permutations' best gains"),
    ("charge", 0.0, _D, "weight of the gain that useless candidates would show"),
    ("useBase", False, _B, "whether a ridge base is fitted"),
    ("rocketFeatures", 10_000, _I, "features of the convolution bank"),
    ("baseStatics", False, _B, "whether the base has the statics, unpenalised"),
    ("baseInteractions", False, _B, "whether it has products of their ranks as well"),
    ("fourier", 0, _I, "random Fourier features of the convolutions"),
    ("fourierGamma", 1.0, _D, "bandwidth of those"),
    ("marginProducts", False, _B, "whether trees see products of the base's margins and the statics"),
    ("permutations", 32, _I, "permutations that say what the base reaches by chance"),
    ("stale", 0, _I, "rounds without improvement before the fit stops; 0 for none"),
    ("bins", _R.bins, _I, "bins that guide the search for a cut; they don't change it"),
    ("seed", 0, _I, "seed of all draws"),
]


class Settings(MLParams):
    """All settings, shared by the estimator and the model."""

    def of(self, name: str) -> Any:
        return self.getOrDefault(name)

    def given(self) -> dict[str, Any]:
        """Every setting by its name, as set or by default."""
        return {p.name: v for p, v in self.extractParamMap().items()}

    def boosting(self) -> boost.Params:
        o = self.of
        draws = Draws(
            intervals=o("intervals"), shapelets=o("shapelets"), stats=tuple(o("stats")), min_length=o("minLength"), whole=o("whole"), shapelet_min=o("shapeletMin"), shapelet_share=o("shapeletShare"),
            normalise=o("normalise"), filters=o("filters"), fitted=o("fitted"), refits=o("refits"), ridge=o("ridge"), filter_length=o("filterLength"), components=o("components"),
        )
        return boost.Params(
            rounds=o("rounds"), depth=o("depth"), rate=o("rate"), rules=ScanRules(o("l2"), o("gamma"), o("minChildWeight"), o("minSamplesLeaf")), draws=draws, stale=o("stale"), subsample=o("subsample"), seed=o("seed"),
            bins=o("bins"), charge=o("charge"), null=o("null"), null_quantile=o("nullQuantile"), thin=o("thin"), columns=o("columns"), bank=o("bank"), bank_share=o("bankShare"), screen=o("screen"),
            screen_share=o("screenShare"), products=o("products"),
        )

    def check(self) -> None:
        """Raise a ValueError that names what is out of range."""
        if self.of("task") not in ("classification", "regression"):
            raise ValueError(f"unknown task {self.of('task')!r}")
        bad = [n for n, least in (("rocketFeatures", 84), ("fourier", 0), ("permutations", 1)) if self.of(n) < least] + ["fourierGamma"] * (self.of("fourierGamma") <= 0)
        if bad:
            raise ValueError(f"out of range: {', '.join(bad)}")
        self.boosting().check()

    def _rows(self, data: DataFrame, steps: int | None) -> DataFrame:
        """row_id, static and series of one length, beside the columns as they came (prefixed)."""
        kinds = dict(data.dtypes)
        static = F.col(self.of("staticCol")) if self.of("staticCol") in kinds else F.array().cast("array<double>")
        series = F.col(self.of("seriesCol")) if self.of("seriesCol") in kinds else F.array().cast("array<array<double>>")
        rows = data.select(F.col(self.of("idCol")).alias("row_id"), static.alias("static"), series.alias("series"), *[F.col(c).alias(f"in_{c}") for c in data.columns])
        return design.coerced(rows, pad_to=steps)


for _name, _, _convert, _doc in SETTINGS:
    setattr(Settings, _name, Param(MLParams._dummy(), _name, _doc, _convert))
_DEFAULTS = {n: d for n, d, _, _ in SETTINGS}


@dataclass
class Base:
    """A kept base as what prediction needs: the bank, the design and the linear map to margins."""

    rocket: RocketBank
    design: design.StaticDesign | None
    products: design.StaticScale | None
    coef: np.ndarray  # (features, outputs)
    side: np.ndarray  # (design columns, outputs)
    offset: np.ndarray
    calibration: list[tuple[float, float]]
    fourier: tuple[int, float, int]
    scaling: tuple[list[float], list[float]] | None
    loo_r2: float
    null_r2: float

    def x(self, series: Column) -> Column:
        return bank_features(self.rocket, series, self.fourier, self.scaling)

    def margins(self, rows: DataFrame) -> DataFrame:
        """The rows with ``margin`` of the full fit."""
        coef, side, offset, calibration = self.coef, self.side, self.offset, self.calibration

        @F.arrow_udf("array<double>")
        def linear(x: pa.Array, z: pa.Array) -> pa.Array:
            a, b = (np.asarray(v.flatten(), float).reshape(len(v), len(w)) for v, w in ((x, coef), (z, side)))
            m = a @ coef + b @ side + offset
            if calibration:
                m = m * [s for s, _ in calibration] + [c for _, c in calibration]
            return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))

        z = self.design.column(F.col("static")) if self.design else F.array(F.lit(1.0))
        return rows.withColumn("margin", linear(self.x(F.col("series")), z))


def bank_features(rocket: RocketBank, series: Column, fourier: tuple[int, float, int], scaling: tuple[list[float], list[float]] | None) -> Column:
    """The convolutions' shares; with Fourier features behind them where wanted, both of the standardised shares."""
    x = rocket.transform(series)
    if scaling is None:
        return x
    center, scale = (np.asarray(v) for v in scaling)

    @F.arrow_udf("array<double>")
    def standardised(v: pa.Array) -> pa.Array:
        got = (np.asarray(v.flatten(), float).reshape(len(v), len(center)) - center) / scale
        return pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1) * len(center), pa.int32()), pa.array(got.ravel()))

    return ridge.random_fourier(standardised(x), rocket.width, *fourier)


class FusedBoost(Estimator, Settings, MLReadable, MLWritable):
    """Rows with statics and series to a ``FusedModel``; see ``SETTINGS`` for the parameters."""

    @keyword_only
    def __init__(self, **settings: Any):
        super().__init__()
        self._setDefault(**_DEFAULTS)
        self._set(**settings)

    @keyword_only
    def setParams(self, **settings: Any) -> FusedBoost:
        return self._set(**settings)

    def _fit(self, dataset: DataFrame) -> FusedModel:
        self.check()
        group, judge, label = self.of("groupCol"), self.of("validationIndicatorCol"), f"in_{self.of('labelCol')}"
        rows = stored(self._rows(dataset, None))
        shape = rows.agg(F.max(F.size("static")), F.max(F.size("series")), F.max(F.coalesce(F.array_max(F.transform("series", F.size)), F.lit(0)))).first()
        width, channels, steps = (max(x or 0, 0) for x in shape)
        rows = design.coerced(rows, pad_to=steps) if channels else rows
        held = rows.where(F.coalesce(F.col(f"in_{judge}"), F.lit(False))) if judge else None
        rows = rows.where(~F.coalesce(F.col(f"in_{judge}"), F.lit(False))) if judge else rows
        labels = None
        if self.of("task") == "classification":
            labels = sorted(r[0] for r in rows.select(label).where(F.col(label).isNotNull()).distinct().collect())
            if len(labels) < 2:
                raise ValueError("at least two classes are needed")
            loss = logistic() if len(labels) == 2 else softmax_loss(len(labels))
            rows, held = (boost.coded_labels(f, labels, label) if f is not None else None for f in (rows, held))
        else:
            loss = squared_error()
            rows, held = (f.withColumn("y", F.col(label).cast("double")) if f is not None else None for f in (rows, held))
        if group:  # a row without a group is one of its own
            rows = rows.withColumn("group", F.coalesce(F.col(f"in_{group}").cast("string"), F.concat(F.lit("row "), F.col("row_id").cast("string"))))
        base, start, chance = None, None, None
        if self.of("useBase") and channels and steps:
            base, rows, chance = self._base(rows, labels, width, channels, steps, "group" if group else None)
        if base is not None:
            start = "margin"
            rows = design.augmented(rows, "margin", base.products)
            held = design.augmented(base.margins(held), "margin", base.products) if held is not None else None
        trees = boost.Booster(loss, self.boosting(), labels=labels).fit(rows, held, start)
        model = FusedModel(trees, base, (width, channels, steps), chance)
        return self._copyValues(model)

    def _base(self, rows: DataFrame, labels: list | None, width: int, channels: int, steps: int, group: str | None) -> tuple[Base | None, DataFrame, tuple[float, float]]:
        """(the base or None, the rows with held-out ``margin`` where it is kept, its held-out R2 and that of chance)."""
        o = self.of
        rocket = RocketBank.fit(rows, "series", steps, channels, o("rocketFeatures"), o("seed"))
        fourier = (o("fourier"), o("fourierGamma"), o("seed"))
        scaling = None
        if fourier[0]:
            shares = stored(rows.select(rocket.transform(F.col("series")).alias("x")))
            sums, n = ridge.summed(shares, ["x"], (2, rocket.width), lambda b: np.stack([(v := np.asarray(b.column(0).flatten(), float).reshape(b.num_rows, -1)).sum(0), (v * v).sum(0)]))
            spread = np.sqrt(np.maximum(sums[1] / n - (sums[0] / n) ** 2, 0))
            scaling = ((sums[0] / n).tolist(), np.where(spread > 1e-12, spread, 1.0).tolist())
        shaped = design.StaticDesign.fit(rows, width, o("baseInteractions")) if o("baseStatics") and width else None
        target = ridge.signed_targets(F.col("y").cast("int"), list(range(len(labels)))) if labels else F.array("y")
        z = "z" if shaped else None
        wide = rows.withColumns({"x": bank_features(rocket, F.col("series"), fourier, scaling), "t": target, **({"z": shaped.column(F.col("static"))} if shaped else {})})
        wide = stored(wide)
        fit = ridge.fit_ridge(wide, z=z, group=group, id_column="row_id")
        ridge.chance_r2(wide, fit, "row_id", z=z, permutations=o("permutations"), seed=o("seed"))
        found = (fit.loo_r2, fit.null_r2)
        if fit.declined:
            return None, rows, found
        if labels:
            ridge.calibrate(wide, fit, "row_id", group=group)
        if group:
            kept = wide.join(fit.leave_group_out(wide, group, "row_id"), "row_id")
        else:
            kept = fit.leave_one_out(wide)
        coef, side, offset = fit.linear()
        scale = design.StaticScale.fit(rows, width) if o("marginProducts") and width else None
        return Base(rocket, shaped, scale, coef, side, offset, fit.calibration, fourier, scaling, *found), stored(kept.drop("x", "t", "z")), found

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class FusedModel(Model, Settings, MLReadable, MLWritable):
    """A fitted ``FusedBoost``: ``transform`` adds predictions, and probabilities for classes."""

    def __init__(self, trees: boost.Booster | None = None, base: Base | None = None, shape: tuple[int, int, int] = (0, 0, 0), chance: tuple[float, float] | None = None):
        super().__init__()
        self._setDefault(**_DEFAULTS)
        self.trees, self.base, self.shape, self.base_r2 = trees, base, shape, chance

    @property
    def declined(self) -> bool:
        """Whether a base was fitted and found no better than chance; ``base_r2`` has both R2."""
        return self.base_r2 is not None and self.base is None

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows = self._rows(dataset, self.shape[2] or None)
        if self.base is not None:
            rows = design.augmented(self.base.margins(rows), "margin", self.base.products)
        got = self.trees.predict(rows, start="margin" if self.base is not None else None)
        own = [F.col("prediction").alias(self.of("predictionCol"))] + ([F.col("probability").alias(self.of("probabilityCol"))] if self.trees.labels is not None else [])
        return got.select(*[F.col(f"in_{c}").alias(c) for c in dataset.columns], *own)

    def splits(self, top: int | None = None) -> list[dict]:
        """The splits of the rounds used, the largest gain first, margins by their names."""
        names = design.augmented_names(self.shape[0], len(self.trees.base), self.base.products is not None) if self.base is not None else []
        out = self.trees.splits(top)
        for s in out:
            for i in range(self.shape[0], len(names)):
                s |= {k: s[k].replace(f"static[{i}]", names[i]) for k in ("feature", "family", "text")}
        return out

    def importances(self) -> dict[str, float]:
        """Summed gain by feature family, the largest first."""
        total: dict[str, float] = {}
        for s in self.splits():
            total[s["family"]] = total.get(s["family"], 0.0) + s["gain"]
        return dict(sorted(total.items(), key=lambda x: -x[1]))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


ROWS = "name string, place int, numbers array<double>"


class _Writer(MLWriter):
    """Settings and small parts as one JSON row, the base's coefficients as rows, the trees as ``persistence`` does."""

    def __init__(self, instance: FusedBoost | FusedModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark, it = SparkSession.active(), self.instance
        mode = "overwrite" if self.shouldOverwrite else "errorifexists"
        about: dict[str, Any] = {"kind": type(it).__name__, "settings": it.given()}
        if isinstance(it, FusedModel):
            persistence.save(it.trees, spark, f"{path}/trees", mode)
            about |= {"shape": it.shape, "base_r2": it.base_r2, "base": None}
            if it.base is not None:
                b = it.base
                about["base"] = {
                    "rocket": {"steps": b.rocket.steps, "channels": b.rocket.channels, "entries": b.rocket.entries}, "design": b.design and asdict(b.design), "products": b.products and asdict(b.products),
                    "offset": b.offset.tolist(), "calibration": b.calibration, "fourier": b.fourier, "scaling": b.scaling, "r2": [b.loo_r2, b.null_r2],
                }
                rows = [(n, i, row) for n, m in (("coef", b.coef), ("side", b.side)) for i, row in enumerate(m.tolist())]
                spark.createDataFrame(rows, ROWS).write.mode(mode).parquet(f"{path}/base")
        spark.createDataFrame([(json.dumps(about),)], "about string").write.mode(mode).parquet(f"{path}/about")


class _Reader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> FusedBoost | FusedModel:
        spark = SparkSession.active()
        about = json.loads(spark.read.parquet(f"{path}/about").first().about)
        if about["kind"] != self.kind.__name__:
            raise ValueError(f"{path} holds a {about['kind']}")
        if self.kind is FusedBoost:
            return FusedBoost(**about["settings"])
        base = None
        if about["base"] is not None:
            b = about["base"]
            rows = spark.read.parquet(f"{path}/base").orderBy("name", "place").collect()
            coef, side = (np.array([r.numbers for r in rows if r.name == n]) for n in ("coef", "side"))
            shaped = None
            if b["design"]:
                d = b["design"]
                shaped = design.StaticDesign(design.StaticScale(**d["scale"]), [tuple(r) for r in d["ranks"]], [tuple(p) for p in d["pairs"]])
            rocket = RocketBank(b["rocket"]["steps"], b["rocket"]["channels"], [tuple(e) for e in b["rocket"]["entries"]])
            base = Base(rocket, shaped, b["products"] and design.StaticScale(**b["products"]), coef, side, np.array(b["offset"]), [tuple(c) for c in b["calibration"]], tuple(b["fourier"]), b["scaling"] and tuple(b["scaling"]), *b["r2"])
        model = FusedModel(persistence.load(spark, f"{path}/trees"), base, tuple(about["shape"]), about["base_r2"] and tuple(about["base_r2"]))
        return model._set(**about["settings"])
