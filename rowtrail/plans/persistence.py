"""Fitted boosters as tables: one row a node, beside one row with all settings and the bank."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import SparkSession

from ..functions.losses import Loss
from ..operators.bank import Bank, Entry
from ..operators.boost import Booster, Node, Params
from ..operators.specs import Draws, Spec
from ..operators.split import ScanRules

SCHEMA = "round int, output int, node int, value double, spec string, threshold double, missing_left boolean, gain double, left int, right int"


def _spec(d: dict | None) -> Spec | None:
    if d is None:
        return None
    return Spec(**{**d, "template": tuple(d["template"]), "frozen": tuple(d["frozen"]), "grids": tuple(map(tuple, d["grids"])), "inner": _spec(d["inner"])})


def _params(d: dict) -> Params:
    return Params(**{**d, "rules": ScanRules(**d["rules"]), "draws": Draws(**{**d["draws"], "stats": tuple(d["draws"]["stats"])})})


def _bank(d: dict | None) -> Bank | None:
    return d and Bank(d["cap"], [Entry(_spec(e["spec"]), gain=e["gain"], last_round=e["last_round"], stats=tuple(e["stats"])) for e in d["entries"]])


def save(model: Booster, spark: SparkSession, path: str, mode: str = "errorifexists") -> None:
    rows = [
        (r, k, i, float(n.value), json.dumps(asdict(n.spec)) if n.spec else None, float(n.threshold), n.missing_left, float(n.gain), n.left, n.right)
        for r, trees in enumerate(model.trees) for k, t in enumerate(trees) for i, n in enumerate(t)
    ]
    spark.createDataFrame(rows, SCHEMA).write.mode(mode).parquet(f"{path}/nodes")
    bank = model.bank and {"cap": model.bank.cap, "entries": [{"spec": asdict(e.spec), "gain": e.gain, "last_round": e.last_round, "stats": e.frozen()} for e in model.bank.entries]}
    about = {"loss": model.loss.name, "outputs": model.loss.outputs, "base": model.base, "params": asdict(model.params), "bank": bank, "best_round": model.best_round, "labels": model.labels, "history": model.history, "shape": model.shape}
    spark.createDataFrame([(json.dumps(about),)], "about string").write.mode(mode).parquet(f"{path}/about")


def load(spark: SparkSession, path: str) -> Booster:
    about = json.loads(spark.read.parquet(f"{path}/about").first().about)
    model = Booster(Loss(about["loss"], about["outputs"]), _params(about["params"]), bank=_bank(about["bank"]), base=about["base"], best_round=about["best_round"], labels=about["labels"], history=about["history"], shape=tuple(about["shape"]))
    for r in sorted(spark.read.parquet(f"{path}/nodes").collect(), key=lambda r: (r.round, r.output, r.node)):
        while len(model.trees) <= r.round:
            model.trees.append([[] for _ in model.base])
        model.trees[r.round][r.output].append(Node(r.value, _spec(json.loads(r.spec)) if r.spec else None, r.threshold, r.missing_left, r.gain, r.left, r.right))
    return model
