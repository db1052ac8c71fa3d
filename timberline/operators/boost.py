"""Stochastic gradient boosting: folds, half samples, shrinkage, convergence, ensembles."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.losses import LOSSES
from timberline.operators.metrics import fold_metrics
from timberline.operators.splits import Feature, Search
from timberline.operators.targets import half
from timberline.operators.tree import Node, Tree, grow
from timberline.plans.durable import discard, durable


@dataclass(frozen=True)
class Config:
    """Learning parameters, checked on creation."""

    loss: str = "logistic"
    max_depth: int = 2
    rate: float = 0.05
    min_convergence_rate: float = 0.001
    folds: int = 2
    forget: float = 0.9
    max_trees: int | None = None
    max_gamma: float | None = None
    deadline: float | None = None
    sample: bool = True

    def __post_init__(self):
        if self.loss not in LOSSES:
            raise ValueError(f"unknown loss {self.loss}")
        for ok, what in ((self.max_depth >= 1, "max_depth"), (0 < self.rate <= 1, "rate"), (self.min_convergence_rate >= 0, "min_convergence_rate"), (self.folds >= 2, "folds"), (0 < self.forget <= 1, "forget"), (self.max_trees is None or self.max_trees >= 1, "max_trees"), (self.max_gamma is None or self.max_gamma > 0, "max_gamma")):
            if not ok:
                raise ValueError(f"{what} is out of range")


class Smoother:
    """Mean with exponential forgetting."""

    def __init__(self, forget: float):
        self.forget, self.theta, self.rinv = forget, 0.0, None

    def add(self, y: float) -> float:
        self.rinv = 1.0 if self.rinv is None else self.rinv / (self.forget + self.rinv)
        self.theta += self.rinv * (y - self.theta)
        return self.theta


@dataclass
class Fit:
    trees: list[Tree] = field(default_factory=list)
    history: list[dict] = field(default_factory=list)
    rate: float = 0.0
    stopped: str = ""


def learn_fold(obs: DataFrame, fold: int, features: list[Feature], conf: Config, rate: float, until: float = math.inf, every: int = 8) -> Fit:
    """Trees of one fold. obs has row_id, y, fold and the features' rank columns.

    The score f is a column that grows by one CASE expression a tree; every few trees it is written out, which keeps plans
    short and lets lost executors recompute little.
    """
    loss, smooth = LOSSES[conf.loss], Smoother(conf.forget)
    work = F.col("fold") != fold
    base = obs.where(work).agg(loss.first(F.col("y")).alias("f")).first()["f"]
    if base is None or not math.isfinite(base):
        raise ValueError("the target has one class only, or no rows to learn from")
    while True:
        fit, cut = Fit([], [], rate), False
        fit.trees.append(Tree({1: Node(float(base))}))
        state, old, kept = obs.withColumn("f", F.lit(float(base))), None, None
        last = fold_metrics(state, fold, conf.loss)["val_loss"]
        i = 1
        while not cut:
            if conf.max_trees is not None and i >= conf.max_trees:
                fit.stopped = "max_trees"
                return fit
            if time.time() > until:
                fit.stopped = "deadline"
                return fit
            seen = state.where(work & half(F.col("row_id"), i)) if conf.sample else state.where(work)
            tree = grow(seen.withColumns(loss.terms(F.col("y"), F.col("f"))), Search(loss, features, conf.max_gamma), conf.max_depth)
            if tree is None:
                fit.stopped = "no split"
                return fit
            tree = tree.shrink(rate)
            state = state.withColumn("f", F.col("f") + tree.column())
            if i % every == 0:
                old, kept = kept, durable(state, "boost-state")
                state = kept
            m = fold_metrics(state, fold, conf.loss)
            if old is not None:
                old = discard(old)
            if m.get("val_wrong") == 0:
                fit.trees.append(tree)
                fit.stopped = "no errors"
                return fit
            if not math.isfinite(m["val_loss"]) or m["val_loss"] >= 2 * last:
                rate, cut = rate / 2, True  # start this fold again; the smoother goes on
                continue
            speed = smooth.add((last - m["val_loss"]) / m["val_loss"] if m["val_loss"] else 0.0)
            fit.history.append(m | {"speed": speed})
            if speed < conf.min_convergence_rate:
                fit.stopped = "converged"
                return fit  # the tree that shows convergence is dropped
            fit.trees.append(tree)
            last, i = m["val_loss"], i + 1


def learn(obs: DataFrame, features: list[Feature], conf: Config) -> tuple[list[Tree], list[Fit]]:
    """Trees of all folds, each leaf divided by the folds that took part, and the fits. A fold cut off by the deadline counts only if it is the first."""
    obs = durable(obs, "boost-rows")
    until, rate, fits = (time.time() + conf.deadline if conf.deadline else math.inf), conf.rate, []
    for k in range(conf.folds):
        fit = learn_fold(obs, k, features, conf, rate, until)
        if fit.stopped == "deadline" and fits:
            break
        fits.append(fit)
        rate = fit.rate
        if fit.stopped == "deadline":
            break
    return [t.shrink(1 / len(fits)) for f in fits for t in f.trees], fits
