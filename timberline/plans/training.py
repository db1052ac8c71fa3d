"""Learning from a table and the name of its target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.operators import targets
from timberline.operators.boost import Config, Fit, learn
from timberline.operators.rowsets import find_features
from timberline.operators.splits import Feature, constrained
from timberline.sources import store
from timberline.sources.model import Model


def find_target(catalog: DataFrame, descriptor: str) -> dict:
    """The catalogue row that a descriptor ("id:n", "name:x" or a name) stands for: exactly one."""
    found = find_features(catalog.select("fid", "name", F.col("kind").alias("type")), [descriptor]).collect()
    if len(found) != 1:
        raise ValueError(f"{descriptor} is {len(found)} features, not one")
    return catalog.where(F.col("fid") == found[0]["fid"]).first().asDict()


def observations(df: DataFrame, catalog: DataFrame, rows: DataFrame, row_id: str, target: str, conf: Config) -> tuple[DataFrame, list[Feature], str | None, str | None]:
    """(row_id, y, fold and the features' columns; features without the target; labels of the positive and the other class)."""
    t = find_target(catalog, target)
    n = rows.count()
    if conf.folds >= n:
        raise ValueError(f"{conf.folds} folds need more than {n} rows")
    features = [Feature(r["fid"], f"f_{r['fid']}", r["kind"], cardinality=r["cardinality"]) for r in catalog.orderBy("fid").collect() if r["fid"] != t["fid"]]
    if not features:
        raise ValueError("there is no feature besides the target")
    code = f"f_{t['fid']}"
    if conf.loss == "square":
        obs, labels = rows.withColumn("y", targets.regression_target(F.col(code), t["kind"], t["breakpoints"] or [])), (None, None)
    else:
        known = [str(int(v)) if t["is_int"] else repr(v) for v in t["breakpoints"]] if t["kind"] == "ord" else t["categories"]
        if len(known) != 2:
            raise ValueError(f"{target} must have two values")
        # numbers: the larger one; names: the rarer one, which has the larger code, but a named one before missing values
        positive = 1 if t["kind"] == "ord" or known[1] is not None else 0
        obs = rows.withColumn("y", F.when(F.col(code) == positive, 1.0).otherwise(-1.0))
        labels = (known[positive], known[1 - positive])
    obs = targets.even_folds(obs.withColumnRenamed(row_id, "row_id"), "row_id", conf.folds)
    return obs.select("row_id", "y", "fold", *[f.column for f in features]), features, *labels


def train(df: DataFrame, columns: list[str], row_id: str, target: str, conf: Config, positive: tuple[str, ...] = (), negative: tuple[str, ...] = (), width: int = 8) -> tuple[Model, list[Fit]]:
    """A model of target by the other columns, in terms of their values. positive and negative name columns with a monotone effect."""
    catalog, rows = store.build(df, columns, row_id, width)
    obs, features, yes, no = observations(df, catalog, rows, row_id, target, conf)
    known = {r["fid"]: r for r in catalog.collect()}
    names = {i: r["name"] for i, r in known.items()}
    code_of = {n: f"f_{i}" for i, n in names.items()}
    features = constrained(features, {code_of.get(c, c) for c in positive}, {code_of.get(c, c) for c in negative})
    trees, fits = learn(obs, features, conf)
    points = {i: r["breakpoints"] for i, r in known.items() if r["kind"] == "ord"}
    categories = {r["name"]: r["categories"] for r in known.values() if r["kind"] == "cat" and r["name"] != names[find_target(catalog, target)["fid"]]}
    return Model([t.in_values(points, names) for t in trees], yes, no, categories), fits
