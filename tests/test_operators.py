from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timberline.functions.losses import LOSSES
from timberline.operators import metrics, profile, rowsets, targets
from timberline.operators.boost import Config, Smoother, learn, learn_fold
from timberline.operators.ranges import ranked, running
from timberline.operators.splits import Feature, Search, best_in_feature, candidates, cumulative, level_best_splits, ordered, stats
from timberline.operators.tree import Node, Tree, grow
from timberline.plans.learning import circle, with_terms
from timberline.plans.training import train


def test_merged_bins_and_ranks():
    bins = profile.merged_bins(np.arange(1, 7), np.array([5, 1, 1, 4, 1, 3]), 3)
    assert bins == [(1, 1, 5), (2, 4, 6), (5, 6, 4)]
    assert profile.bin_breakpoints(bins) == [1, 2, 5, 6]
    assert len(profile.merged_bins(np.arange(1000), np.ones(1000), 255)) == 255
    assert profile.merged_bins(np.array([2.0, 1.0]), np.array([1, 4]), 5) == [(1, 1, 4), (2, 2, 1)]


def plain_bins(values, counts, bins):
    """Merging as it is told: one list of bins, all pairs looked at each time."""
    rows = [[v, v, n] for v, n in sorted(zip(values, counts, strict=True))]
    now, rest = rows[max(len(rows) - bins, 0) :], rows[: max(len(rows) - bins, 0)]
    while rest:
        now.insert(0, rest.pop())
        k = min(range(len(now) - 1), key=lambda i: (now[i][2] + now[i + 1][2], i))
        now[k : k + 2] = [[now[k][0], now[k + 1][1], now[k][2] + now[k + 1][2]]]
    return [tuple(b) for b in now]


@pytest.mark.parametrize("most", [1, 2, 7, 255])
def test_merged_bins_against_a_plain_version(most):
    rng = np.random.default_rng(most)
    v, n = np.unique(rng.integers(0, 3000, 900)).astype(float), None
    n = rng.integers(1, 30, len(v))
    assert profile.merged_bins(v, n, most) == plain_bins(v.tolist(), n.tolist(), most)


def test_downsample_of_several_columns(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), None if a % 7 == 0 else float(a * b % 11)) for a, b in rng.integers(0, 400, (1500, 2))]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    got = {}
    for r in profile.downsample(df, ["a", "b", "c"], 4).collect():
        got.setdefault(r["fid"], []).append((r["left"], r["right"], r["n"]))
    for k in range(3):
        v, n = np.unique([r[k] for r in rows if r[k] is not None], return_counts=True)
        assert sorted(got[k]) == plain_bins(v.tolist(), n.tolist(), 15)


def test_places_in_ranges(spark):
    rng = np.random.default_rng(5)
    v = rng.permutation(5000)
    df = spark.createDataFrame([(int(x), int(x) % 3) for x in v], "v long, w long").repartition(7)
    assert all(r["v"] == r["at"] for r in ranked(df, [F.col("v")], "at").collect())
    total = np.cumsum([x % 3 for x in range(4999, -1, -1)])
    assert all(r["s"] == total[4999 - r["v"]] for r in running(df, [F.desc("v")], s=F.col("w")).collect())
    assert ranked(df.limit(0), [F.col("v")], "at").count() == 0


def test_many_breakpoints(spark):
    points = [float(k) for k in range(0, 600, 3)]
    df = spark.createDataFrame([(k / 2,) for k in range(-5, 1300)], "v double")
    got = profile.rank_encode(df, "v", points, "r").collect()
    assert all(r["r"] == min(sum(p < r["v"] for p in points), len(points) - 1) for r in got)


def test_ranks_of_breakpoints(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 4, 5, 6, 9)], "v double")
    assert [r["r"] for r in profile.rank_encode(df, "v", [1, 2, 5, 6], "r").collect()] == [0, 0, 1, 2, 2, 2, 3, 3]


def sparse(spark, pairs, length, span=None):
    df = spark.createDataFrame(pairs, "i long, v long")
    return sorted((r["start"], r["length"], r["value"]) for r in profile.sparse_runs(df, "i", "v", length, F.lit(0).cast("long"), span).collect())


def test_sparse_runs(spark):
    assert sparse(spark, [(2, 7), (3, 7), (4, 1), (8, 0)], 10) == [(0, 2, 0), (2, 2, 7), (4, 1, 1), (5, 5, 0)]
    assert sparse(spark, [], 4) == [(0, 4, 0)]
    assert sparse(spark, [], 0) == []
    assert sparse(spark, [(0, 5)], 1) == [(0, 1, 5)]
    for pairs, error in (([(3, 1), (3, 2)], "twice"), ([(5, 1)], "bounds"), ([(-1, 1)], "bounds"), ([(None, 1)], "bounds")):
        with pytest.raises(Exception, match=error):
            sparse(spark, pairs, 5)


@pytest.mark.parametrize("seed", range(4))
def test_sparse_runs_round_trip(spark, seed):
    rng = random.Random(seed)
    pairs = [(i, rng.randrange(3)) for i in range(200) if rng.random() < (0.05, 0.3, 0.7, 1.0)[seed]]
    dense = [0] * 200
    for i, v in pairs:
        dense[i] = v
    out = sparse(spark, rng.sample(pairs, len(pairs)), 200, span=16)
    assert [v for _, n, v in out for _ in range(n)] == dense
    assert all(a[2] != b[2] and a[0] + a[1] == b[0] for a, b in zip(out, out[1:], strict=False))


def test_runs_meet_over_ranges(spark):
    values = [random.Random(3).choice("ab") for _ in range(300)] + ["z"] * 90
    df = spark.createDataFrame(list(enumerate(values)), "i long, v string")
    r = profile.runs(df, "i", "v", span=32)
    assert [(x["i"], x["value"]) for x in profile.expand(r).orderBy("i").collect()] == list(enumerate(values))
    assert r.count() == 1 + sum(a != b for a, b in zip(values, values[1:], strict=False))


X, Y2 = [5, 1000, 21, 5, 1000, 5, 5], [1, 2, 6, 3, 9, 4, 3]
Y1 = [1, -1, 1, 1, -1, -1, 1]


def scanned(spark, y, loss):
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(X, y, strict=True)], "node int, x double, y double")
    s = Search(LOSSES[loss], [Feature(0, "x")])
    return candidates(cumulative(ordered(stats(with_terms(df, loss), s.features), s.features)), s)


def test_worked_example(spark):
    rows = {r["x"]: r for r in scanned(spark, Y1, "logistic").collect()}
    assert rows[5.0]["gl"] == pytest.approx(0.364583, abs=1e-6)
    assert rows[5.0]["left_loss"] == pytest.approx(2.265729, abs=1e-6)
    assert rows[21.0]["gr"] == pytest.approx(-1.166667, abs=1e-6)
    assert best_in_feature(scanned(spark, Y1, "logistic")).first()["x"] == 21.0
    assert best_in_feature(scanned(spark, Y2, "square")).first()["x"] == 5.0


def brute(rows, y, features, loss):
    """(loss, fid, x) of the best split, by trying all of them."""
    base = np.mean(y) if loss == "square" else 0.5 * np.log((y > 0).sum() / (y < 0).sum())
    z = y - base if loss == "square" else 2 * y / (1 + np.exp(2 * y * base))
    w = np.ones_like(y) if loss == "square" else np.abs(z) * (2 - np.abs(z))
    l0 = z**2 if loss == "square" else np.log(1 + np.exp(-2 * y * base))
    best = None
    for fid, (c, kind) in enumerate(features):
        v = rows[c].astype(float)
        key = {x: (z[v == x].mean() if kind == "cat" else x, x) for x in np.unique(v)}
        order = sorted(np.unique(v), key=lambda x: key[x])
        for i in range(1, len(order)):
            left = np.isin(v, order[:i])
            t = 0.0
            for m in (left, ~left):
                g = z[m].sum() / w[m].sum()
                t += l0[m].sum() - (g * z[m].sum() - 0.5 * g * g * w[m].sum()) * (1 if loss == "logistic" else 2)
            cand = (round(t, 6), -fid, i - 1)
            if best is None or cand < best[0]:
                best = (cand, fid, order[i - 1])
    return best


@pytest.mark.parametrize("loss", ["logistic", "square"])
def test_best_split_against_brute_force(spark, loss):
    rng = np.random.default_rng(11)
    n = 120
    rows = {"a": rng.integers(0, 6, n), "b": rng.integers(0, 4, n), "c": rng.integers(0, 5, n)}
    y = np.where(rng.random(n) < 0.3 + 0.1 * rows["c"], 1.0, -1.0) if loss == "logistic" else rng.normal(size=n) + (rows["c"] == 2)
    df = spark.createDataFrame([(1, int(a), int(b), int(c), float(t)) for a, b, c, t in zip(rows["a"], rows["b"], rows["c"], y, strict=True)], "node int, a int, b int, c int, y double")
    got = level_best_splits(with_terms(df, loss), Search(LOSSES[loss], [Feature(0, "a"), Feature(1, "b"), Feature(2, "c", "cat")])).first()
    (total, _, _), fid, x = brute(rows, y, [("a", "ord"), ("b", "ord"), ("c", "cat")], loss)
    assert (got["fid"], got["x"]) == (fid, x)
    assert got["loss"] == pytest.approx(total, abs=1e-4)


def test_monotone_and_clamp(spark):
    df = spark.createDataFrame([(1, float(i), float(-i)) for i in range(10)], "node int, x double, y double")
    obs = with_terms(df, "square")
    assert level_best_splits(obs, Search(LOSSES["square"], [Feature(0, "x", monotone=1)])).count() == 0
    assert level_best_splits(obs, Search(LOSSES["square"], [Feature(0, "x", monotone=-1)])).first()["x"] == 4.0
    r = level_best_splits(obs, Search(LOSSES["square"], [Feature(0, "x")], max_gamma=0.5)).first()
    assert (r["gl"], r["gr"]) == (0.5, -0.5)
    with pytest.raises(ValueError, match="monotone"):
        Feature(0, "x", "cat", 1)


def test_unseen_categories_go_left(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, -1.0), (1, 1, -1.0), (1, 0, 1.0)], "node int, c int, y double")
    tree = grow(with_terms(df, "square"), Search(LOSSES["square"], [Feature(0, "c", "cat")]), 2)
    out = spark.createDataFrame([(0,), (1,), (7,)], "c int").select("c", tree.column().alias("s")).collect()
    assert {r["c"]: r["s"] for r in out} == {1: -1.0, 0: 1.0, 7: -1.0}


def test_tree_text_equals_column(spark):
    t = Tree({1: Node(0, fid=0, column="x", split=2.5), 2: Node(-1.5), 3: Node(0, fid=1, column="c", kind="cat", split=0.0, right_codes=[1, 3]), 6: Node(0.25), 7: Node(2.0)})
    df = spark.createDataFrame([(float(i), i % 5) for i in range(10)], "x double, c int")
    assert df.where(F.expr(t.sql()) != t.column()).count() == 0
    assert t.feature_ids() == {0, 1}
    assert sorted(p[0] for p in t.paths()) == [2, 6, 7]


def test_boosting_learns_a_circle(spark):
    trees, fits = learn(circle(spark, 2000), [Feature(0, "x1"), Feature(1, "x2")], Config(max_depth=3, rate=0.5, max_trees=8, folds=2))
    f = sum((t.column() for t in trees[1:]), trees[0].column())
    got = metrics.auc(circle(spark, 2000), F.when(F.col("y") > 0, 1).otherwise(0), 1 / (1 + F.exp(-2 * f))).first()["auc"]
    assert got > 0.9
    assert {f.stopped for f in fits} <= {"max_trees", "converged", "no split", "no errors"}


def test_rate_is_cut_on_divergence(spark):
    rows = [(i, 10.0 if (i % 4 < 2) == (i % 2 == 0) else -10.0, i % 2, float(i % 4 < 2)) for i in range(400)]
    obs = spark.createDataFrame(rows, "row_id long, y double, fold int, x double")
    fit = learn_fold(obs, 0, [Feature(0, "x")], Config(loss="square", rate=1.0, max_trees=5, sample=False), 1.0)
    assert fit.rate == 0.25  # 400 and 225 are more than twice 100, 156.25 is not
    assert fit.stopped == "converged"


def xyz(spark, n=900, square=False):
    """Points in a square: whether they are in the circle and of no class B, or the height of a bell."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(n):
        x, y, p = round(rng.uniform(-2, 2), 5), round(rng.uniform(-2, 2), 5), "ABC"[rng.integers(3)]
        inside = x * x + y * y <= 1 and p != "B"
        rows.append((i, (3.0 if p == "B" else math.exp(-(x * x + y * y)) + rng.uniform(-0.05, 0.05)) if square else "NY"[inside != (rng.random() < 0.02)], float(x), float(y), None if square and p == "B" else p))
    return spark.createDataFrame(rows, f"id long, z {'double' if square else 'string'}, x double, y double, p string").repartition(4)


def test_learning_from_a_table(spark):
    df = xyz(spark)
    model, fits = train(df, ["z", "x", "y", "p"], "id", "name:z", Config(max_depth=4, rate=0.4, max_trees=12), width=5)
    assert (model.positive, model.negative) == ("Y", "N")
    assert set(model.columns()) <= {"x", "y", "p"}
    got = model.score(df)
    assert metrics.auc(got, F.when(F.col("z") == "Y", 1).otherwise(0), F.col("score")).first()["auc"] > 0.9
    row = df.first().asDict()
    assert model.score_one(row) == pytest.approx(model.score(df.where(F.col("id") == row["id"]), link="raw").first()["score"])


def test_regression_from_a_table(spark):
    df = xyz(spark, square=True)
    model, _ = train(df, ["z", "x", "y", "p"], "id", "z", Config(loss="square", max_depth=3, rate=0.4, max_trees=10), width=5)
    miss = model.score(df).agg(F.avg(F.pow(F.col("score") - F.col("z"), 2)).alias("m"), F.var_pop("z").alias("v")).first()
    assert miss["m"] < 0.2 * miss["v"]


def test_targets_are_looked_up(spark):
    df = xyz(spark, 40).withColumn("n", (F.col("id") % 2 + 3).cast("int"))
    columns = ["z", "x", "y", "p", "n"]
    for target, error in (("w", "no feature"), ("x", "two values"), ("p", "two values")):
        with pytest.raises(ValueError, match=error):
            train(df, columns, "id", target, Config(max_trees=2))
    with pytest.raises(ValueError, match="numeric target"):
        train(df, columns, "id", "p", Config(loss="square", max_trees=2))
    with pytest.raises(ValueError, match="folds"):
        train(df, columns, "id", "z", Config(folds=40, max_trees=2))
    with pytest.raises(ValueError, match="both ways"):
        train(df, columns, "id", "z", Config(max_trees=2), positive=("x",), negative=("x", "y"))
    model, _ = train(df, columns, "id", "n", Config(max_trees=2))
    assert (model.positive, model.negative) == ("4", "3")


def test_config_is_checked():
    for bad in ({"rate": 0}, {"folds": 1}, {"loss": "hinge"}, {"forget": 0}, {"max_trees": 0}, {"max_gamma": -1.0}, {"max_depth": 0}):
        with pytest.raises(ValueError, match="."):
            Config(**bad)


def test_smoother():
    s = Smoother(0.9)
    assert [s.add(y) for y in (0.1, 0.05, 0.02, 0.01)] == pytest.approx([0.1, 0.073684, 0.053875, 0.041117], abs=1e-6)


def test_auc_of_ties(spark):
    df = spark.createDataFrame(list(zip([0.9, 0.8, 0.8, 0.4, 0.3, 0.3], [1, 1, 0, 0, 1, 0], strict=True)), "p double, y int")
    assert metrics.auc(df, F.col("y"), F.col("p")).first()["auc"] == pytest.approx(0.666667, abs=1e-6)
    assert metrics.auc(df.where("y = 1"), F.col("y"), F.col("p")).first()["auc"] is None


def test_targets(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2, "v string")
    y, positive = targets.binary_target(df, "v")
    assert positive == "b"
    assert y.where("y > 0").count() == 2
    y, positive = targets.binary_target(spark.createDataFrame([("a",)] * 3 + [(None,)], "v string"), "v")
    assert positive == "a"
    with pytest.raises(ValueError, match="two values"):
        targets.binary_target(spark.createDataFrame([("a",), ("b",), ("c",)], "v string"), "v")
    y, positive = targets.binary_target(spark.createDataFrame([(7,)] * 3 + [(2,)], "v int"), "v")
    assert positive == "7" and y.where("y > 0").count() == 3
    y, positive = targets.binary_target(spark.createDataFrame([(-1.5,), (None,), (0.0,)], "v double"), "v")
    assert positive == "0.0" and y.where("y > 0").count() == 2
    with pytest.raises(ValueError, match="two values"):
        targets.binary_target(spark.createDataFrame([(1,), (2,), (3,)], "v int"), "v")
    with pytest.raises(ValueError, match="numeric target"):
        targets.regression_target(F.lit(0), "cat", [])
    with pytest.raises(ValueError, match="folds"):
        targets.rank_folds(F.lit(1), 2, 3)


def test_profile_kinds(spark):
    df = spark.createDataFrame([("1", "x", "k", "1"), ("2.5", "y", "k", "b"), ("3", "x", "k", "2")], "n string, c string, u string, m string")
    kinds = {r["name"]: r["kind"] for r in profile.column_profile(df, df.columns).collect()}
    assert kinds == {"n": "ord", "c": "cat", "u": "uniform", "m": "mixed"}
    with pytest.raises(ValueError, match="m"):
        profile.require_pure(profile.column_profile(df, df.columns))


def test_column_programs_and_sets():
    assert rowsets.select_columns(["a1", "b1", "a2"], ["x 1", "i b"], "all") == ["b1", "a2"]
    with pytest.raises(ValueError, match="step"):
        rowsets.select_columns(["a"], ["z a"])
    import re

    s = rowsets.FeatureSet({0: "age", 1: None, 2: "wage"}, included=False).include(re.compile("age")).exclude("wage").include(1)
    assert s.included == {0, 1}
    assert s.counts() == (2, 1)


def test_row_sets_of_bits(spark):
    rng = random.Random(5)
    bits = [(i, rng.random() < 0.3, rng.random() < 0.6) for i in range(500)]
    df = spark.createDataFrame(bits, "i long, a boolean, b boolean")
    for op, f in (("and", lambda a, b: a and b), ("or", lambda a, b: a or b), ("xor", lambda a, b: a != b), ("and_not", lambda a, b: a and not b)):
        got = {r["i"] for r in df.where(rowsets.combine(F.col("a"), F.col("b"), op)).collect()}
        assert got == {i for i, a, b in bits if f(a, b)}
    assert rowsets.packed(df, "i", "a").agg(F.sum(F.bitmap_count("bits"))).first()[0] == sum(a for _, a, _ in bits)
    with pytest.raises(ValueError, match="length"):
        rowsets.same_length(df, df.limit(3))


def test_sleeping_features():
    s = rowsets.FeatureSet({0: "a", 1: "b", 2: None}).deactivate("a").deactivate_if(lambda i, n: n is None)
    assert s.active() == {1} and s.included == {0, 1, 2}
    assert s.activate("any").exclude(1).active() == {0, 2}


def test_lists_of_rows_ascend(spark):
    df = spark.range(5)
    assert [r["bit"] for r in rowsets.from_list(df, "id", [1, 4], "bit").orderBy("id").collect()] == [False, True, False, False, True]
    with pytest.raises(ValueError, match="ascend"):
        rowsets.from_list(df, "id", [1, 1], "bit")
