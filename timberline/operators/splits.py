"""Split search: statistics by (node, feature, rank), cumulative sums in rank order, and the best split of every node of a level in one job."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.losses import Logistic, Square, side
from timberline.functions.scalar import named


@dataclass(frozen=True)
class Feature:
    """A rank-encoded column: ordinal (monotone: +1, -1 or 0) or categorical."""

    fid: int
    column: str
    kind: str = "ord"
    monotone: int = 0
    cardinality: int | None = None

    def __post_init__(self):
        if self.kind == "cat" and self.monotone:
            raise ValueError(f"{self.column}: a categorical feature cannot be monotone")


@dataclass(frozen=True)
class Search:
    loss: Logistic | Square
    features: list[Feature] = field(default_factory=list)
    max_gamma: float | None = None
    digits: int = 6


def constrained(features: list[Feature], positive: set[str], negative: set[str]) -> list[Feature]:
    """features with the constraints of two sets of column names, which must not meet; names of no feature raise."""
    if both := positive & negative:
        raise ValueError(f"monotone both ways: {', '.join(sorted(both))}")
    if lost := (positive | negative) - {f.column for f in features}:
        raise ValueError(f"no feature: {', '.join(sorted(lost))}")
    return [replace(f, monotone=1 if f.column in positive else -1 if f.column in negative else f.monotone) for f in features]


def long_form(obs: DataFrame, features: list[Feature], *keep: str) -> DataFrame:
    """keep, fid, x: one row for each feature of each row (unpivot)."""
    cells = F.explode(F.array(*[F.struct(F.lit(f.fid).alias("fid"), named(f.column).cast("double").alias("x")) for f in features]))
    return obs.select(*keep, cells.alias("c")).select(*keep, "c.fid", "c.x")


def stats(obs: DataFrame, features: list[Feature]) -> DataFrame:
    """node, fid, x, n, z, w, l: sums of the terms in obs (node, z, w, l) by rank. Partial sums leave a task with at most nodes x features x ranks rows."""
    return long_form(obs, features, "node", "z", "w", "l").groupBy("node", "fid", "x").agg(F.count("*").alias("n"), F.sum("z").alias("z"), F.sum("w").alias("w"), F.sum("l").alias("l"))


def ordered(st: DataFrame, features: list[Feature]) -> DataFrame:
    """Adds the sort key of scanning: the rank, or the mean response of a category (ties by code)."""
    cats = [f.fid for f in features if f.kind == "cat"]
    key = F.col("x") if not cats else F.when(F.col("fid").isin(cats), F.round(F.col("z") / F.col("n"), 12)).otherwise(F.col("x"))
    return st.withColumn("k", key)


def cumulative(st: DataFrame) -> DataFrame:
    """Adds sums at and before each position (l*) and after it (r*), and the position, inside (node, fid)."""
    part = Window.partitionBy("node", "fid")
    upto = part.orderBy("k", "x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    order = F.row_number().over(part.orderBy("k", "x")) - 1
    out = st.select("*", order.alias("pos"), *[F.sum(c).over(upto).alias(f"l{c}") for c in "nzwl"], *[F.sum(c).over(part).alias(f"t{c}") for c in "nzwl"])
    return out.select("*", *[(F.col(f"t{c}") - F.col(f"l{c}")).alias(f"r{c}") for c in "nzwl"])


def candidates(cum: DataFrame, s: Search) -> DataFrame:
    """Splits with both sides filled that obey monotonicity: node, fid, pos, x, left_n, right_n, gl, gr, loss."""
    c = F.col
    fine = s.loss.fine(c("ln"), c("lw")) & s.loss.fine(c("rn"), c("rw"))
    gl, ll = side(s.loss, c("ln"), c("lz"), c("lw"), c("ll"), s.max_gamma)
    gr, rl = side(s.loss, c("rn"), c("rz"), c("rw"), c("rl"), s.max_gamma)
    out = cum.where(fine).withColumns({"gl": gl, "gr": gr, "left_loss": ll, "right_loss": rl}).withColumn("loss", F.round(c("left_loss") + c("right_loss"), s.digits))
    up, down = [f.fid for f in s.features if f.monotone > 0], [f.fid for f in s.features if f.monotone < 0]
    if up:
        out = out.where(~c("fid").isin(up) | (c("gr") > c("gl")))
    if down:
        out = out.where(~c("fid").isin(down) | (c("gr") < c("gl")))
    return out.where(~F.isnan("loss")).select("node", "fid", "pos", "x", c("ln").alias("left_n"), c("rn").alias("right_n"), "gl", "gr", "left_loss", "right_loss", "loss")


def best_in_feature(found: DataFrame) -> DataFrame:
    """The first position of least loss of every (node, fid)."""
    w = Window.partitionBy("node", "fid").orderBy("loss", "pos")
    return found.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def best_of_node(found: DataFrame) -> DataFrame:
    """The split of least loss of every node; ties go to the larger feature id, then to the first position."""
    w = Window.partitionBy("node").orderBy("loss", F.desc("fid"), "pos")
    return found.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def level_best_splits(obs: DataFrame, s: Search) -> DataFrame:
    """Best split of every node in obs (node, z, w, l and the features' columns), with the codes that go left for a categorical one."""
    cum = cumulative(ordered(stats(obs, s.features), s.features))
    best = best_of_node(best_in_feature(candidates(cum, s)))
    cats = [f.fid for f in s.features if f.kind == "cat"]
    if not cats:
        return best.withColumn("right_codes", F.lit(None).cast("array<int>"))
    # codes not seen in the node go left, so the right side is what is listed
    right = cum.where(F.col("fid").isin(cats)).select("node", "fid", F.col("pos").alias("p"), F.col("x").cast("int").alias("code"))
    listed = best.join(right, ["node", "fid"], "left").where("p is null or p > pos").groupBy("node").agg(F.sort_array(F.collect_list("code")).alias("right_codes"))
    return best.join(listed, "node", "left")


def goes_right(kind: str, column: Column, x: float, right_codes: list[int] | None) -> Column:
    return column > F.lit(x) if kind == "ord" else column.isin(*(right_codes or []))
