"""Measures of predictions and of learning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.losses import LOSSES
from timberline.functions.scalar import binary_log_loss, trapezoid
from timberline.operators.ranges import running


def fold_table(state: DataFrame, fold: int, loss: str) -> DataFrame:
    """working, n, mean_loss and for two classes the shares tt, tf, ft, ff (truth, call), on both sides of a fold."""
    t = LOSSES[loss].terms(F.col("y"), F.col("f"))
    aggs = [F.count("*").alias("n"), F.avg(t["l"]).alias("mean_loss")]
    if loss == "logistic":
        for a, truth in (("t", F.col("y") > 0), ("f", F.col("y") <= 0)):
            for b, call in (("t", F.col("f") >= 0), ("f", F.col("f") < 0)):
                aggs.append(F.avg(F.when(truth & call, 1.0).otherwise(0.0)).alias(a + b))
    return state.groupBy((F.col("fold") != fold).alias("working")).agg(*aggs)


def fold_metrics(state: DataFrame, fold: int, loss: str) -> dict:
    rows = {r["working"]: r.asDict() for r in fold_table(state, fold, loss).collect()}
    if True not in rows or False not in rows:
        raise ValueError("a side of the fold is empty")
    out = {"work_loss": rows[True]["mean_loss"], "val_loss": rows[False]["mean_loss"]}
    if loss == "logistic":
        out["val_wrong"] = rows[False]["tf"] + rows[False]["ft"]
    return out


def confusion(df: DataFrame, y: Column, p: Column) -> DataFrame:
    """y, call, n, share: counts of truth and call (p >= 0.5) with all margins (null: any)."""
    c = df.select(y.cast("int").alias("y"), F.when(p >= 0.5, 1).otherwise(0).alias("call")).cube("y", "call").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.max("n").over(Window.partitionBy()))


def auc(df: DataFrame, y: Column, p: Column) -> DataFrame:
    """auc: area under the ROC curve, tied scores as one trapezoid. Distinct scores, not rows, are ordered, in ranges."""
    g = df.groupBy(p.alias("p")).agg(F.sum(F.when(y == 1, 1.0).otherwise(0.0)).alias("tp"), F.sum(F.when(y == 0, 1.0).otherwise(0.0)).alias("fp"))
    w = running(g, [F.desc("p")], ctp=F.col("tp"))
    area = F.sum(trapezoid(F.lit(0.0), F.col("ctp") - F.col("tp"), F.col("fp"), F.col("ctp")))
    return w.agg(F.try_divide(area, F.sum("tp") * F.sum("fp")).alias("auc"))


def log_loss(df: DataFrame, y: Column, p: Column) -> DataFrame:
    return df.agg(F.avg(binary_log_loss(p, y == 1)).alias("log_loss"), F.count("*").alias("n"))


def importance(paths: DataFrame) -> DataFrame:
    """fid, unsigned_, positive, negative: each leaf adds |gamma| / (features on its path) to every feature there, repeats
    counted; each column is scaled to sum 1 (null if nothing adds). paths has leaf, gamma, fids (array)."""
    x = paths.where(F.size("fids") > 0).select("gamma", F.size("fids").alias("k"), F.explode("fids").alias("fid"))
    v = F.abs("gamma") / F.col("k")
    s = x.groupBy("fid").agg(F.sum(v).alias("u"), F.sum(F.when(F.col("gamma") > 0, v).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("gamma") < 0, v).otherwise(0.0)).alias("m"))
    every = Window.partitionBy()
    share = lambda c: F.try_divide(F.col(c), F.sum(c).over(every))
    return s.select("fid", share("u").alias("unsigned_"), share("p").alias("positive"), share("m").alias("negative"))


def ewma(df: DataFrame, order: str, value: str, forget: float) -> DataFrame:
    """order, smoothed: exponentially forgetting mean along a short series."""
    w = Window.orderBy(order)
    t = df.select(order, value, (F.row_number().over(w) - 1).alias("t"))
    k = F.pow(F.lit(forget), -F.col("t"))
    return t.select(order, (F.sum(F.col(value) * k).over(w) / F.sum(k).over(w)).alias("smoothed"))
