"""Column profiles and encodings: kinds, cardinality, breakpoints, dictionaries, runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.scalar import cell_kind
from timberline.operators.ranges import ranked

#: Breakpoints between two that are compared first.
STEP = 16
#: Positions of a range in which runs are found by one task.
SPAN = 100_000


def cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """fid, name, value (string): the table in long form; fid is the column's position in columns."""
    parts = F.array(*[F.struct(F.lit(i).alias("fid"), F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)])
    return df.select(F.explode(parts).alias("c")).select("c.*")


def histogram(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """fid, name, n_int, n_float, n_string, n_empty, cardinality, kind. Values are counted once, so kinds are found on distinct values."""
    values = cells(df, columns).groupBy("fid", "name", "value").agg(F.count("*").alias("n")).withColumn("k", cell_kind(F.col("value")))
    n = lambda k: F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).cast("long").alias(f"n_{k}")
    out = values.groupBy("fid", "name").agg(n("int"), n("float"), n("string"), n("empty"), F.count(F.when(F.col("k") != "empty", 1)).alias("cardinality"))
    kind = F.when((F.col("n_string") > 0) & (F.col("n_int") + F.col("n_float") > 0), "mixed").when(F.col("cardinality") < 2, "uniform").when(F.col("n_string") > 0, "cat").otherwise("ord")
    return out.withColumn("kind", kind)


def require_pure(profile: DataFrame) -> None:
    """Raises on columns that mix strings and numbers."""
    bad = [r["name"] for r in profile.where("kind = 'mixed'").select("name").collect()]
    if bad:
        raise ValueError(f"columns mix strings and numbers: {', '.join(sorted(bad))}")


def samples(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    return df.select(column).distinct().orderBy(column).limit(n)


def breakpoints(df: DataFrame, column: str) -> DataFrame:
    """v, rank: distinct values in order, from 0."""
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null").distinct()
    return ranked(values, [F.col("v")], "rank").withColumn("rank", F.col("rank").cast("int"))


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """v, n, code: categories by falling frequency, ties by name; missing values have one place of their own (v is null)."""
    counts = df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    return ranked(counts, [F.desc("n"), F.asc_nulls_last("v")], "code").withColumn("code", F.col("code").cast("int"))


def encode(df: DataFrame, column: str, codes: DataFrame, out: str) -> DataFrame:
    """df with the code of column; nulls match the null entry."""
    c = codes.select(F.col("v").alias("_v"), F.col("code").alias(out))
    return df.join(c, F.col(column).eqNullSafe(F.col("_v")), "left").drop("_v")


def rank_encode(df: DataFrame, column: str, points: list[float], out: str) -> DataFrame:
    """df with the rank of column among breakpoints (a short list, ascending); missing values are 0. Every STEP-th point is
    compared first, then the points between two of these."""
    v = F.coalesce(F.col(column).cast("double"), F.lit(0.0))
    below = lambda some: F.size(F.filter(some, lambda b: b < v))
    every, coarse = F.array(*[F.lit(float(p)) for p in points]), [F.lit(float(p)) for p in points[STEP - 1 :: STEP]]
    df = df.withColumn("_at", below(F.array(*coarse)) * STEP if coarse else F.lit(0))
    return df.withColumn(out, F.least(F.col("_at") + below(F.slice(every, F.col("_at") + 1, STEP)), F.lit(len(points) - 1))).drop("_at")


def merged_bins(values: np.ndarray, counts: np.ndarray, bins: int) -> list[tuple[float, float, int]]:
    """Bins [left, right, count] of a histogram: the largest `bins` values start as bins of their own; the others come in
    falling order, and each time the adjacent pair with the smallest joint count (the lowest such pair) becomes one."""
    order = np.argsort(values)[::-1]
    b = Bins(bins)
    b.add(np.asarray(values, float)[order].tolist(), np.asarray(counts, np.int64)[order].tolist())
    return b.rows()


class Bins:
    """The state of merging: at most `most` bins, whatever comes; values must fall."""

    def __init__(self, most: int):
        self.most, self.left, self.right, self.size, self.pairs = most, [], [], [], []

    def add(self, values: list[float], counts: list[int]) -> None:
        left, right, size, pairs = self.left, self.right, self.size, self.pairs
        for v, n in zip(values, counts, strict=True):
            if size:
                pairs.insert(0, n + size[0])
            left.insert(0, v)
            right.insert(0, v)
            size.insert(0, n)
            if len(size) > self.most:
                k = pairs.index(min(pairs))
                right[k] = right.pop(k + 1)
                size[k] += size.pop(k + 1)
                del left[k + 1], pairs[k]
                if k < len(pairs):
                    pairs[k] = size[k] + size[k + 1]
                if k:
                    pairs[k - 1] = size[k - 1] + size[k]

    def rows(self) -> list[tuple[float, float, int]]:
        return list(zip(self.left, self.right, self.size, strict=True))


def bin_breakpoints(bins: list[tuple[float, float, int]]) -> list[float]:
    return sorted({b[0] for b in bins} | {bins[-1][1]}) if bins else []


def downsample(df: DataFrame, columns: list[str], width: int = 8) -> DataFrame:
    """fid, left, right, n: at most 2**width - 1 bins of every numeric column. Greedy merging depends on order, so each
    feature's histogram (distinct values, not rows) goes to one task, which reads it in falling order and holds the bins only."""
    h = cells(df, columns).select("fid", F.col("value").cast("double").alias("v")).where("v is not null").groupBy("fid", "v").agg(F.count("*").alias("n"))

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fid, state = None, None
        out = lambda: pd.DataFrame([(fid, *r) for r in state.rows()], columns=["fid", "left", "right", "n"])
        for b in batches:
            for f, p in b.groupby("fid", sort=True):
                if f != fid:
                    if state:
                        yield out()
                    fid, state = f, Bins(2**width - 1)
                state.add(p["v"].tolist(), p["n"].tolist())
        if state:
            yield out()

    return h.repartition("fid").sortWithinPartitions("fid", F.desc("v")).mapInPandas(bins, "fid int, left double, right double, n long")


def runs(df: DataFrame, order: str, value: str, span: int | None = None) -> DataFrame:
    """start, length, value of maximal runs of equal neighbours, numbered order without gaps.

    The order column is cut into ranges of `span`; runs are found inside them and joined where they meet, so no task
    holds the whole column.
    """
    return merged(df.select(F.col(order).cast("long").alias("start"), F.lit(1).cast("long").alias("length"), F.col(value).alias("value")), span)


def merged(pieces: DataFrame, span: int | None = None) -> DataFrame:
    """start, length, value of the maximal runs of pieces (start, length, value) that lie end to end."""
    rows = pieces.withColumn("_p", F.floor(F.col("start") / (span or SPAN)))
    w = Window.partitionBy("_p").orderBy("start")
    marked = rows.withColumn("_b", F.when(F.lag("start").over(w).isNull() | ~F.col("value").eqNullSafe(F.lag("value").over(w)), 1).otherwise(0)).withColumn("_g", F.sum("_b").over(w))
    part = marked.groupBy("_p", "_g").agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.max("value").alias("value"))
    part = part.withColumn("_last", F.col("_g") == F.max("_g").over(Window.partitionBy("_p"))).withColumn("_edge", F.col("_last") | (F.col("_g") == 1))
    # only the first and the last run of a range, two rows a range, can go on in another range
    o = Window.orderBy("start")
    goes_on = F.lag("_last").over(o) & (F.col("_g") == 1) & F.col("value").eqNullSafe(F.lag("value").over(o))
    joined = part.where("_edge").withColumn("_n", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("_k", F.sum("_n").over(o))
    joined = joined.groupBy("_k").agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.max("value").alias("value")).drop("_k")
    return joined.unionByName(part.where("not _edge").select("start", "length", "value"))


def expand(run_table: DataFrame) -> DataFrame:
    """i, value of every position of runs."""
    return run_table.select(F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("i"), "value")


def sparse_runs(pairs: DataFrame, index: str, value: str, length: int, default: Column, span: int | None = None) -> DataFrame:
    """start, length, value of the runs of a vector of `length` places: value at the places of pairs, default elsewhere. A
    place that is out of bounds or comes twice raises when the rows are made."""
    i = F.col(index).cast("long")
    inside = F.when((i >= 0) & (i < length), i).otherwise(F.raise_error(F.concat(F.lit("index out of bounds: "), F.coalesce(i.cast("string"), F.lit("null")))).cast("long"))
    rows = pairs.select(inside.alias("i"), F.col(value).alias("v")).withColumn("_p", F.floor(F.col("i") / (span or SPAN)))
    # the next place: in the same range, or the first one of the next range that has any (one row a range)
    firsts = rows.groupBy("_p").agg(F.min("i").alias("_first"))
    firsts = firsts.select("_p", F.coalesce(F.lead("_first").over(Window.orderBy("_p")), F.lit(length)).alias("_beyond"))
    after = F.lead("i").over(Window.partitionBy("_p").orderBy("i"))
    rows = rows.withColumn("_next", F.when(after == F.col("i"), F.raise_error(F.concat(F.lit("index comes twice: "), F.col("i").cast("string"))).cast("long")).otherwise(after))
    rows = rows.join(firsts, "_p").withColumn("_next", F.coalesce("_next", "_beyond"))
    piece = lambda start, n, v: F.struct(start.cast("long").alias("start"), n.cast("long").alias("length"), v.alias("value"))
    own, gap = piece(F.col("i"), F.lit(1), F.col("v")), piece(F.col("i") + 1, F.col("_next") - F.col("i") - 1, default)
    pieces = rows.select(F.explode(F.array(own, gap)).alias("p")).select("p.*")
    head = rows.agg(F.coalesce(F.min("i"), F.lit(length)).alias("n")).select(piece(F.lit(0), F.col("n"), default).alias("p")).select("p.*")
    return merged(pieces.unionByName(head).where("length > 0"), span)
