"""Row sets as boolean columns, their packed form, and include / exclude programs over columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that one literal of a compressed row set covers.
BLOCK = 7


def from_indexes(df: DataFrame, row_id: str, indexes: DataFrame, out: str) -> DataFrame:
    """df with out = whether row_id is in the one column of indexes."""
    i = indexes.select(F.col(indexes.columns[0]).alias("_i")).distinct().withColumn("_in", F.lit(True))
    return df.join(i, F.col(row_id) == F.col("_i"), "left").withColumn(out, F.coalesce("_in", F.lit(False))).drop("_i", "_in")


def from_list(df: DataFrame, row_id: str, indexes: list[int], out: str) -> DataFrame:
    """df with out = whether row_id is in a list, which must ascend strictly."""
    if any(a >= b for a, b in zip(indexes, indexes[1:], strict=False)):
        raise ValueError("indexes must ascend")
    rows = df.sparkSession.createDataFrame([(i,) for i in indexes], "i long")
    return from_indexes(df, row_id, rows, out)


def combine(a: Column, b: Column, op: str) -> Column:
    return {"and": a & b, "or": a | b, "xor": a != b, "and_not": a & ~b}[op]


def same_length(a: DataFrame, b: DataFrame) -> None:
    if a.count() != b.count():
        raise ValueError("row sets differ in length")


def work(df: DataFrame, row_id: str, flag: str) -> DataFrame:
    """length, n_true, uniform_runs, literals: what the set costs in blocks of BLOCK rows, all equal or mixed; adjacent uniform blocks of one value are one run."""
    from timberline.operators.profile import runs

    blocks = df.groupBy(F.floor(F.col(row_id) / BLOCK).alias("b")).agg(F.count("*").alias("n"), F.count_if(F.col(flag)).alias("t"))
    kind = F.when(F.col("t") == 0, "0").when(F.col("t") == F.col("n"), "1").otherwise("m")
    blocks = blocks.withColumn("k", kind)
    r = runs(blocks, "b", "k").agg(F.count_if(F.col("value") != "m").alias("uniform_runs"))
    return blocks.agg(F.sum("n").alias("length"), F.sum("t").alias("n_true"), F.count_if(F.col("k") == "m").alias("literals")).join(F.broadcast(r))


def packed(df: DataFrame, row_id: str, flag: str) -> DataFrame:
    """bucket, bits: Spark's bitmaps of the true rows, which merge with bitmap_or_agg."""
    return df.where(flag).groupBy(F.bitmap_bucket_number(row_id).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(row_id)).alias("bits"))


def select_columns(columns: list[str], program: list[str], start: str = "none") -> list[str]:
    """Columns that a program leaves included: start from "all" or "none"; "i re" includes and "x re" excludes what matches (anywhere in the name), in order."""
    if start not in ("all", "none"):
        raise ValueError(f"unknown start {start}")
    inside = set(columns) if start == "all" else set()
    for step in program:
        what, _, pattern = step.partition(" ")
        hit = {c for c in columns if re.search(pattern, c)}
        if what == "i":
            inside |= hit
        elif what == "x":
            inside -= hit
        else:
            raise ValueError(f"unknown step {step}")
    return [c for c in columns if c in inside]


def catalog(df: DataFrame) -> DataFrame:
    """fid, name, type of a table's columns."""
    return df.sparkSession.createDataFrame([(i, n, t) for i, (n, t) in enumerate(df.dtypes)], "fid int, name string, type string")


def find_features(cat: DataFrame, descriptors: list[str]) -> DataFrame:
    """Catalogue rows for "id:n" and "name:x" (or bare names), each descriptor with all its matches; unknown ones raise."""
    from timberline.functions.scalar import descriptor_kind, descriptor_value

    d = cat.sparkSession.createDataFrame([(x,) for x in descriptors], "descriptor string")
    d = d.select("descriptor", descriptor_kind(F.col("descriptor")).alias("k"), descriptor_value(F.col("descriptor")).alias("v"))
    out = d.join(cat, ((F.col("k") == "id") & (F.col("fid").cast("string") == F.col("v"))) | ((F.col("k") == "name") & (F.col("name") == F.col("v"))))
    lost = set(descriptors) - {r["descriptor"] for r in out.select("descriptor").distinct().collect()}
    if lost:
        raise ValueError(f"no feature: {', '.join(sorted(lost))}")
    return out.select("descriptor", "fid", "name", "type")


def exclude_features(cat: DataFrame, pattern: str) -> DataFrame:
    """Catalogue without the names that match; unnamed features stay."""
    return cat.where(F.col("name").isNull() | ~F.col("name").rlike(pattern))


class FeatureSet:
    """Included and excluded feature ids; features move between both by name, id or pattern. A feature may be put to sleep
    without leaving its side; only included ones that are awake are active."""

    def __init__(self, names: dict[int, str | None], included: bool = True):
        self.names, self.included, self.asleep = names, set(names) if included else set(), set()

    def activate(self, what) -> FeatureSet:
        self.asleep -= self._match(what)
        return self

    def deactivate(self, what) -> FeatureSet:
        self.asleep |= self._match(what)
        return self

    def deactivate_if(self, test: Callable[[int, str | None], bool]) -> FeatureSet:
        self.asleep |= {i for i, n in self.names.items() if test(i, n)}
        return self

    def active(self) -> set[int]:
        return self.included - self.asleep

    def _match(self, what) -> set[int]:
        if what == "any":
            return set(self.names)
        if isinstance(what, int):
            return {what} & set(self.names)
        if isinstance(what, re.Pattern):
            return {i for i, n in self.names.items() if n is not None and what.search(n)}
        return {i for i, n in self.names.items() if n == what}

    def include(self, what) -> FeatureSet:
        self.included |= self._match(what)
        return self

    def exclude(self, what) -> FeatureSet:
        self.included -= self._match(what)
        return self

    def counts(self) -> tuple[int, int]:
        return len(self.included), len(self.names) - len(self.included)
