"""Targets of learning: two classes as +1 and -1, thresholds, folds and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from timberline.operators.ranges import ranked

#: Knuth's multiplicative constant: an arithmetic hash that every SQL engine can compute.
MULTIPLIER, MODULUS = 2654435761, 4294967296


def row_hash(key: Column) -> Column:
    return F.pmod(F.pmod(key.cast("long"), F.lit(1 << 31)) * F.lit(MULTIPLIER), F.lit(MODULUS))


def binary_target(df: DataFrame, column: str) -> tuple[DataFrame, str]:
    """df with y = +1 or -1, and the positive label. Of two numbers (missing ones are 0) the larger is positive. Of two names the
    rarer is (the larger name on ties); with missing values, a named one is."""
    if isinstance(df.schema[column].dataType, NumericType):
        v = F.coalesce(F.col(column), F.lit(0))
        lo, hi = df.select(F.min(v), F.max(v)).first()
        if lo is None or lo == hi or not df.where((v != F.lit(lo)) & (v != F.lit(hi))).isEmpty():
            raise ValueError(f"{column} must have two values")
        return df.withColumn("y", F.when(v == F.lit(hi), 1.0).otherwise(-1.0)), str(hi)
    seen = sorted(((r["n"], r["v"]) for r in df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")).limit(3).collect()), key=lambda r: (-r[0], r[1] is None, r[1]))
    if len(seen) != 2:
        raise ValueError(f"{column} must have two values")
    positive = next((v for _, v in reversed(seen) if v is not None)) if any(v is None for _, v in seen) else seen[1][1]
    return df.withColumn("y", F.when(F.col(column) == F.lit(positive), 1.0).otherwise(-1.0)), str(positive)


def regression_target(rank: Column, kind: str, points: list[float]) -> Column:
    """The value of a ranked numeric column, which is its breakpoint; categories are no targets of a regression."""
    if kind != "ord":
        raise ValueError("a regression needs a numeric target")
    return F.get(F.array(*[F.lit(float(p)) for p in points]), rank)


def threshold_target(x: Column, at: float, inclusive_above: bool = True) -> Column:
    """+1 for x >= at (or x > at), else -1."""
    return F.when(x >= at if inclusive_above else x > at, 1.0).otherwise(-1.0)


def random_folds(df: DataFrame, key: str, k: int) -> DataFrame:
    """df with fold, from a hash of key: no row has to know of others, so fold sizes are equal only on average."""
    return df.withColumn("fold", F.pmod(F.floor(row_hash(F.col(key)) / 65536), F.lit(k)).cast("int"))


def even_folds(df: DataFrame, key: str, k: int) -> DataFrame:
    """df with fold; sizes differ by one at most."""
    return ranked(df, [row_hash(F.col(key)), F.col(key)], "_at").withColumn("fold", F.pmod("_at", F.lit(k)).cast("int")).drop("_at")


def rank_folds(rank: Column, cardinality: int, k: int) -> Column:
    """Fold of an ordinal fold feature: rank / (cardinality / k); the remainder's ranks get folds >= k and are always learned from."""
    if cardinality < k:
        raise ValueError("fewer distinct values than folds")
    return F.floor(rank / F.lit(cardinality // k)).cast("int")


def code_folds(code: Column, cardinality: int, k: int) -> Column:
    if cardinality < k:
        raise ValueError("fewer categories than folds")
    return F.pmod(code, F.lit(k)).cast("int")


def half(key: Column, seed: int) -> Column:
    """Whether a row is in this tree's half of the rows."""
    return F.pmod(F.floor(row_hash(key + F.lit(seed * 7919)) / 65536), F.lit(2)) == 0
