"""Positions and running sums over a whole table without one task for it: rows are cut into ranges, sums of ranges are added up first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.plans.durable import durable


def running(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """df with one more column for each of sums: its sum over all rows up to this one, in order. Rows that tie in order go to
    one range; which of them comes first is left open unless order says so."""
    t = df.withColumns({f"_v_{k}": v for k, v in sums.items()}).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    t = durable(t, "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = t.groupBy("_part").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = t.join(F.broadcast(totals), "_part").withColumns({k: F.col(f"_o_{k}") + F.sum(f"_v_{k}").over(inside) for k in sums})
    return out.select(*df.columns, *sums)


def ranked(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """df with the place of each row in order, from 0."""
    return running(df, order, _rank=F.lit(1)).withColumn(out, (F.col("_rank") - 1).cast("long")).drop("_rank")
