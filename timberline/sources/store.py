"""Columnar store of a rank-encoded data set: a catalogue and the encoded rows, both Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.scalar import named
from timberline.operators.profile import bin_breakpoints, column_profile, dictionary, downsample, encode, rank_encode, require_pure
from timberline.plans.durable import small

CATALOG = "fid int, name string, kind string, cardinality int, is_int boolean, breakpoints array<double>, categories array<string>"


def build(df: DataFrame, columns: list[str], row_id: str, width: int = 8) -> tuple[DataFrame, DataFrame]:
    """(catalogue, rows with row_id and f_<fid>): mixed columns raise, uniform ones go, numeric ones are ranked (down-sampled
    beyond 2**width - 1 values; missing is 0), others coded by frequency. The catalogue, with at most 2**width breakpoints of
    a numeric column and all names of a categorical one, comes to the driver."""
    profile = column_profile(df, columns)
    require_pure(profile)
    kept = sorted(profile.where("kind <> 'uniform'").collect(), key=lambda r: r["fid"])
    numeric = [p["name"] for p in kept if p["kind"] != "cat"]
    bins: dict[str, list] = {n: [] for n in numeric}
    if numeric:
        for r in downsample(df.select(*[F.coalesce(named(n).cast("double"), F.lit(0.0)).alias(n) for n in numeric]), numeric, width).collect():
            bins[numeric[r["fid"]]].append((r["left"], r["right"], r["n"]))
    rows, out = [], df
    for p in kept:
        f = f"f_{p['fid']}"
        if p["kind"] == "cat":
            codes = dictionary(df, p["name"])
            names = [r["v"] for r in codes.orderBy("code").collect()]
            out = encode(out, p["name"], small(codes), f)
            rows.append((p["fid"], p["name"], "cat", len(names), False, None, names))
        else:
            points = bin_breakpoints(sorted(bins[p["name"]]))
            out = rank_encode(out, p["name"], points, f)
            rows.append((p["fid"], p["name"], "ord", len(points), p["n_float"] == 0, [float(x) for x in points], None))
    catalog = df.sparkSession.createDataFrame(rows, CATALOG)
    return catalog, out.select(row_id, *[f"f_{r[0]}" for r in rows])


def write(catalog: DataFrame, rows: DataFrame, path: str) -> None:
    catalog.coalesce(1).write.mode("overwrite").parquet(f"{path}/catalog")
    rows.write.mode("overwrite").parquet(f"{path}/rows")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(CATALOG).parquet(f"{path}/catalog"), spark.read.parquet(f"{path}/rows")


def decode(catalog: DataFrame, rows: DataFrame, row_id: str, name: str) -> DataFrame:
    """row_id, code, value of one feature, as text."""
    c = catalog.where(F.col("name") == name).first()
    if c is None:
        raise ValueError(f"no feature {name}")
    known = [F.lit(str(int(v)) if c["is_int"] else repr(v)) for v in c["breakpoints"]] if c["kind"] == "ord" else [F.lit(v) for v in c["categories"]]
    return rows.select(row_id, F.col(f"f_{c['fid']}").alias("code"), F.get(F.array(*known), F.col(f"f_{c['fid']}")).alias("value"))


def describe(catalog: DataFrame) -> DataFrame:
    """line: one JSON text a feature."""
    return catalog.select(F.to_json(F.struct(*catalog.columns)).alias("line"))


def brief(catalog: DataFrame) -> DataFrame:
    """line: fid, name, kind and cardinality with commas between."""
    return catalog.select(F.concat_ws(",", F.col("fid").cast("string"), "name", "kind", F.col("cardinality").cast("string")).alias("line"))
