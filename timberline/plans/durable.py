"""Cutting lineage with tables in the folder that driver and executors share, and broadcasts of a checked size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that may be broadcast; larger tables go through a shuffled join.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: Settings of durable writes: shuffle files go when a write is done, Python gets batches of bounded size.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own if everything runs in one process, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="timberline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system of path, path as an object of it)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def results(spark: SparkSession, name: str, schema: str) -> tuple[Callable[[DataFrame], None], Callable[[], DataFrame]]:
    """(a function that adds rows to a table in the shared folder, one that reads it): results of many jobs without a plan that grows with them."""
    path = f"{shared_dir(spark)}/timberline/{name}-{uuid.uuid4().hex}"
    fs, p = file_system(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return lambda df: df.write.mode("append").parquet(path), lambda: spark.read.schema(schema).parquet(path)


def durable(df: DataFrame, name: str, little: bool = False) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, so a lost executor costs no
    recomputation of what is upstream. Shuffle files of the write go when it is done (if little, when Spark's cleaner comes
    to them: many small requests to executors take threads); the table goes with discard, or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/timberline/{name}-{uuid.uuid4().hex}"
    setting = {k: v for k, v in WRITING.items() if not (little and k.endswith("fileCleanup.enabled"))}
    before = {k: spark.conf.get(k) for k in setting}
    try:
        for k, v in setting.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    fs, p = file_system(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that durable wrote; nothing may read them any more."""
    for t in tables:
        fs, p = file_system(t.sparkSession, t.durable_path)
        fs.delete(p, True)
        fs.cancelDeleteOnExit(p)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES, of: DataFrame | None = None) -> DataFrame:
    """Marks df for broadcast if it is within rows and size; beyond that Spark shuffles both sides. A durable table is judged by
    its files, which may hold an eighth of size; so is df if it has no more rows and columns than the durable table `of`.
    Anything else is run for its count and the bytes of its rows as text."""
    t = of if of is not None else df
    if hasattr(t, "durable_path"):
        fs, p = file_system(t.sparkSession, t.durable_path)
        return F.broadcast(df) if fs.getContentSummary(p).getLength() * 8 <= size else df
    n, width = df.agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*")))) if df.columns else F.lit(0)).first()
    return F.broadcast(df) if n <= rows and (width or 0) <= size else df
