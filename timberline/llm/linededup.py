"""Line dedup by distinct-site spread.

A line's spread is the number of distinct sites (sources) that carry it. HyperLogLog sketches of sites are built per line
hash and merge in the aggregation; lines whose estimate is clearly above or below the threshold are decided by it, and the
lines near the threshold get exact distinct counts. A line with spread >= min_sites is cross-site boilerplate: it stays in
the document with the smallest doc_id that has it and goes from all others.

The sketch has 2**lg_k registers, a relative standard error of about 1.04 / sqrt(2**lg_k) (1.6 % for 12); "near" is within
the factor 1 +- band (25 %, over ten standard errors) and at least two sites either way.

Lines are compared without white space at their ends; blank lines and lines under min_chars characters are never removed.

Defined cases: null texts have no lines and come back null; a null source is no site; null doc_ids count as larger than
any other and lose boilerplate; rows of one doc_id are treated alike, as one document; an empty table gives no rows; other
columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import SPACES, durable, free, small

MIN_SITES, MIN_CHARS = 10, 10


def bare(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def line_hash(line: Column) -> Column:
    return F.xxhash64(bare(line))


def candidate_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """h, doc_id, source of every line long enough; once per document row."""
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: F.length(bare(x)) >= min_chars), line_hash)
    return docs.select("doc_id", "source", F.explode(F.array_distinct(lines)).alias("h"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, lg_k: int = 12, band: float = 0.25) -> DataFrame:
    """h, first_doc of the lines that spread over at least min_sites sites."""
    lines = candidate_lines(docs, min_chars)
    spread = lines.groupBy("h").agg(F.hll_sketch_agg("source", lg_k).alias("sketch"), F.min("doc_id").alias("first_doc"), F.min("source").alias("lo"), F.max("source").alias("hi"))
    low, high = min(min_sites * (1 - band), min_sites - 2), max(min_sites * (1 + band), min_sites + 2)
    # lines of one site are far below any threshold above 2; their sketches need no estimate
    spread = spread.where((F.col("lo") != F.col("hi")) | F.lit(min_sites <= 3)).select("h", "first_doc", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = durable(spread.where(F.col("sites") >= low), "line-spread", little=True)
    near = spread.where(F.col("sites") < high).select("h", "first_doc")
    exact = lines.join(small(near, of=spread), "h").groupBy("h", "first_doc").agg(F.count_distinct("source").alias("sites")).where(F.col("sites") >= min_sites)
    return spread.where(F.col("sites") >= high).select("h", "first_doc").unionByName(exact.select("h", "first_doc"))


def remove_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with text after removal, and n_lines and n_removed (free() names them where docs has such columns)."""
    min_chars = options.get("min_chars", MIN_CHARS)
    gone = durable(boilerplate(docs, **options), "line-boilerplate", little=True)
    lines = candidate_lines(docs, min_chars)
    hashes, key, left, n_lines, n_removed = (free(x, docs) for x in ("_drop", "_doc", "_kept", "n_lines", "n_removed"))
    drop = lines.join(small(gone), "h").where(F.col("doc_id").isNull() | (F.col("doc_id") != F.col("first_doc")))
    drop = drop.groupBy("doc_id").agg(F.collect_set("h").alias(hashes)).withColumnRenamed("doc_id", key)
    out = docs.join(drop, F.col("doc_id").eqNullSafe(F.col(key)), "left").drop(key)
    split = F.split("text", "\n")
    kept = F.when(F.col(hashes).isNull(), split).otherwise(F.filter(split, lambda x: (F.length(bare(x)) < min_chars) | ~F.array_contains(hashes, line_hash(x))))
    count = lambda x: F.when(F.col("text").isNull(), 0).otherwise(F.size(x)).cast("long")
    out = out.withColumn(left, kept).withColumn(n_lines, count(split)).withColumn(n_removed, F.col(n_lines) - count(F.col(left)))
    return out.withColumn("text", F.array_join(left, "\n")).drop(left, hashes)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return remove_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


_TRIM = "trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
ORACLE = f"""
with l0 as (select doc_id, source, unnest(string_split(text, chr(10))) l, unnest(range(len(string_split(text, chr(10))))) i from documents),
l1 as (select doc_id, source, i, l, {_TRIM} b from l0),
g as (select b, min(doc_id) first_doc from l1 where length(b) >= {MIN_CHARS} group by b having count(distinct source) >= {MIN_SITES}),
m as (select l1.*, (g.b is not null and l1.doc_id <> g.first_doc) gone from l1 left join g on l1.b = g.b)
select doc_id, count(*) n_lines, count(*) filter (gone) n_removed, sha256(coalesce(string_agg(l, chr(10) order by i) filter (not gone), '')) kept_sha256
from m group by doc_id"""
