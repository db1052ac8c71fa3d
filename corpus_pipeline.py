"""A training-data pipeline over `documents`: classify, remove boilerplate lines, keep one of near copies, decontaminate, mix.

run(spark, sf_dir) applies STAGES one after the other; what a stage returns is written as Parquet in the shared folder and
read back as the next one's docs. All stages but the last return the columns of documents, extra ones of any name included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import decontam, jaccard, linededup, mixing, quality
from timberline.llm.common import durable, free, own


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    scored = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where(F.col(free("predicted", docs)) == 1).select(own(docs))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many sites go; so do documents of which nothing is left."""
    n_removed = F.col(free("n_removed", docs))
    out = linededup.remove_lines(docs).where(~((n_removed > 0) & (F.trim("text") == "")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(n_removed > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(own(docs))


def one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by five-word shingle similarity of 0.8 or more, the smallest doc_id stays, in one row."""
    return jaccard.keep_one(docs, k=5, num=80, den=100)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with size, source_size, target, taken (words, repeats counted), first_slot and
    last_slot, with underscores behind a name that the documents have already."""
    return mixing.mixed(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_boilerplate),
    ("n-gram Jaccard join", one_of_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixed),
]

#: A trained classifier is no SQL; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
