"""Mixing sources to target weights with a low-discrepancy schedule (DataFrame functions only).

Every source's documents are put in a shuffled order and their words cut into blocks of equal length. Slot i of the mix
belongs to the source into whose share of [0, 1) the golden-ratio point frac(i / phi) falls; the r-th slot of a source
takes the r-th block of that source, starting over when the source is used up. A source has as many slots as its target
needs, and its last block is cut where the target ends, so what is taken equals the target rounded to a word.

Defined cases: null or blank texts have size 0 and are never taken; a null source is a source of its own and sorts last;
rows that repeat a doc_id, or have none, are documents of their own; an empty table gives an empty mix; other columns are
ignored. The order depends on doc_id, seed and text alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.common import durable, free, n_words, small

#: 2**31 / golden ratio, rounded to an odd number: i * this modulo 2**31 is a golden-ratio sequence with period 2**31.
GOLDEN_31 = 1327217885
CELLS = 1 << 12


def source_key(source: Column) -> Column:
    """A non-null key that sorts by code point with the null source last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def sized_documents(docs: DataFrame, row: str | None = None) -> DataFrame:
    """row (the column of that name, or numbers that hold once this is written), doc_id, source, size, th (hash of the text), key."""
    number = F.col(row) if row else F.monotonically_increasing_id()
    return docs.select(number.alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("th"), source_key(F.col("source")).alias("key"))


def targets(sized: DataFrame, pattern: tuple[int, ...] = (3, 1, 2), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: key, source_size, target. The catalogue of sources, not the documents, is ordered in one task.

    Weights share total * (all words); a source's target stops at most * (its size) and the excess is dealt out again by
    weight. That fixed point fills the sources like vessels to one common level: sorted by the level at which each is full,
    the sources before the level are full and the others get level * weight.
    """
    by_key = Window.orderBy("key")
    s = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in pattern]), F.pmod(F.row_number().over(by_key) - 1, F.lit(len(pattern))) + 1))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("full_at", F.col("cap") / F.col("w"))
    order, everything = Window.orderBy("full_at", "key"), Window.partitionBy()
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(total))).withColumn("at", F.row_number().over(order))
    s = s.withColumn("level", (F.col("budget") - (F.sum("cap").over(upto) - F.col("cap"))) / (F.sum("w").over(everything) - F.sum("w").over(upto) + F.col("w")))
    s = s.withColumn("full", F.col("level") >= F.col("full_at"))
    s = s.withColumn("common", F.min(F.when(~F.col("full"), F.struct("at", "level"))).over(everything)["level"])
    return s.select("key", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("common") * F.col("w")).alias("target"))


def running_start(df: DataFrame, key: str, bucket: str, order: list[str], value: Column, out: str) -> DataFrame:
    """Sum of value over the rows before each row, in order (bucket, *order) inside a key, without one task per key: sums of buckets first, then inside buckets."""
    totals = df.groupBy(key, bucket).agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(key, bucket, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(totals, [key, bucket]).withColumn(out, F.col("_o") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_o", bucket)


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """Slots of the mix: key, rank (of the slot in its source), slot. Sources have key, take (words) and slots (blocks)."""
    n, catalogue = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)).cast("long"), F.count("*")).first()
    parts = max(CELLS, 1 << (4 * catalogue).bit_length())  # cells meet few sources each, however many there are
    cum = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shares = sources.where("take > 0").select("key", "slots", F.sum("take").over(cum).alias("hi"), "take", F.sum("take").over(Window.partitionBy()).alias("all"))
    shares = shares.select("key", ((F.col("hi") - F.col("take")) / F.col("all")).alias("lo"), F.when(F.col("hi") == F.col("all"), F.lit(2.0)).otherwise(F.col("hi") / F.col("all")).alias("hi"))
    cells = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * parts), F.least(F.floor(F.col("hi") * parts), F.lit(parts - 1)))))
    slots = sources.sparkSession.range(n).withColumn("u", F.pmod(F.pmod("id", F.lit(1 << 31)) * GOLDEN_31, F.lit(1 << 31)) / float(1 << 31)).withColumn("cell", F.floor(F.col("u") * parts))
    slots = slots.join(small(cells), "cell").where("u >= lo and u < hi").select("key", F.col("id").alias("slot"), F.floor(F.col("id") / max(1, int(n**0.5))).alias("_b"))
    ranked = running_start(slots, "key", "_b", ["slot"], F.lit(1), "rank").select("key", "rank", "slot")
    have = ranked.groupBy("key").agg(F.count("*").alias("have"))
    # the sequence may leave a source a few slots short of its target; those follow at the end
    rest = sources.where("slots > 0").join(have, "key", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < slots")
    rest = rest.withColumn("at", F.lit(n) + F.sum(F.col("slots") - F.col("have")).over(cum) - (F.col("slots") - F.col("have")))
    rest = rest.select("key", F.explode(F.sequence(F.col("have"), F.col("slots") - 1)).alias("rank"), "have", "at")
    return ranked.unionByName(rest.select("key", "rank", (F.col("at") + F.col("rank") - F.col("have")).alias("slot")))


def mix(docs: DataFrame, pattern: tuple[int, ...] = (3, 1, 2), total: float = 1.5, most: float = 2.0, block: int = 4096, seed: int = 7, row: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with row, key and size, sources with source_size, target and take, mix). The mix has a row for each piece of
    a document in a block: slot, key, row, doc_id, first_word, n_words; slot gives the order."""
    sized = durable(sized_documents(docs, row), "mix-sizes", little=True)
    sources = targets(sized, pattern, total, most)
    sources = sources.withColumn("take", F.least(F.round("target"), F.floor(F.col("source_size") * F.lit(float(most)))).cast("long"))
    sources = durable(sources.withColumn("slots", F.ceil(F.col("take") / block)), "mix-sources", little=True)
    buckets = max(1, int(sized.count() ** 0.5))
    h = sized.where("size > 0").withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("_b", F.pmod(F.shiftrightunsigned("h", 20), F.lit(buckets)))
    placed = running_start(h, "key", "_b", ["h", "doc_id", "th", "row"], F.col("size"), "start").join(small(sources), "key")
    rounds = F.explode(F.sequence(F.lit(0), F.floor((F.col("take") - 1 - F.col("start")) / F.col("source_size"))))
    pieces = placed.where("start < take").withColumn("round", rounds).withColumn("from", F.col("round") * F.col("source_size") + F.col("start"))
    pieces = pieces.withColumn("to", F.least(F.col("from") + F.col("size"), F.col("take")))
    pieces = pieces.withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
    lo, hi = F.greatest(F.col("rank") * block, F.col("from")), F.least((F.col("rank") + 1) * block, F.col("to"))
    pieces = pieces.select("key", "rank", "row", "doc_id", (lo - F.col("from")).alias("first_word"), (hi - lo).alias("n_words"))
    return sized, sources, pieces.join(schedule(sources, block), ["key", "rank"]).drop("rank")


def taken(docs: DataFrame, **options) -> DataFrame:
    """row, doc_id, source, size, source_size, target, taken: how many of each document's words the mix takes, repeats counted; first_slot, last_slot: between which slots of the mix they stand."""
    sized, sources, plan = mix(docs, **options)
    got = plan.groupBy("row").agg(F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))
    out = sized.join(got, "row", "left").join(small(sources.select("key", "source_size", "target"), of=sources), "key")
    return out.select("row", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", "last_slot")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """Rows of docs that the mix takes words of, with size, source_size, target, taken, first_slot and last_slot (free() names them where docs has such columns)."""
    key = free("_row", docs)
    rows = durable(docs.withColumn(key, F.monotonically_increasing_id()), "mix-rows", little=True)
    named = [F.col(x).alias(free(x, docs)) for x in ("size", "source_size", "target", "taken", "first_slot", "last_slot")]
    got = taken(rows, row=key, **options).where("taken > 0").select(F.col("row").alias(key), *named)
    return rows.join(got, key).drop(key)


def query(spark, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row", "source")
