"""Benchmark decontamination by template windows (DataFrame functions only).

Canonical form: words are lower-cased and stripped of outer punctuation; numbers, names and units become the typed
placeholders <num>, <name> and <unit>. A number is a word with a digit first; a name is a word with a capital and a small
letter first that stands in the same line after a word which ends in a letter, digit, comma or semicolon, or starts a sentence or
line of a text that has it as a name elsewhere, and never in small letters; a unit is a word
of UNITS that follows a number. Windows of width canonical words with at least
literals words that are no placeholders are hashed and hash-joined with the benchmark's windows.

All this runs over every document; the slots' values are taken only from documents that hold enough windows of an item.

Windows of SHORT words and, where these hold too few literals, of width words are the seeds; a window's first word counts
as a word whatever precedes it. Seeds are hashed with names as slots
and, so that case, lines and marks make no difference, with names as words. An item under width words is one seed. An item without a literal-rich window has windows of
its plain words as seeds and matches only as a whole and with equal values. Documents whose seeds cover SEEDED of an
item's words are compared with it word by word, each seed at its own offset: a word of the item counts if it is the same
canonical word there and stands within SHORT words of a seed. A document matches if share of the item's words count, or
part of them and at least PART_WORDS words (a long partial quote), so a changed word costs one word; and if the slots
agree: a slot value of the item must stand for one and the same value of the document in all words that count, in at
least consistency of the item's slot values. All words and equal values everywhere mean a verbatim copy, other values a
re-parameterised question. An edit that leaves no run of SHORT words is not seen: in items of 8 and 9 words, one in the middle.

Defined cases: null and blank texts and items have no windows and match nothing; an item of a word or two is found wherever it stands; very long texts are used whole; repeated
rows of a document or an item count once; ties are all reported; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import durable, let, own, small

WIDTH, LITERALS, SHARE, CONSISTENCY = 8, 4, 0.8, 0.8
SHORT, SEEDED, PART, PART_WORDS = 5, 0.3, 0.6, 13
#: Units that may follow a number.
UNITS = "% kg g mg km m cm mm mi ft in lb lbs oz l ml s sec min h hr hours minutes seconds days weeks years usd eur gbp dollars euros cents percent degrees celsius fahrenheit mph kmh watts volts joules".split()
#: Marks in front of names, numbers and words with a capital that start a sentence or line while a text is taken apart; texts that hold these control characters lose them.
NAME, NUMBER, START = "\u0001", "\u0002", "\u0003"
INSIDE = rf"[^\p{{L}}\p{{N}}%\s{NAME}{NUMBER}{START}]"


def marked(text: Column) -> Column:
    """The text in lower case with names, numbers and other words with a capital with their mark in front of them. Whole-text
    expressions, much cheaper than looking at each word; each begins with a plain class that most places fail, and never goes back."""
    t = F.coalesce(text, F.lit(""))
    t = F.when(F.contains(t, F.lit(NAME)) | F.contains(t, F.lit(NUMBER)) | F.contains(t, F.lit(START)), F.translate(t, NAME + NUMBER + START, "")).otherwise(t)
    t = F.concat(F.lit(" "), t)
    t = F.regexp_replace(t, r"[ \t](?<=[\p{L}\p{N},;][ \t])[ \t]*+[\"'(\[]?(?=\p{Lu}\p{Ll})", f" {NAME}")
    # other words with a capital may be names only where the text has names
    t = F.when(F.contains(t, F.lit(NAME)), F.regexp_replace(t, r"([ \t-\r])[\"'(\[]?(?=\p{Lu}\p{Ll})", f"$1{START}")).otherwise(t)
    t = F.regexp_replace(t, r"([ \t-\r])(?![a-zA-Z])[^\p{L}\p{N}\s]*+(?=\p{N})", f"$1{NUMBER}")
    return F.concat(F.lower(t), F.lit(" "))


def split_words(t: Column) -> Column:
    """Words without outer punctuation."""
    return F.array_remove(F.split(t, rf"(?![a-z0-9]){INSIDE}*+[ \t-\r]++{INSIDE}*+"), "")


def canonical(df: DataFrame) -> DataFrame:
    """Adds c (canonical words), b (the same, but names as words), v (as c, but slots as their type, a colon and their value), p (plain words) and l (plain words, but <num>: a window's first word, as it counts whatever precedes it)."""
    df = let(df, "marked", marked(F.col("text")))
    df = let(df, "raw", split_words(F.col("marked")))
    starts = lambda x: F.startswith(x, F.lit(START))
    # names of the text that it has in no other way than with a capital
    names = F.transform(F.filter("raw", lambda x: F.startswith(x, F.lit(NAME))), lambda x: F.substring(x, 2, 1 << 30))
    df = let(df, "names", F.when(F.contains("marked", F.lit(START)), F.array_except(names, F.col("raw"))).otherwise(F.array().cast("array<string>")))
    again = lambda x: F.when(starts(x), F.concat(F.when(F.array_contains("names", F.substring(x, 2, 1 << 30)), NAME).otherwise(""), F.substring(x, 2, 1 << 30))).otherwise(x)
    df = let(df, "raw", F.when(F.contains("marked", F.lit(START)), F.transform("raw", again)).otherwise(F.col("raw"))).drop("names")
    number, name = (lambda x: F.startswith(x, F.lit(NUMBER))), (lambda x: F.startswith(x, F.lit(NAME)))
    bare = lambda x: F.translate(x, NAME + NUMBER, "")

    def typed(value: bool) -> Column:
        def one(x: Column, i: Column) -> Column:
            put = lambda kind, v: F.concat(F.lit(f"<{kind}>:"), v) if value else F.lit(f"<{kind}>")
            unit = x.isin(UNITS) & number(F.coalesce(F.get("raw", i - 1), F.lit("")))
            return F.when(number(x), put("num", bare(x))).when(name(x), put("name", bare(x))).when(unit, put("unit", x)).otherwise(x)

        return F.transform("raw", one)

    some = F.contains("marked", F.lit(NUMBER)) | F.contains("marked", F.lit(NAME))
    forms = {"c": typed(False), "b": F.transform("c", lambda x, i: F.when(x == "<name>", F.get("l", i)).otherwise(x)), "v": typed(True), "p": F.transform("raw", bare), "l": F.transform("raw", lambda x: F.when(number(x), "<num>").otherwise(bare(x)))}
    df = let(df, "c", F.when(some, forms["c"]).otherwise(F.col("raw")))
    df = let(df, "l", F.when(some, forms["l"]).otherwise(F.col("raw")))
    df = let(df, "b", F.when(F.contains("marked", F.lit(NAME)), forms["b"]))
    return df.withColumns({x: F.when(some, forms[x]).otherwise(F.col("raw")) for x in ("v", "p")}).drop("marked")


def windows(k: int | Column, exact: bool = False, form: str = "c") -> Column:
    """Hashes of all windows of k words, in order; exact: of the plain words. Form b is null for a text without names, and has no windows then."""
    n = F.greatest(F.size(form) - (k - 1), F.lit(0))
    if exact:
        return F.transform(F.slice("p", 1, n), lambda x, i: F.xxhash64(F.lit("exact"), F.slice("p", i + 1, k)))
    # the same hash either way; single words are cheaper than slices
    rest = lambda i: [F.get(form, i + j) for j in range(1, k)] if isinstance(k, int) else [F.slice(form, i + 2, k - 1)]
    return F.transform(F.slice("l", 1, n), lambda x, i: F.xxhash64(x, *rest(i)))


def both_forms(kinds: list[tuple[int, bool]], place) -> list[Column]:
    """Windows of each kind, in the form with names as slots and in the one without names."""
    nothing = F.array().cast("array<bigint>")
    return [place(x) for k, exact in kinds for x in ([windows(k, True)] if exact else [windows(k), F.coalesce(windows(k, form="b"), nothing)])]


def literal(words: Column) -> Column:
    """Words that are no placeholders."""
    return F.size(F.filter(words, lambda t: ~F.startswith(t, F.lit("<"))))


def seeds(items: DataFrame, width: int, literals: int) -> DataFrame:
    """item_id, part, n (words of the item), exact, i, k, h. Windows with literals enough; of width words only where no shorter
    window in them has. An item under width words is one window; one without a literal-rich window has exact ones."""
    short = min(SHORT, width)
    at = items.select("item_id", "part", "c", "l", "p", F.size("c").alias("n")).where("n > 0")
    at = at.unionByName(items.where("b is not null").select("item_id", "part", F.col("b").alias("c"), "l", "p", F.size("c").alias("n")))
    rich = lambda k: literal(F.concat(F.slice("l", F.col("i") + 1, 1), F.slice("c", F.col("i") + 2, k - 1))) >= literals

    def placed(some: DataFrame, k: Column, exact: bool = False) -> DataFrame:
        return some.select("*", F.lit(exact).alias("exact"), k.alias("k"), F.posexplode(windows(k, exact)).alias("i", "h"))

    # a shorter window does for a longer one if its first word is the same in both forms
    inner = lambda j: F.slice("c", F.col("i") + j + 1, short)
    inside = F.exists(F.sequence(F.lit(0), F.lit(width - short)), lambda j: (literal(inner(j)) >= literals) & (F.element_at(inner(j), 1) == F.get("l", F.col("i") + j)))
    most = F.least("n", F.lit(width))
    few = placed(at.where(F.col("n") >= width), F.lit(short)).unionByName(placed(at, most).where((F.col("n") < width) | ~inside)).where(rich(F.col("k")))
    poor = at.join(few.select("item_id", "part").distinct(), ["item_id", "part"], "left_anti")
    few = few.unionByName(placed(poor, most, True))
    return few.drop("c", "l", "p").distinct()


def find(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, literals: int = LITERALS, share: float = SHARE, consistency: float = CONSISTENCY, part: float = PART) -> DataFrame:
    """doc_id, item_id, n_windows (distinct seeds matched), item_windows, n_words (words of the item that count), item_words, n_slots, n_consistent, n_same (slot values; of those, consistent; equal), verbatim."""
    key = ["doc_id", "item_id", "part"]
    # items of one item_id with different texts are matched each for itself
    items = canonical(benchmark.select("item_id", "text").where("item_id is not null").distinct()).withColumn("part", F.xxhash64("text"))
    items = durable(items.select("item_id", "part", "c", "b", "v", "p", "l"), "benchmark-words", little=True)
    index = durable(seeds(items, width, literals), "benchmark-windows", little=True)
    kinds = sorted((r["k"], r["exact"]) for r in index.select("k", "exact").distinct().collect())  # of a few values
    all_windows = F.concat(F.array().cast("array<bigint>"), *both_forms(kinds, lambda x: x))
    sizes = index.groupBy("item_id", "part", "exact").agg(F.count_distinct("h").alias("item_windows"))
    texts = docs.select("doc_id", "text").where("doc_id is not null")
    hashes = index.select("h").distinct()
    found = canonical(texts).select("doc_id", F.explode(all_windows).alias("h")).join(small(hashes, of=index), "h").distinct()
    hits = found.join(small(index), "h").groupBy(*key, "n").agg(F.count_distinct("h").alias("n_windows"), F.flatten(F.collect_list(F.expr("sequence(i, least(i + k, n) - 1)"))).alias("at"))
    enough = durable(hits.where(F.size(F.array_distinct("at")) >= F.ceil(F.col("n") * SEEDED)).select(*key, "n_windows"), "leak-candidates", little=True)

    near = texts.join(small(enough.select("doc_id").distinct(), of=enough), "doc_id", "left_semi")
    placed = F.concat(F.array().cast("array<struct<j:int,h:bigint>>"), *both_forms(kinds, lambda x: F.transform(x, lambda h, j: F.struct(j.alias("j"), h.alias("h")))))
    ours = canonical(near).select("doc_id", "c", "v", "p", F.explode(placed).alias("w")).select("doc_id", "c", "v", "p", "w.*").join(small(index), "h").join(small(enough.select(*key), of=enough), key)
    ours = ours.withColumn("offset", F.col("j") - F.col("i")).withColumn("skip", F.greatest(-F.col("offset"), F.lit(0)))
    ours = ours.withColumns({x: F.slice(x, F.col("offset") + F.col("skip") + 1, F.col("n") - F.col("skip")) for x in ("c", "v", "p")})
    ours = ours.groupBy(*key, "offset", "skip").agg(F.max(F.struct("c", "v", "p")).alias("d"), F.collect_set(F.struct("i", "k")).alias("seeds"))
    rows = ours.join(small(items.select("item_id", "part", F.col("c").alias("ic"), F.col("v").alias("iv"), F.col("p").alias("ip")), of=items), ["item_id", "part"])
    reached = lambda p: F.exists("seeds", lambda s: (p >= s["i"] - SHORT) & (p < s["i"] + s["k"] + SHORT))
    ours_at = lambda x, p: F.get(f"d.{x}", p - F.col("skip"))

    def cell(x: Column, p: Column) -> Column:
        """A word is the same as typed, or as it stands: what precedes it may have made it a slot on one side only."""
        typed, theirs = F.coalesce(ours_at("c", p) == x, F.lit(False)), F.get("iv", p)
        return F.struct(p.alias("p"), ((typed | F.coalesce(ours_at("p", p) == F.get("ip", p), F.lit(False))) & reached(p)).alias("same"), theirs.alias("theirs"), F.when(typed, ours_at("v", p)).otherwise(theirs).alias("ours"))

    cells = F.transform("ic", cell)
    rows = let(rows, "cells", F.filter(cells, lambda x: x["same"])).withColumn("rank", F.struct(F.size("cells"), F.size(F.filter("cells", lambda x: x["theirs"] == x["ours"])), -F.col("offset")))
    # a word of the item is taken at the offset where most of the item is
    words = rows.select(*key, "rank", F.explode("cells").alias("x")).groupBy(*key, "x.p").agg(F.max_by(F.struct("x.theirs", "x.ours"), "rank").alias("x")).select(*key, "x.*")
    words = durable(words, "leak-words", little=True)
    counts = words.groupBy(*key).agg(F.count("*").alias("n_words"))
    slots = words.where(F.startswith("theirs", F.lit("<"))).groupBy(*key, "theirs").agg(F.min("ours").alias("a"), F.max("ours").alias("b"))
    slots = slots.groupBy(*key).agg(F.count("*").alias("n_slots"), F.count_if(F.col("a") == F.col("b")).alias("n_consistent"), F.count_if((F.col("a") == F.col("theirs")) & (F.col("b") == F.col("theirs"))).alias("n_same"))
    out = enough.join(small(sizes.join(items.select("item_id", "part", F.size("c").alias("item_words")), ["item_id", "part"]), of=items), ["item_id", "part"]).join(counts, key).join(slots, key, "left").fillna(0, ["n_slots", "n_consistent", "n_same"])
    whole = F.col("n_words") >= F.ceil(F.col("item_words") * share)
    quote = (F.col("n_words") >= PART_WORDS) & (F.col("n_words") >= F.ceil(F.col("item_words") * part))
    exact = F.col("exact") & ((F.col("n_words") < F.col("item_words")) | (F.col("n_same") < F.col("n_slots")))
    out = out.where((whole | quote) & ~exact & (F.col("n_consistent") >= F.col("n_slots") * consistency)).withColumn("verbatim", (F.col("n_same") == F.col("n_slots")) & (F.col("n_words") == F.col("item_words")))
    names = ["n_windows", "item_windows", "n_words", "item_words", "n_slots", "n_consistent", "n_same", "verbatim"]
    return out.groupBy("doc_id", "item_id").agg(F.max_by(F.struct(*names), F.struct("n_words", "n_same", "part")).alias("m")).select("doc_id", "item_id", "m.*")


def remove(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that match an item; null doc_ids stay."""
    bad = durable(find(docs, benchmark, **options).select("doc_id").distinct(), "leaks", little=True)
    return docs.join(small(bad), "doc_id", "left_anti").select(own(docs))


def query(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
