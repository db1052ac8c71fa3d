from __future__ import annotations

import re
import unicodedata

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_other_operators import plain_targets
from tests.llm.test_text_operators import brute_components
from timberline.llm import decontam, linededup, quality

DATA = "/root/testdata/sf0.001"


def letter_or_digit(c):
    return unicodedata.category(c)[0] in "LN"


def template(text):
    """Canonical words, one character at a time."""
    out, before, line_start = [], "", True
    for line in re.split("\n", text):
        line_start = True
        for raw in re.findall(r"[^\x20\x09-\x0d]+", line):
            inner = raw
            while inner and not (letter_or_digit(inner[0]) or inner[0] == "%"):
                inner = inner[1:]
            while inner and not (letter_or_digit(inner[-1]) or inner[-1] == "%"):
                inner = inner[:-1]
            if inner:
                name = not line_start and len(inner) > 1 and inner[0].isupper() and inner[1].islower() and before and (letter_or_digit(before[-1]) or before[-1] in ",;") and raw.find(inner) <= 1
                number = unicodedata.category(inner[0])[0] == "N"
                unit = inner.lower() in decontam.UNITS and out and out[-1] == "<num>"
                out.append("<num>" if number else "<name>" if name else "<unit>" if unit else inner.lower())
            before, line_start = raw, False
    return out


def windows(text):
    w = template(text)
    return {tuple(w[i : i + 8]) for i in range(max(len(w) - 7, min(len(w), 1)))}


def plain_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scored = quality.classify(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = {r["doc_id"]: (r["text"], r["source"]) for r in scored.where("predicted = 1").collect()}
    sites, first = {}, {}
    for i, (t, s) in rows.items():
        for line in {x.strip(" \t\n\x0b\f\r") for x in t.split("\n")}:
            if len(line) >= linededup.MIN_CHARS:
                sites.setdefault(line, set()).add(s)
                first[line] = min(first.get(line, i), i)
    kept = {}
    for i, (t, s) in rows.items():
        lines = [x for x in t.split("\n") if not (len(sites.get(b := x.strip(" \t\n\x0b\f\r"), ())) >= linededup.MIN_SITES and first[b] != i)]
        if lines == t.split("\n") or "\n".join(lines).strip(" "):
            kept[i] = ("\n".join(lines), s)
    group = brute_components([(i, t) for i, (t, _) in kept.items()], 5, 80, 100)
    kept = {i: v for i, v in kept.items() if group[i][1] == i}
    items = [w for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if (w := {x for x in windows(r["text"]) if sum(not t.startswith("<") for t in x) >= 4})]
    kept = {i: (t, s) for i, (t, s) in kept.items() if not any(len(w & windows(t)) >= 0.8 * len(w) for w in items)}
    return kept


def test_pipeline_against_a_plain_version(spark):
    want = plain_run(spark)
    got = corpus_pipeline.run(spark, DATA).collect()
    size = {}
    for t, s in want.values():
        size[s] = size.get(s, 0) + len(t.split())
    target = plain_targets(size)
    assert {r["doc_id"] for r in got} <= set(want)
    assert all(r["text"] == want[r["doc_id"]][0] for r in got)
    for s in size:
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - target[s]) <= 0.5
        assert all(0 < r["taken"] <= 2 * r["size"] for r in own)
        if target[s] >= size[s]:  # then every document is taken
            assert {r["doc_id"] for r in own} == {i for i, (t, x) in want.items() if x == s and t.split()}


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), DATA).columns == docs.columns
    assert corpus_pipeline.mixed(spark, docs.limit(0), DATA).count() == 0


def test_stages_keep_clashing_columns(spark):
    """Extra columns of any name come through every stage with their values, and repeated rows leave as one."""
    names = ["size", "source_size", "target", "taken", "n_lines", "n_removed", "score", "predicted", "_row", "_id", "_th", "_drop", "h", "node", "comp", "item_id", "key", "row", "a.b", "first_slot"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first = docs.orderBy("doc_id").limit(40)
    docs = first.unionByName(first.limit(3)).withColumns({n: F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")) for n in names})
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        rows = out.collect()
        assert rows and out.columns[: len(docs.columns)] == docs.columns
        assert all(r[n] == f"{n}-{r['doc_id']}" for r in rows for n in names)
    kept = corpus_pipeline.one_of_copies(spark, docs, DATA).collect()
    assert len({r["doc_id"] for r in kept}) == len(kept)
    mixed = {}
    for r in rows:
        assert 0 < r["taken_"] <= 2 * r["size_"] == 2 * len(r["text"].split())
        mixed.setdefault(r["source"], []).append((r["taken_"], r["target_"]))
    for own in mixed.values():
        assert abs(sum(t for t, _ in own) - own[0][1]) <= 0.5


def test_stages_take_nulls(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(5)
    nulls = docs.select(*[F.lit(None).cast(t).alias(n) for n, t in docs.dtypes])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.unionByName(nulls), DATA).count() >= 0
