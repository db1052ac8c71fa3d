from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from timberline.llm import ann, common, mixing, quality, tokencounts

DATA = "/root/testdata/sf0.001"


# ---- mixing ----


def plain_targets(sizes, pattern=(3, 1, 2), total=1.5, most=2.0):
    """Targets by dealing out the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: pattern[i % len(pattern)] for i, s in enumerate(names)}
    target, left, budget = {}, set(names), total * sum(sizes.values())
    while left:
        share = (budget - sum(target.values())) / sum(weight[s] for s in left)
        full = {s for s in left if share * weight[s] >= most * sizes[s]}
        if not full:
            return target | {s: share * weight[s] for s in left}
        target |= {s: most * sizes[s] for s in full}
        left -= full
    return target


def mixed_docs(spark, seed=4):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randrange(1, 3) for _ in range(rng.choice([0, 1, 5, 40, 300]))), rng.choice(["a", "b", "b", "b", "é", "Z", None, "tiny"] if i else ["tiny"])) for i in range(150)]
    rows = [(i, t, s if s != "tiny" or i % 9 == 0 else "b") for i, t, s in rows] + [(500, None, "a"), (501, "   ", "nothing"), (502, "x " * 5000, "a"), (None, "x y", "a")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


@pytest.mark.parametrize("block", [16, 4096])
def test_mix_meets_targets(spark, block):
    rows, df = mixed_docs(spark)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    want = plain_targets(size)
    got = mixing.taken(df, block=block).collect()
    assert len(got) == len(rows)
    for s in size:
        own = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in own} == {size[s]}
        assert own[0]["target"] == pytest.approx(want[s])
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 0.5
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    again = mixing.taken(df.repartition(5), block=block).collect()
    plain = lambda rows: sorted(str(tuple(r)[1:]) for r in rows)
    assert plain(got) == plain(again)
    assert all((r["taken"] > 0) == (r["first_slot"] is not None) and (r["first_slot"] or 0) <= (r["last_slot"] or 0) for r in got)


def test_mix_pieces_cover_blocks(spark):
    _, df = mixed_docs(spark)
    _, sources, plan = mixing.mix(df, block=16)
    rows = plan.collect()
    n = sum(r["slots"] for r in sources.collect())
    ends = [r["slot"] for r in rows]
    assert len({(r["key"], r["slot"]) for r in rows if r["slot"] < n}) >= 0.9 * n
    # slots beyond the sequence, which no source was left short of in the first place, have numbers of their own
    assert len({(r["key"], r["slot"]) for r in rows}) == len({r["slot"] for r in rows}) == n
    assert max(ends) < n + len({r["slot"] for r in rows if r["slot"] >= n}) + 1
    # every tenth of the schedule has each source near its share
    share = {r["key"]: r["slots"] / n for r in sources.collect()}
    for k, s in share.items():
        if s > 0.1:
            slots = sorted({r["slot"] for r in rows if r["key"] == k})
            for part in range(10):
                assert abs(sum(part * n / 10 <= x < (part + 1) * n / 10 for x in slots) - s * n / 10) < 6


def test_mix_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.taken(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.taken(blank).collect()] == [0, 0]
    twice = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s")], "doc_id long, text string, source string")
    assert sorted((r["size"], r["source_size"], r["taken"]) for r in mixing.taken(twice).collect()) == [(2, 4, 2), (2, 4, 4)]
    clash = twice.withColumns({"size": F.lit("x"), "Taken": F.lit("y"), "_row": F.lit("z"), "a.b": F.lit(1)})
    got = mixing.mixed(clash).collect()
    assert sorted((r["size"], r["Taken"], r["_row"], r["a.b"], r["size_"], r["taken_"], r["source_size"]) for r in got) == [("x", "y", "z", 1, 2, 2, 4), ("x", "y", "z", 1, 2, 4, 4)]


# ---- quality ----


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    out = quality.query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    right = np.mean([r["predicted"] == r["quality"] for r in out])
    assert right >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    good, bad = [r["score"] for r in out if r["quality"]], [r["score"] for r in out if not r["quality"]]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95


def test_forest_follows_its_arrays():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    f = quality.fit(x, y, trees=30)
    p = f.score(x)
    assert ((p > 0.5) == y).mean() > 0.95
    total = np.full(len(x), f.base)
    for t in range(len(f.leaf)):  # row by row
        for i in range(len(x)):
            at = 0
            while at < 2**f.depth - 1:
                at = 2 * at + 1 + int(x[i, f.feature[t, at]] > f.threshold[t, at])
            total[i] += f.leaf[t, at - (2**f.depth - 1)]
    assert np.allclose(1 / (1 + np.exp(-total)), p)


def test_quality_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "x " * 40_000, 7), (None, "a b", 7), (4, "Good text here.", 7), (4, "Good text here.", 7)], "doc_id long, text string, score long")
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0), (None, 1), (9, 1), (3, 0)], "doc_id long, quality int")
    out = quality.classify(docs.drop("score"), labels)
    assert out.count() == 6
    assert out.where("score between 0 and 1").count() == 6
    assert quality.classify(docs.drop("score"), labels.limit(0)).first()["score"] == pytest.approx(0.5)
    assert quality.classify(docs.drop("score").limit(0), labels).count() == 0


def test_statistics_do_not_depend_on_chunks(monkeypatch):
    texts = ["One two. Two!", None, "", "a a a b | c ###", "É É é 12 x" * 50, "tail"]
    whole = quality.text_features(texts)
    monkeypatch.setattr(common, "CHUNK_BYTES", 8)
    assert np.allclose(whole, quality.text_features(texts))
    assert not whole[1].any()


# ---- token counts ----


def totals(store):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in store.totals().collect()}


def test_rollups_follow_changes(spark, tmp_path):
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    store = tokencounts.Store(spark, str(tmp_path / "s"), ["words"])
    first = docs([(1, "a b c", "x", "en"), (2, "d", "x", "en"), (3, None, None, "de"), (4, "", "y", None), (4, "", "y", None)])
    assert store.commit("1", first)
    assert not store.commit("1", first)
    assert totals(store) == {("x", "en", "words"): (2, 4), (None, "de", "words"): (1, 0), ("y", None, "words"): (1, 0)}
    ids = spark.createDataFrame([(2,), (77,)], "doc_id long")
    assert store.commit("2", docs([(1, "a b c d e", "x", "en"), (4, "q r", "z", "en")]), ids)
    assert not store.commit("2", docs([(1, "never", "x", "en")]), ids)
    assert totals(store) == {("x", "en", "words"): (1, 5), (None, "de", "words"): (1, 0), ("z", "en", "words"): (1, 2)}
    assert store.commit("3", docs([]))
    assert store.commit("4", deletes=spark.createDataFrame([(1,), (3,), (4,)], "doc_id long"))
    assert totals(store) == {}
    with pytest.raises(Exception, match="cannot be tracked"):
        store.commit("5", docs([(None, "a", "x", "en")]))
    assert store.batches() == ["1", "2", "3", "4"]


def test_rows_of_one_document_count_as_one(spark, tmp_path):
    store = tokencounts.Store(spark, str(tmp_path / "s"), ["byte_bpe_50k", "words"])
    rows = [(1, "a b c d e", "x", "en"), (1, "internationalisation of", "y", "de")]
    store.commit("1", spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"))
    assert {(r["source"], r["lang"]) for r in store.totals().collect()} == {("y", "de")}


def test_writers_at_once(spark, tmp_path, monkeypatch):
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    a, b = (tokencounts.Store(spark, str(tmp_path / "s"), ["words"]) for _ in range(2))
    a.commit("0", docs((1, "one two three", "x", "en"), (2, "four", "x", "en")))
    write, raced = a._write, []

    def late(delta):
        name = write(delta)
        if not raced:  # another writer deletes the document, and sends the same batch, before a has committed
            raced.append(b.commit("other", deletes=docs((1, "", "", ""))))
        return name

    monkeypatch.setattr(a, "_write", late)
    assert a.commit("mine", docs((1, "five six", "x", "en")))
    assert raced == [True] and a.batches() == ["0", "mine", "other"]
    assert [(r["n_docs"], r["n_tokens"]) for r in a.totals().collect()] == [(2, 3)]
    raced.clear()
    monkeypatch.setattr(b, "commit", lambda *x, **y: tokencounts.Store.commit(b, "same", docs((3, "seven", "x", "en"))))
    assert not a.commit("same", docs((3, "seven", "x", "en")))
    assert [(r["n_docs"], r["n_tokens"]) for r in a.totals().collect()] == [(3, 4)]
    (tmp_path / "s" / "data" / "crashed").mkdir()
    assert a.compact() and len(a.log()) == 1 and a.batches() == ["0", "mine", "other", "same"]
    assert a.clean() == 5
    assert not a.commit("0", docs((9, "no", "x", "en")))
    assert a.commit("last", deletes=docs((3, "", "", "")))
    assert [(r["n_docs"], r["n_tokens"]) for r in a.totals().collect()] == [(2, 3)]


def test_rollups_equal_a_recount(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    lab = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    want = {}
    for r in d.collect():
        q, t = lab.get(r["doc_id"], (1, 0))
        text = r["text"] if q else b" ".join(w for w, _ in itertools.groupby(r["text"].encode().split())).decode()
        if t and q:
            continue
        for v in ("byte_bpe_50k", "words"):
            k = (r["source"], r["lang"], v)
            n = want.get(k, (0, 0))
            want[k] = (n[0] + 1, n[1] + tokencounts.counter(v, tokencounts.TOKENIZER_DIR)(text))
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in tokencounts.query(spark, DATA).collect()}
    assert got == want


# ---- nearest neighbours ----


def brute(ids, x, qids, k=10):
    out = {}
    for q in qids:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        o = np.lexsort((ids, d))[: min(k, len(ids) - 1)]
        out[q] = [(int(ids[i]), d[i]) for i in o]
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def test_recall(spark, monkeypatch):
    d = "/root/testdata/sf0.01"
    t = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    ids, x = t["vec_id"].to_numpy(), np.stack(t["embedding"]).astype(np.float64)
    want = brute(ids, x, [i for i in ids if i % 100 == 0])
    index, q = ann.build(spark.read.parquet(f"{d}/embeddings.parquet"))
    for rerank, rows in ((400, 16_384), (40, 16_384), (40, 100)):  # nearly all reranked, few, and few of short runs
        monkeypatch.setattr(ann, "SCAN_ROWS", rows)
        got = {}
        for r in ann.search(index.repartition(2), q, F.col("vec_id") % 100 == 0, rerank=rerank, block=2).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
        assert all(sorted(g) == list(range(1, 11)) for g in got.values())
        hits = [len({v for v, _ in g.values()} & {v for v, _ in want[i]}) for i, g in got.items()]
        assert len(got) == len(want)
        assert np.mean(hits) >= 9
        for i, g in got.items():
            for v, s in g.values():
                assert s == pytest.approx(math.sqrt(((x[ids == i][0] - x[ids == v][0]) ** 2).sum()), abs=1e-12)


def test_recall_of_many_vectors(spark):
    """50,000 vectors in one partition, whose batches Arrow may cut as it likes."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 32))[rng.integers(0, 500, 50_000)] + 0.6 * rng.normal(size=(50_000, 32))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(50_000), "embedding": list(x)}))
    want = brute(np.arange(50_000), x, range(0, 50_000, 100))
    index, q = ann.build(df)
    got = {}
    for r in ann.search(index.coalesce(1), q, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[i] & {v for v, _ in want[i]}) for i in want]) >= 9


def test_anisotropic_loss_is_what_codes_minimise():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    plain, aware = ann.Quantizer.train(x, eta=1.0), ann.Quantizer.train(x, eta=8.0)

    def parallel(q):
        y = q.extend(x, q.scale)
        c = q.encode(x)
        dec = np.concatenate([q.books[j][c[:, j]] for j in range(len(q.books))], 1)
        return float(((((y - dec) * y).sum(1) / np.linalg.norm(y, axis=1)) ** 2).mean())

    assert parallel(aware) < 0.5 * parallel(plain)
    lut, codes = aware.tables(x[:5]), aware.pack(aware.encode(x[:50]))
    score = sum(lut[:, b, :][:, codes[:, b]] for b in range(codes.shape[1]))
    dec = np.concatenate([aware.books[j][aware.encode(x[:50])[:, j]] for j in range(len(aware.books))], 1)
    q = np.concatenate([x[:5], np.full((5, 1), aware.scale), np.zeros((5, 1))], 1)
    assert np.allclose(score, q @ dec.T, atol=1e-4)


def test_neighbours_of_odd_tables(spark):
    bad = [(100, None, 1), (101, [0.0, 0.0], 1), (102, [float("nan"), 1.0], 1), (103, [float("inf"), 1.0], 1), (104, [None, 1.0], 1), (105, [1.0], 1), (None, [1.0, 1.0], 1)]
    rows = [(k, [1.0, float(k // 40)], 0) for k in range(120) if k not in range(100, 106)] + [(200, [1.0, 0.0], 0), (200, [1.0, 0.0], 0)]
    index, q = ann.build(vectors(spark, rows + bad))
    got = {}
    for r in ann.search(index, q, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {0: list(range(1, 11)), 200: list(range(10))}  # ties: smaller ids
    index, q = ann.build(vectors(spark, rows[:3]))
    assert ann.search(index, q, F.col("vec_id") % 100 == 0).count() == 2
    index, q = ann.build(vectors(spark, bad[:5]))
    assert ann.search(index, q, F.col("vec_id") % 100 == 0).count() == 0
    index, q = ann.build(vectors(spark, []))
    assert ann.search(index, q, F.col("vec_id") % 100 == 0).columns == ["query_id", "rank", "vec_id", "score"]
