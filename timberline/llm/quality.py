"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are vectorised over the bytes and words of whole texts. Trees are grown level by level on quantile histograms
with logistic loss; the forest is flattened into arrays (feature, threshold, leaf value in heap order) that numpy
traverses for all rows and trees at once.

The classifier is fitted on the driver on at most max_train labelled rows (TRAIN_ROWS, 20,000 by default): those with the
smallest hash of doc_id among the rows whose crc32(doc_id as text) mod 5 is not 0. Everything is scored.

Defined cases: null and empty texts have all statistics 0 and get a score like any other; labels that are null or of no
document are ignored, and of repeated labels the largest counts; with no labels or one class only, the score is that
class's share (0.5 without labels); repeated rows are scored alike, and of rows of one doc_id one is learned from; a null
doc_id is not held out; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from timberline.llm.common import Chunk, chunks, free, hash_sample

TRAIN_ROWS, TREES, DEPTH, BINS, RATE = 20_000, 60, 4, 64, 0.2
THRESHOLD = 0.3
KINDS = ["upper", "lower", "digit", "symbol", "mark", "high"]


def _classes() -> np.ndarray:
    c = np.full(256, KINDS.index("mark"), np.int64)
    c[65:91], c[97:123], c[48:58], c[128:] = 0, 1, 2, KINDS.index("high")
    for s in b"#$%&*@^~_=+<>{}[]\\/|`":
        c[s] = KINDS.index("symbol")
    return c


CLASS = _classes()
ALNUM = np.isin(CLASS, [0, 1, 2, KINDS.index("high")])
N_FEATURES = len(KINDS) + 12


def features(c: Chunk) -> np.ndarray:
    """One row of statistics for each document of a chunk."""
    n, nk = len(c.rows), len(KINDS)
    out = np.zeros((n, N_FEATURES), np.float32)
    if not len(c.hash):
        return out
    words = np.maximum(c.counts, 1).astype(np.float64)
    size = (c.ends - c.starts).astype(np.float64)
    total = lambda x: np.bincount(c.doc, weights=x, minlength=n)
    letters = np.maximum(total(size), 1)
    for k in range(nk):  # bytes of a kind, from running sums at word bounds
        run = np.concatenate([[0], np.cumsum(CLASS[c.buf] == k)])
        out[:, k] = total((run[c.ends] - run[c.starts]).astype(np.float64)) / letters
    new = np.empty(len(c.hash), bool)
    new[0], new[1:] = True, c.doc[1:] != c.doc[:-1]
    again = ~new & np.concatenate([[False], c.hash[1:] == c.hash[:-1]])
    order = np.lexsort((c.hash, c.doc))
    h, d = c.hash[order], c.doc[order]
    head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]))
    often = np.diff(np.concatenate([head, [len(h)]]))
    top = np.zeros(n)
    np.maximum.at(top, d[head], often)
    g, at = c.grams(2)
    gd = c.doc[at]
    o2 = np.lexsort((g, gd))
    pairs = np.bincount(gd[o2][np.concatenate([[True], (g[o2][1:] != g[o2][:-1]) | (gd[o2][1:] != gd[o2][:-1])])], minlength=n) if len(g) else np.zeros(n)
    last, first = c.buf[c.ends - 1], c.buf[c.starts]
    mean = letters / words
    stats = [
        np.log1p(c.counts), mean, np.sqrt(np.maximum(total(size**2) / words - mean**2, 0)), total(~ALNUM[last]) / words, total(CLASS[first] == 0) / words,
        total(again) / words, np.bincount(d[head], minlength=n) / words, top / words, pairs / words, total((size == 1) & ~ALNUM[first]) / words,
        total(np.isin(last, np.frombuffer(b".?!", np.uint8))) / words, total(size > 15) / words,
    ]
    for k, x in enumerate(stats):
        out[:, nk + k] = x
    out[c.counts == 0] = 0
    return out


def text_features(texts: list[str | None]) -> np.ndarray:
    out = np.zeros((len(texts), N_FEATURES), np.float32)
    for c in chunks(texts):
        out[c.rows] = features(c)
    return out


class Forest:
    """Trees of one depth in heap order: node i has children 2i+1 and 2i+2; rows go right if value > threshold."""

    def __init__(self, base: float, depth: int, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.depth, self.feature, self.threshold, self.leaf = base, depth, feature, threshold, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        n, trees = len(x), len(self.leaf)
        f = np.full(n, self.base)
        for lo in range(0, n, 4096):
            part = x[lo : lo + 4096]
            rows, t = np.arange(len(part))[:, None], np.arange(trees)[None, :]
            at = np.zeros((len(part), trees), np.int64)
            for _ in range(self.depth if trees else 0):
                at = 2 * at + 1 + (part[rows, self.feature[t, at]] > self.threshold[t, at])
            if trees:
                f[lo : lo + 4096] += self.leaf[t, at - (2**self.depth - 1)].sum(1)
        return 1 / (1 + np.exp(-f))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, l2: float = 1.0, min_rows: int = 5) -> Forest:
    empty = np.zeros((0, 2**depth - 1))
    if len(y) == 0 or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
        return Forest(float(np.log(p / (1 - p))), depth, empty.astype(np.int64), empty, np.zeros((0, 2**depth)))
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    f = np.full(n, base)
    feature, threshold, leaf = np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth))
    for t in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            nodes, lo = 2**level, 2**level - 1
            best, pick, cut = np.full(nodes, 1e-9), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
            for j in range(m):
                key = (at - lo) * bins + binned[:, j]
                sg, sh, sn = (np.bincount(key, weights=w, minlength=nodes * bins).reshape(nodes, bins).cumsum(1) for w in (g, h, np.ones(n)))
                tg, th, tn = sg[:, -1:], sh[:, -1:], sn[:, -1:]
                gain = sg**2 / (sh + l2) + (tg - sg) ** 2 / (th - sh + l2) - tg**2 / (th + l2)
                gain[(sn < min_rows) | (tn - sn < min_rows)] = 0
                k = gain.argmax(1)
                v = gain[np.arange(nodes), k]
                win = v > best
                best[win], pick[win], cut[win] = v[win], j, k[win]
            split = best > 1e-9
            for i in np.flatnonzero(split):
                feature[t, lo + i], threshold[t, lo + i] = pick[i], edges[pick[i]][cut[i]] if cut[i] < len(edges[pick[i]]) else np.inf
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > threshold[t, at])
        end = at - (2**depth - 1)
        sg, sh = np.bincount(end, weights=g, minlength=2**depth), np.bincount(end, weights=h, minlength=2**depth)
        leaf[t] = rate * sg / (sh + l2)
        f += leaf[t][end]
    return Forest(base, depth, feature, threshold, leaf)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train: int = TRAIN_ROWS) -> Forest:
    """Fits on at most max_train labelled rows, which come to the driver as statistics."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("quality").alias("y"))
    sample = hash_sample(known, "doc_id", max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = text_features(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample.select(F.col("doc_id").cast("long"), F.col("y").cast("double"))), "doc_id")
    # of rows that repeat a doc_id one is learned from
    once = rows.mapInArrow(run, "doc_id long, y double, x binary").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x"))
    got = sorted((r.doc_id, bytes(r.x), r.y) for r in once.collect())
    x = np.frombuffer(b"".join(r[1] for r in got), np.float32).reshape(len(got), N_FEATURES)
    return fit(x, np.array([r[2] for r in got], np.float64))


def add_score(docs: DataFrame, forest: Forest) -> DataFrame:
    """docs with score (free() names it where docs has such a column), one pass over the texts."""
    at = docs.columns.index("text") if "text" in docs.columns else [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = forest.score(text_features(b.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], names=[*b.schema.names, "score"])

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names may have marks that are not passed on
    return plain.mapInArrow(run, StructType([*plain.schema.fields, StructField("score", DoubleType())])).toDF(*docs.columns, free("score", docs))


def classify(docs: DataFrame, labels: DataFrame, max_train: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted; free() names them where docs has such columns."""
    out = add_score(docs, train(docs, labels, max_train))
    return out.withColumn(free("predicted", docs), (F.col(free("score", docs)) >= threshold).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
