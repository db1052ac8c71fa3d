"""Approximate nearest neighbours by score-aware anisotropic quantisation.

Nearest in Euclidean distance is largest inner product of (q, 1) with (x, -|x|^2 / 2), so the index works on the extended
vectors y, scaled so that all coordinates matter alike. A product quantiser with 16 codewords for each pair of
coordinates (four bits a code, two codes a byte) is trained and applied under the anisotropic loss
    eta * |r_par|^2 + |r_orth|^2,
where r = y - code(y) and r_par is its part parallel to y: errors that change large inner products cost more. Codes are
improved by coordinate descent on that loss. A search adds up table entries for the codes of each run of SCAN_ROWS rows of
a partition, takes the best `rerank` of the run and ranks these by exact distance in double precision; the best of all
runs are merged.

Codebooks are trained on at most `sample` vectors (TRAIN, 8,192 by default: those with the smallest hash of vec_id); every
vector is encoded. Queries go out in blocks of about QUERY_BLOCK vectors, which bounds what is sent with a task; each block
scans all codes and adds its results to one table.

Defined cases: vectors that are null, zero, or hold null or non-finite components, or whose length is not the commonest
one (the larger of equally common), take no part; neither do rows without vec_id. Ties go to the smaller vec_id; of
repeated rows of a vec_id the smallest vector counts; fewer candidates than k are all returned; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.common import discard, durable, hash_sample, results

TRAIN, QUERY_BLOCK, SCAN_ROWS, RERANK, K = 8_192, 4_096, 16_384, 400, 10
ETA, CODES = 4.0, 16


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>), one row a vec_id."""
    v = F.col(column).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    return rows


class Quantizer:
    """Codebooks (pairs of coordinates x 16 x 2) over extended, scaled vectors."""

    def __init__(self, scale: float, books: np.ndarray, eta: float):
        self.scale, self.books, self.eta = scale, books, eta

    @staticmethod
    def extend(x: np.ndarray, scale: float) -> np.ndarray:
        y = np.concatenate([x, -0.5 * (x**2).sum(1, keepdims=True) / scale], 1)
        return np.concatenate([y, np.zeros((len(y), y.shape[1] % 2))], 1)

    def encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes (rows x pairs), by coordinate descent on the anisotropic loss."""
        y = self.extend(x, self.scale)
        n, m = len(y), len(self.books)
        unit = y / np.maximum(np.sqrt((y**2).sum(1, keepdims=True)), 1e-30)
        parts, units = y.reshape(n, m, 2), unit.reshape(n, m, 2)
        codes = np.zeros((n, m), np.uint8)
        par = np.zeros(n)  # parallel residual so far
        own = np.zeros((n, m))
        for j in range(m):  # start: plain nearest codeword
            d = ((parts[:, j, None, :] - self.books[j]) ** 2).sum(2)
            codes[:, j] = d.argmin(1)
            own[:, j] = ((parts[:, j] - self.books[j][codes[:, j]]) * units[:, j]).sum(1)
        par = own.sum(1)
        for _ in range(rounds):
            for j in range(m):
                r = parts[:, j, None, :] - self.books[j]
                along = (r * units[:, j, None, :]).sum(2)
                rest = (par - own[:, j])[:, None]
                # |r|^2 + (eta - 1) * (parallel part)^2 as far as it depends on this code
                codes[:, j] = ((r**2).sum(2) + (self.eta - 1) * (rest + along) ** 2).argmin(1)
                new = along[np.arange(n), codes[:, j]]
                par += new - own[:, j]
                own[:, j] = new
        return codes

    @classmethod
    def train(cls, x: np.ndarray, eta: float = ETA, rounds: int = 6, seed: int = 5) -> Quantizer:
        scale = max(float(np.sqrt(((0.5 * (x**2).sum(1)) ** 2).mean() / max((x**2).mean(), 1e-30))), 1e-30)
        y = cls.extend(x, scale)
        n, m = len(y), y.shape[1] // 2
        pick = np.random.default_rng(seed).choice(n, CODES, replace=n < CODES)
        q = cls(scale, y.reshape(n, m, 2)[pick].transpose(1, 0, 2).copy(), eta)
        unit = (y / np.maximum(np.sqrt((y**2).sum(1, keepdims=True)), 1e-30)).reshape(n, m, 2)
        parts = y.reshape(n, m, 2)
        for _ in range(rounds):
            codes = q.encode(x, rounds=1)
            dec = np.stack([q.books[j][codes[:, j]] for j in range(m)], 1)
            par = ((parts - dec) * unit).sum((1, 2))
            for j in range(m):
                # least squares for a codeword c: sum over its rows of |y-c|^2 + (eta-1) (rest + u.(y-c))^2
                rest = par - ((parts[:, j] - dec[:, j]) * unit[:, j]).sum(1)
                for c in range(CODES):
                    i = np.flatnonzero(codes[:, j] == c)
                    if len(i):
                        u, z = unit[i, j], parts[i, j]
                        a = len(i) * np.eye(2) + (eta - 1) * u.T @ u
                        b = z.sum(0) + (eta - 1) * (u * ((u * z).sum(1) + rest[i])[:, None]).sum(0)
                        q.books[j, c] = np.linalg.solve(a, b)
                dec[:, j] = q.books[j][codes[:, j]]
                par = rest + ((parts[:, j] - dec[:, j]) * unit[:, j]).sum(1)
        return q

    def pack(self, codes: np.ndarray) -> np.ndarray:
        codes = np.concatenate([codes, np.zeros((len(codes), codes.shape[1] % 2), np.uint8)], 1)
        return codes[:, ::2] | (codes[:, 1::2] << 4)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """queries x bytes x 256: what both codes of a byte add to the inner product."""
        q = np.concatenate([queries, np.full((len(queries), 1), self.scale)], 1)
        q = np.concatenate([q, np.zeros((len(q), q.shape[1] % 2))], 1).reshape(len(q), -1, 2)
        t = np.einsum("qmd,mcd->qmc", q, self.books).astype(np.float32)
        t = np.concatenate([t, np.zeros((len(t), t.shape[1] % 2, CODES), np.float32)], 1)
        return (t[:, 1::2, :, None] + t[:, ::2, None, :]).reshape(len(t), -1, 256)


def build(vectors: DataFrame, sample: int = TRAIN) -> tuple[DataFrame, Quantizer | None]:
    """(index with vec_id, v and code of every usable vector, quantiser)."""
    rows = found = durable(usable(vectors), "vectors")
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if sizes is None:
        return rows.withColumn("code", F.lit(None).cast("binary")), None
    dim = sizes["dim"]
    rows = rows.where(F.size("v") == dim)
    got = hash_sample(rows, "vec_id", sample).collect()
    q = Quantizer.train(np.array([r.v for r in got], np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("v").flatten().to_numpy().reshape(-1, dim)
                code = q.pack(q.encode(x))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array([c.tobytes() for c in code], pa.binary())], names=["vec_id", "v", "code"])

    index = durable(rows.select(F.col("vec_id").cast("long"), "v").mapInArrow(run, "vec_id long, v array<double>, code binary"), "ann-index")
    discard(found)
    return index, q


def nearest(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, qids: np.ndarray, qx: np.ndarray, lut: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k of some rows for each query: query number, vec_id, exact distance. ids ascend."""
    n, keep = len(ids), min(len(ids), rerank + 1)  # one more: a query may find itself
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(qids)):
        score = np.zeros(n, np.float32)
        for b in range(codes.shape[1]):
            score += lut[i, b][codes[:, b]]
        if keep < n:
            bound = np.partition(score, n - keep)[n - keep]
            above, equal = np.flatnonzero(score > bound), np.flatnonzero(score == bound)
            at = np.concatenate([above, equal[: keep - len(above)]])
        else:
            at = np.arange(n)
        at = at[ids[at] != qids[i]]
        d = np.sqrt(((x[at] - qx[i]) ** 2).sum(1))
        best = np.lexsort((ids[at], d))[:k]
        out.append((np.full(len(best), i), ids[at[best]], d[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def search(index: DataFrame, q: Quantizer | None, is_query: Column, k: int = K, rerank: int = RERANK, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each index row that satisfies is_query its k nearest other rows."""
    schema = "query_id long, vec_id long, score double"
    if q is None:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    wanted = index.where(is_query).select("vec_id", "v")
    blocks = max(1, -(-wanted.count() // block))
    put, found = results(index.sparkSession, "ann-found", schema)
    for n in range(blocks):  # a block's queries come to the driver and go out with the tasks
        got = sorted((r.vec_id, r.v) for r in wanted.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).collect())
        if got:
            shared = index.sparkSession.sparkContext.broadcast((q, np.array([g[0] for g in got]), np.array([g[1] for g in got], np.float64)))
            put(scan(index, shared, k, rerank, schema))
            shared.destroy()
    ranked = found().withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of all batches in tables of `rows` rows, the last one shorter, whatever the batches' size."""
    held, n = [], 0
    for b in batches:
        while b.num_rows:
            take = min(rows - n, b.num_rows)
            held.append(b.slice(0, take))
            b, n = b.slice(take), n + take
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def scan(index: DataFrame, shared: Broadcast, k: int, rerank: int, schema: str) -> DataFrame:
    """query_id, vec_id, score of the best k of each partition; shared holds the quantiser, the queries' ids and vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quant, ids_q, x_q = shared.value
        got: list[tuple[np.ndarray, ...]] = []
        for b in runs(batches, SCAN_ROWS):
            ids = b.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            x = b.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
            codes = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            found = [nearest(ids[order], x, codes, ids_q[s : s + 64], x_q[s : s + 64], quant.tables(x_q[s : s + 64]), k, rerank) for s in range(0, len(ids_q), 64)]
            got.append((np.concatenate([f[0] + 64 * i for i, f in enumerate(found)]), np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])))
            if len(got) > 1:  # keep k of each query from the batches so far
                i, v, d = (np.concatenate(c) for c in zip(*got, strict=True))
                o = np.lexsort((v, d, i))
                i, v, d = i[o], v[o], d[o]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                got = [(i[rank < k], v[rank < k], d[rank < k])]
        for i, v, d in got:
            yield pa.RecordBatch.from_arrays([pa.array(ids_q[i], pa.int64()), pa.array(v, pa.int64()), pa.array(d, pa.float64())], names=["query_id", "vec_id", "score"])

    return index.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    index, q = build(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(index, q, F.col("vec_id") % 100 == 0)

