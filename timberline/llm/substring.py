"""Substring dedup with super-k-mers.

A window is `width` consecutive words of a document. Words covered by a window whose word sequence also starts in a
document with a smaller doc_id are removed; windows are judged on the input.

Each window's minimiser is the smallest hash of its `inner`-word grams. Consecutive windows that share it are one
super-k-mer: their words travel once, as one packed string, to the bucket of the minimiser, where windows are sorted and
equal ones (sorted by a hash, then compared byte by byte) are counted exactly. Every task packs its super-k-mers of a
bucket together and compresses them, and sends equal strings once: an equal string in a larger doc_id is decided on the
spot and only its place travels, to a bucket of its document, so a passage in very many documents makes no large bucket.
Packed strings are compressed with a dictionary trained on slices of some documents, so few strings of a bucket shrink as
much as many, however many buckets a large table has. Buckets are dealt to partitions in turn.
Windows of a minimiser that would fill a bucket many times over go to buckets by a second one, over longer grams.

Defined cases: null and blank texts have no words; fewer words than a window are kept; documents without doc_id (and
one of 2**63 - 1) come after all others and do not judge each other; rows that repeat a doc_id do not judge each other either (their words go only for
a smaller doc_id); long texts are cut like any other; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import Chunk, chunks, mix, small

WIDTH, INNER = 13, 3
NO_ID = (1 << 63) - 1
#: Packed bytes that a task gathers before it sends them, and raw bytes that a bucket should hold.
FLUSH, BUCKET = 16 << 20, 4 << 20
#: Raw bytes of a minimiser that is split by grams of SECOND words, and bytes of text that estimate these.
HOT_BYTES, SECOND, SAMPLE_BYTES = 16 << 20, 8, 64 << 20
#: Level of compression, bytes of its dictionary, and the documents and characters of each that it is trained on.
LEVEL, DICTIONARY, SLICES, SLICE = 3, 112 << 10, 2_000, 2_048

PACKED = "bucket int, meta binary, body binary, gone binary"
SPAN = "doc_id long, mark long, lo int, hi int"


@lru_cache(maxsize=2)
def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def compression(rows: DataFrame, n: int) -> bytes:
    """A dictionary for the compression of strings like those of n rows; empty where there is too little to train it on. What
    is sampled has no part in the result, only in the size of what travels."""
    h = F.pmod(F.xxhash64("id", "mark"), F.lit(1 << 30))
    some = rows.where(h < int((1 << 30) * (SLICES + 6 * SLICES**0.5 + 10) / max(n, 1)) + 1)
    at = F.pmod(h, F.greatest(F.length("text") - SLICE, F.lit(1))).cast("int") + 1
    got = some.select(F.substring("text", at, F.lit(SLICE)).alias("t")).where(F.length("t") > 0).limit(2 * SLICES).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY, [r["t"].encode("utf-8", "surrogatepass") for r in got], level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def _pack(cols: list[np.ndarray], z: zstandard.ZstdCompressor) -> bytes:
    """Columns doc_id and mark (int64), first and count (int32)."""
    return z.compress(b"".join(c.astype(t).tobytes() for c, t in zip(cols, ("<i8", "<i8", "<i4", "<i4"), strict=True)))


def _unpack(raw: bytes, z: zstandard.ZstdDecompressor) -> list[np.ndarray]:
    b = z.decompress(raw)
    n, out, at = len(b) // 24, [], 0
    for t in ("<i8", "<i8", "<i4", "<i4"):
        size = n * np.dtype(t).itemsize
        out.append(np.frombuffer(b, t, n, at))
        at += size
    return out


def minima(c: Chunk, width: int, inner: int) -> np.ndarray:
    """For each word the smallest hash of the `inner`-word grams in the `width` words from it on."""
    m = len(c.hash) - inner + 1
    low = c.hash[:m].copy()
    with np.errstate(over="ignore"):
        for j in range(1, inner):
            low = mix(low + c.hash[j : m + j] * np.uint64(2 * j + 1))
    span, have = width - inner + 1, 1
    while have < span:  # smallest of `span` grams by doubling
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    return low


def super_kmers(c: Chunk, width: int, inner: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and number of windows of each super-k-mer of a chunk, and its minimiser; windows whose minimiser is in hot (sorted) go by one over longer grams."""
    n = len(c.hash) - width + 1
    at = np.flatnonzero(c.doc[:n] == c.doc[width - 1 :]) if n > 0 else np.zeros(0, np.int64)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    v = minima(c, width, inner)[at]
    if hot is not None and len(hot):
        often = hot[np.minimum(np.searchsorted(hot, v), len(hot) - 1)] == v
        if often.any():
            v[often] = mix(minima(c, width, min(SECOND, width))[at][often] + np.uint64(1))
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (v[1:] != v[:-1]) | (c.doc[at[1:]] != c.doc[at[:-1]])])
    head = np.flatnonzero(new)
    return at[head], np.diff(np.concatenate([head, [len(at)]])), v[head]


def hot_minimisers(rows: DataFrame, raw: int, width: int, inner: int) -> np.ndarray:
    """Sorted minimisers whose super-k-mers are estimated to hold more than HOT_BYTES and a millionth of all. The estimate is
    from documents chosen by a hash; it only decides which bucket a window goes to, and all equal windows go to the same."""
    share = min(64, max(1, raw // SAMPLE_BYTES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column("text").to_pylist()):
                first, n, v = super_kmers(c, width, inner)
                if len(first):
                    size = c.ends[first + n + width - 2] - c.starts[first]
                    keys, at = np.unique(v, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(at, weights=size).astype(np.int64))], names=["v", "size"])

    sums = rows.where(F.pmod(F.xxhash64("id", "mark"), F.lit(share)) == 0).select("text").mapInArrow(count, "v long, size long").groupBy("v").agg(F.sum("size").alias("size"))
    found = sums.where(F.col("size") * share > max(HOT_BYTES, 3 * raw // 1_000_000)).select("v").collect()  # a million at most
    return np.sort(np.array([r["v"] for r in found], np.int64).view(np.uint64))


class Packer:
    def __init__(self, buckets: int, hot: np.ndarray | None = None, dictionary: bytes = b""):
        self.buckets, self.hot, self.z = buckets, hot, zstandard.ZstdCompressor(level=LEVEL)
        self.text_z = zstandard.ZstdCompressor(level=LEVEL, dict_data=d) if (d := _dictionary(dictionary)) else self.z
        self.clear()

    def clear(self) -> None:
        self.pieces: list[bytes] = []
        self.cols: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, c: Chunk, ids: np.ndarray, marks: np.ndarray, width: int, inner: int) -> None:
        first, count, v = super_kmers(c, width, inner, self.hot)
        if not len(first):
            return
        lo, hi = c.starts[first], c.ends[first + count + width - 2]
        text = c.text
        self.pieces += [text[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        d = c.doc[first]
        self.cols.append((ids[d], marks[d], first - c.first[d], count, (v % np.uint64(self.buckets)).astype(np.int64)))
        self.size += int((hi - lo).sum())

    def flush(self) -> pa.RecordBatch | None:
        if not self.pieces:
            return None
        doc, mark, first, count, bucket = (np.concatenate(x) for x in zip(*self.cols, strict=True))
        # of equal strings only those of the smallest document travel as strings
        least: dict[bytes, int] = {}
        ids = doc.tolist()
        for p, d in zip(self.pieces, ids, strict=True):
            if d < least.get(p, NO_ID + 1):
                least[p] = d
        keep = np.fromiter((least[p] == d for p, d in zip(self.pieces, ids, strict=True)), bool, len(ids))
        where = np.where(keep, bucket, (mix(doc.astype(np.uint64)) % np.uint64(self.buckets)).astype(np.int64))
        order = np.lexsort((~keep, where))
        heads = np.flatnonzero(np.concatenate([[True], np.diff(where[order]) != 0]))
        rows: list[tuple] = []
        for a, b in zip(heads, [*heads[1:], len(order)], strict=True):
            i = order[a:b]
            sent, gone = i[keep[i]], i[~keep[i]]
            rows.append((
                int(where[i[0]]), _pack([x[sent] for x in (doc, mark, first, count)], self.z) if len(sent) else None,
                self.text_z.compress(b"\n".join([self.pieces[k] for k in sent.tolist()])) if len(sent) else None,
                _pack([x[gone] for x in (doc, mark, first, count)], self.z) if len(gone) else None,
            ))
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "meta", "body", "gone"])


def _spans(doc: np.ndarray, mark: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Table:
    return pa.table({"doc_id": pa.array(doc, pa.int64()), "mark": pa.array(mark, pa.int64()), "lo": pa.array(lo, pa.int32()), "hi": pa.array(hi, pa.int32())})


def equal_windows(c: Chunk, key: np.ndarray, at: np.ndarray, piece: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order that puts equal windows side by side, where a new sequence of words begins in it). Windows are sorted by a hash;
    then the bytes of every window are compared with the first one's of its hash, neighbours in one go, and hashes that
    stand for several sequences are taken apart."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    group = np.cumsum(new) - 1
    again, head = order[~new], order[np.flatnonzero(new)][group[~new]]
    o = np.argsort(again)
    again, head = again[o], head[o]
    follows = lambda x: (x[1:] == x[:-1] + 1) & (piece[x[1:]] == piece[x[:-1]])
    cut = np.flatnonzero(np.concatenate([[True], ~(follows(again) & follows(head))])) if len(again) else np.zeros(0, np.int64)
    lo, hi = c.starts[at], c.ends[at + width - 1]
    ends = np.concatenate([cut[1:], [len(again)]]) - 1 if len(cut) else cut
    differs = []
    for i, (a, b, x, y) in enumerate(zip(lo[again[cut]].tolist(), hi[again[ends]].tolist(), lo[head[cut]].tolist(), hi[head[ends]].tolist(), strict=True)):
        if c.text[a:b] != c.text[x:y]:
            differs.append(i)
    if not differs:
        return order, new
    of = np.empty(len(order), np.int64)
    of[order] = group
    apart = np.isin(of, np.unique(of[np.concatenate([again[cut[i] : ends[i] + 1] for i in differs])]))
    exact: dict[tuple[int, bytes], int] = {}
    for i in np.flatnonzero(apart).tolist():
        of[i] = exact.setdefault((int(of[i]), c.text[lo[i] : hi[i]]), len(order) + len(exact))
    order = np.argsort(of, kind="stable")
    return order, np.concatenate([[True], of[order][1:] != of[order][:-1]])


def judge(table: pa.Table, width: int, dictionary: bytes = b"") -> pa.Table:
    """Spans of words to remove, from all super-k-mers of one bucket."""
    z = zstandard.ZstdDecompressor()
    text_z = zstandard.ZstdDecompressor(dict_data=d) if (d := _dictionary(dictionary)) else z
    out: list[pa.Table] = [_spans(*(np.zeros(0, np.int64),) * 4)]
    split: list[bytes] = []
    metas: list[list[np.ndarray]] = []
    for meta, body, gone in zip(*(table.column(x).to_pylist() for x in ("meta", "body", "gone")), strict=True):
        if gone is not None:
            doc, mark, first, count = _unpack(gone, z)
            out.append(_spans(doc, mark, first, first + count + (width - 1)))
        if meta is not None:
            metas.append(_unpack(meta, z))
            split += text_z.decompress(body).split()
    if not metas:
        return pa.concat_tables(out)
    doc, mark, first, count = (np.concatenate(x) for x in zip(*metas, strict=True))
    c = Chunk([0], [split])
    del split
    start = np.concatenate([[0], np.cumsum(count + (width - 1))])[:-1]  # of each piece, in words
    piece = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
    at = start[piece] + inside
    key = np.zeros(len(c.hash) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            key += c.hash[j : j + len(key)] * mix(np.array([j + 1], np.uint64))[0]
    order, new = equal_windows(c, key[at], at, piece, width)
    owner = doc[piece]
    first_doc = np.minimum.reduceat(owner[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    bad = np.zeros(len(order), bool)
    bad[order] = owner[order] > first_doc
    b = np.flatnonzero(bad)
    if len(b):
        p, w = piece[b], first[piece[b]] + inside[b]
        cut = np.concatenate([[True], (p[1:] != p[:-1]) | (w[1:] != w[:-1] + 1)])
        s = np.flatnonzero(cut)
        e = np.concatenate([s[1:], [len(b)]]) - 1
        out.append(_spans(doc[p[s]], mark[p[s]], w[s], w[e] + width))
    return pa.concat_tables(out)


def repeated_spans(rows: DataFrame, width: int = WIDTH, inner: int = INNER) -> DataFrame:
    """doc_id (NO_ID: none), mark, lo, hi: words lo to hi - 1 of that row of marked() are to go."""
    spark = rows.sparkSession
    raw, n = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    buckets = max(1, int(3 * raw / BUCKET))
    parts = min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = spark.sparkContext.broadcast(hot_minimisers(rows, raw, width, inner))
    shared = spark.sparkContext.broadcast(compression(rows, n))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Packer(buckets, hot.value, shared.value)
        for b in batches:
            ids, marks = b.column("id").to_numpy(zero_copy_only=False), b.column("mark").to_numpy(zero_copy_only=False)
            for c in chunks(b.column("text").to_pylist()):
                p.add(c, ids[c.rows], marks[c.rows], width, inner)
                if p.size > FLUSH and (out := p.flush()) is not None:
                    yield out
        if (out := p.flush()) is not None:
            yield out

    packed = rows.select("id", "mark", "text").mapInArrow(pack, PACKED).withColumn("part", (F.col("bucket") % parts).cast("int"))
    return packed.repartitionById(parts, F.col("part")).groupBy("part", "bucket").applyInArrow(lambda t: judge(t, width, shared.value), SPAN)


def marked(docs: DataFrame) -> DataFrame:
    """id (NO_ID: none), mark (0; where a doc_id repeats, 60 bits of the text's MD5, which tell its rows apart), doc_id, text."""
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    again = named.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("again"))
    text_mark = F.conv(F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    return named.join(small(again), "id", "left").select("id", F.when(F.col("again"), text_mark).otherwise(F.lit(0)).cast("long").alias("mark"), "doc_id", "text")


def remove_repeats(docs: DataFrame, width: int = WIDTH, inner: int = INNER) -> DataFrame:
    """doc_id, text (kept words joined by one space), n_words, n_removed."""
    rows = marked(docs)
    spans = repeated_spans(rows, width, inner).groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("s")).withColumnRenamed("doc_id", "id")
    rows = rows.join(spans, ["id", "mark"], "left").select("doc_id", "text", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, n, removed = [], [], []
            for t, lo, hi in zip(b.column("text").to_pylist(), b.column("lo"), b.column("hi"), strict=True):
                w = t.encode("utf-8", "surrogatepass").split() if t else []
                n.append(len(w))
                if lo.is_valid:
                    left: list[bytes] = []
                    at = 0
                    for x, y in zip(lo.as_py(), hi.as_py(), strict=True):
                        if x > at:
                            left += w[at:x]
                        at = max(at, y)
                    w = left + w[at:]
                removed.append(n[-1] - len(w))
                kept.append(b" ".join(w).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], names=["doc_id", "text", "n_words", "n_removed"])

    return rows.mapInArrow(cut, "doc_id long, text string, n_words long, n_removed long")


def query(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
with t as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') w from documents),
p as (select doc_id, unnest(w) x, unnest(range(len(w))) i from t),
k as (select doc_id, unnest(range(len(w) - 12)) i, unnest(list_transform(range(len(w) - 12), lambda j: array_to_string(w[j + 1 : j + 13], ' '))) g from t where len(w) > 12),
f as (select g, min(doc_id) d from k group by g having min(doc_id) < max(doc_id)),
b as (select k.doc_id, k.i, 1 bad from k join f on k.g = f.g where k.doc_id > f.d),
m as (select p.doc_id, p.i, p.x, coalesce(max(b.bad) over (partition by p.doc_id order by p.i rows between 12 preceding and current row), 0) gone from p left join b on p.doc_id = b.doc_id and p.i = b.i),
s as (select doc_id, count(*) n_words, cast(sum(gone) as bigint) n_removed, coalesce(string_agg(x, ' ' order by i) filter (gone = 0), '') kept from m group by doc_id)
select d.doc_id, coalesce(n_words, 0) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from documents d left join s on d.doc_id = s.doc_id"""
