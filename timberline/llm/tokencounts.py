"""Token counts as delta-maintained rollups.

A store is a folder with one delta per committed batch: signed rows of documents (the ledger) and of totals (the rollup).
An insert adds +1 document and +n tokens under its source, language and tokenizer version; a delete adds the negated sum
of what the ledger holds of the document; a revised text does both. Totals are sums over all deltas, so they are additive.
The ledger is in buckets of doc_ids and a batch reads those of its documents only; compact() folds deltas into one.

A batch's delta is written to a folder of its own and counts from the moment that a numbered log entry names it. Of writers
that want one number one gets it, the others make their delta anew from the new state. A batch id that is in the log is
skipped, so retries change nothing; clean() removes what crashed commits left.

Defined cases: null and empty texts count 0 tokens and one document; null source and lang are values of their own; rows
without doc_id cannot be tracked and raise; repeated rows of one document in a batch count once (the row with the most
bytes of text, then tokens, source, lang); deleting an unknown document changes nothing; an insert of a known document counts as its revision;
empty batches commit and change nothing; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import discard, durable, let, shared_dir, small, words
from timberline.plans.durable import file_system

TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: the split pattern that belongs to byte-level BPE vocabularies of this family.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROWS = "doc_id bigint, source string, lang string, tokenizer string, docs bigint, tokens bigint"
LEDGER, BUCKETS = ROWS + ", bucket int", 32
KEYS = ["source", "lang", "tokenizer"]

_loaded: dict[str, Callable[[str], int]] = {}


def counter(version: str, folder: str) -> Callable[[str], int]:
    """Tokens of one text under a tokenizer version: "words", or the name of a tiktoken rank file."""
    if version == "words":
        return lambda t: len(t.encode("utf-8", "surrogatepass").split())
    if version not in _loaded:
        import tiktoken

        with open(f"{folder}/{version}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding(version, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        _loaded[version] = lambda t: len(enc.encode_ordinary(t))
    return _loaded[version]


def count_tokens(docs: DataFrame, versions: list[str], folder: str = TOKENIZER_DIR) -> DataFrame:
    """doc_id, source, lang, size (bytes of the text), tokens (of each version, in order) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [counter(v, folder) for v in versions]
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            size = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
            tokens = pa.array([[c(t) for c in count] for t in texts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("lang"), size, tokens], names=["doc_id", "source", "lang", "size", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.col("source").cast("string"), F.col("lang").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, source string, lang string, size bigint, tokens array<bigint>")


def bucket(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(BUCKETS)).cast("int")


class Store:
    """Committed deltas under one folder of a file system that all executors share: data/<name> holds a delta's ledger, in
    buckets of doc_ids, and rollup; log/<number> names the batch and its data."""

    def __init__(self, spark: SparkSession, path: str, versions: list[str], folder: str = TOKENIZER_DIR):
        self.spark, self.path, self.versions, self.folder = spark, path, versions, folder
        self._fs, _ = file_system(spark, path)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder))) if self._fs.exists(self._path(folder)) else []

    def log(self) -> list[dict]:
        """Entries in order, from the last compaction on."""
        out: list[dict] = []
        for name in reversed([n for n in self._names("log") if n.isdigit()]):
            stream = self._fs.open(self._path(f"log/{name}"))
            out.append(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) | {"number": int(name)})
            stream.close()
            if out[-1]["batch"] is None:
                break
        return out[::-1]

    def batches(self) -> list[str]:
        return sorted(b for e in self.log() for b in (e["batches"] if e["batch"] is None else [e["batch"]]))

    def _append(self, entry: dict, number: int) -> bool:
        """Whether the entry became the one of this number, which only one writer can get: a finished file moves to a name that must be free."""
        aside, final = self._path(f"log/_{uuid.uuid4().hex}"), self._path(f"log/{number:012d}")
        self._fs.mkdirs(self._path("log"))
        stream = self._fs.create(aside, False)
        stream.write(json.dumps(entry).encode())
        stream.close()
        try:
            if self._fs.getScheme() != "file":  # a rename on a shared file system fails if the name is taken
                return not self._fs.exists(final) and self._fs.rename(aside, final)
            try:
                os.link(aside.toUri().getPath(), final.toUri().getPath())  # local renames would overwrite
            except FileExistsError:
                return False
            return True
        finally:
            self._fs.delete(aside, False)

    def _read(self, entries: list[dict], part: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/data/{e['data']}/{part}" for e in entries]
        reader = self.spark.read.schema(schema)
        parts = [reader.parquet(p) for p in paths]
        return functools.reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        return self._read(self.log(), "ledger", LEDGER)

    def _write(self, delta: DataFrame) -> str:
        """Writes a delta's ledger and rollup; the name of its folder."""
        name = uuid.uuid4().hex
        at = f"{self.path}/data/{name}"
        spread = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
        rows = delta.withColumn("bucket", bucket("doc_id"))
        rows.repartition("bucket", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(spread))).write.partitionBy("bucket").parquet(f"{at}/ledger")
        written = self.spark.read.schema(LEDGER).parquet(f"{at}/ledger")
        written.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{at}/rollup")
        return name

    def _state(self, entries: list[dict], ids: DataFrame) -> DataFrame:
        """What the ledger holds of the documents in ids; only their buckets are read."""
        where = [r[0] for r in ids.select(bucket("doc_id").alias("b")).distinct().collect()]  # at most BUCKETS numbers
        rows = self._read(entries, "ledger", LEDGER).where(F.col("bucket").isin(where)) if where else self._read([], "", LEDGER)
        return rows.join(ids, "doc_id", "left_semi").groupBy("doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def commit(self, batch: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Applies a batch of documents to insert or revise and of doc_ids to delete, once; False if the batch is there already.
        A document in both is revised. If another batch gets its place in the log first, the delta is made anew from what is then there."""
        if batch in self.batches():
            return False
        new = self.spark.createDataFrame([], ROWS)
        if upserts is not None:
            one = count_tokens(upserts, self.versions, self.folder).withColumn("doc_id", F.coalesce("doc_id", F.raise_error(F.lit("a document without doc_id cannot be tracked")).cast("long")))
            one = one.groupBy("doc_id").agg(F.max(F.struct("size", "tokens", "source", "lang")).alias("m")).select("doc_id", "m.*")
            each = F.posexplode(F.arrays_zip(F.array(*map(F.lit, self.versions)).alias("tokenizer"), F.col("tokens").alias("tokens"))).alias("i", "t")
            new = durable(one.select("doc_id", "source", "lang", each).select("doc_id", "source", "lang", "t.tokenizer", F.lit(1).cast("long").alias("docs"), "t.tokens"), "token-counts")
        ids = new.select("doc_id")
        if deletes is not None:
            ids = ids.unionByName(deletes.select(F.col("doc_id").cast("long")))
        ids = ids.where("doc_id is not null").distinct()
        while True:
            entries = self.log()
            if batch in self.batches():
                return False
            delta = new
            if entries:
                delta = new.unionByName(self._state(entries, ids).select("doc_id", *KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")))
            name = self._write(delta)
            if self._append({"batch": batch, "data": name}, (entries[-1]["number"] if entries else 0) + 1):
                if upserts is not None:
                    discard(new)
                return True
            self._fs.delete(self._path(f"data/{name}"), True)

    def compact(self) -> bool:
        """Folds all deltas into one; False if a batch was committed meanwhile. Folders of the deltas stay until clean()."""
        entries = self.log()
        if not entries:
            return False
        every = self._read(entries, "ledger", LEDGER).groupBy("doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")
        name = self._write(every)
        done = self._append({"batch": None, "batches": self.batches(), "data": name}, entries[-1]["number"] + 1)
        if not done:
            self._fs.delete(self._path(f"data/{name}"), True)
        return done

    def clean(self) -> int:
        """Deletes folders that the log does not need, of crashed commits or before a compaction; their number. No commit may be under way."""
        used = {e["data"] for e in self.log()}
        gone = [n for n in self._names("data") if n not in used]
        for n in gone:
            self._fs.delete(self._path(f"data/{n}"), True)
        return len(gone)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens from the rollups alone."""
        rollup = self._read(self.log(), "rollup", "source string, lang string, tokenizer string, docs bigint, tokens bigint")
        return rollup.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")


def query(spark, sf_dir: str) -> DataFrame:
    """All documents come in; then toxic ones are deleted and those of low quality come back with runs of one word squeezed to one; each batch is sent twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    store = Store(spark, f"{shared_dir(spark)}/timberline/token-store-{uuid.uuid4().hex}", ["byte_bpe_50k", "words"])
    bad, toxic = (labels.where(f"{c} = {v}").select("doc_id").distinct() for c, v in (("quality", 0), ("toxic", 1)))
    squeezed = let(docs.join(small(bad), "doc_id", "left_semi"), "w", words(F.col("text")))
    squeezed = squeezed.withColumn("text", F.array_join(F.filter("w", lambda x, i: (i == 0) | (x != F.get("w", i - 1))), " ")).drop("w")
    for _ in range(2):
        store.commit("0001-all", docs)
        store.commit("0002-labelled", squeezed, toxic)
    return store.totals()
