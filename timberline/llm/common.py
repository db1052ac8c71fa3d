"""Shared helpers of the corpus operators: words, column names, vectorised word hashing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.plans.durable import discard, durable, results, shared_dir, small  # noqa: F401

#: White space that separates words, as a Java character class and as a list for trim functions.
SPACE_CLASS = "[ \\t-\\r]+"
SPACES = " \t\n\u000b\f\r"
#: Bytes of text that one vectorised pass handles at a time, and bytes of a word that it hashes.
CHUNK_BYTES, LONG_WORD = 1 << 20, 64


def let(df: DataFrame, name: str, value: Column) -> DataFrame:
    """withColumn whose value is computed once a row: a generator keeps the optimizer from copying a costly expression into every place that uses it."""
    return df.withColumn(name, F.explode(F.array(value)))


def free(name: str, df: DataFrame) -> str:
    """name, with underscores behind it while df has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own(df: DataFrame) -> list[Column]:
    """All columns of df, whatever marks are in their names."""
    return [quoted(c) for c in df.columns]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most n rows, those with the smallest hashes of key. A bound on the hash, set from a count, keeps what is sorted near n rows, however many partitions there are."""
    h, span = F.pmod(F.xxhash64(key), F.lit(1 << 30)), 1 << 30
    total = df.count()
    if total > n:
        df = df.where(h < int(span * (n + 6 * n**0.5 + 10) / total) + 1)
    return df.orderBy(h, key).limit(n)


def words(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+ of a text; empty for null or blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS))


def n_words(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.lit(0).cast("long")).otherwise(F.size(F.split(bare, SPACE_CLASS)).cast("long"))


# ---- vectorised hashing of words (numpy, 64 bit) ----

#: What of eight bytes belongs to a word with 0 to 8 of them left.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words buf[start:end]. Words of up to seven bytes have different hashes; longer ones are folded eight bytes
    at a time, very long ones by a cryptographic hash. Whoever needs equality of words compares their bytes."""
    size = ends - starts
    at8 = np.ndarray(len(buf) + 1, "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]).data, strides=(1,))  # eight bytes from each place on
    h = mix((at8[starts] & _MASK[np.minimum(size, 7)]) | (np.minimum(size, 255).astype(np.uint64) << np.uint64(56)))
    more = np.flatnonzero((size > 7) & (size <= LONG_WORD))
    done = 7
    while len(more):
        left = size[more] - done
        h[more] = mix(h[more] ^ mix((at8[starts[more] + done] & _MASK[np.minimum(left, 8)]) + np.uint64(done)))
        done += 8
        more = more[left > 8]
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


class Chunk:
    """Some documents' words in one buffer: bytes of words with one space between, word starts and ends, words per document, 64-bit word hashes."""

    def __init__(self, rows: list[int], split: list[list[bytes]]):
        self.rows, self.counts = rows, np.array([len(w) for w in split], np.int64)
        self.text = b" ".join(b" ".join(w) for w in split if w)
        buf = np.frombuffer(self.text, np.uint8)
        gaps = np.flatnonzero(buf == 32)
        self.starts = np.concatenate([[0], gaps + 1]) if len(buf) else np.zeros(0, np.int64)
        self.ends = np.concatenate([gaps, [len(buf)]]) if len(buf) else np.zeros(0, np.int64)
        self.doc = np.repeat(np.arange(len(rows)), self.counts)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.hash = word_hashes(buf, self.starts, self.ends)
        self.buf = buf

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word grams inside documents, and each gram's first word."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
        with np.errstate(over="ignore"):
            out = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                out = mix(out + self.hash[j : n - k + 1 + j] + np.uint64(j + 1))
        return out[at], at


def chunks(texts: list[str | None], lower: bool = False) -> Iterator[Chunk]:
    """Splits texts into words (null: none) and yields them in chunks of bounded size; rows are positions in texts."""
    rows, split, size = [], [], 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if t else b""
        w = (b.lower() if lower else b).split()
        if rows and size + len(b) > CHUNK_BYTES:
            yield Chunk(rows, split)
            rows, split, size = [], [], 0
        rows.append(i)
        split.append(w)
        size += len(b)
    if rows:
        yield Chunk(rows, split)
