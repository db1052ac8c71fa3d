"""N-gram Jaccard join with adaptive multi-match prefixes, and its connected components.

A document's set holds its distinct k-word shingles (lower-cased A-Z; fewer words: the whole sequence as one shingle).
Sets x and y link when den * |x n y| >= num * |x u y|. Documents of one sequence of words are one node, named by half of a
128-bit BLAKE2 digest of it (by the other half where two digests share the first); only nodes are joined.

Order. Shingles are ordered by an estimated frequency, rarest first, then by hash. The estimates come from a sketch of
fixed size (SKETCH counters) filled from all documents; any order gives right results, this one makes few candidates.

Prefixes. If x and y link, they share o >= num / (num + den) * (|x| + |y|) shingles, and the first l shared ones lie in
the first |x| - o + l of x and the first |y| - o + l of y, so in their first |x| - ceil(t |x|) + l (t = num / den). Each
document lengthens its prefix by the l that minimises an estimated cost: the postings its prefix meets, plus VERIFY times
the candidates left when l matches are required, about postings / l. A pair must then share min(l_x, l_y) prefix shingles
before its texts are compared.

A pair is a candidate where it shares its first shingle, if that leaves o shingles in both, and if what it shares up to its
last shared prefix shingle and the shorter rest after that are o or more.

Groups. Components need a spanning set of links, not all pairs in a group. First, in some rounds, every node is paired
with one hub of a shingle it shares, the node whose shingles are the most frequent, which is near the centre of a group of
near copies; these pairs, too, need min(l_x, l_y) shared prefix shingles and room for a link. Then the join proper makes
candidates only between different components, all of them, so no link that would join two components is lost. Candidates
are counted on 64-bit shingle hashes; pairs that link by these are compared shingle by shingle.

Skew. Shingles with many estimated postings are spread over several partitions by node; a task sends equal texts once.
Joins on a hot shingle split one side by node and send the other to every part.

Defined cases: null and blank texts have no shingles, link with nothing and are their own component; rows without doc_id
come back with a null component and join nothing; repeated rows of a doc_id are documents with equal id; long texts are
used whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm import common
from timberline.llm.common import Chunk, chunks, discard, durable, free, mix, own

SKETCH, SLICES = 1 << 20, 64
MOST_MATCHES, VERIFY, HOT, COLD, ROUNDS = 6, 50.0, 2_000, 32, 1
#: Rows of a hot shingle that one part of a split join gets; bytes of a table that is broadcast.
SPREAD, SMALL = 5_000, 32 << 20
#: Bytes of text that are compared at a time.
PAIR_BYTES = 2 << 20


def small(df: DataFrame, of: DataFrame) -> DataFrame:
    return common.small(df, size=SMALL, of=of)


def digests(c: Chunk) -> np.ndarray:
    """Two 64-bit halves of the digest of each document's words (rows x 2)."""
    out = np.zeros((len(c.rows), 2), np.int64)
    for i in np.flatnonzero(c.counts).tolist():
        a, b = c.first[i], c.first[i + 1] - 1
        out[i] = np.frombuffer(hashlib.blake2b(c.text[c.starts[a] : c.ends[b]], digest_size=16).digest(), "<i8")
    return out


def shingle_sets(c: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Document number in the chunk and hash of its distinct shingles, sorted by both."""
    h, at = c.grams(k)
    d = c.doc[at]
    few = np.flatnonzero((c.counts > 0) & (c.counts < k))
    if len(few):
        one = np.full(len(few), 0, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k - 1):
                more = c.counts[few] > j
                one[more] = mix(one[more] + c.hash[c.first[few[more]] + j] + np.uint64(j + 101))
        h, d = np.concatenate([h, one]), np.concatenate([d, few])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, bool)
    return d[new], h[new]


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """One row a document: doc_id, th (MD5 of the text), n (set size), node and alt (halves of the digest of its words); and rows with slice and sketch."""
    rows = docs.select(F.col("doc_id").cast("long"), F.md5(F.col("text").cast("binary")).alias("th"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.uint32)
        names = ["doc_id", "th", "n", "node", "alt", "slice", "sketch"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for b in batches:
            n, node = np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, 2), np.int64)
            for c in chunks(b.column("text").to_pylist(), lower=True):
                d, h = shingle_sets(c, k)
                counts += np.bincount((h & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
                n[c.rows] = np.bincount(d, minlength=len(c.rows))
                node[c.rows] = digests(c)
            none = [pa.nulls(b.num_rows, t) for t in kinds[5:]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(n), pa.array(node[:, 0]), pa.array(node[:, 1]), *none], names=names)
        z = zstandard.ZstdCompressor(level=1)
        parts = [z.compress(x.tobytes()) for x in np.split(counts, SLICES)] if counts.any() else []
        if parts:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(SLICES, t) for t in kinds[:5]), pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return rows.mapInArrow(run, "doc_id long, th string, n long, node long, alt long, slice int, sketch binary")


def merged_sketch(prints: DataFrame) -> np.ndarray:
    """Estimated counts above the mean load of a counter; SKETCH numbers come to the driver, whatever the input."""

    def add(t: pa.Table) -> pa.Table:
        z = zstandard.ZstdDecompressor()
        total = np.zeros(SKETCH // SLICES, np.uint64)
        for s in t.column("sketch").to_pylist():
            total += np.frombuffer(z.decompress(s), np.uint32)
        return pa.table({"slice": t.column("slice").slice(0, 1), "sketch": pa.array([np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes()], pa.binary())})

    got = prints.where("slice is not null").select("slice", "sketch").groupBy("slice").applyInArrow(add, "slice int, sketch binary").collect()
    counts = np.zeros(SKETCH)
    for r in got:
        counts[r["slice"] * (SKETCH // SLICES) : (r["slice"] + 1) * (SKETCH // SLICES)] = np.frombuffer(r["sketch"], np.uint32)
    return np.maximum(counts - counts.mean(), 0).astype(np.float32)


def prefix_rows(c: Chunk, k: int, num: int, den: int, sketch: np.ndarray, skip: set[int], others: set[tuple[int, int]]) -> tuple[np.ndarray, ...]:
    """token, node, n, l, pop, salt, i (place in the prefix) of a chunk's prefixes; equal texts once. Digests in others name their node by the second half."""
    d, h = shingle_sets(c, k)
    if not len(h):
        return (np.zeros(0, np.int64),) * 7
    size = np.bincount(d, minlength=len(c.rows)).astype(np.int64)
    ends = np.cumsum(size)
    both = digests(c)
    node = both[:, 0]
    if others:
        node = np.array([y if (x, y) in others else x for x, y in both.tolist()], np.int64)
    use = np.zeros(len(size), bool)
    for i, x in enumerate(node.tolist()):
        if size[i] and x not in skip:
            skip.add(x)
            use[i] = True
    est = sketch[(h & np.uint64(SKETCH - 1)).astype(np.int64)]
    order = np.lexsort((h, est, d))  # documents stay together: rarest shingles first
    h, est = h[order], est[order]
    start = ends - size
    need = -(-num * size // den)
    run = np.concatenate([[0], np.cumsum(est, dtype=np.float64)])
    best, l = np.full(len(size), np.inf), np.ones(len(size), np.int64)
    for m in range(1, MOST_MATCHES + 1):
        met = run[start + np.minimum(size - need + m, size)] - run[start]
        cost = met * (1 + VERIFY / m)
        better = (cost < best) & ((m <= need) | (m == 1))
        best[better], l[better] = cost[better], m
    probe = np.minimum(size - need + l, size)
    pop = (run[start + probe] - run[start]) / np.maximum(probe, 1)
    place = np.arange(len(h)) - np.repeat(start, size)
    take = (place < np.repeat(probe, size)) & np.repeat(use, size)
    at = d[take]
    spread = np.maximum(np.ceil(est[take] / HOT), 1).astype(np.int64)
    salt = np.where(spread > 1, 1 + (node[at].view(np.uint64) % spread.astype(np.uint64)).astype(np.int64), 0)
    return h[take].view(np.int64), node[at], size[at], l[at], pop[at], salt, place[take]


ENTRY = "token long, node long, n int, l int, pop float, salt int, i int"
_KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float32(), pa.int32(), pa.int32())


def entries(docs: DataFrame, k: int, num: int, den: int, sketch: np.ndarray, partitions: int, others: set[tuple[int, int]]) -> DataFrame:
    """Prefix entries whose token occurs in at least two nodes."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skip: set[int] = set()
        for b in batches:
            for c in chunks(b.column("text").to_pylist(), lower=True):
                cols = prefix_rows(c, k, num, den, shared.value, skip, others)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, _KINDS, strict=True)], names=[f.split()[0] for f in ENTRY.split(", ")])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if t is None or not t.num_rows:
            return
        token, node, salt = (t.column(x).to_numpy() for x in ("token", "node", "salt"))
        order = np.lexsort((node, token))
        a, b = token[order], node[order]
        first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])  # one entry of a node
        order = order[first]
        a = a[first]
        same = np.concatenate([[False], a[1:] == a[:-1]])
        keep = same | np.concatenate([same[1:], [False]]) | (salt[order] > 0)
        yield from t.take(pa.array(np.sort(order[keep]))).combine_chunks().to_batches(max_chunksize=20_000)

    rows = docs.select("text").mapInArrow(run, ENTRY)
    return rows.repartition(partitions, "token", "salt").mapInArrow(repeated, ENTRY)


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node it is connected with), old of all nodes of edges a, b: smallest labels spread over the edges, then labels of labels are followed, until nothing changes."""
    both = durable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", little=True)
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp"), F.col("node").alias("old")), "labels", little=True)
    while True:
        now = labels.select("node", "comp")
        near = both.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        step = durable(now.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp")), "labels", little=True)
        up = step.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        new = durable(step.join(up, "comp").select("node", F.least("comp", "up").alias("comp"), "old"), "labels", little=True)
        discard(labels, step)
        labels = new
        if new.where("old <> comp").limit(1).count() == 0:
            discard(both)
            return labels


def shingles(text: str, k: int) -> set[bytes]:
    """A text's set, word for word."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(len(w) - k, 0) + 1)} if w else set()


def verify(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """a, b of the pairs whose texts link."""
    p = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, hashes, size = [], [], np.zeros(len(texts), np.int64)
        for c in chunks(texts, lower=True):
            d, h = shingle_sets(c, k)
            r = np.array(c.rows)
            rows.append(r[d])
            hashes.append(h)
            size[r] = np.bincount(d, minlength=len(r))
        return np.concatenate(rows), np.concatenate(hashes), size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = sum(pc.binary_length(whole.column(x)).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("ta", "tb"))
            at = np.flatnonzero(np.diff(np.concatenate([[-1], (np.cumsum(size) - size) // PAIR_BYTES])))  # runs of pairs with so many bytes of text
            for lo, hi in zip(at.tolist(), [*at[1:].tolist(), whole.num_rows], strict=True):
                b = whole.slice(lo, hi - lo)
                (ra, ha, na), (rb, hb, nb) = (sets(b.column(x).to_pylist()) for x in ("ta", "tb"))
                r, h = np.concatenate([ra, rb]), np.concatenate([ha, hb])
                o = np.lexsort((h, r))
                r, h = r[o], h[o]
                both = np.bincount(r[1:][(r[1:] == r[:-1]) & (h[1:] == h[:-1])], minlength=b.num_rows)
                ok = (den * both >= num * (na + nb - both)) & (both > 0)
                for i in np.flatnonzero(ok).tolist():
                    x, y = (shingles(b.column(t)[i].as_py(), k) for t in ("ta", "tb"))
                    ok[i] = den * len(x & y) >= num * len(x | y)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return p.mapInArrow(run, "a long, b long")


def link(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, with th (MD5 of the text) and comp (a node of the component)."""
    spark = docs.sparkSession
    everything = durable(fingerprints(docs, k), "fingerprints")
    prints = everything.where("slice is null").select("doc_id", "th", "n", "node", "alt")
    nodes = durable(named_nodes(prints), "nodes", little=True)
    others: set[tuple[int, int]] = set()
    if nodes.where("lo <> hi").limit(1).count():  # two digests share their first half: hardly ever, and then a few
        clash = prints.join(nodes.where("lo <> hi").select("node", "lo"), "node").where("alt <> lo").select("node", "alt").distinct()
        others = {(r["node"], r["alt"]) for r in clash.collect()}
        prints = prints.join(F.broadcast(clash.withColumn("o", F.lit(True))), ["node", "alt"], "left").withColumn("node", F.when(F.col("o"), F.col("alt")).otherwise(F.col("node")))
        nodes = durable(named_nodes(prints), "nodes", little=True)
        if nodes.where("lo <> hi").limit(1).count():
            raise ValueError("two digests share both halves with others")
    sizes = prints.agg(F.sum("n")).first()[0] or 0
    sketch = merged_sketch(everything)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(sizes * 0.2 / 500_000) + 1)
    rows = docs.where("doc_id is not null")
    found = durable(entries(rows, k, num, den, sketch, partitions, others), "entries")
    held = durable(found.select("node").distinct().join(nodes.select("node", "doc_id", "th"), "node"), "held", little=True)
    keyed = rows.select(F.col("doc_id").cast("long"), F.md5(F.col("text").cast("binary")).alias("th"), "text").join(held, ["doc_id", "th"]).select("node", "text")
    texts = durable(keyed.dropDuplicates(["node"]), "texts")
    lists = durable(prefixes(found), "prefixes", little=True)

    comp = spark.createDataFrame([], "node long, comp long")
    tested = spark.createDataFrame([], "a long, b long")
    links, done = tested, [found, held, texts, lists]
    live = found.withColumn("comp", F.col("node"))
    for r in range(ROUNDS + 1):
        # entries of tokens that still meet different components; others never will again
        open_tokens = live.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.max(F.struct("pop", F.xxhash64("node", F.lit(r)).alias("_h"), "node", "comp", "n")).alias("hub")).where("x <> y")
        open_tokens = durable(open_tokens.select("token", F.col("hub.node").alias("hub"), F.col("hub.comp").alias("hub_comp"), F.col("hub.n").alias("hub_n")), "open-tokens", little=True)
        left = durable(live.join(open_tokens, "token"), "live")
        discard(open_tokens, *([live] if r else []))
        mine = [left]
        if r < ROUNDS:
            near = left.where((F.col("comp") != F.col("hub_comp")) & (F.col("n") * num <= F.col("hub_n") * den) & (F.col("hub_n") * num <= F.col("n") * den))
            near = near.select("node", "hub").groupBy("node", "hub").agg(F.count("*").alias("c")).groupBy("node").agg(F.max(F.struct("c", "hub")).alias("m")).select("node", F.col("m.hub").alias("y"))
            near = near.join(lists, "node").select(F.col("y").alias("node"), "x").join(lists.withColumnRenamed("x", "y"), "node").where(overlap_room("x", "y", num, den))
            pairs = near.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        else:
            pairs = candidates(left.select("token", "node", "comp", "n", "l", "i"), num, den, mine)
        pairs = durable(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        done.append(pairs)
        if r == ROUNDS or pairs.limit(1).count():
            new = durable(verify(pairs, texts, k, num, den), "links")
            tested, links = tested.unionByName(pairs), links.unionByName(new)
            labels = components(links)
            comp = labels.select("node", "comp")
            done += [new, labels]
        if r < ROUNDS:
            live = durable(left.drop("comp", "hub", "hub_comp", "hub_n").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "live")
        discard(*mine)
    ids = nodes.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = ids.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named_comp = durable(ids.join(least, "comp").select("node", "comp", "component_id"), "component-ids", little=True)
    discard(*done)
    out = prints.join(named_comp, "node", "left")
    own_id = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own_id.alias("component_id"), "th", "comp")


def named_nodes(prints: DataFrame) -> DataFrame:
    """node, doc_id and th of its smallest document, lo and hi of the other half of the digest."""
    named = prints.where("n > 0 and doc_id is not null")
    return named.groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("m"), F.min("alt").alias("lo"), F.max("alt").alias("hi")).select("node", "m.doc_id", "m.th", "lo", "hi")


def prefixes(entries: DataFrame) -> DataFrame:
    """node, x: struct of node, n, l, tokens, places."""
    lists = entries.groupBy("node", "n", "l").agg(F.sort_array(F.collect_list(F.struct("i", "token"))).alias("p"))
    return lists.select("node", F.struct("node", "n", "l", F.col("p.token").alias("tokens"), F.col("p.i").alias("places")).alias("x"))


def overlap_room(x: str, y: str, num: int, den: int) -> F.Column:
    """Whether the prefixes of two nodes leave room for a link: they share min(l) tokens at least, and, as all is counted up
    to the last token they share there, at most what follows it in common besides. x, y: structs of n, l, tokens, places."""
    a, b = F.col(x), F.col(y)
    both = F.array_intersect(a["tokens"], b["tokens"])
    last = F.element_at(both, -1)
    place = lambda s: F.element_at(s["places"], F.array_position(s["tokens"], last).cast("int"))
    most = F.size(both) + F.least(a["n"] - place(a), b["n"] - place(b)) - 1
    return (F.size(both) >= F.least(a["l"], b["l"])) & (most * (num + den) >= (a["n"] + b["n"]) * num)


def first_here(nx: F.Column, rx: F.Column, ny: F.Column, ry: F.Column, num: int, den: int) -> F.Column:
    """Whether a token with rx and ry tokens from it on can be the first that is shared: with o the overlap a link needs, both must be o at least."""
    return F.least(rx, ry) * (num + den) >= (nx + ny) * num


def candidates(live: DataFrame, num: int, den: int, made: list[DataFrame]) -> DataFrame:
    """Adds the tables it writes to made. All pairs a < b of nodes of different components that may link by their prefixes.

    A pair is found at the first token it shares. Tokens of at most COLD nodes are simply joined. At the others, components
    meet first, with bounds over their nodes there (a component with one node there is tested as that node), and are then
    expanded, the smaller one first, so a large component costs no pairs with itself; prefixes travel along, and a pair is
    made only at its first token and only if there is room for a link.
    """
    col = F.col
    prefix = durable(prefixes(live), "prefixes", little=True)
    hot = durable(live.groupBy("token").agg(F.count("*").alias("k")).where(col("k") > COLD).select("token", F.ceil(col("k") / SPREAD).cast("int").alias("parts")), "hot-tokens", little=True)
    # a first shared token is in the part of a prefix that one match needs
    live = live.where((col("n") - col("i")) * den >= col("n") * num)
    cold = live.join(hot, "token", "left_anti")
    a = cold.select("token", col("comp").alias("c"), col("node").alias("x"), col("n").alias("nx"), col("i").alias("ix"))
    b = cold.select("token", col("comp").alias("d"), col("node").alias("y"), col("n").alias("ny"), col("i").alias("iy"))
    few = a.join(b, "token").where((col("c") < col("d")) & first_here(col("nx"), col("nx") - col("ix"), col("ny"), col("ny") - col("iy"), num, den)).select(col("x").alias("node"), "y").distinct()
    few = few.join(prefix, "node").select(col("y").alias("node"), "x").join(prefix.withColumnRenamed("x", "y"), "node").where(overlap_room("x", "y", num, den))
    pairs = [few.select(col("x.node").alias("a"), col("y.node").alias("b"))]

    rows = durable(live.join(hot, "token").select("token", "parts", "comp", "node", "i").join(prefix, "node").drop("node"), "hot-rows")
    at = rows.groupBy("token", "comp", "parts").agg(F.count("*").alias("k"), F.min("x.n").alias("n"), F.max(col("x.n") - col("i")).alias("r"))
    at = durable(at, "hot-groups", little=True)
    made += [prefix, hot, rows, at]

    def dealt(x: DataFrame, by: str) -> DataFrame:
        """x with the part of its token that a row belongs to."""
        return x.withColumn("part", F.pmod(F.xxhash64(by), col("parts"))).drop("parts")

    def copied(x: DataFrame) -> DataFrame:
        """x with a row for each part of its token."""
        return x.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), (col("parts") - 1).cast("long")))).drop("parts")

    single = rows.join(at.where("k = 1").select("token", "comp"), ["token", "comp"], "left_semi").withColumnRenamed("comp", "c")
    groups = at.where("k > 1").withColumnRenamed("comp", "d")
    other = rows.select("token", col("comp").alias("d"), col("x").alias("y"), col("i").alias("j"))

    def meets(d: DataFrame) -> DataFrame:
        """Pairs of rows that meet at their first shared token."""
        here = first_here(col("x.n"), col("x.n") - col("i"), col("y.n"), col("y.n") - col("j"), num, den)
        return d.where(here & (F.element_at(F.array_intersect("x.tokens", "y.tokens"), 1) == col("token")) & overlap_room("x", "y", num, den)).select(col("x.node").alias("a"), col("y.node").alias("b"))

    partner = copied(single.select("token", "parts", col("c").alias("d"), col("x").alias("y"), col("i").alias("j")))
    pairs.append(meets(dealt(single, "c").join(partner, ["token", "part"]).where("c < d")))
    # one node against a group
    bounds = copied(groups.select("token", "parts", "d", "n", "r"))
    room = first_here(col("x.n"), col("x.n") - col("i"), col("n"), col("r"), num, den)
    pairs.append(meets(dealt(single, "c").join(bounds, ["token", "part"]).where((col("c") != col("d")) & room).select("token", "d", "x", "i").join(other, ["token", "d"])))
    # two groups
    g = dealt(groups.select("token", "parts", col("d").alias("c"), col("k").alias("k1"), col("n").alias("n1"), col("r").alias("r1")), "c")
    both = g.join(copied(groups), ["token", "part"]).where((col("c") != col("d")) & (F.struct("k1", "c") < F.struct("k", "d")) & first_here(col("n1"), col("r1"), col("n"), col("r"), num, den)).select("token", "c", "d")
    pairs.append(meets(both.join(rows.withColumnRenamed("comp", "c"), ["token", "c"]).select("token", "d", "x", "i").join(other, ["token", "d"])))
    parts = [durable(p, "pairs-part") for p in pairs]  # one job each: four small plans
    made += parts
    found = functools.reduce(DataFrame.unionByName, parts)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component, the one with the smallest doc_id (of rows that repeat it, the smallest MD5 of the
    text, then any one); rows without doc_id and without words stay, these once for each row."""
    key = [free("_id", docs), free("_th", docs)]
    keyed = docs.withColumns({key[0]: F.col("doc_id").cast("long"), key[1]: F.md5(F.col("text").cast("binary"))})
    found = link(docs.select("doc_id", "text"), k, num, den).where("n_shingles > 0 and doc_id is not null")
    found = durable(found.groupBy("comp", "doc_id", "th").agg(F.count("*").alias("n")), "components", little=True)
    first = found.groupBy("comp").agg(F.min(F.struct("doc_id", "th")).alias("m"))
    ranked = found.join(first, "comp").withColumn("gone", F.struct("doc_id", "th") > F.col("m"))
    ranked = durable(ranked.select(F.col("doc_id").alias(key[0]), F.col("th").alias(key[1]), "gone", "n"), "copies", little=True)
    discard(found)
    out = keyed.join(small(ranked.where("gone").select(*key), ranked), key, "left_anti")
    again = ranked.where("not gone and n > 1").select(*key)
    if again.limit(1).count():
        twice = out.join(small(again, ranked), key, "left_semi").dropDuplicates(key)
        out = out.join(small(again, ranked), key, "left_anti").unionByName(twice)
    return out.select(own(docs))


def query(spark, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("th", "comp")


ORACLE = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') w from documents),
s as (select distinct doc_id, g from (
  select doc_id, unnest(case when len(w) >= 4 then list_transform(range(len(w) - 3), lambda j: array_to_string(w[j + 1 : j + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ') || ' '] else [] end) g from w)),
n as (select doc_id, count(*) n from s group by doc_id),
i as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from i join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 85 * (x.n + y.n - c)),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
select d.doc_id, coalesce(max(n.n), 0) n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) component_id
from documents d left join n on d.doc_id = n.doc_id left join r on d.doc_id = r.a group by d.doc_id"""
