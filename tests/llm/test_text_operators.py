from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from timberline.llm import chat, decontam, jaccard, licenses, linededup, substring

SPLIT = re.compile(rb"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, source string, extra int"


def words(text):
    return SPLIT.findall((text or "").encode())


def docs(spark, rows, source="s"):
    return spark.createDataFrame([(i, t, source, 1) for i, t in rows], SCHEMA).repartition(3)


def corpus(seed=1, n=60):
    """Texts with exact and near copies, shared passages, long, short, blank and null ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["été", "Ünter", "X"]
    say = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, base, rows = say(40), say(60), []
    for i in range(n):
        w = say(rng.randrange(1, 80))
        if i % 5 == 0:
            w = base[:]
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if i % 7 == 0:
            w = w[:5] + passage + w[5:]
        rows.append((i, " ".join(w)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, rows[0][1]), (n + 4, rows[0][1].replace(" ", "  \n")), (n + 5, "one two"), (n + 6, "ONE Two"), (n + 7, "one"), (n + 8, " ".join(say(30_000))), (n + 9, "x " * 500)]
    return rows


# ---- shingle Jaccard ----


def brute_components(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = [x.lower() for x in words(t)]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 50, 100)])
def test_components(spark, k, num, den):
    rows = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link(docs(spark, rows), k, num, den).collect()}
    assert got == brute_components(rows, k, num, den)


@pytest.mark.parametrize(("rounds", "cold"), [(0, 32), (0, 1), (1, 1)])
def test_candidates_find_every_link(spark, monkeypatch, rounds, cold):
    rows = corpus(seed=9 + cold)
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "COLD", cold)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link(docs(spark, rows)).collect()}
    assert got == brute_components(rows, 4, 85, 100)


def test_components_of_odd_tables(spark):
    assert jaccard.link(docs(spark, [])).count() == 0
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (2, "a b c d e"), (4, None)]
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.link(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(None, None), (3, 2), (3, 2), (2, 2), (4, 4)], key=str)
    kept = jaccard.keep_one(docs(spark, [*rows, (2, "a b c d e"), (2, "something else"), (9, "something else"), (4, None)]))
    assert kept.columns == ["doc_id", "text", "source", "extra"]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(None, "a b c d e"), (2, "a b c d e"), (2, "something else"), (4, None), (4, None)], key=str)


# ---- repeated windows ----


def brute_removed(rows, width):
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        for j in range(len(w) - width + 1):
            first.setdefault(tuple(w[j : j + width]), i)
    for i, t in rows:
        w = words(t)
        gone = set()
        for j in range(len(w) - width + 1):
            if first[tuple(w[j : j + width])] < i:
                gone |= set(range(j, j + width))
        out[i] = (len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode())
    return out


@pytest.mark.parametrize(("width", "inner"), [(13, 3), (5, 2), (4, 4)])
def test_repeated_windows(spark, width, inner):
    rows = corpus(seed=3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in substring.remove_repeats(docs(spark, rows), width, inner).collect()}
    assert got == brute_removed(rows, width)


def test_hot_minimisers_are_split(spark, monkeypatch):
    monkeypatch.setattr(substring, "HOT_BYTES", 1_000)
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice(["of the and", f"w{rng.randrange(50)}"]) for _ in range(60))
    rows = [(k, text()) for k in range(60)]
    rows += [(100 + k, rows[k][1][20:] + " more") for k in range(20)]
    marked = substring.marked(docs(spark, rows))
    assert len(substring.hot_minimisers(marked, 10_000, 13, 3)) > 0
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in substring.remove_repeats(docs(spark, rows)).collect()}
    assert got == brute_removed(rows, 13)


def test_repeated_windows_of_odd_tables(spark):
    assert substring.remove_repeats(docs(spark, [])).count() == 0
    t = " ".join(map(str, range(20)))
    rows = [(5, t), (5, t), (5, "q " + t), (None, t), (None, t), (7, t + " z")]
    got = sorted(((r["doc_id"], r["n_removed"]) for r in substring.remove_repeats(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 0), (5, 0), (5, 0), (None, 20), (None, 20), (7, 20)], key=str)


def test_windows_that_share_a_key_are_told_apart(monkeypatch):
    import numpy as np
    import pyarrow as pa

    p = substring.Packer(1)
    from timberline.llm.common import chunks

    texts = ["a b c d", "e f g h", "a b c d"]
    for c in chunks(texts):
        p.add(c, np.array([1, 2, 3]), np.zeros(3, np.int64), 4, 2)
    monkeypatch.setattr(substring, "mix", lambda x: np.zeros_like(x))  # one key for all windows
    out = substring.judge(pa.Table.from_batches([p.flush()]), 4).to_pylist()
    assert [(r["doc_id"], r["lo"], r["hi"]) for r in out] == [(3, 0, 4)]


def two_words():
    """Two words of 1,024 letters whose polynomial hashes modulo 2**64 are equal for every odd multiplier."""
    return ["".join("ab"[(k.bit_count() + flip) % 2] for k in range(1024)) for flip in (0, 1)]


def test_words_with_equal_polynomial_hashes(spark):
    x, y = two_words()
    assert [(r["doc_id"], r["component_id"]) for r in jaccard.link(docs(spark, [(1, x), (2, y)])).orderBy("doc_id").collect()] == [(1, 1), (2, 2)]
    some = " ".join(f"w{k}" for k in range(12))
    got = {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(docs(spark, [(1, f"{some} {x}"), (2, f"{some} {y}"), (3, f"{some} {x}")])).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_equal_word_hashes_do_not_link(spark, monkeypatch):
    """Hashes may collide as they like: texts decide."""
    import numpy as np

    from timberline.llm.common import Chunk

    real = Chunk.__init__

    def dull(self, rows, split):
        real(self, rows, split)
        self.hash = (self.hash % np.uint64(2)).astype(np.uint64)

    monkeypatch.setattr(Chunk, "__init__", dull)
    text = [bytes(f"{a} b c d e f g h i j k l {m}", "ascii") for a, m in (("x", "m"), ("y", "m"), ("x", "m"), ("x", "n"))]
    import pyarrow as pa

    p = substring.Packer(1)
    c = Chunk([0, 1, 2, 3], [t.split() for t in text])
    p.add(c, np.array([1, 2, 3, 4]), np.zeros(4, np.int64), 12, 3)
    out = substring.judge(pa.Table.from_batches([p.flush()]), 12).to_pylist()
    assert sorted((r["doc_id"], r["lo"], r["hi"]) for r in out) == [(2, 1, 13), (3, 0, 13), (4, 0, 12)]


def test_digests_that_share_a_half(spark):
    prints = spark.createDataFrame([(1, "p", 3, 5, 7), (2, "q", 3, 5, 8), (3, "r", 3, 6, 7)], "doc_id long, th string, n long, node long, alt long")
    nodes = {r["node"]: (r["doc_id"], r["lo"] == r["hi"]) for r in jaccard.named_nodes(prints).collect()}
    assert nodes == {5: (1, False), 6: (3, True)}


# ---- lines ----


def test_line_spread(spark):
    sites = [f"s{k}" for k in range(30)]
    rows = [(k, f"Accept all cookies now\nown line of document {k}", sites[k]) for k in range(30)]
    rows += [(100 + k, f"  eleven sites carry this \nsomething else {k}\n", sites[k]) for k in range(11)]
    rows += [(200 + k, f"nine sites carry this one\nmore text {k}", sites[k]) for k in range(9)]
    rows += [(300 + k, "many times but on one site only", "s1") for k in range(40)] + [(400, None, "s1"), (401, "", None), (402, "Accept all cookies now", None), (None, "Accept all cookies now", "s2")]
    df = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], SCHEMA)
    out = {r["doc_id"]: r for r in linededup.remove_lines(df).collect()}
    assert out[0]["text"] == rows[0][1]  # the first keeps it
    assert out[1]["text"] == "own line of document 1"
    assert out[100]["n_removed"] == 0
    assert out[105]["text"] == "something else 5\n"
    assert out[205]["n_removed"] == out[310]["n_removed"] == 0
    assert out[400]["text"] is None
    assert (out[401]["text"], out[402]["text"], out[None]["text"]) == ("", "", "")
    assert out[0]["extra"] == 1
    clash = linededup.remove_lines(df.withColumns({"n_lines": F.lit(42), "N_Removed": F.lit("x"), "_drop": F.lit(1), "h": F.lit(2), "a.b": F.lit(3)})).where("doc_id = 1").first()
    assert (clash["n_lines"], clash["N_Removed"], clash["_drop"], clash["h"], clash["a.b"], clash["n_lines_"], clash["n_removed_"]) == (42, "x", 1, 2, 3, 2, 1)
    assert linededup.remove_lines(df.limit(0)).count() == 0


def test_near_threshold_lines_get_exact_counts(spark):
    rows = [(k * 1000 + j, f"line number {k} of the test", f"site{j}") for k in range(6, 16) for j in range(k)]
    df = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], SCHEMA)
    gone = linededup.boilerplate(df, min_sites=10).select("first_doc").collect()
    assert sorted(r[0] for r in gone) == [k * 1000 for k in range(10, 16)]


# ---- benchmark ----


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_templates(spark):
    item = "A train leaves at 9 and travels 120 km with Alice to the old town before 12 when Alice meets Bob near the station"
    other = item.replace("Alice", "Carol").replace("Bob", "Dan").replace("120", "300").replace(" 9 ", " 7 ")
    mixed = item.replace("with Alice", "with Carol").replace("when Alice", "when Erin").replace("120 km", "55 km")
    rows = [(1, f"Intro text here.\n{item}. And more words follow."), (2, f"Before that: {other}!"), (3, mixed), (4, "nothing of the kind in here at all, only some words"), (5, None), (6, ""), (7, item), (7, item), (8, item[:40])]
    got = {r["doc_id"]: r for r in decontam.find(docs(spark, rows), benchmark(spark, [(9, item), (9, item), (10, None), (11, ""), (None, item)]), consistency=0.9).collect()}
    assert sorted(got) == [1, 2, 7]
    assert (got[1]["verbatim"], got[2]["verbatim"], got[7]["verbatim"]) == (True, False, True)
    assert got[2]["n_slots"] == got[2]["n_consistent"] > got[2]["n_same"]
    kept = decontam.remove(docs(spark, [*rows, (None, item)]), benchmark(spark, [(9, item)]), consistency=0.9)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([3, 4, 5, 6, 8, None], key=str)
    assert decontam.find(docs(spark, []), benchmark(spark, [(9, item)])).count() == 0
    assert decontam.find(docs(spark, rows), benchmark(spark, [])).count() == 0


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"v{k}x" for k in range(300)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(15, 50)))) for k in range(20)]
    rows = []
    for i in range(80):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 90))]
        if i % 4 == 0:
            at = rng.randrange(len(w))
            w[at:at] = items[rng.randrange(20)][1].upper().split() if i % 8 == 0 else items[rng.randrange(20)][1].split()
        rows.append((i, " ".join(w)))
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    want = {(i, k) for i, t in rows for k, x in items if plain(x) in plain(t) and t != t.upper()} | {(i, k) for i, t in rows for k, x in items if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find(docs(spark, rows), benchmark(spark, items)).collect()}
    assert want <= got
    assert {i for i, _ in got} <= {i for i in range(80) if i % 4 == 0}


def leaked(spark, rows, items):
    return {(r["doc_id"], r["item_id"]) for r in decontam.find(docs(spark, rows), benchmark(spark, items)).collect()}


def test_edited_and_partial_passages(spark):
    rng = random.Random(5)
    vocabulary = [f"v{k}x" for k in range(400)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [some(n) for n in (10, 11, 15, 20, 37, 59)]
    rows, want = [], set()
    for k, w in enumerate(items):
        n = len(w)
        kinds = [(w[:at] + ["other"] + w[at + 1 :], True) for at in (0, n // 2, n - 1)] + [(w[: n // 2] + ["one"] + w[n // 2 :], True), (w[: n // 3], False)]
        kinds += [(w[: (7 * n + 9) // 10], True), (w[(3 * n) // 10 :], True)] if n >= 20 else []
        for text, leak in kinds:
            want |= {(len(rows), k)} if leak else set()
            rows.append((len(rows), " ".join([*some(30), *text, *some(30)])))
    assert leaked(spark, rows, [(k, " ".join(w)) for k, w in enumerate(items)]) == want


def test_short_items(spark):
    items = [(1, "What is the capital of France?"), (2, "Compute 12 + 45 * 3 - 7 / 2 + 9"), (3, "Which gas do plants absorb from the air?"), (4, "Which gas do most green plants absorb from the air?"), (5, "Define entropy."), (6, " ".join(str(k) for k in range(30)))]
    rows = [(1, "He asked: What is the capital of France? Nobody knew it."), (2, "Now Compute 12 + 45 * 3 - 7 / 2 + 9 by hand, please"), (3, "Question 3 Which gas do plants absorb from the air?"), (4, "Question 3 Which gas do most green plants absorb from the air?"), (5, "First define entropy. Then use it."), (6, f"Numbers: {items[5][1]} and more")]
    rows += [(7, "Compute 12 + 45 * 3 - 7 / 2 + 8 by hand"), (8, "What is the use of a capital in this case?"), (9, "0 1 2 3 4 5 6 7 8 9 10 11 12 13 14"), (10, "entropy")]
    assert leaked(spark, rows, items) == {(k, k) for k in range(1, 7)}


def test_case_lines_and_names(spark):
    item = "Every morning the baker Sarah Miller brings fresh bread to the old market, where Paul and Sarah sell it to people from the town. On Monday it rained. Sarah went home before noon and Paul stayed"
    other = item.replace("Sarah", "Judith").replace("Paul", "Henry").replace("Miller", "Stone")
    rows = [(1, item.title()), (2, item.lower()), (3, item.upper()), (4, item.replace(" Sarah", "\nSarah").replace(" Paul", "\nPaul")), (5, other), (6, f"He read: {other}. The end."), (7, "The baker went home, and Sarah stayed with Paul in the town before noon")]
    got = {r["doc_id"]: r for r in decontam.find(docs(spark, rows), benchmark(spark, [(1, item)])).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    assert [got[k]["verbatim"] for k in range(1, 7)] == [True, True, True, True, False, False]
    assert got[5]["n_words"] == got[6]["n_words"] == got[5]["item_words"]


# ---- licences ----


def test_licenses(spark):
    rows = [(1, "Some text.\nReleased under the MIT License.\nMore."), (2, "licensed under the apache license version 2.0"), (3, "the license of the old man and the sea"), (4, None), (5, ""), (6, "license"), (7, "All rights reserved."), (7, "All rights reserved."), (8, "This work is licensed under the GNU General Public License, version 3."), (9, "Permission is hereby granted, free of charge,\nto any person obtaining a copy of this software and associated documentation files\n(the Software), to deal in the Software without restriction")]
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(docs(spark, rows)).collect()}
    assert got == {(1, "MIT"), (2, "Apache-2.0"), (7, "All-Rights-Reserved"), (8, "GPL-3.0"), (9, "MIT")}
    assert licenses.scan(docs(spark, [])).count() == 0
    # rows without doc_id, or of one doc_id, are not put together
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    halves = [(None, mit[:70]), (None, mit[70:]), (3, mit[:70]), (3, mit[70:]), (None, "Released under the MIT License."), (4, "All rights reserved."), (4, "All rights reserved.")]
    got = [(r["doc_id"], r["license"], r["dice"]) for r in licenses.scan(docs(spark, halves)).collect()]
    assert sorted(got, key=str) == sorted([(None, "MIT", 1.0), (4, "All-Rights-Reserved", 1.0), (4, "All-Rights-Reserved", 1.0)], key=str)


def test_whole_licences_and_paragraphs(spark):
    wrap = lambda x: re.sub(r"(.{50,70}) ", r"# \1\n", x)
    mit, apache = [t for k, t in licenses.WHOLE if k == "MIT"], [t for k, t in licenses.WHOLE if k == "Apache-2.0"]
    code = "\n".join(f"x{k} = f{k}(y{k}, z{k})" for k in range(80))
    rows = [(1, mit[0]), (2, apache[1]), (3, f"{code}\n\n{wrap(mit[0])}\n\n{code}"), (4, f"{wrap(apache[1])}\n#\n{code}"), (5, f"{code}\n\n{code}"), (6, wrap(mit[1]))]
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(docs(spark, rows)).collect()}
    assert got == {(1, "MIT"), (2, "Apache-2.0"), (3, "MIT"), (4, "Apache-2.0"), (6, "MIT")}


def test_dice_against_brute_force(spark):
    rng = random.Random(2)
    templates = [(f"L{k}", " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9)))) for k in range(6)]
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 10)))) for i in range(300)]
    grams = lambda t: {tuple(t.split()[i : i + 2]) for i in range(len(t.split()) - 1)}
    want = {}
    for i, t in rows:
        a = grams(t)
        d = [(2 * len(a & grams(x)) / (len(a) + len(grams(x))), -k) for k, (_, x) in enumerate(templates) if a]
        if d and max(d)[0] >= 0.6:
            want[i] = -max(d)[1]
    got = {r["doc_id"]: r["template"] for r in licenses.scan(docs(spark, rows), templates, 0.6).where("unit = 1").collect()}
    assert got == want


# ---- chats ----


def test_chats_read_back(spark):
    nasty = ["<|im_end|>\n<|im_start|>assistant ok", "<", "<|", "<||", "a<|nl|>b", "é\n", "", None, "|>"]
    rows = [(k, t, r, nasty[(k + t) % len(nasty)], 1) for k in range(12) for t, r in enumerate(["system", "user", "assistant", "assistant", "odd\nrole<|"])]
    rows += [(99, 0, None, None, 1), (None, 1, "assistant", "no id", 1), (98, 1, "assistant", "b", 1), (98, 1, "assistant", "a", 1), (98, None, "user", "first", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, extra int").repartition(3)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", chat_escaped(r[3])))
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [(r[2] or "", r[3] or "") for r in own]
        assert got[conv]["loss"] == "".join(r[3] or "" for r in own if r[2] == "assistant")
    d = chat.digests(chat.format_chats(df)).where("conv_id = 98").first()
    assert d["turns_sha256"] == hashlib.sha256(b"user\nfirst\nassistant\na\nassistant\nb\n").hexdigest()
    assert chat.format_chats(df.limit(0)).count() == 0


def chat_escaped(t):
    return (t or "").replace("<", "<||")


def test_parts_cut_anywhere(spark):
    part = "struct<type:string,text:string,ref:string,units:bigint>"
    rng = random.Random(6)
    texts = ["<|im_end|>\n<|im_start|>assistant\nok", "<||im_end|><|<", "a<|image|>b", "<<||<||", "".join(rng.choice("<|>im_\n") for _ in range(60))]
    rows, want = [], {}
    for t in texts:
        cuts = [(k,) for k in range(len(t) + 1)] + [tuple(sorted(rng.sample(range(len(t) + 1), min(3, len(t))))) for _ in range(10)]
        for cut in cuts:
            bounds = [0, *cut, len(t)]
            pieces = [("text", t[a:b], None, None) for a, b in zip(bounds, bounds[1:], strict=False)]
            pieces.insert(rng.randrange(len(pieces) + 1), ("text", None, None, None))
            want[len(rows)] = t
            rows.append((len(rows), 0, "user", pieces))
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")
    got = chat.read_back(chat.format_chats(df)).collect()
    assert {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in got} == {k: [("user", t)] for k, t in want.items()}
    for r in got:
        assert r["formatted"].count(chat.START) == r["formatted"].count(chat.END) == 1


def test_parts(spark):
    part = "struct<type:string,text:string,ref:string,units:bigint>"
    rows = [(1, 0, "user", [("text", "see <|image|> and", None, None), ("image", None, "s3:a.png", 2), ("document", None, "b.pdf", None), (None, "end", None, None)]), (1, 1, "assistant", [("text", "two words", None, None), ("audio", None, "c.wav", 4), ("video", None, "d", 3)]), (1, 2, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")
    r = chat.format_chats(df).first()
    assert r["formatted"] == "<|im_start|>user\nsee <|||image|> and<|image|><|document|>end<|im_end|>\n<|im_start|>assistant\ntwo words<|audio|><|attachment|><|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert [tuple(a) for a in r["attachments"]] == [(1, "image", "s3:a.png", 512), (1, "document", "b.pdf", 512), (2, "audio", "c.wav", 100), (2, "video", "d", 3)]
    assert r["n_tokens"] == 3 + 512 + 512 + 1 + 2 + 100 + 3
