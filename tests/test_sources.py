from __future__ import annotations

import io
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from timberline.operators.tree import Node, Tree
from timberline.plans import codegen
from timberline.sources import csvio, store
from timberline.sources.model import CategoryMissing, CategoryNotFound, Model, ScoringError, TypeMismatch, ValueMissing
from timberline.streaming import scoring


@pytest.mark.parametrize(
    ("line", "form", "cells"),
    [
        ("1,2.5", "dense", {0: ("int", "1"), 1: ("float", "2.5")}),
        ("3.0", "dense", {0: ("int", "3")}),
        ('"7"', "dense", {0: ("string", "7")}),
        ("'q,r',1", "dense", {0: ("string", "q,r"), 1: ("int", "1")}),
        ("1,,3", "sparse", {0: ("int", "1"), 2: ("int", "3")}),
        ("{0 Y,2 1.5}", "sparse", {0: ("string", "Y"), 2: ("float", "1.5")}),
        ("{}", "sparse", {}),
        ("a b, c # note", "dense", {0: ("string", "a b"), 1: ("string", "c")}),
        (r'"a\"b\n\q"', "dense", {0: ("string", 'a"b\n\\q')}),
    ],
)
def test_rows(line, form, cells):
    assert csvio.parse_row(line, 1) == (form, cells)


def test_lines_without_rows_and_errors():
    assert csvio.parse_row("# note", 1) is None
    assert csvio.parse_row("   ", 1) is None
    for bad, what in (('"open', "unterminated"), ("99999999999999999999", "overflow"), ("{0 1", "unclosed"), ("{x 1}", "bad sparse"), ("{0 1,}", "bad sparse")):
        with pytest.raises(csvio.CsvError, match=what):
            csvio.parse_row(bad, 3)


def test_file(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("# head\n\nx,y,z\n1,'b',2\n\n{0 4,2 'c'}\n5,,6 # end\n")
    names, rows = csvio.read(spark, str(p))
    assert names == ["x", "y", "z"]
    got = sorted((r["row_id"], r["fid"], r["value"]) for r in csvio.to_cells(rows).collect())
    assert [(f, v) for _, f, v in got] == [(0, "1"), (1, "b"), (2, "2"), (0, "4"), (2, "c"), (0, "5"), (2, "6")]
    p.write_text("x,y\n1\n")
    with pytest.raises(Exception, match="2 expected"):
        csvio.read(spark, str(p))[1].collect()


def test_standard_input(spark, monkeypatch):
    text = "x,y\n" + "".join(f"{i},'é{i}'\n" for i in range(500))
    monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(text.encode())))
    names, rows = csvio.read(spark)
    assert names == ["x", "y"]
    assert sorted(int(r["value"]) for r in csvio.to_cells(rows).where("fid = 0").collect()) == list(range(500))
    path = csvio.spooled(spark, io.BytesIO(b"1\n2\n3"), block=2)
    assert [r["line"] for r in csvio.numbered_lines(spark, path).orderBy("line_no").collect()] == ["1", "2", "3"]
    assert csvio.read(spark, csvio.spooled(spark, io.BytesIO(b"")))[0] == []


def test_pairs_and_subsets(spark, tmp_path):
    (tmp_path / "p").write_text("1 0.5\n\n  0\t0.25 \n")
    assert [tuple(r) for r in csvio.pairs(spark, str(tmp_path / "p")).collect()] == [("1", 0.5), ("0", 0.25)]
    (tmp_path / "q").write_text("1 2 3\n")
    with pytest.raises(Exception, match="not a label"):
        csvio.pairs(spark, str(tmp_path / "q")).collect()
    df = spark.createDataFrame([(1, "a", 2.0)], "k int, name string, v double")
    assert csvio.write_subset(df, str(tmp_path / "out"), ["x k"], "all") == ["name", "v"]
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["name", "v"]


def test_store_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 300), "abc"[i % 3], 1) for i in range(900)], "id long, v double, c string, u int")
    catalog, rows = store.build(df, ["v", "c", "u"], "id", width=8)
    store.write(catalog, rows, str(tmp_path / "s"))
    catalog, rows = store.read(spark, str(tmp_path / "s"))
    assert {(r["name"], r["kind"]) for r in catalog.collect()} == {("v", "ord"), ("c", "cat")}
    assert catalog.where("name = 'v'").first()["cardinality"] == 255
    back = store.decode(catalog, rows, "id", "c").join(df, "id")
    assert back.where("value <> c").count() == 0
    assert store.brief(catalog).count() == store.describe(catalog).count() == 2


TREES = [Tree({1: Node(0, fid=0, column="x", split=2.0), 2: Node(-0.4), 3: Node(0, fid=1, column="c", kind="cat", split=0.0, right_codes=[1]), 6: Node(0.1), 7: Node(0.7)})]


def model():
    return Model(TREES, "Y", "N", {"c": ["a", "b", None]})


def test_model_scores_agree(spark):
    m = Model.from_json(model().to_json())
    rows = [(0.5, "a"), (3.0, "b"), (3.0, "zz"), (None, None), (9.0, None)]
    df = spark.createDataFrame(rows, "x double, c string")
    space: dict = {}
    exec(codegen.to_python(m), space)
    for (x, c), r in zip(rows, m.score(df).collect(), strict=True):
        f = m.score_one({"x": x, "c": c})
        assert r["score"] == pytest.approx(space["eval_by_name"]({"x": x, "c": c}))
        assert (r["x"], r["c"]) == (x, c)
        assert r["score"] == pytest.approx(1 / (1 + 2.718281828459045 ** (-2 * f)))
    other = m.score(df, positive="N").collect()
    assert other[0]["score"] == pytest.approx(1 - m.score(df).first()["score"])


def test_model_errors(spark):
    df = spark.createDataFrame([(1.0, "zz")], "x double, c string")
    with pytest.raises(ScoringError, match="no class"):
        model().score(df, positive="Q")
    with pytest.raises(ScoringError, match="missing"):
        model().score(df.drop("x"))
    with pytest.raises(Exception, match="unknown category"):
        model().score(df.withColumn("x", F.lit(5.0)), strict=True).collect()
    with pytest.raises(ScoringError, match="missing"):
        model().score_one({"c": "a"}, missing_ok=False)
    with pytest.raises(ScoringError, match="text"):
        model().score(df.withColumn("x", F.lit("t")))


def test_generated_c():
    text = codegen.to_c(model(), static=True)
    assert "static double f(int c, double x) {" in text
    assert "/* c: 0 = a, 1 = b, 2 = (other) */" in text
    assert text.count("{") == text.count("}") == 6
    assert [x.strip() for x in text.splitlines() if "+=" in x] == ["f += 0.7;", "f += 0.1;", "f += -0.4;"]


def test_generated_code_shares_direction_sets():
    right = lambda codes: Tree({1: Node(0, fid=0, column="c", kind="cat", split=0.0, right_codes=codes), 2: Node(1.0), 3: Node(2.0)})
    m = Model([right([1]), right([0, 2]), right([2, 0]), right([])], categories={"c": ["a", "b", None]})
    assert codegen.direction_sets(m) == {(1,): 0, (0, 2): 1, (): 2}
    assert codegen.to_c(m).count("#define") == 3
    text, space = codegen.to_python(m), {}
    exec(text, space)
    assert text.count("frozenset") == 3
    assert [space["eval_by_name"]({"c": c}) for c in ("a", "b", "x")] == [m.score_one({"c": c}) for c in ("a", "b", "x")]


def compiles(folder) -> bool:
    """Whether a C compiler is there and whole."""
    (folder / "empty.c").write_text("int main(void) { return 0; }\n")
    return shutil.which("gcc") is not None and subprocess.run(["gcc", str(folder / "empty.c"), "-o", str(folder / "empty")], capture_output=True).returncode == 0


def test_generated_python_keeps_names_apart():
    m, rows = clashing()
    space: dict = {}
    exec(codegen.to_python(m), space)
    assert [space["eval_by_name"](r) for r in rows] == [m.score_one(r) for r in rows]
    assert "double a_b, double a_b_2" in codegen.to_c(m)


def clashing():
    """A model whose names clean up to one, and rows for it."""
    tree = Tree({1: Node(0, fid=0, column="a.b", split=1.0), 2: Node(1.0), 3: Node(0, fid=1, column="a_b", split=2.0), 6: Node(20.0), 7: Node(300.0)})
    cat = Tree({1: Node(0, fid=2, column="c", kind="cat", split=0.0, right_codes=[1]), 2: Node(0.25), 3: Node(0.5)})
    rows = [{"a.b": 2, "a_b": 3, "c": 'q"\\'}, {"a.b": 2, "a_b": 1, "c": "é"}, {"a.b": 0, "a_b": 9, "c": None}]
    return Model([tree, cat], categories={"c": ["é", 'q"\\', None]}), rows


def test_generated_c_runs(tmp_path):
    if not compiles(tmp_path):
        pytest.skip("no C compiler")
    m, rows = clashing()
    main = '#include <stdio.h>\nint main(void) { printf("%.6f %.6f %.6f %d", f(2, 3, f_code_c("q\\"\\\\")), f(2, 1, f_code_c("\u00e9")), f(0, 9, f_code_c(0)), f_code_c("new")); return 0; }\n'
    (tmp_path / "m.c").write_text(codegen.to_c(m) + main)
    subprocess.run(["gcc", str(tmp_path / "m.c"), "-o", str(tmp_path / "m"), "-lm"], check=True)
    want = " ".join(f"{m.score_one(r):.6f}" for r in rows) + " 2"
    assert subprocess.run([str(tmp_path / "m")], capture_output=True, text=True).stdout == want


def test_names_with_marks(spark):
    m = Model([Tree({1: Node(0, fid=0, column="a.b", split=1.0), 2: Node(-1.0), 3: Node(1.0)})])
    df = spark.createDataFrame([(2.0,), (0.0,), (None,)], "`a.b` double")
    assert [r["score"] for r in df.select(m.raw().alias("score")).collect()][:2] == [1.0, -1.0]
    assert [r[0] for r in df.selectExpr(codegen.to_sql(m)).collect()][:2] == [1.0, -1.0]


def test_errors_of_one_row():
    m = Model([Tree({1: Node(0, fid=0, column="c", kind="cat", split=0.0, right_codes=[0]), 2: Node(1.0), 3: Node(0, fid=1, column="x", split=0.0), 6: Node(2.0), 7: Node(3.0)})], categories={"c": ["a"]})
    for row, error in (({"c": "z"}, CategoryNotFound), ({"c": None}, CategoryMissing), ({"c": "a", "x": "t"}, TypeMismatch)):
        with pytest.raises(error):
            m.score_one(row)
    with pytest.raises(ValueMissing):
        m.score_one({"c": "a"}, missing_ok=False)


def test_copies_of_a_table(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.0, 'x "y"\n'), (0, 2.5, None)], "a int, b double, c string")
    names = csvio.write_subset(df, str(tmp_path / "s"), ["i ."], form="sparse")
    got, rows = csvio.read(spark, str(tmp_path / "s" / "header.csv"))
    assert got == names == ["a", "b", "c"]
    lines = spark.read.text(str(tmp_path / "s" / "part-*")).withColumnRenamed("value", "line").withColumn("line_no", F.monotonically_increasing_id())
    cells = {tuple((c["fid"], c["value"]) for c in sorted(csvio.to_cells(csvio.parse(lines)).where(F.col("row_id") == i).collect())) for i in [r["line_no"] for r in lines.collect()]}
    assert cells == {((0, "1"), (2, 'x "y"\n')), ((1, "2.5"),)}
    csvio.write_subset(df, str(tmp_path / "h"), ["i ."], form="header")
    assert spark.read.text(str(tmp_path / "h")).collect()[0][0] == '"a","b","c"'
    csvio.write_subset(df, str(tmp_path / "n"), ["i a"], header=False)
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "n")).collect()) == ["0", "1"]
    csvio.write_predictions(df, str(tmp_path / "p"), "b", header="p")
    assert sorted({r[0] for r in spark.read.text(str(tmp_path / "p")).collect()}) == ["0.000000", "2.500000", "p"]


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(float(i), "ab"[i % 2]) for i in range(8)], "x double, c string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = scoring.files(spark.readStream, df.schema, str(tmp_path / "in"))
    q = scoring.score_stream(rows, model()).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored").count() == 8
    q = scoring.smoothed_stream(rows, "c", "x", 1.0).writeStream.outputMode("update").format("memory").queryName("smooth").start()
    q.processAllAvailable()
    q.stop()
    assert {r["c"]: round(r["smoothed"], 6) for r in spark.table("smooth").collect()} == {"a": 3.0, "b": 4.0}


def test_entry_imports_alone():
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 50"]).returncode == 0
