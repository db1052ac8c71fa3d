"""CSV dialect: dense rows, sparse rows {i v, ...}, comments, quotes and escapes."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from timberline.functions.scalar import named, quoted
from timberline.operators.rowsets import select_columns
from timberline.plans.durable import file_system, shared_dir

#: What a backslash and a letter stand for inside quotes.
ESCAPES = {'"': '"', "'": "'", "\\": "\\", "b": "\b", "f": "\f", "r": "\r", "t": "\t", "n": "\n"}
INT_BITS = 62


class CsvError(ValueError):
    """A line that is not in the dialect."""


def tokens(line: str, number: int) -> list[tuple[str, str]]:
    """("q", text) for quoted and ("b", text) for bare cells, and the marks , { } as themselves; a comment ends the line."""
    out: list[tuple[str, str]] = []
    i, n = 0, len(line)
    while i < n:
        c = line[i]
        if c in " \t\r":
            i += 1
        elif c == "#":
            break
        elif c in ",{}":
            out.append((c, c))
            i += 1
        elif c in "\"'":
            text, j = [], i + 1
            while j < n and line[j] != c:
                if line[j] == "\\" and j + 1 < n:
                    text.append(ESCAPES.get(line[j + 1], "\\" + line[j + 1]))
                    j += 2
                else:
                    text.append(line[j])
                    j += 1
            if j >= n:
                raise CsvError(f"line {number}: unterminated string")
            out.append(("q", "".join(text)))
            i = j + 1
        else:
            j = i
            while j < n and line[j] not in ",{}#\"'" and not (line[j] in " \t" and out and _in_sparse(out)):
                j += 1
            out.append(("b", line[i:j].rstrip()))
            i = j
    return out


def _in_sparse(out: list[tuple[str, str]]) -> bool:
    return sum(k == "{" for k, _ in out) > sum(k == "}" for k, _ in out)


def typed(kind: str, text: str, number: int) -> tuple[str, str]:
    """(kind, text) of a cell: int, float or string; an integral float is an int, a quoted number a string."""
    if kind == "q":
        return "string", text
    try:
        v = int(text)
    except ValueError:
        try:
            d = float(text)
        except ValueError:
            return "string", text
        if text.strip().lower().lstrip("+-") in ("nan", "inf", "infinity") or "_" in text:
            return "string", text
        if d.is_integer() and abs(d) < 2**INT_BITS:
            return "int", str(int(d))
        return "float", repr(d)
    if "_" in text:
        return "string", text
    if not -(2**INT_BITS) <= v < 2**INT_BITS:
        raise CsvError(f"line {number}: integer overflow: {text}")
    return "int", str(v)


def parse_row(line: str, number: int) -> tuple[str, dict[int, tuple[str, str]]] | None:
    """("dense" or "sparse", column → cell); None for a line without a row. A dense row with an empty cell is sparse."""
    t = tokens(line, number)
    if not t:
        return None
    if t[0][0] == "{":
        if t[-1][0] != "}":
            raise CsvError(f"line {number}: unclosed sparse row")
        cells: dict[int, tuple[str, str]] = {}
        body = t[1:-1]
        while body:
            if len(body) < 2 or body[0][0] != "b" or not body[0][1].isdigit() or body[1][0] not in "bq":
                raise CsvError(f"line {number}: bad sparse row")
            cells[int(body[0][1])] = typed(*body[1], number)
            body = body[2:]
            if body and (body[0][0] != "," or len(body) < 2):
                raise CsvError(f"line {number}: bad sparse row")
            body = body[1:]
        return "sparse", cells
    cells, column, filled, empty = {}, 0, False, False
    for kind, text in t:
        if kind == ",":
            empty |= not filled
            column, filled = column + 1, False
        elif kind in "bq" and not filled:
            cells[column], filled = typed(kind, text, number), True
        else:
            raise CsvError(f"line {number}: bad row")
    empty |= not filled
    return ("sparse" if empty else "dense"), cells


def parse_header(line: str, number: int = 1) -> list[str]:
    return [text for kind, text in tokens(line, number) if kind in "bq"]


def parse(lines: DataFrame, width: int | None = None) -> DataFrame:
    """row_id, form, cells (map of column to struct<kind, value>) from line_no, line; lines without a row go. Dense rows of
    another width than given raise."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for no, line in zip(b["line_no"], b["line"], strict=True):
                if (row := parse_row(line, int(no))) is None:
                    continue
                if width is not None and row[0] == "dense" and len(row[1]) != width:
                    raise CsvError(f"line {no}: {len(row[1])} cells, {width} expected")
                out.append((no, row[0], {c: {"kind": k, "value": v} for c, (k, v) in row[1].items()}))
            yield pd.DataFrame(out, columns=["row_id", "form", "cells"])

    return lines.mapInPandas(run, "row_id long, form string, cells map<int, struct<kind:string, value:string>>")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, line of a text file. Numbers follow the file's order and may have gaps between its parts."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def spooled(spark: SparkSession, stream: BinaryIO, block: int = 1 << 20) -> str:
    """Path of a file in the shared folder with the bytes of a stream of the driver; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/timberline/spool-{uuid.uuid4().hex}.csv"
    fs, p = file_system(spark, path)
    fs.deleteOnExit(p)
    out = fs.create(p)
    try:
        while got := stream.read(block):
            out.write(bytearray(got))
    finally:
        out.close()
    return path


def read(spark: SparkSession, path: str | None = None, header: bool = True) -> tuple[list[str], DataFrame]:
    """(names, rows as parse gives them) of a file in the dialect; without a path, of the driver's standard input."""
    lines = numbered_lines(spark, spooled(spark, sys.stdin.buffer) if path is None else path)
    if not header:
        return [], parse(lines)
    first = lines.where(~F.ltrim(F.regexp_replace("line", "#.*", "")).eqNullSafe("")).orderBy("line_no").first()
    if first is None:
        return [], parse(lines)
    names = parse_header(first["line"])
    return names, parse(lines.where(F.col("line_no") > first["line_no"]), len(names))


def to_cells(rows: DataFrame) -> DataFrame:
    """fid, row_id, kind, value in long form."""
    return rows.select("row_id", F.explode("cells").alias("fid", "c")).select("fid", "row_id", "c.kind", "c.value")


def write_subset(df: DataFrame, path: str, program: list[str], start: str = "none", header: bool = True, form: str = "dense") -> list[str]:
    """Writes the columns that the program selects as CSV; their names. form: dense, sparse ({i v, ...} of the cells that are
    neither missing nor 0; the header is a file of its own, header.csv) or header (that file only)."""
    names = select_columns(df.columns, program, start)
    if form == "dense":
        df.select(*map(named, names)).write.mode("overwrite").option("header", header).csv(path)
        return names
    if form not in ("sparse", "header"):
        raise ValueError(f"unknown form {form}")
    lines = df.select(sparse_line(df, names).alias("value")) if form == "sparse" else df.sparkSession.createDataFrame([], "value string")
    lines.write.mode("overwrite").text(path)
    if header or form == "header":
        fs, at = file_system(df.sparkSession, f"{path}/header.csv")
        out = fs.create(at, True)
        out.write((",".join(quote(n) for n in names) + "\n").encode())
        out.close()
    return names


def quote(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def sparse_line(df: DataFrame, names: list[str]) -> Column:
    """A row in the sparse form."""
    numeric = {f.name for f in df.schema if isinstance(f.dataType, NumericType)}
    text = lambda c: named(c).cast("string") if c in numeric else F.replace(quoted(named(c).cast("string")), F.lit("\n"), F.lit("\\n"))
    cell = lambda i, c: F.when(named(c).isNotNull() & (named(c) != 0) if c in numeric else named(c).isNotNull(), F.concat(F.lit(f"{i} "), text(c)))
    return F.concat(F.lit("{"), F.concat_ws(", ", *[cell(i, c) for i, c in enumerate(names)]), F.lit("}"))


def prediction_lines(scored: DataFrame, column: str = "score") -> DataFrame:
    """value: a prediction a line, with six digits."""
    return scored.select(F.format_string("%.6f", named(column).cast("double")).alias("value"))


def write_predictions(scored: DataFrame, path: str, column: str = "score", header: str | None = None) -> None:
    """Writes predictions as text, one a line; header, if given, is the first line of every file."""
    lines = prediction_lines(scored, column)
    if header is None:
        lines.write.mode("overwrite").text(path)
    else:
        lines.withColumnRenamed("value", header).write.mode("overwrite").option("header", True).csv(path)


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """label, prob of a file with two fields a line between white space; other lines raise."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "")
    bad = F.raise_error(F.concat(F.lit("not a label and a probability: "), F.col("value")))
    return rows.select(F.when(F.size(f) == 2, f[0]).otherwise(bad.cast("string")).alias("label"), F.try_element_at(f, F.lit(2)).try_cast("double").alias("prob"))


def floats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").cast("double").alias("v"))
