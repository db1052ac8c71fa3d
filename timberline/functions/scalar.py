"""Scalar functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(column: str) -> Column:
    """A column whatever marks are in its name."""
    return F.col("`" + column.replace("`", "``") + "`")


def basename(path: Column) -> Column:
    """What follows the last slash."""
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def timestamp_text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def probability(f: Column) -> Column:
    return 1 / (1 + F.exp(-2 * f))


def inverted(p: Column) -> Column:
    """Probability of the other class."""
    return 1 - p


def log_odds(f: Column) -> Column:
    """Log-odds of the positive class under a score f; the score counts half of them."""
    return 2 * f


def binary_log_loss(p: Column, positive: Column, clamp: float = 1 - 1e-8) -> Column:
    """-ln of the probability given to what happened; certain and wrong is infinite."""
    inf = F.lit(float("inf"))
    return F.when(positive, F.when(p <= 1 - clamp, inf).otherwise(-F.log(p))).otherwise(F.when(p >= clamp, inf).otherwise(-F.log(1 - p)))


def clamped(g: Column, most: float | None) -> Column:
    return g if most is None else F.greatest(F.lit(-most), F.least(F.lit(most), g))


def trapezoid(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (y1 + y2) / 2


def bit_width(n: Column) -> Column:
    """Bits that tell n values apart, at least one."""
    return F.when(n <= 2, 1).otherwise(F.length(F.bin(n.cast("long") - 1))).cast("int")


def byte_width(n: Column) -> Column:
    return F.ceil(bit_width(n) / 8).cast("int")


def xor(a: Column, b: Column) -> Column:
    return a != b


def and_not(a: Column, b: Column) -> Column:
    return a & ~b


def duration_seconds(text: Column) -> Column:
    """Seconds of "90s", "5m", "1.2h", "2d" or a plain number of seconds; null for anything else."""
    number = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]*)?)([smhd]?)$", 1)
    unit = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]*)?)([smhd]?)$", 2)
    per = F.when(unit == "m", 60.0).when(unit == "h", 3600.0).when(unit == "d", 86400.0).otherwise(1.0)
    return F.when(number != "", number.cast("double") * per)


def descriptor_kind(text: Column) -> Column:
    """"id" or "name" of a feature descriptor "id:n" or "name:x"; a bare text is a name."""
    return F.when(text.rlike(r"^id:[0-9]+$"), "id").otherwise("name")


def descriptor_value(text: Column) -> Column:
    return F.regexp_replace(text, r"^(id:(?=[0-9]+$)|name:)", "")


def identifier(text: Column) -> Column:
    """A name that generated code can use."""
    return F.translate(text, ". :-", "____")


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def cell_kind(text: Column) -> Column:
    """Kind of a raw cell: int, float, string or empty; a float with an integral value is an int, a quoted cell a string."""
    number = text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    d = F.when(number, text.cast("double"))
    return F.when(text.isNull() | (text == ""), "empty").when(~number, "string").when(d == F.floor(d), "int").otherwise("float")


def find_rank(breakpoints: Column, v: Column) -> Column:
    """Rank of v: the least i with v <= breakpoints[i], the last one for larger values."""
    return F.least(F.size(F.filter(breakpoints, lambda b: b < v)), F.size(breakpoints) - 1)


def updated_smoother(theta: Column, rinv: Column, y: Column, forget: float) -> tuple[Column, Column]:
    """Next (theta, rinv) of the exponentially forgetting mean."""
    r = rinv / (F.lit(forget) + rinv)
    return theta + r * (y - theta), r
