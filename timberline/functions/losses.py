"""Losses of boosting: per-row terms z (pseudo-response), w (weight) and l (loss), and what a node does with their sums."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.functions.scalar import clamped


@dataclass(frozen=True)
class Logistic:
    """Two classes, y is +1 or -1; the score is half the log-odds."""

    name: str = "logistic"

    def terms(self, y: Column, f: Column) -> dict[str, Column]:
        m = -2 * y * f
        e = F.exp(F.least(m, F.lit(700.0)))
        z = F.when(m > 700, 2 * y).otherwise(2 * y * e / (1 + e))
        return {"z": z, "w": F.abs(z) * (2 - F.abs(z)), "l": F.when(m > 35, m).otherwise(F.log(1 + e))}

    def first(self, y: Column) -> Column:
        """Score of the constant first tree, null if there is one class only."""
        return 0.5 * F.log(F.try_divide(F.sum(F.when(y > 0, 1.0).otherwise(0.0)), F.sum(F.when(y < 0, 1.0).otherwise(0.0))))

    def gamma(self, n: Column, z: Column, w: Column) -> Column:
        return z / w

    def updated(self, g: Column, n: Column, z: Column, w: Column, l: Column) -> Column:  # noqa: E741
        return l - g * z + 0.5 * g * g * w

    def fine(self, n: Column, w: Column) -> Column:
        return (n > 0) & (w != 0)


@dataclass(frozen=True)
class Square:
    """Least squares, y is a number; a row weighs one."""

    name: str = "square"

    def terms(self, y: Column, f: Column) -> dict[str, Column]:
        return {"z": y - f, "w": F.lit(1.0), "l": (y - f) * (y - f)}

    def first(self, y: Column) -> Column:
        return F.avg(y)

    def gamma(self, n: Column, z: Column, w: Column) -> Column:
        return z / n

    def updated(self, g: Column, n: Column, z: Column, w: Column, l: Column) -> Column:  # noqa: E741
        return l + n * g * g - 2 * g * z

    def fine(self, n: Column, w: Column) -> Column:
        return n > 0


LOSSES = {"logistic": Logistic(), "square": Square()}


def side(loss: Logistic | Square, n: Column, z: Column, w: Column, l: Column, most: float | None) -> tuple[Column, Column]:  # noqa: E741
    """(gamma, loss after adding it) of one side of a split, from its sums."""
    g = clamped(loss.gamma(n, z, w), most)
    return g, loss.updated(g, n, z, w, l)
