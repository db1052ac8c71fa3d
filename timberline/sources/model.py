"""Models: forests as JSON documents, and scoring with them."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.scalar import inverted, log_odds, probability
from timberline.operators.tree import Node, Tree

#: Trees whose CASE expressions make one column; larger forests are summed over several.
TREES_A_COLUMN = 50


class ScoringError(ValueError):
    """A row or a table does not fit a model."""


class TypeMismatch(ScoringError):
    """Text where the model needs a number."""


class CategoryNotFound(ScoringError):
    """A category that the model does not know, without an anonymous one."""


class CategoryMissing(ScoringError):
    """A missing category, without an anonymous one."""


class ValueMissing(ScoringError):
    """A missing value that may not be missing."""


@dataclass
class Model:
    """A forest in value space. positive and negative label the classes of a logistic model; regression has none."""

    trees: list[Tree]
    positive: str | None = None
    negative: str | None = None
    categories: dict[str, list[str | None]] = field(default_factory=dict)

    def to_json(self) -> str:
        trees = [{str(i): asdict(n) for i, n in t.nodes.items()} for t in self.trees]
        return json.dumps({"positive": self.positive, "negative": self.negative, "categories": self.categories, "trees": trees}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Model:
        d = json.loads(text)
        return cls([Tree({int(i): Node(**n) for i, n in t.items()}) for t in d["trees"]], d["positive"], d["negative"], d["categories"])

    def save(self, path: str) -> None:
        """Writes the document to a path that Python can open on the driver."""
        with open(path, "w") as f:
            f.write(self.to_json())

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path) as f:
            return cls.from_json(f.read())

    def columns(self) -> list[str]:
        """Columns that scoring reads."""
        return sorted({n.column for t in self.trees for n in t.nodes.values() if n.fid is not None})

    def bind(self, df: DataFrame, strict: bool = False) -> DataFrame:
        """df with what the forest reads: missing numbers are 0; categories become codes, missing and unknown ones the code of
        the anonymous category (without one, or if strict, unknown ones raise)."""
        missing = [c for c in self.columns() if c not in df.columns]
        if missing:
            raise ScoringError(f"columns are missing: {', '.join(missing)}")
        for c in self.columns():
            if c not in self.categories:
                if dict(df.dtypes)[c] == "string":
                    raise TypeMismatch(f"{c} is text, the model needs a number")
                df = df.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
                continue
            known = self.categories[c]
            codes = F.create_map(*[F.lit(x) for i, v in enumerate(known) if v is not None for x in (v, i)])
            other = F.lit(known.index(None)) if None in known else F.raise_error(F.concat(F.lit(f"unknown category of {c}: "), F.coalesce(F.col(c), F.lit("(missing)")))).cast("int")
            if strict and None in known:
                other = F.when(F.col(c).isNull(), other).otherwise(F.raise_error(F.concat(F.lit(f"unknown category of {c}: "), F.col(c))).cast("int"))
            df = df.withColumn(c, F.coalesce(F.try_element_at(codes, F.col(c)), other))
        return df

    def raw(self) -> Column:
        groups = [self.trees[i : i + TREES_A_COLUMN] for i in range(0, len(self.trees), TREES_A_COLUMN)]
        sums = [sum((t.column() for t in g[1:]), g[0].column()) for g in groups]
        return sums[0] if len(sums) == 1 else F.aggregate(F.array(*sums), F.lit(0.0), lambda a, b: a + b)

    def score(self, df: DataFrame, positive: str | None = None, link: str | None = None, strict: bool = False) -> DataFrame:
        """df with score: a probability (of the class `positive` if named), log-odds, or the number of a regression."""
        if positive not in (None, self.positive, self.negative):
            raise ScoringError(f"the model has no class {positive}")
        f = self.raw()
        if self.positive is not None and link == "log_odds":
            f = log_odds(f)
        elif self.positive is not None and link in (None, "probability"):
            f = probability(f)
        flip = positive is not None and positive == self.negative
        f = (-f if link == "log_odds" else inverted(f)) if flip else f
        bound = self.bind(df.select("*", *[F.col(c).alias(f"_in_{c}") for c in self.columns() if c in df.columns]), strict)
        out = bound.withColumn("score", f)
        for c in self.columns():
            out = out.withColumn(c, F.col(f"_in_{c}")).drop(f"_in_{c}")
        return out

    def score_one(self, row: dict, missing_ok: bool = True) -> float:
        """Score of one row given as column → value."""

        def value(n: Node) -> float:
            v = row.get(n.column)
            if v is None and not missing_ok:
                raise ValueMissing(f"{n.column} is missing")
            if n.column in self.categories:
                known = self.categories[n.column]
                if v not in known and None not in known:
                    raise CategoryMissing(f"category of {n.column} is missing") if v is None else CategoryNotFound(f"unknown category of {n.column}: {v}")
                return known.index(v) if v in known else known.index(None)
            if isinstance(v, str):
                raise TypeMismatch(f"{n.column} is text, the model needs a number")
            return v or 0

        total = 0.0
        for t in self.trees:
            i = 1
            while (n := t.nodes[i]).fid is not None:
                v = value(n)
                i = 2 * i + (v > n.split if n.kind == "ord" else v in (n.right_codes or []))
            total += n.gamma
        return total
