"""Trees: level-wise growth, one Spark job a level, and their use as column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.scalar import named
from timberline.operators.splits import Feature, Search, goes_right, level_best_splits


@dataclass
class Node:
    """A node in heap numbering (root 1, children 2i and 2i + 1); a leaf has no fid."""

    gamma: float
    n: int = 0
    fid: int | None = None
    column: str | None = None
    kind: str = "ord"
    split: float | None = None
    right_codes: list[int] | None = None


@dataclass
class Tree:
    nodes: dict[int, Node] = field(default_factory=dict)

    def leaves(self) -> dict[int, Node]:
        return {i: n for i, n in self.nodes.items() if n.fid is None}

    def feature_ids(self) -> set[int]:
        return {n.fid for n in self.nodes.values() if n.fid is not None}

    def shrink(self, rate: float) -> Tree:
        return Tree({i: Node(n.gamma * rate, n.n, n.fid, n.column, n.kind, n.split, n.right_codes) for i, n in self.nodes.items()})

    def column(self, i: int = 1) -> Column:
        """The tree as a CASE expression over the features' columns."""
        n = self.nodes[i]
        if n.fid is None:
            return F.lit(float(n.gamma))
        right = goes_right(n.kind, named(n.column), n.split, n.right_codes)
        return F.when(right, self.column(2 * i + 1)).otherwise(self.column(2 * i))

    def sql(self, i: int = 1) -> str:
        """The same as SQL text that Spark and, where names need no quotes, other engines read."""
        n = self.nodes[i]
        if n.fid is None:
            return repr(float(n.gamma)) if abs(n.gamma) >= 1e-4 or n.gamma == 0 else f"{n.gamma:.18f}"
        name = n.column if re.fullmatch(r"[A-Za-z_][A-Za-z_0-9]*", n.column) else "`" + n.column.replace("`", "``") + "`"
        test = f"{name} > {n.split!r}" if n.kind == "ord" else f"{name} in ({', '.join(map(str, n.right_codes or [-1]))})"
        return f"case when {test} then {self.sql(2 * i + 1)} else {self.sql(2 * i)} end"

    def paths(self) -> list[tuple[int, float, list[int]]]:
        """(leaf, gamma, feature ids from the root) of every leaf."""
        out = []
        for i, n in self.leaves().items():
            up, ids = i // 2, []
            while up:
                ids.append(self.nodes[up].fid)
                up //= 2
            out.append((i, n.gamma, ids[::-1]))
        return out

    def in_values(self, breakpoints: dict[int, list[float]], columns: dict[int, str]) -> Tree:
        """Rank splits as value splits; codes stay codes."""
        made = {}
        for i, n in self.nodes.items():
            split = breakpoints[n.fid][int(n.split)] if n.fid is not None and n.kind == "ord" else n.split
            made[i] = Node(n.gamma, n.n, n.fid, columns.get(n.fid, n.column), n.kind, split, n.right_codes)
        return Tree(made)


def node_column(tree: Tree, level: int) -> Column:
    """Number of the node of a level in which a row is; rows that reached a leaf above get null."""

    def at(i: int, depth: int) -> Column:
        n = tree.nodes[i]
        if depth == level:
            return F.lit(i)
        if n.fid is None:
            return F.lit(None).cast("int")
        return F.when(goes_right(n.kind, named(n.column), n.split, n.right_codes), at(2 * i + 1, depth + 1)).otherwise(at(2 * i, depth + 1))

    return at(1, 0)


def grow(obs: DataFrame, s: Search, depth: int) -> Tree | None:
    """A tree with at most depth levels of nodes (depth 2: one split); obs has z, w, l and the features' columns. None if nothing splits. Only node rows come to the driver."""
    by_id = {f.fid: f for f in s.features}
    tree = Tree({1: Node(0.0)})
    open_nodes = {1}
    for level in range(depth - 1):
        if not open_nodes:
            break
        here = obs.withColumn("node", node_column(tree, level)).where(F.col("node").isin(*open_nodes))
        found = level_best_splits(here, s).collect()
        open_nodes = set()
        for r in sorted(found, key=lambda r: r["node"]):
            f: Feature = by_id[r["fid"]]
            old = tree.nodes[r["node"]]
            tree.nodes[r["node"]] = Node(old.gamma, old.n, f.fid, f.column, f.kind, r["x"], r["right_codes"] if f.kind == "cat" else None)
            tree.nodes[2 * r["node"]] = Node(r["gl"], r["left_n"])
            tree.nodes[2 * r["node"] + 1] = Node(r["gr"], r["right_n"])
            open_nodes |= {2 * r["node"], 2 * r["node"] + 1}
    return tree if tree.nodes[1].fid is not None else None
