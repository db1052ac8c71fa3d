"""Models as nested JSON documents that other evaluators exchange.

A document is a pair of a kind ("Logistic" or "Square") and a record of features and trees. Variants are [name, content] or a
bare name, options "None" or ["Some", x]. A categorical node holds the directions of all codes as lengths of runs that take
turns, an ordinal one the largest value that goes left.
"""

from __future__ import annotations

import json
from itertools import groupby

from timberline.operators.tree import Node, Tree
from timberline.sources.model import Model

SIDES = ("Left", "Right")


def direction_runs(right_codes: list[int], n: int) -> dict:
    """Directions of the codes 0 to n - 1 as runs: the first one's side, and how many codes share each side in turn."""
    right = set(right_codes)
    if n < 1 or not right <= set(range(n)):
        raise ValueError(f"codes {sorted(right)} among {n} categories")
    sides = [k in right for k in range(n)]
    return {"first_direction": SIDES[sides[0]], "run_lengths": [len(list(g)) for _, g in groupby(sides)]}


def right_codes(runs: dict) -> list[int]:
    """The codes that go right."""
    side, at, out = SIDES.index(runs["first_direction"]), 0, []
    for n in runs["run_lengths"]:
        out += range(at, at + n) if side else []
        side, at = 1 - side, at + n
    return out


def _option(x):
    return "None" if x is None else ["Some", x]


def _value(x):
    """What an option holds; null and a missing field are none, too."""
    return x[1] if isinstance(x, list) else None


def _features(m: Model) -> list[list]:
    """The features that trees use, without data: id, name, and categories apart from the anonymous one's place."""
    used = {n.fid: n for t in m.trees for n in t.nodes.values() if n.fid is not None}
    out: list[list] = []
    for fid, n in sorted(used.items()):
        record = {"feature_id": fid, "feature_name_opt": _option(n.column)}
        if n.kind == "ord":
            out.append(["OrdinalFeature", record])
            continue
        if n.column not in m.categories:
            raise ValueError(f"no categories of {n.column}")
        known = m.categories[n.column]
        record["categories"] = [v for v in known if v is not None]
        record["anonymous_category_index_opt"] = _option(known.index(None) if None in known else None)
        out.append(["CategoricalFeature", record])
    return out


def to_document(m: Model) -> str:
    def tree(t: Tree, i: int) -> list:
        n = t.nodes[i]
        if n.fid is None:
            return ["Leaf", float(n.gamma)]
        record: dict = {"feature_id": n.fid}
        if n.kind == "ord":
            record["split"] = float(n.split)
        else:
            record["category_directions"] = direction_runs(n.right_codes or [], len(m.categories[n.column]))
        record |= {"left_tree": tree(t, 2 * i), "right_tree": tree(t, 2 * i + 1)}
        return ["OrdinalNode" if n.kind == "ord" else "CategoricalNode", record]

    head = {} if m.positive is None else {"positive_category": m.positive, "negative_category_opt": _option(m.negative)}
    return json.dumps(["Square" if m.positive is None else "Logistic", head | {"features": _features(m), "trees": [tree(t, 1) for t in m.trees]}])


def from_document(text: str, columns: dict[int, str] | None = None) -> Model:
    """The model of a document. columns names features by id, in place of or for want of a name of their own."""
    kind, body = json.loads(text)
    if kind not in ("Logistic", "Square"):
        raise ValueError(f"unknown kind of model: {kind}")
    names: dict[int, str] = {}
    categories: dict[str, list[str | None]] = {}
    for what, f in body["features"]:
        fid = f["feature_id"]
        name = (columns or {}).get(fid, _value(f.get("feature_name_opt")))
        if name is None:
            raise ValueError(f"feature {fid} has no name")
        names[fid] = name
        if what == "CategoricalFeature":
            known: list[str | None] = list(f["categories"])
            at = _value(f.get("anonymous_category_index_opt"))
            categories[name] = known if at is None else [*known[:at], None, *known[at:]]

    def nodes(tree: list, i: int, out: dict[int, Node]) -> dict[int, Node]:
        what, x = tree
        if what == "Leaf":
            out[i] = Node(float(x))
            return out
        fid = x["feature_id"]
        if fid not in names:
            raise ValueError(f"no feature {fid}")
        if what == "OrdinalNode":
            out[i] = Node(0.0, fid=fid, column=names[fid], split=float(x["split"]))
        else:
            out[i] = Node(0.0, fid=fid, column=names[fid], kind="cat", split=0.0, right_codes=right_codes(x["category_directions"]))
        return nodes(x["right_tree"], 2 * i + 1, nodes(x["left_tree"], 2 * i, out))

    trees = [Tree(nodes(t, 1, {})) for t in body["trees"]]
    return Model(trees, body.get("positive_category"), _value(body.get("negative_category_opt")), categories)
