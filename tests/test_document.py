from __future__ import annotations

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from timberline.operators.tree import Node, Tree
from timberline.sources.document import direction_runs, from_document, right_codes, to_document
from timberline.sources.model import Model

TREE = Tree({1: Node(0, fid=4, column="x", split=2.0), 2: Node(-0.4), 3: Node(0, fid=7, column="c", kind="cat", split=0.0, right_codes=[1, 3]), 6: Node(0.1), 7: Node(0.7)})
ROWS = [{"x": 3.0, "c": c} for c in ("a", "b", "d", "new", None)] + [{"x": 2.0, "c": "a"}, {"x": None, "c": "b"}]


def logistic():
    return Model([TREE, TREE.shrink(0.5)], "Y", "N", {"c": ["a", None, "b", "d"]})


@given(st.lists(st.booleans(), min_size=1, max_size=40))
def test_directions_round_trip(sides):
    codes = [i for i, right in enumerate(sides) if right]
    runs = direction_runs(codes, len(sides))
    assert right_codes(runs) == codes
    assert sum(runs["run_lengths"]) == len(sides) and min(runs["run_lengths"]) > 0


def test_directions_of_no_category():
    for codes, n in (([], 0), ([3], 3)):
        with pytest.raises(ValueError, match="categories"):
            direction_runs(codes, n)


def test_layout():
    kind, body = json.loads(to_document(logistic()))
    assert kind == "Logistic" and body["positive_category"] == "Y" and body["negative_category_opt"] == ["Some", "N"]
    assert body["features"] == [
        ["OrdinalFeature", {"feature_id": 4, "feature_name_opt": ["Some", "x"]}],
        ["CategoricalFeature", {"feature_id": 7, "feature_name_opt": ["Some", "c"], "categories": ["a", "b", "d"], "anonymous_category_index_opt": ["Some", 1]}],
    ]
    directions = {"first_direction": "Left", "run_lengths": [1, 1, 1, 1]}
    right = ["CategoricalNode", {"feature_id": 7, "category_directions": directions, "left_tree": ["Leaf", 0.1], "right_tree": ["Leaf", 0.7]}]
    assert body["trees"][0] == ["OrdinalNode", {"feature_id": 4, "split": 2.0, "left_tree": ["Leaf", -0.4], "right_tree": right}]


def test_scores_survive():
    m = logistic()
    back = from_document(to_document(m))
    assert (back.positive, back.negative, back.categories) == (m.positive, m.negative, m.categories)
    assert [back.score_one(r) for r in ROWS] == [m.score_one(r) for r in ROWS]
    square = from_document(to_document(Model(m.trees, categories=m.categories)))
    assert square.positive is None and square.score_one(ROWS[1]) == m.score_one(ROWS[1])
    assert to_document(back) == to_document(m)


def test_names_by_id():
    kind, body = json.loads(to_document(logistic()))
    body["features"][0][1]["feature_name_opt"] = "None"
    body["negative_category_opt"] = "None"
    with pytest.raises(ValueError, match="feature 4 has no name"):
        from_document(json.dumps([kind, body]))
    m = from_document(json.dumps([kind, body]), {4: "y"})
    assert m.columns() == ["c", "y"] and m.negative is None


def test_errors():
    with pytest.raises(ValueError, match="unknown kind"):
        from_document('["Other", {}]')
    with pytest.raises(ValueError, match="no feature 4"):
        from_document('["Square", {"features": [], "trees": [["OrdinalNode", {"feature_id": 4, "split": 1, "left_tree": ["Leaf", 0], "right_tree": ["Leaf", 1]}]]}]')
    with pytest.raises(ValueError, match="no categories"):
        to_document(Model([TREE]))
