from __future__ import annotations

import pytest

from tests.oracle import held
from timberline.llm import queries

DATA = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    held(spark, queries.QUERIES[name], queries.ORACLES[name], DATA)


def test_contract_columns(spark):
    kinds = {
        "op2_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
        "op4_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op7_mix_sources": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
        "op8_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
        "op10_nearest": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    }
    for name, want in kinds.items():
        assert want.items() <= dict(queries.QUERIES[name](spark, DATA).dtypes).items()
