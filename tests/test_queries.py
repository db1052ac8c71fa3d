from __future__ import annotations

import pytest

from tests.oracle import held
from timberline.plans import encoding, learning, registry, serving

DATA = "/root/testdata/sf0.001"


def test_modules_register_their_queries():
    assert all(m.__name__ for m in (encoding, learning, serving))
    assert set(registry.ORACLES) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    held(spark, registry.QUERIES[name], registry.ORACLES[name], DATA)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0
