from __future__ import annotations

import pytest

from parchmill.llm.oracle import oracle_sql
from parchmill.llm.queries import queries
from tests.compare import compare, duck


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_in_both_engines(spark, sf_dir, name):
    assert compare(spark, duck(sf_dir), queries()[name], oracle_sql()[name], sf_dir) == []


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries()) == list(range(1, 14))
