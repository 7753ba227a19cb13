"""Queries with SQL give its rows; the others are tried against brute force in their own files."""

import pytest

from fleetlens.llm import queries
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert compare(spark, connect(SF), queries.queries()[name], queries.oracle_sql()[name], SF) is None


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
