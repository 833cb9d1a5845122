import os

import pytest

from oracle import DATA, connect, same
from orrery.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    return connect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, tables, name):
    same(spark, tables, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(spark, name):
    # at the smallest scale no document leaks an item
    assert queries.QUERIES[name](spark, DATA).count() >= (name != "p6_leaks")
