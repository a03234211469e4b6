import pytest

from tests.oracle import check, connect
from tidemark.plans.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, sf, con, name):
    check(QUERIES[name](spark, sf), con, ORACLE_SQL[name])


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
