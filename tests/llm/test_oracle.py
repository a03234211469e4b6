import pytest

from tests.oracle import check, connect
from tidemark.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, sf, name):
    check(QUERIES[name](spark, sf), connect(sf), ORACLE_SQL[name])
