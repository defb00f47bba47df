import pytest

from leafmill.llm import queries
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, small, name):
    same(spark, small, queries.QUERIES[name], queries.ORACLES[name])
