import pytest
from oracle import agree

from quern.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, data, name):
    agree(spark, queries.queries()[name], queries.oracle_sql()[name], data)
