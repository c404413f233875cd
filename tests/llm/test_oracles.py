import pytest

from ragworks.llm.queries import oracle_sql, queries
from tests.compare import rows_of_duckdb, rows_of_spark


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_oracle(spark, data, name):
    assert rows_of_spark(queries()[name](spark, data)) == rows_of_duckdb(oracle_sql()[name], data)
