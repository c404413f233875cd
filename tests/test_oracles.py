import pytest

from ragworks.jobs.queries import ORACLES, QUERIES
from tests.compare import rows_of_duckdb, rows_of_spark


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, data, name):
    assert rows_of_spark(QUERIES[name](spark, data)) == rows_of_duckdb(ORACLES[name], data)


def test_entry_has_every_query():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
