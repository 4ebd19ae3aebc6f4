"""Every query that has SQL gives the same rows as DuckDB; every other one gives rows."""

import pytest
from compare import connection, rows_of_duckdb, rows_of_spark
from conftest import SF

from paperloom.plans import registry


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    found = rows_of_spark(registry.queries()[name](spark, SF))
    if name in registry.oracle_sql():
        assert found == rows_of_duckdb(con, registry.oracle_sql()[name])
    else:
        assert found[1]
