"""The registered queries give the rows of their SQL, and every document has its row."""

import pytest
from compare import connection, rows_of_duckdb, rows_of_spark
from conftest import SF

from paperloom.llm import queries


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, con, name):
    found = rows_of_spark(queries.queries()[name](spark, SF))
    if name in queries.oracle_sql():
        assert found == rows_of_duckdb(con, queries.oracle_sql()[name])
    else:
        key, table = ("page_id", "pages") if "page_id" in found[0] else ("doc_id", "documents")
        assert {r[found[0].index(key)] for r in found[1]} == set(float(r[0]) for r in con.execute(f"SELECT {key} FROM {table}").fetchall())
