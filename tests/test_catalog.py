"""Every query agrees with its SQL on the smallest tables."""

import duckdb
import pytest

from catalog import all_queries, all_sql
from check_sql import TABLES, compare
from tests.conftest import SMALL, plan

SQL = all_sql()


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def test_every_sql_has_a_query():
    assert set(SQL) <= set(all_queries())


FORBIDDEN = ("PythonUDF", "MapInPandas", "ArrowEvalPython", "BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", list(all_queries()))
def test_query_agrees_with_sql(spark, database, name):
    """Also: no Python workers and no cross joins in any plan."""

    def inspect(df):
        text = plan(df)
        assert not [bad for bad in FORBIDDEN if bad in text]

    result, _ = compare(spark, database, all_queries()[name], SQL.get(name), SMALL, inspect)
    assert result.startswith(("ok", "rows only")), result
