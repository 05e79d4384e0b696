import duckdb
import pytest

import __spark_entry__ as entry_module
from check import normal
from workload.data import TABLES

SF = "/root/testdata/sf0.001"
ORACLES = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(entry_module.queries()))
def test_query_equals_its_sql(spark, con, name):
    got = entry_module.queries()[name](spark, SF).toPandas()
    if name in ORACLES:
        want = normal(con.execute(ORACLES[name]).fetch_df())
        got = normal(got)
        assert list(got.columns) == list(want.columns)
        assert got.equals(want)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
