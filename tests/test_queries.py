"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from listwright.plans.fixtures import TABLES
from tests.conftest import SF
from tools.check_queries import rows_of

QUERIES, CHECKS = queries(), oracle_sql()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def test_entry(spark):
    assert entry(spark).count() == 1


def test_all_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in CHECKS:
        assert got[1]
        return
    result = sql.execute(CHECKS[name])
    assert got == rows_of([d[0] for d in result.description], result.fetchall())
