"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from newsgraph.plans.queries import QUERIES
from oracle.sql import ORACLE
from tools.check_oracle import TABLES, sorted_rows

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_its_sql(spark, database, name):
    df = entry.queries()[name](spark, DATA)
    result = database.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    found = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    assert found == sorted_rows(columns, result.fetchall())


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["label", "n_articles"]
    assert entry.entry(spark).count() > 0
