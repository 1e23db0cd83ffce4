"""Every registered engine query against its SQL in DuckDB, and the driver's contract."""

import decimal

import duckdb
import pytest

import __spark_entry__
from folioscope.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(tables):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{tables}/{t}.parquet'")
    return connection


def plain(rows):
    return sorted((tuple(round(float(x), 6) if isinstance(x, float | decimal.Decimal) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, tables, db, name):
    got = QUERIES[name](spark, tables)
    columns = sorted(got.columns)
    found = db.execute(SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert plain(map(tuple, got.select(*columns).collect())) == plain(tuple(r[i] for i in at) for r in found.fetchall())


def test_contract(spark):
    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
