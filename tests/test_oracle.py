"""Every registered query against its SQL oracle on the smallest tables."""

import os
from decimal import Decimal

import pytest

import __spark_entry__ as contract

duckdb = pytest.importorskip("duckdb")

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, (float, Decimal)):
        return round(float(value), 9)
    return value


def ordered(rows):
    return sorted((tuple(plain(v) for v in row) for row in rows), key=repr)


QUERIES = contract.queries()
ORACLE = contract.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = ordered(df.select(*columns).collect())
    if name not in ORACLE:
        assert got
        return
    result = duck.execute(ORACLE[name])
    header = [c[0] for c in result.description]
    assert sorted(header) == columns
    expected = ordered([[row[header.index(c)] for c in columns] for row in result.fetchall()])
    assert got == expected


def test_entry(spark):
    assert contract.entry(spark).count() > 0
