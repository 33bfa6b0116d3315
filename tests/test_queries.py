"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(columns, rows):
    order = sorted(columns)
    show = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(show(r[columns.index(c)]) for c in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    got = plain(df.columns, df.collect())
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    cursor = duck.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == plain(columns, cursor.fetchall())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "log_span" in df.columns
