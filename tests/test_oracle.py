"""Every query with SQL agrees with it on the small tables."""

import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__

QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return str(round(v, 6) + 0.0 if isinstance(v, float) else v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    want = duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    rows = lambda rs, names: sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in rs)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), want.columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_queries_without_sql_run(spark, sf_dir):
    for name in sorted(set(QUERIES) - set(SQL)):
        if not name.startswith("p"):
            assert QUERIES[name](spark, sf_dir).count() > 0, name
