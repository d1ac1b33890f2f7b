"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone import queries as engine


def value(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(value(r[i]) for i in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = engine.QUERIES[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    if name in engine.ORACLE_SQL:
        ran = duck.execute(engine.ORACLE_SQL[name])
        names = [c[0] for c in ran.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, ran.fetchall())
    assert got


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
