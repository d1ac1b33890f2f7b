import os

import duckdb
import pytest

from lodestone.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_gives_the_same_rows(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    ran = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in ran.description]
    got = queries.QUERIES[name](spark, sf_dir).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(ran.fetchall()) if name != "op9_warc" else sorted(map(str, map(tuple, got))) == sorted(map(str, ran.fetchall()))
