"""Every query with SQL against that SQL in DuckDB, on the smallest tables."""

import os

import pytest

from stratalode.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def compare(spark, duck, query, sql):
    df = query(spark, SF)
    cols = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    got = duck.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", list(core.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    compare(spark, duck, core.QUERIES[name], core.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(core.QUERIES) <= set(__spark_entry__.queries())
