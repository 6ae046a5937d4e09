"""Every query of the library proper that SQL can state, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from sparkloom.plans.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NO_ORACLE = {"jn_03", "jn_03_recall", "gen_03_chunks", "set_05", "gen_01", "gen_04"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float) or hasattr(v, "as_integer_ratio") and not isinstance(v, (int, bool)):
        return f"{round(float(v), 6) + 0.0:.6g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if getattr(v, "tzinfo", None):
        return v.replace(tzinfo=None)
    return v


def test_only_named_queries_lack_an_oracle():
    assert QUERIES.keys() - ORACLES.keys() == NO_ORACLE


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    want = sorted((tuple(plain(dict(zip(rel.columns, row))[c]) for c in columns) for row in rel.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert os.path.isdir(FOLDER)
    assert __spark_entry__.entry(spark).count() >= 0
