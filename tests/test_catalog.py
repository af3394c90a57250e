"""Every archive query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from foliary.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(value):
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(name, spark, duck):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    rows = sorted(str([plain(r[c]) for c in order]) for r in got.collect())
    assert rows == sorted(str([plain(r[names.index(c)]) for c in order]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(name, spark):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
