"""Every query with SQL against DuckDB, on the smallest of the given tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as driver

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


def same(x):
    return round(x, 9) if isinstance(x, float) and not math.isnan(x) else str(x)


def core(names):
    return sorted(n for n in names if not n.startswith(("p1_", "p5_", "p6_", "p7_", "p8_")))


def compare(spark, duck, name):
    df = driver.queries()[name](spark, DATA)
    want = duck.sql(driver.oracle_sql()[name])
    assert set(df.columns) == set(want.columns)
    got = sorted(repr([same(v) for v in r]) for r in df.select(*want.columns).collect())
    assert got == sorted(repr([same(v) for v in r]) for r in want.fetchall())


@pytest.mark.parametrize("name", core(driver.oracle_sql()))
def test_against_sql(spark, duck, name):
    compare(spark, duck, name)


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_all_core_queries_have_sql():
    assert set(core(driver.queries())) == set(core(driver.oracle_sql()))


def test_key_rows_meet_whole(spark, duck):
    """Both columns pass whole through the registered set operations: what is in one only comes out, odd or even."""
    only = lambda a, b: {k for (k,) in duck.sql(f"select user_id from {a} except select user_id from {b}").fetchall()}
    run = lambda name: {r.k for r in driver.queries()[name](spark, DATA).collect()}
    owners, users = only("playlist", "users"), only("users", "playlist")
    assert owners and users and any(k and k % 2 for k in owners | users)
    assert run("keyset_whole_minus") == owners and run("keyset_whole_minus_back") == users
    assert run("keyset_whole_union") >= owners | users
