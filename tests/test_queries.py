"""Every registered query beside its SQL, whole results compared."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, table

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def sf_dir():
    # Some queries choose columns by their variance, which the SQL states for this size.
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def same(a: str, b: str) -> bool:
    """Equal, or the same number but for the last rounded place."""
    if a == b:
        return True
    try:
        return math.isclose(float(a), float(b), rel_tol=1e-6, abs_tol=1e-6)
    except ValueError:
        return False


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    names, mine = table(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(SQL[name])
    want_names, want = table([d[0] for d in cur.description], cur.fetchall())
    assert names == want_names
    assert len(mine) == len(want)
    for a, b in zip(mine, want, strict=True):
        assert all(same(x, y) for x, y in zip(a, b, strict=True)), (a, b)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "column"
    assert df.count() == 8


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert not QUERIES[name](spark, "/root/testdata/sf0.001").isEmpty()


def test_sql_only_for_registered_queries():
    assert set(SQL) <= set(QUERIES)
