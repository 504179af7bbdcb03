"""Every query with SQL gives the rows that SQL gives, over whole tables."""

import glob
import math
import os

import duckdb
import pytest

from sheafwork.plans import catalog


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, data, duck, name):
    got = catalog.queries()[name](spark, data)
    names = sorted(got.columns)
    rows = sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=repr)
    want = duck.execute(catalog.oracle_sql()[name])
    at = [c[0] for c in want.description]
    assert names == sorted(at)
    assert rows == sorted((tuple(plain(r[at.index(n)]) for n in names) for r in want.fetchall()), key=repr)


def test_queries_without_sql_run(spark, data):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, data).count() >= 0


def test_entry_point():
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
