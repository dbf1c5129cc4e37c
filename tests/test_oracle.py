"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import pytest

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _entry():
    import __spark_entry__

    return __spark_entry__


NAMES = sorted(_entry().oracle_sql()) if os.path.isdir(SF) else []


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "tzinfo") else v.isoformat()
    if isinstance(v, float):
        return round(v, 6)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((repr(tuple(plain(r[i]) for i in order)) for r in data))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    e = _entry()
    df = e.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(e.oracle_sql()[name])
    assert got == rows(rel.columns, rel.fetchall())


def test_entry(spark):
    assert _entry().entry(spark).limit(1).count() == 1
