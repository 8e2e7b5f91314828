"""Every registered query of the library against its DuckDB form; those without one must run and keep their schema."""

import glob
import os

import duckdb
import pytest

from loomline.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return "None"
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    out = catalog.queries()[name](spark, SF)
    columns = sorted(out.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in out.collect())
    sql = catalog.oracle_sql().get(name)
    if not sql:
        assert rows
        return
    found = duck.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["tier", "n", "pct"]
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
