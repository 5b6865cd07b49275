"""Every core query with SQL gives the same rows as DuckDB on the smallest tables."""

import datetime
import decimal
import glob
import os

import pytest

from karwan import queries as core

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(D + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", sorted(core.SQL))
def test_same_rows(spark, duck, name):
    df = core.QUERIES[name](spark, D)
    c = duck.execute(core.SQL[name])
    names = [x[0] for x in c.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(x) for x in sorted(names)]
    want = sorted((tuple(plain(r[i]) for i in at) for r in c.fetchall()), key=repr)
    got = sorted((tuple(plain(r[x]) for x in sorted(names)) for r in df.collect()), key=repr)
    assert got == want
