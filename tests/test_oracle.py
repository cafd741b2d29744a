"""Every core query against its SQL, over whole tables."""

import datetime
import math
import os

import duckdb
import pytest

from srcatlas.plans import registry

DATA = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def norm(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return str(v)
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted(([norm(r[c]) for c in cols] for r in df.collect()), key=str)
    cur = duck.execute(SQL[name])
    at = [d[0] for d in cur.description]
    assert sorted(at) == cols
    other = sorted(([norm(r[at.index(c)]) for c in cols] for r in cur.fetchall()), key=str)
    assert rows == other
