"""Every query with an oracle, on the smallest tables, against DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from engram import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 7) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if v is not None and not isinstance(v, (int, bool)) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, db, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    cur = db.execute(registry.ORACLES[name])
    order = [x[0] for x in cur.description]
    assert sorted(order) == cols
    want = sorted((tuple(plain(r[order.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str) == want
