"""Each query against its SQL in DuckDB, over the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from tessera.plans import catalog

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", catalog.queries())
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    sql = catalog.oracle_sql().get(name)
    if sql:
        r = duck.execute(sql)
        at = [x[0] for x in r.description]
        assert sorted(at) == columns
        want = sorted((tuple(plain(x[at.index(c)]) for c in columns) for x in r.fetchall()), key=str)
        assert got == want
