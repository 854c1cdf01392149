"""Every core query with SQL against DuckDB, on the smallest tables."""

import glob
import math
import os

import pytest

from tokenmill import queries as core

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "None"
    return repr(round(float(v), 5) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = core.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    rows = sorted(tuple(value(r[c]) for c in cols) for r in df.collect())
    sql = core.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted(tuple(value(r[i]) for i in at) for r in got.fetchall())
