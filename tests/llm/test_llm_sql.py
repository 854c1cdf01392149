"""The training-data queries that have SQL, against DuckDB on the smallest tables."""

import glob
import os

import pytest

from tokenmill.llm import queries

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = queries.queries()[name](spark, DIR)
    rows = sorted(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect())
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns) and rows
    at = [names.index(c) for c in sorted(names)]
    assert rows == sorted(tuple(str(r[i]) for i in at) for r in got.fetchall())
