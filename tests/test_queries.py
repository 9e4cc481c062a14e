"""Every registered query of the library against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from orbitlake.plans.all_queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    out = QUERIES[name](spark, DATA)
    cols = sorted(out.columns)
    want = db.execute(f"select {', '.join(cols)} from ({SQL[name]})").fetchall()
    assert sorted(map(tuple, out.select(*cols).collect()), key=repr) == sorted(want, key=repr)
