"""The queries that SQL can express against DuckDB over the smallest tables."""

import glob
import os

import duckdb
import pytest

from graphweft.llm import queries

SF = "/root/testdata/sf0.001"


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[k] for k in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_duckdb(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    found, want = queries.QUERIES[name](spark, SF), c.sql(queries.SQL[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found.columns, map(tuple, found.collect())) == rows(want.columns, want.fetchall())
