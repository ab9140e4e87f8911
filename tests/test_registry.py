"""Every query with SQL against DuckDB over the smallest tables."""

import glob
import os

import duckdb
import pytest

from graphweft.functions.scalars import glob_pattern
from graphweft.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(str, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_duckdb(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(registry.SQL[name]).df())


def test_the_two_glob_dialects():
    import re

    assert re.match(glob_pattern("a/*.py"), "a/b/c.py")
    assert not re.match(glob_pattern("a/*.py", star_crosses=False), "a/b/c.py")
    assert re.match(glob_pattern("a/**.py", star_crosses=False), "a/b/c.py")


def test_reach_ends_on_cycles(spark):
    from graphweft.operators.traverse import reach

    edges = spark.createDataFrame([("a", "b", "CALLS"), ("b", "a", "CALLS"), ("c", "a", "CALLS")], "from_id string, to_id string, relation string")
    got = {(r.from_id, r.to_id, r.depth) for r in reach(edges, ["a"], ["CALLS"], 5).collect()}
    assert got == {("b", "a", 1), ("c", "a", 1), ("a", "b", 2)}
