"""Globs joined by their literal keys against every pattern tried on every path."""

import random

import pytest
from pyspark.sql import functions as F

from graphweft.operators import globs

_GLOBS = [
    "src/a.py", "src/*.py", "src/**", "src/**/*.py", "**/*.test.js", "*.md", "*", "**", "**/gen/**", "*gen*", "doc*", "doc?", "src/a?.py", "/top*", "a.b/*", "a+b/**", "[x]/*", "", "s*c/a.py", "**/a.py", "src/lib/", "?", None,
]
_PATHS = ["src/a.py", "src/ab.py", "src/x/a.py", "src/x/y/b.py", "src", "src/", "a.test.js", "w/a.test.js", "README.md", "d/README.md", "gen", "x/gen/y", "gen/y", "x/gen", "docs", "doc", "doc?", "/topmost", "/t", "a.b/c", "aXb/c", "a+b/c/d", "[x]/q", "x/q", "", "s/c/a.py", "src/a?.py", "src/lib/", None]


def pairs(frame):
    return sorted((r["path"], r["glob"]) for r in frame.collect())


@pytest.mark.parametrize("crosses", [False, True])
def test_the_join_finds_what_every_pattern_on_every_path_finds(spark, crosses):
    rng = random.Random(11)
    made = ["".join(rng.choices(["a", "b", "/", "*", "**", ".py", "?"], k=rng.randint(1, 7))) for _ in range(150)]
    seen = ["".join(rng.choices(["a", "b", "/", ".py"], k=rng.randint(1, 7))) for _ in range(150)]
    paths = spark.createDataFrame([(p,) for p in (_PATHS + seen) * 2], "path string")
    own = spark.createDataFrame([(g,) for g in (_GLOBS + made) * 2], "glob string")
    tried = paths.distinct().crossJoin(own.distinct().withColumn("p", globs.glob_column(F.col("glob"), crosses))).filter(F.expr("path rlike p")).select("path", "glob")
    assert pairs(globs.matches(paths, own, crosses)) == pairs(tried)


def test_no_glob_and_no_path(spark):
    none_path, none_glob = spark.createDataFrame([], "path string"), spark.createDataFrame([], "glob string")
    assert globs.matches(none_path, spark.createDataFrame([("*",)], "glob string")).count() == 0
    assert globs.matches(spark.createDataFrame([("a",)], "path string"), none_glob).count() == 0


def test_ten_thousand_globs_need_no_nested_loop(spark, capsys):
    own = spark.range(10_000).selectExpr("concat(case when id % 3 = 0 then '**/' else concat('d', id % 50, '/') end, 'f', id, '*.py') as glob")
    paths = spark.range(20_000).selectExpr("concat('d', id % 50, '/f', id, '.py') as path")
    found = globs.matches(paths, own)
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.filter("glob = 'd4/f4*.py'").count() == len([k for k in range(20_000) if k % 50 == 4 and str(k).startswith("4")])
