"""The stored indexes against the operators that look at every row."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphweft.operators import lineage, search, text_index, vector_index

_SCHEMA = "id string, text string"


def index_of(spark, rows):
    path = lineage.scratch_path(spark, "text-index-test")
    docs = spark.createDataFrame(rows, _SCHEMA)
    text_index.build(docs, "id", "text", path)
    return docs, text_index.load(spark, path)


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    words = ["th", "the", "then", "rean", "r", "a1", "zz", "zzz", "z", "über", "x_y"]
    rows = [(f"d{k:03}", " ".join(rng.choices(words, k=rng.randint(1, 30)))) for k in range(120)]
    rows += [("null", None), ("empty", ""), ("marks", "?! --"), ("long", "the " * 60_000 + "zzz"), ("same1", "Zz THE"), ("same2", "zz the")]
    return index_of(spark, rows)


@pytest.mark.parametrize("query", ["th", "the zz", "z", "zzz the r", "nothing", "the nothing", "", "?!", "the the", "a b c d e f g h i", "R'E ü"])
def test_a_search_in_the_index_equals_one_in_the_texts(texts, query):
    docs, index = texts
    assert [tuple(r) for r in text_index.search(index, query, 40).collect()] == [tuple(r) for r in search.full_text(docs, "id", "text", query, 40).collect()]


def test_many_searches_equal_single_ones(spark, texts):
    docs, index = texts
    asked = ["th", "the zz", "the zz", "zzz the r", "the the", "nothing", "", None, "?!", "z th re a u x z z th"]
    many = text_index.search_many(index, spark.createDataFrame(list(enumerate(asked)), "query_id int, query string"), 7).orderBy("query_id", "rn").collect()
    for k, query in enumerate(asked):
        own = [(r["key"], r["score"]) for r in many if r["query_id"] == k]
        assert own == [tuple(r) for r in search.full_text(docs, "id", "text", query or "", 7).collect()], query


def test_many_searches_are_exact_however_little_they_look_at_first(spark, texts, monkeypatch):
    monkeypatch.setattr(text_index, "FIRST", 1)
    docs, index = texts
    asked = ["th", "the zz", "zzz the r", "the the", "re z th a", "zz th"]
    for limit in (1, 5):
        many = text_index.search_many(index, spark.createDataFrame(list(enumerate(asked)), "query_id int, query string"), limit).orderBy("query_id", "rn").collect()
        for k, query in enumerate(asked):
            assert [(r["key"], r["score"]) for r in many if r["query_id"] == k] == [tuple(r) for r in search.full_text(docs, "id", "text", query, limit).collect()], query


def test_many_searches_score_a_part_of_the_texts_that_hold_their_words(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(f"d{k:04}", " ".join(["aa"] * rng.randint(1, 9) + ["bb"] * rng.randint(1, 9) + ["x"] * rng.randint(1, 40))) for k in range(3000)]
    rows += [(f"same{k:04}", "aa bb bb") for k in range(500)]
    docs, index = index_of(spark, rows)
    scored, best = [], text_index.top_per_group

    def counted(frame, group, order, k):
        if "score" in frame.columns:
            scored.append(frame.count())
        return best(frame, group, order, k)

    monkeypatch.setattr(text_index, "top_per_group", counted)
    found = text_index.search_many(index, spark.createDataFrame([(1, "aa bb")], "query_id int, query string"), 5).orderBy("rn").collect()
    assert [(r["key"], r["score"]) for r in found] == [tuple(r) for r in search.full_text(docs, "id", "text", "aa bb", 5).collect()]
    assert sum(scored) < 2000


def test_postings_are_dealt_out_in_blocks(spark, monkeypatch):
    rows = [(f"d{k}", f"The word{k % 3} \u212aelvin \u0130stanbul caf\u00e9") for k in range(300)]
    path = lineage.scratch_path(spark, "text-index-test")
    docs = spark.createDataFrame(rows, _SCHEMA).coalesce(1)
    text_index.build(docs, "id", "text", path)
    assert spark.read.parquet(f"{path}/postings").count() < 30  # 2,100 with a row a posting
    index = text_index.load(spark, path)
    for query in ("kelvin i", "caf stanbul", "word1 the"):
        assert [tuple(r) for r in text_index.search(index, query, 400).collect()] == [tuple(r) for r in search.full_text(docs, "id", "text", query, 400).collect()]


def test_an_index_of_nothing_finds_nothing(spark):
    for rows in ([], [("a", None), ("b", "")]):
        _, index = index_of(spark, rows)
        assert text_index.search(index, "a", 5).count() == 0 and text_index.expand(index, "a", 5).count() == 0
        assert text_index.search_many(index, spark.createDataFrame([(1, "a")], "query_id int, query string"), 5).count() == 0


def test_a_search_reads_the_ranges_of_its_terms_and_no_text(spark, texts, capsys):
    docs, index = texts
    text_index.search(index, "the", 5).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(term,the)" in plan and "LessThan(term,the{)" in plan
    assert "text:string" not in plan and "nodes" not in plan
    assert [(r["term"], r["df"]) for r in text_index.expand(index, "ZZ", 5).collect()] == [
        (r["t"], r["n"]) for r in docs.select("id", F.explode(F.array_distinct(text_index.tokens_of(F.col("text")))).alias("t")).filter("startswith(t, 'zz')").groupBy("t").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "t").collect()
    ]


def brute(vectors, queries, k):
    def sim(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b)), 6)

    out = set()
    for q in queries:
        near = sorted((-sim(vectors[q], v), i) for i, v in vectors.items() if i != q and sim(vectors[q], v) > 0)
        out |= {(q, i, -s) for s, i in near[:k]}
    return out


def found_by(spark, rows, queries, k, monkeypatch=None, **how):
    frame = spark.createDataFrame(rows, "id bigint, v array<double>")
    index = vector_index.build(frame, "id", "v", 3, **how)
    if index is None:
        return None
    own = vector_index.units(frame, "id", "v", 3)
    asked = own.filter(F.col("id").isin(queries)).withColumnRenamed("id", "query_id")
    got = vector_index.nearest_many(index, asked, k, first=1)
    assert vector_index.recall(got, own, queries[:5], k) == 1.0
    return {tuple(r) for r in got.collect()}


def test_nearest_of_many_are_exact_whatever_the_cells(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "MEMBERS", 40)
    monkeypatch.setattr(vector_index, "ASKED", 3)
    rng = random.Random(5)
    vectors = {k: [rng.gauss(0, 1) for _ in range(3)] for k in range(200)}
    vectors |= {k: [1.0, 2.0, 3.0] for k in range(200, 350)}  # a hot cell of equal rows: ties go by id
    vectors |= {k: [float(k), 0.0, 0.0] for k in range(350, 360)}  # equal up to their length
    broken = [(1000, None), (1001, [0.0, 0.0, 0.0]), (1002, [1.0]), (1003, [float("nan"), 1.0, 1.0]), (1004, [float("inf"), 1.0, 1.0]), (1005, [None, 1.0, 1.0]), (1006, [])]
    queries = list(range(0, 360, 20)) + [201, 202, 203, 1001, 1003]
    valid = [q for q in queries if q in vectors]
    for cells in (1, 12):
        assert found_by(spark, list(vectors.items()) + broken, queries, 6, cells=cells) == brute(vectors, valid, 6)


def test_a_block_gives_only_what_may_be_among_the_best(monkeypatch):
    monkeypatch.setattr(vector_index, "AT_ONCE", 2)
    rng = random.Random(9)
    unit = lambda: [x / 3 for x in rng.choice([(1, 2, 2), (2, 1, 2), (2, 2, 1), (-1, 2, 2), (1, -2, 2)])]
    members = pd.DataFrame({"id": range(60), "unit": [unit() for _ in range(60)]}).sample(frac=1, random_state=1)
    asked = pd.DataFrame({"query_id": range(5), "unit": [unit() for _ in range(5)], "far": 2.0})
    found = vector_index._best_of(4)(asked, members)
    for q, own in zip(asked["query_id"], asked["unit"]):
        near = sorted((-round(sum(a * b for a, b in zip(own, u)), 6), i) for i, u in zip(members["id"], members["unit"]) if i != q)
        assert [tuple(r) for r in found[found.query_id == q][["id", "similarity"]].values] == [(i, -s) for s, i in near[:4] if s < 0]
    asked["far"] = -0.1  # nearer rows than any are known already
    assert len(vector_index._best_of(4)(asked, members)) == 0


def test_vectors_with_nobody_near(spark):
    assert found_by(spark, [(1, None), (2, [0.0, 0.0, 0.0])], [1], 3) is None
    assert found_by(spark, [(1, [1.0, 0.0, 0.0])], [1], 3) == set()
    assert found_by(spark, [(1, [1.0, 0.0, 0.0]), (2, [-1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0])], [1, 2, 3], 3) == set()
