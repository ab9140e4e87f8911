"""The pipeline from tables to token ids, on odd rows and on empty tables."""

import hashlib
import os
import subprocess
import sys

import pytest

import corpus_pipeline
from graphweft.llm import common

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, ord string, `row` string, segments string, _h string"


def put(spark, folder, docs, labels, benchmark):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return f"file://{folder}"


def test_stages_take_effect(spark, tmp_path):
    words = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    clean = [(k, f"a calm text about things\n{words(f'c{k}x', 30)}") for k in range(1, 91)]
    toxic = [(100 + k, f"you utter zzgrim fool\n{words(f't{k}x', 20)}") for k in range(60)]
    item = words("q", 14)
    text = words("long", 120)
    odd = [(500, None), (501, ""), (502, "  "), (503, text), (504, text + " more"), (505, text), (505, text), (506, f"{words('before', 30)} {item} {words('after', 30)}"), (507, item), (508, "word " * 40_000), (None, "no id " + words("n", 20))]
    docs = [(i, t, "en", "s", len(t or ""), "o", "r", "g", "h") for i, t in clean + toxic + odd]
    labels = [(i, 1, int(i >= 100)) for i, _ in clean + toxic]
    sf_dir = put(spark, tmp_path, docs, labels, [(1, item), (2, None)])
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    ids = [r.doc_id for r in rows]
    assert not {i for i, _ in toxic} & set(ids) and {i for i, _ in clean} <= set(ids)
    assert ids.count(503) == 1 and not {504, 505, 507} & set(ids) and {506, 508, None} <= set(ids)
    assert {500, 501, 502} & set(ids)  # texts without words are near copies of each other: one of them stays
    by_id = {r.doc_id: r for r in rows}
    left = f"{words('before', 30)}  {words('after', 30)}"
    assert by_id[506].decoded_sha256 == hashlib.sha256(left.encode()).hexdigest()
    first, second = (f"a calm text about things\n{words(f'c{k}x', 30)}" for k in (1, 2))
    assert by_id[1].decoded_sha256 == hashlib.sha256(first.encode()).hexdigest()
    assert by_id[2].decoded_sha256 == hashlib.sha256(second.split("\n")[1].encode()).hexdigest()
    assert all(r.n_tokens == len(r.ids) for r in rows)


def test_each_stage_returns_the_columns_of_documents(spark, tmp_path):
    docs = [(k, f"w{k} some words{k} in{k} a line{k} here", "en", "s", 3, f"o{k}", f"r{k}", f"g{k}", f"h{k}") for k in range(30)]
    sf_dir = put(spark, tmp_path, docs, [(k, 1, int(k % 4 == 0)) for k in range(30)], [(1, "some other words")])
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        own = stage(spark, frame, sf_dir)
        assert own.columns == frame.columns, name
        assert all(r["ord"] == f"o{r.doc_id}" and r["row"] == f"r{r.doc_id}" and r.segments == f"g{r.doc_id}" and r["_h"] == f"h{r.doc_id}" for r in own.collect()), name


@pytest.mark.parametrize("n_labels", [0, 1])
def test_empty_tables(spark, tmp_path, n_labels):
    sf_dir = put(spark, tmp_path, [], [(1, 1, 1)] * n_labels, [])
    assert corpus_pipeline.run(spark, sf_dir).count() == 0


def test_only_the_result_stays_in_the_shared_folder(spark, tmp_path):
    docs = [(k, f"text{k} number{k} with a{k} few{k} words{k}", "en", "s", 3, "o", "r", "g", "h") for k in range(20)]
    sf_dir = put(spark, tmp_path, docs, [(k, 1, int(k % 4 == 0)) for k in range(20)], [])
    mark = common.scratch_mark()
    done = corpus_pipeline.run(spark, sf_dir)
    assert common.scratch_mark() == mark + 1 and done.count() == 20


def test_executors_need_no_copy_of_the_package(spark, tmp_path):
    """The stages in a process whose workers can't import it, over columns with dots in their names."""
    words = lambda k: " ".join(f"w{k // 2}x{i}" if i not in (50, 99) else f"own{k}x{i}" for i in range(150))
    docs = spark.createDataFrame([(f"d{k}", words(k), "en", "s", 3, "m") for k in range(12)], "doc_id string, text string, lang string, source string, n_chars bigint, `meta.lang` string")
    docs.write.parquet(f"{tmp_path}/in/documents.parquet")
    spark.createDataFrame([(f"d{k}", 1, 0) for k in range(4)], "doc_id string, quality int, toxic int").write.parquet(f"{tmp_path}/in/labels.parquet")
    spark.createDataFrame([(1, "a benchmark item")], "item_id bigint, text string").write.parquet(f"{tmp_path}/in/benchmark.parquet")
    program = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
def found(_):
    try:
        import graphweft
    except ImportError:
        return iter(["none"])
    return iter(["found"])
assert spark.sparkContext.parallelize([1], 1).mapPartitions(found).collect() == ["none"]
import corpus_pipeline
docs = spark.read.parquet("{tmp_path}/in/documents.parquet")
for name, stage in corpus_pipeline.STAGES:
    out = "{tmp_path}/out/" + name.replace(" ", "-")
    stage(spark, docs, "{tmp_path}/in").write.parquet(out)
    docs = spark.read.parquet(out)
    print(name, docs.count(), "meta.lang" in docs.columns)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", program], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    lines = done.stdout.splitlines()
    assert lines[2] == "simhash near-dedup 6 True" and lines[3].endswith("6 True") and lines[-1].startswith("byte-level bpe 6")
