"""Source trees, evidence files, manifests and briefs on disk."""

import json

import pytest
from pyspark.sql import functions as F

from graphweft.operators import arguments, evidence, ingest
from graphweft.operators.lineage import shared_dir
from graphweft.sources import files, sinks, store


def test_scan(spark, tmp_path):
    put = {"src/a.py": b"x = 1\n", "src/deep/b.ts": b"let y\r\nlet z", "node_modules/m/i.js": b"no", "README.md": b"# Hi", "gen/out.go": b"no", "bin/data.dat": b"\x00\x01\x02", "src/long.c": b"c" * 50, "empty.py": b""}
    for name, body in put.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    rows = {r.file_path: r for r in files.scan(spark, f"file://{tmp_path}", globs=["gen/*.go"], most=40).collect()}
    assert set(rows) == set(put) - {"node_modules/m/i.js", "gen/out.go", "empty.py"}
    assert rows["src/a.py"].content == "x = 1\n" and rows["src/a.py"].language == "python" and rows["README.md"].language is None
    assert rows["src/long.c"].skipped == "too long" and rows["src/long.c"].content is None and rows["bin/data.dat"].skipped == "not text"
    listed = spark.createDataFrame([("src/a.py",), ("gone.py",)], "file_path string")
    assert [r.file_path for r in files.scan(spark, f"file://{tmp_path}", candidates=listed).collect()] == ["src/a.py"]
    tree = files.scan(spark, f"file://{tmp_path}")
    assert [(r.line_no, r.line) for r in files.window(tree, "src/deep/b.ts", 2, 9).collect()] == [(2, "let z")]
    assert [(r.file_path, r.line_no) for r in files.occurrences(tree, "y").collect()] == [("src/deep/b.ts", 1)]


def test_python_that_does_not_parse_gives_nothing(spark):
    tree = spark.createDataFrame([("a.py", "python", "def f(:"), ("b.py", "python", None), ("c.py", "python", "f = lambda: g()\n" * 3), ("d.js", "javascript", "def f(): pass")], "file_path string, language string, content string")
    nodes, refs = ingest.python_symbols(tree)
    assert nodes.count() == 0 and {(r.source_file, r.target) for r in refs.collect()} == {("c.py", "g")}


def test_records_of_lines_and_collections(spark, tmp_path):
    place = {"start": {"line": 3, "col": 1}, "end": {"line": 3, "col": 9}}
    records = [
        {"kind": "symbol", "qname": "a.F", "name": "F", "file": "a.cpp", "range": place},
        {"kind": "call", "from": {"qname": "a.G", "name": "G", "file": "b.cpp", "line": 7}, "to": {"qname": "a.F", "name": "F", "file": "a.cpp", "line": 3}},
        {"kind": "include", "file": "b.cpp", "to": {"file": "a.h"}, "range": place},
        {"kind": "diagnostic", "file": "a.cpp", "message": "odd", "code": "w1", "range": place},
    ]
    (tmp_path / "r.jsonl").write_text("# comment\n\n" + "\n".join(map(json.dumps, records)) + "\nbroken {\n")
    own, bad = evidence.read_lines(spark, str(tmp_path / "r.jsonl"))
    assert own.count() == 4 and [r.value for r in bad.collect()] == ["broken {"]
    nodes, edges = evidence.as_graph(own)
    labels = {r.id: r.label for r in nodes.collect()}
    assert sorted(labels.values()) == ["F", "G", "a.cpp", "a.h", "b.cpp", "odd"]
    assert {(labels[r.from_id], r.relation, labels[r.to_id]) for r in edges.collect()} == {("a.cpp", "DEFINES", "F"), ("G", "CALLS", "F"), ("b.cpp", "IMPORTS", "a.h"), ("a.cpp", "HAS_DIAGNOSTIC", "odd")}
    whole = {"schema_version": "0.2", "collectionId": "c1", "provider": "p", "status": "ok", "operations": {"references": {"status": "ok", "count": 1}}, "session": {"collectedAt": "now"}, "records": records}
    (tmp_path / "c.json").write_text(json.dumps(whole, indent=1))
    told = evidence.authority(evidence.read_collections(spark, str(tmp_path / "c.json"))).first()
    assert told.may_invalidate and told.may_replace and told.collectionId == "c1"


def test_manifest_brief_and_dump(spark, tmp_path):
    path = f"file://{tmp_path}/manifest.json"
    assert sinks.read_manifest(spark, path) == {}
    for n in (1, 2):
        sinks.write_manifest(spark, path, {"nodes": n, "commit": "c"})
    assert sinks.read_manifest(spark, path) == {"commit": "c", "nodes": 2}
    sections = spark.createDataFrame([(2, "Hubs", "b"), (1, "Counts", "n 3"), (2, "Hubs", "a")], "place int, heading string, line string")
    assert sinks.brief(sections, "T") == "# T\n\n## Counts\n- n 3\n\n## Hubs\n- a\n- b\n"
    rows = spark.createDataFrame([(2, None), (1, "x")], "b int, a string")
    sinks.dump(rows, f"{tmp_path}/dump")
    lines = "".join(p.read_text() for p in sorted((tmp_path / "dump").glob("part-*"))).splitlines()
    assert lines == ['{"a":"x","b":1}', '{"a":null,"b":2}']
    assert sinks.digest(rows).first() == sinks.digest(rows.select("a", "b").orderBy("b")).first() != sinks.digest(rows.union(rows)).first()


def test_a_stored_graph_skips_what_a_filter_excludes(spark, tmp_path):
    nodes = spark.range(100).selectExpr("concat('n', id) as id")
    edges = spark.range(1000).selectExpr("concat('n', id % 100) as from_id", "concat('n', id % 7) as to_id")
    store.save(nodes, edges, str(tmp_path / "g"))
    g = store.load(spark, str(tmp_path / "g"))
    assert g.incoming.filter("to_id = 'n3'").count() == edges.filter("to_id = 'n3'").count()
    assert "PushedFilters: [IsNotNull(to_id), EqualTo(to_id,n3)]" in g.incoming.filter(F.col("to_id") == "n3")._jdf.queryExecution().toString()


def test_arguments_are_held_to_their_ranges():
    assert [arguments.depth_of(x) for x in (-1, 0, 1, 7, 99)] == [1, 1, 1, 7, 10]
    assert (arguments.top_k_of(500), arguments.limit_of(500), arguments.hops_of(99)) == (200, 100, 15)
    with pytest.raises(ValueError):
        arguments.depth_of(1.5)


def test_paths_that_clients_may_not_name():
    assert arguments.is_sensitive("/etc/passwd") and arguments.is_sensitive("~/.ssh/id_rsa") and arguments.is_sensitive("a/../../.aws/credentials") and arguments.is_sensitive("src/.env")
    assert not arguments.is_sensitive("src/etc/passwd.py") and not arguments.is_sensitive("docs/env.md")


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    context = SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(sparkContext=context))


def test_binary_files_by_a_zero_byte_anywhere(spark, tmp_path):
    put = {"a": b"p\n\0\0binary", "b": b"x\0\0binary", "c": b"\x10\x01\x00", "d": "p0 00 Ā é".encode(), "e": b"\x30\x00", "f": b"\x03\x07"}
    for name, content in put.items():
        (tmp_path / name).write_bytes(content)
    assert {r.file_path: r.skipped for r in files.scan(spark, f"file://{tmp_path}").collect()} == {k: "not text" if b"\0" in v else None for k, v in put.items()}
