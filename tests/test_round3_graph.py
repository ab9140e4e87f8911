"""Findings of round 3 on queries over the stored graph: a graph of a few edges stands in for the tables."""

import pytest

from graphweft.operators import traverse
from graphweft.operators.lineage import cut
from graphweft.plans import registry
from graphweft.sources import store
from graphweft.sources import testgraph as tg

_EDGE = "from_id string, to_id string, relation string, source_line int, confidence double, provenance string"


@pytest.fixture
def stored(spark):
    """Puts edges (from_id, to_id, relation) and the files of nodes in the place of a folder's graph."""
    folder = "a folder of no tables"

    def put(edges, files=()):
        frame = cut(spark.createDataFrame([(*e, 1, 1.0, "EXTRACTED") for e in edges], _EDGE))
        tg._stored[spark.sparkContext.applicationId, folder] = store.Graph(cut(spark.createDataFrame(list(files), "id string, file_path string")), frame, frame)
        return folder

    yield put
    tg._stored.pop((spark.sparkContext.applicationId, folder), None)


def test_no_path_is_no_row(spark, stored):
    """Parts that no six references link: the search says None, the query has no row."""
    folder = stored([("O1", "P1", "REFERENCES"), ("O2", "P2", "REFERENCES"), ("R0", "N1", "CONTAINS")])
    for name in ("t11_undirected_path", "t9_a14_v39_shortest_path"):
        found = registry.QUERIES[name](spark, folder)
        assert found.columns == ["hop", "from_id", "to_id", "relation"] and found.collect() == []
    folder = stored([("O1", "P1", "REFERENCES"), ("O1", "P2", "REFERENCES")])
    assert [tuple(r) for r in registry.QUERIES["t11_undirected_path"](spark, folder).collect()] == [(1, "P1", "O1", "REFERENCES"), (2, "O1", "P2", "REFERENCES")]


def _plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_named_seeds_move_no_edges(spark, stored):
    """Seeds in a list are a filter of the scan; as a table of unknown size they made each traversal shuffle all edges for its first hop."""
    stored([("a", "b", "CALLS"), ("c", "b", "CALLS"), ("d", "c", "CALLS"), ("x", "y", "CALLS")])
    edges = next(iter(g.outgoing for (app, folder), g in tg._stored.items() if folder == "a folder of no tables"))
    first = traverse.reach(edges, ["b", "b"], ["CALLS"], 1)
    assert "Exchange" not in _plan(first)
    assert sorted(tuple(r) for r in first.select("from_id", "depth").collect()) == [("a", 1), ("c", 1)]
    both = traverse.reach(edges, ["b", "y"], ["CALLS"], 2).select("from_id", "to_id", "depth")
    assert sorted(map(tuple, both.collect())) == [("a", "b", 1), ("c", "b", 1), ("d", "c", 2), ("x", "y", 1)]
    assert traverse.reach(edges, [], ["CALLS"], 2).count() == 0


@pytest.fixture
def moved(spark):
    """Small limits for broadcasts, and how many rows were shuffled since."""
    view = spark._jvm.scala.jdk.javaapi.CollectionConverters
    listed = lambda: list(view.asJava(spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)))
    before, usual = {x.stageId() for x in listed()}, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4000")
    yield lambda: sum(x.shuffleWriteRecords() for x in listed() if x.stageId() not in before)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)


def test_targets_of_a_roll_up_dont_move_the_edges(spark, stored, moved):
    """Few targets are sent to the edges, which stay where they are."""
    folder = stored([(f"N{3 if k < 20 else 4}", f"C{k}", "CONTAINS") for k in range(2000)] + [(f"O{k}", f"C{k}", "CALLS") for k in range(2000)] + [("R0", "N3", "CONTAINS")])
    found = sorted(map(tuple, registry.QUERIES["rolled_up_with_a_class"](spark, folder).collect()))
    assert found == sorted([("N3", 20, 1), ("R0", 1, 1)] + [(f"O{k}", 1, 1) for k in range(20)])
    assert moved() < 500


def test_a_digest_moves_only_the_edges_of_its_file(spark, stored, moved):
    """The file's nodes are few and are sent to the edges, however many nodes there are."""
    edges = [(f"C{k % 50}", f"O{k}", "CALLS") for k in range(4000)] + [(f"O{k}", f"P{k % 70}", "REFERENCES") for k in range(4000)]
    files = [(f"O{k}", f"orders/f{1 if k < 20 else 2 + k % 90}.py") for k in range(4000)] + [(f"C{k}", f"ASIA/{k % 2}") for k in range(50)] + [(f"P{k}", "") for k in range(70)]
    found = sorted(map(tuple, registry.QUERIES["v28_file_digest"](spark, stored(edges, files)).collect()))
    assert found == [("in", "CALLS", "ASIA/0", 10), ("in", "CALLS", "ASIA/1", 10), ("out", "REFERENCES", "", 20)]
    assert moved() < 6000  # nodes may move once; 8,000 edges moved twice


_REF = "ref_id string, from_id string, source_file string, relation string, target string, extractor string"


def _names(spark):
    nodes = [("K1", "Class", "Base", "pkg.Base", "a.py", "python"), ("K2", "Class", "Own", "pkg.Own", "a.py", "python"), ("K1.save", "Method", "save", "", "a.py", "python")]
    return spark.createDataFrame(nodes, "id string, type string, label string, qname string, file_path string, language string"), spark.createDataFrame([("K1", "K1.save")], "from_id string, to_id string")


def test_equal_references_are_resolved_once(spark, moved):
    """3,000 references that ask three questions: questions are resolved, and references get the answers without being moved."""
    from graphweft.operators import resolver

    nodes, _ = _names(spark)
    kinds = [("a.py", "CALLS", "pkg.Base", "python"), (None, "CALLS", "Own", None), ("b.py", "CALLS", "nowhere", "python")]
    refs = spark.createDataFrame([(f"r{k}", f"O{k}", *kinds[k % 3]) for k in range(3000)], _REF)
    found = {tuple(r) for r in resolver.resolve(refs, nodes).select("ref_id", "to_id", "rule").collect()}
    assert found == {(f"r{k}", *[("K1", 0), ("K2", 4), (None, None)][k % 3]) for k in range(3000)}
    assert moved() < 1000


def test_equal_calls_climb_to_bases_once(spark, moved):
    """3,000 calls of one inherited member: the levels of bases are climbed by the question."""
    from graphweft.operators import resolver

    nodes, contains = _names(spark)
    refs = [("e", "K2", "a.py", "EXTENDS", "Base", "python")] + [(f"r{k}", f"O{k}", "b.py", "CALLS", "Own.save", "python") for k in range(3000)]
    found = {tuple(r) for r in resolver.resolve_with_bases(spark.createDataFrame(refs, _REF), nodes, contains).select("ref_id", "to_id", "rule").collect()}
    assert found == {("e", "K1", 4)} | {(f"r{k}", "K1.save", 5) for k in range(3000)}
    assert moved() < 1000


def test_collections_lie_in_one_folder_a_file_each(spark, tmp_path, monkeypatch):
    """A folder for each collection cost the driver a listing and a rename each."""
    from graphweft.plans import details

    folder, cuts = tmp_path / "collections", iter(range(9))
    monkeypatch.setattr(details.lineage, "scratch_path", lambda spark, label="graph": str(folder if label == "collections" else tmp_path / f"cut{next(cuts)}"))
    spark.range(40).withColumnRenamed("id", "s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    found = sorted(map(tuple, registry.QUERIES["s9_collections_of_documents"](spark, str(tmp_path)).collect()))
    assert found == sorted((f"c{k}", k % 2 == 0, 1 + k % 3) for k in range(40))
    assert [p for p in folder.iterdir() if p.is_dir()] == [] and len(list(folder.glob("*.txt"))) == 40
