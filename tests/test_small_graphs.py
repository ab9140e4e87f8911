"""Cases small enough to see the answer: paths, overrides, evidence, contradictions, searches, suggestions, communities."""

import pytest
from pyspark.sql import functions as F

from graphweft.functions import scalars, verdicts
from graphweft.operators import clusters, documents, evidence, overlays, paths, ranking, resolver, search, suggest, traverse
from graphweft.operators import relational as rel


def edges_of(spark, *rows):
    return spark.createDataFrame([(a, b, r, 1, c, p) for a, b, r, c, p in rows], "from_id string, to_id string, relation string, source_line int, confidence double, provenance string")


def calls(spark, *pairs):
    return edges_of(spark, *((a, b, "CALLS", 1.0, "EXTRACTED") for a, b in pairs))


def test_a_trace_crosses_a_bridge_and_ends_where_there_is_no_way(spark):
    e = edges_of(spark, ("a", "b", "CALLS", 1.0, "x"), ("b", "c", "OVERRIDDEN_BY", 1.0, "x"), ("c", "d", "CALLS", 1.0, "x"), ("a", "z", "REFERENCES", 1.0, "x"))
    way = lambda x, y, most=9: paths.shortest_path(e, x, y, ["CALLS", "OVERRIDDEN_BY"], most)
    assert [(r.from_id, r.to_id, r.relation) for r in way("a", "d").orderBy("hop").collect()] == [("a", "b", "CALLS"), ("b", "c", "OVERRIDDEN_BY"), ("c", "d", "CALLS")]
    assert way("d", "a") is None and way("a", "z") is None and way("a", "d", 2) is None and way("a", "a").count() == 0


def test_impact_counts_edges_not_paths(spark):
    e = calls(spark, ("b", "a"), ("c", "b"), ("c", "a"), ("a", "c"))
    got = {(r.from_id, r.to_id): r.depth for r in traverse.reach(e, ["a"], ["CALLS"], 3).collect()}
    assert got == {("b", "a"): 1, ("c", "a"): 1, ("c", "b"): 2, ("a", "c"): 2}
    assert paths.impact_set(e, "a", ["CALLS"], 3, 1).collect() == [("b", 1, True)]


def test_a_child_that_stands_under_an_earlier_sibling_goes(spark):
    e = edges_of(spark, ("a", "b", "CALLS", 0.9, "x"), ("b", "c", "CALLS", 0.9, "x"), ("a", "c", "CALLS", 0.8, "x"), ("c", "d", "CALLS", 0.9, "x"), ("d", "a", "CALLS", 1.0, "x"))
    tree = paths.ranked_tree(e, ["a"], ["CALLS"], 3, 5)
    left = {"".join(r.path) for r in paths.without_shadowed(tree).collect()}
    assert left == {"a", "ab", "abc", "abcd"}
    assert [("".join(r.path), r.looped) for r in tree.filter("looped").collect()] == [("acda", True)]
    assert [r.chain for r in paths.deepest_chains(tree).collect()] == [["a", "b", "c", "d"]]


def test_overrides_take_the_nearest_base_and_are_capped(spark):
    bases = paths.ancestors(spark.createDataFrame([("D", "B"), ("B", "A"), ("E", "A"), ("A", "D")], "src string, dst string"))
    methods = spark.createDataFrame([("a.run", "A", "run/1"), ("b.run", "B", "run/1"), ("d.run", "D", "run/1"), ("e.run", "E", "run/2"), ("e.go", "E", "go")], "id string, class string, key string")
    assert {(r.base_method, r.method) for r in paths.overrides(methods, bases).collect()} == {("b.run", "d.run"), ("a.run", "b.run"), ("d.run", "a.run")}
    many = spark.range(70).selectExpr("concat('m', lpad(id, 2, '0')) as id", "concat('K', id) as class", "'k' as key").unionByName(spark.createDataFrame([("base", "A", "k")], "id string, class string, key string"))
    below = spark.range(70).selectExpr("concat('K', id) as src", "'A' as dst")
    assert paths.overrides(many, paths.ancestors(below)).count() == 50


NODES = "id string, type string, label string, qname string, file_path string, language string"


def test_the_resolver_refuses_what_stays_ambiguous(spark):
    nodes = spark.createDataFrame(
        [
            ("1", "Function", "walk", "a.walk", "src/a.py", "python"), ("2", "Function", "walk", "b.walk", "src/b.py", "python"), ("3", "Function", "open", "a.open", "src/a.py", "python"),
            ("4", "Function", "paint", "p.paint", "ui/p.css", "css"), ("5", "File", "a.py", "", "src/a.py", "python"), ("6", "Function", "only", "b.only", "lib/b.py", "python"),
        ], NODES,
    )
    refs = [
        ("same file", "src/a.py", "CALLS", "walk", "python"), ("two", "x/y.py", "CALLS", "walk", "python"), ("whole", "x/y.py", "CALLS", "b.walk", "python"), ("common", "x/y.py", "CALLS", "open", "python"), ("common here", "src/a.py", "CALLS", "open", "python"),
        ("other family", "x/y.py", "CALLS", "paint", "python"), ("loose relation", "x/y.py", "LINKS_TO", "paint", "python"), ("path", "x/y.py", "IMPORTS", "src/a.py", "python"), ("unique", "x/y.py", "CALLS", "only", "python"), ("none", "x/y.py", "CALLS", "Gone.now", "python"),
    ]
    rows = resolver.resolve(spark.createDataFrame(refs, "ref_id string, source_file string, relation string, target string, extractor string"), nodes).cache()
    got = {r.ref_id: (r.to_id, r.provenance) for r in rows.collect()}
    assert got == {
        "same file": ("1", "AMBIGUOUS"), "two": (None, None), "whole": ("2", "EXTRACTED"), "common": (None, None), "common here": ("3", "INFERRED"), "other family": (None, None),
        "loose relation": ("4", "EXTRACTED"), "path": ("5", "INFERRED"), "unique": ("6", "EXTRACTED"), "none": (None, None),
    }
    outside = resolver.externals(rows.filter("to_id is null"))
    assert {r.label for r in outside.collect()} == {"walk", "paint", "Gone.now"}


def test_what_a_file_imports_goes_before_a_namesake_nearby(spark):
    nodes = spark.createDataFrame([("1", "Function", "paint", "", "src/a.ts", "typescript"), ("2", "Function", "paint", "", "lib/b.ts", "typescript"), ("3", "Class", "Box", "", "lib/b.ts", "typescript")], NODES)
    refs = spark.createDataFrame([("r1", "src/x.ts", "CALLS", "paint", "typescript"), ("r2", "src/y.ts", "CALLS", "paint", "typescript"), ("r3", "src/x.ts", "CALLS", "Own", "typescript")], "ref_id string, source_file string, relation string, target string, extractor string")
    imports = spark.createDataFrame([("src/x.ts", "paint", "lib/b.ts", "paint"), ("src/x.ts", "Own", "lib/b.ts", "Box")], "file_path string, local string, from_file string, exported string")
    got = {r.ref_id: (r.to_id, r.rule) for r in resolver.resolve(refs, nodes, imports).collect()}
    assert got == {"r1": ("2", 3), "r2": ("1", 4), "r3": ("3", 3)}


def test_a_reference_inside_a_caller_proves_a_call(spark):
    nodes = spark.createDataFrame([("caller", "Function", "a.cpp", 1, 9), ("callee", "Method", "b.cpp", 3, 6), ("Box", "Class", "b.cpp", 1, 20)], "id string, type string, file_path string, start_line int, end_line int")
    symbols = evidence.defined_symbols(spark.createDataFrame([(1, "s", "b.cpp", 3), (2, "t", "c.cpp", 8)], "seq int, symbol string, file string, line int"), nodes)
    assert {(r.symbol, r.node if r.symbol == "s" else r.node[:7]) for r in symbols.collect()} == {("s", "callee"), ("t", "ci:lsp:")}
    refs = spark.createDataFrame([(1, "s", "a.cpp", 5, "high"), (2, "s", "b.cpp", 4, "high"), (3, "s", "d.cpp", 2, "low"), (4, "s", "a.cpp", 5, "low"), (5, "u", "a.cpp", 5, "high")], "ref int, symbol string, file string, line int, confidence string")
    got = {(r.from_id, r.to_id, r.confidence) for r in evidence.proven_calls(refs, symbols, nodes).collect()}
    assert got == {("caller", "callee", 0.95), ("file:d.cpp", "callee", 0.6)}


def test_only_a_removed_exported_unique_declaration_with_outside_callers_contradicts(spark):
    nodes = spark.createDataFrame(
        [("f", "Function", "gone", "a.js"), ("g", "Function", "kept", "a.js"), ("h", "Function", "twice", "a.js"), ("i", "Function", "twice", "a.js"), ("x", "Function", "user", "b.js"), ("y", "Function", "own", "a.js")], "id string, type string, label string, file_path string"
    )
    e = edges_of(spark, ("x", "f", "CALLS", 1.0, "LSP_VERIFIED"), ("y", "f", "CALLS", 1.0, "LSP_VERIFIED"), ("x", "g", "CALLS", 1.0, "LSP_VERIFIED"), ("x", "h", "CALLS", 1.0, "LSP_VERIFIED"))
    diff = lambda *lines: spark.createDataFrame([("a.js", x) for x in lines], "file string, line string")
    told = lambda *lines, over=e: [(r.name, r.callers) for r in overlays.deleted_with_callers(diff(*lines), nodes, over).collect()]
    assert told("-export function gone() {") == [("gone", 1)]
    assert told("-function gone() {") == [] and told("-export function gone() {", "+export function gone(a) {") == []
    assert told("-export function twice() {") == [] and told("-export function nowhere() {") == []
    assert told("-export function gone() {", over=e.withColumn("provenance", F.lit("EXTRACTED"))) == []


def test_full_text_takes_prefixes_and_no_metacharacters(spark):
    docs = spark.createDataFrame([(1, "Parse the graph"), (2, "graph parser of graphs"), (3, "nothing"), (4, None)], "id int, text string")
    found = lambda q: [r.id for r in search.full_text(docs, "id", "text", q, 5).collect()]
    assert set(found("par gra")) == {1, 2} and found('"*( gra') == found("gra") and found("par xyz") == [] and found("***") == []
    assert search.query_tokens("a b c d e f g h i j") == list("abcdefgh")


def test_suggestions_know_typos_and_leaves(spark):
    nodes = spark.createDataFrame([("parse_graph",), ("a.b.load_all",), ("load",), ("unrelated",)], "label string")
    told = lambda name: [(r.label, r["rank"]) for r in suggest.suggestions(nodes, name, 5).collect()]
    assert told("parse_grpah") == [("parse_graph", 5)]
    assert told("x.load_all") == [("a.b.load_all", 1)]
    assert told("LOAD")[0] == ("load", 0) and told("zzzzzz") == []


def test_buckets_of_unresolved_references(spark):
    cases = [
        ("IMPORTS", "vector", "cpp", "external-by-design:cpp-system"), ("IMPORTS", "SDL3/SDL.h", "c", "external-by-design:cpp-system"), ("IMPORTS", "react", "javascript", "external-by-design:npm"),
        ("IMPORTS", "@a/b.c", "typescript", "external-by-design:npm"), ("IMPORTS", "mcp/own", "javascript", "fixable:qualified-path"), ("CALLS", "setTimeout", "javascript", "denylisted-by-design:js-global"),
        ("CALLS", "parse", "python", "denylisted-by-design:common-name"), ("REFERENCES", "Thing", "php", "fixable:reference-short-name"), ("USES_TYPE", "Thing", "php", "unclassified"), ("CALLS", "DB.table", "laravel", "external-by-design:php-framework"),
        ("CONTAINS", None, "cpp", "shape-issue:contains-missing-target"), ("CALLS", "", "cpp", "shape-issue:empty-target"),
    ]
    rows = spark.createDataFrame(cases, "r string, t string, x string, want string").select("want", verdicts.unresolved_bucket(F.col("r"), F.col("t"), F.col("x")).alias("got")).collect()
    assert all(r.got == r.want for r in rows), rows


def test_cosine_of_odd_vectors(spark):
    rows = [([1.0, 2.0], [1.0, 2.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<double>, b array<double>").select(scalars.cosine(F.col("a"), F.col("b"))).collect()]
    assert [round(x, 9) for x in got] == [1, 0, 0, 0]


def test_communities_do_not_depend_on_the_order_of_edges(spark):
    pairs = [("a1", "a2", 5), ("a2", "a3", 5), ("a3", "a1", 5), ("b1", "b2", 5), ("b2", "b3", 5), ("b3", "b1", 5), ("a1", "b1", 1)]
    own = [clusters.communities(spark.createDataFrame(p, "src string, dst string, w int")) for p in (pairs, pairs[::-1])]
    first, second = ({r.node: r.community for r in x.collect()} for x in own)
    assert first == second and len(set(first.values())) == 2 and first["a1"] == first["a2"] == first["a3"] != first["b1"]
    assert clusters.modularity(spark.createDataFrame(pairs, "src string, dst string, w int"), own[0]).first().modularity > 0.3


def test_documents_keep_out_of_fences_and_of_themselves(spark):
    docs = spark.createDataFrame([("docs/a.md", "[x](b.md)\n~~~\n[no](c.md)\n~~~\n[me](a.md) [out](https://x.y/b.md) [up](../../z.md)")], "doc string, text string")
    files = spark.createDataFrame([("A", "docs/a.md"), ("B", "docs/b.md"), ("C", "docs/c.md")], "id string, file_path string")
    told = documents.classified(documents.references(docs), files)
    assert {(r.target, r.kind, r.reason) for r in told.collect()} == {("b.md", "resolved", None), ("a.md", "resolved", None), ("https://x.y/b.md", "external", None), ("../../z.md", "unresolved", "no_such_path")}
    assert [(r.from_id, r.to_id) for r in documents.links(told, spark.createDataFrame([("docs/a.md", "A")], "doc string, doc_id string")).collect()] == [("A", "B")]


def test_sections_are_folded_before_they_are_dropped(spark):
    sections = spark.createDataFrame([(1, "t", "x" * 30, "", True), (2, "a", "y" * 50, "y", False), (3, "b", "z" * 50, "z" * 20, False)], "place int, section string, text string, collapsed string, kept boolean")
    told = lambda budget: [(r.section, r.how) for r in ranking.clamp_sections(sections, budget).orderBy("place").collect()]
    assert told(200) == [("t", "whole"), ("a", "whole"), ("b", "whole")] and told(100) == [("t", "whole"), ("a", "whole"), ("b", "collapsed")]
    assert told(52) == [("t", "whole"), ("a", "collapsed"), ("b", "collapsed")] and told(31) == [("t", "whole"), ("a", "collapsed")] and told(5) == [("t", "whole")]


@pytest.mark.parametrize("width", [None, 1, 7, 1000])
def test_the_innermost_span_whatever_the_stretch(spark, width):
    spans = spark.createDataFrame([("f", 1, 0, 100), ("f", 2, 10, 20), ("f", 3, 10, 15), ("g", 4, 0, 9)], "k string, span_id int, first int, last int")
    points = spark.createDataFrame([("f", 10, 12), ("f", 11, 18), ("f", 12, 99), ("f", 13, 101), ("g", 14, 9)], "k string, point_id int, at int")
    assert {(r.point_id, r.span_id) for r in rel.innermost(points, spans, "k", width).collect()} == {(10, 3), (11, 2), (12, 1), (14, 4)}


def test_leiden_of_rings_of_cliques(spark):
    """Cliques in a ring are the communities; a bridge that moves away doesn't leave its community apart."""
    import itertools

    from graphweft.operators import algorithms

    cliques = [[f"c{k}n{i}" for i in range(5)] for k in range(6)]
    pairs = [(a, b, 1) for c in cliques for a, b in itertools.combinations(c, 2)] + [(cliques[k][0], cliques[(k + 1) % 6][1], 1) for k in range(6)]
    frame = lambda p: spark.createDataFrame(p, "src string, dst string, w int")
    found = {r.node: r.community for r in clusters.leiden(frame(pairs)).collect()}
    assert sorted(found) == sorted(n for c in cliques for n in c) and len(set(found.values())) == 6
    assert all(len({found[n] for n in c}) == 1 for c in cliques)
    assert found["c0n0"] == 1 and clusters.leiden(frame([("a", "a", 3)])).count() == 0
    chain = [(f"n{i:03}", f"n{i + 1:03}", 1) for i in range(60)] + [("x", "y", 1)]
    parts = {r.node: r.component for r in algorithms.connected(frame(chain)).collect()}
    assert set(parts.values()) == {"n000", "x"} and len(parts) == 63
