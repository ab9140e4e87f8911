"""The refreshed graph equals one that is built anew, whatever changed; and members of bases by plain search."""

import random

import pytest

from graphweft.operators import resolver
from graphweft.streaming import graph_refresh

TABLES = ["nodes", "refs", "edges", "keys", "asks"]


def world(seed, files):
    random.seed(seed)
    out = {}
    for f in files:
        folder = "/".join(f.split("/")[:-1])
        names = random.sample(["run", "load", "save", "main", "Thing", "parse", "get"], random.randint(0, 4))
        nodes = [(f"{f}:{n}", "Function", n, f"{folder.replace('/', '.')}.{n}", f, random.choice(["python", "python", "php"])) for n in names] + [(f"F:{f}", "File", f.split("/")[-1], "", f, "python")]
        targets = random.choices(["run", "load", "a.load", "b.save", "main", "Thing", "b/m1.py", "m2.py", "get", "nothing"], k=random.randint(0, 5))
        refs = [(f"{f}#{i}", f, f"{f}:x", random.choice(["CALLS", "LINKS_TO", "IMPORTS"]), t, random.choice(["python", "php", ""])) for i, t in enumerate(targets)]
        out[f] = (nodes, refs)
    return out


def tables(spark, folder):
    return {n: sorted(map(tuple, graph_refresh.table(spark, folder, n).select(*sorted(graph_refresh.table(spark, folder, n).columns)).collect()), key=str) for n in TABLES}


def test_refreshed_equals_rebuilt(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graph_refresh, "BUCKETS", 8)
    files = [f"{d}/m{i}.py" for d in ("a", "b", "a/c") for i in range(4)]
    now = world(0, files)

    def extract(changed):
        own = [now[r.file] for r in changed.collect()]
        return spark.createDataFrame([n for ns, _ in own for n in ns], graph_refresh.NODES), spark.createDataFrame([r for _, rs in own for r in rs], graph_refresh.REFS)

    change = lambda rows: spark.createDataFrame(rows, "file string, deleted boolean")
    followed = f"file://{tmp_path}/followed"
    graph_refresh.refresh(change([(f, False) for f in files]), 0, followed, extract)
    for batch in (1, 2):
        random.seed(batch)
        edited, deleted = random.sample(files, 2), random.sample(files, 2)
        fresh = world(batch * 7, edited + [f"new/n{batch}.py"])
        now.update(fresh)
        for f in set(deleted) - set(edited):
            now.pop(f, None)
        rows = [(f, False) for f in fresh] + [(f, True) for f in deleted] + [(None, False), ("unknown", True)]
        before = graph_refresh.versions(spark, followed)
        graph_refresh.refresh(change(rows), batch, followed, extract)
        after = graph_refresh.versions(spark, followed)
        assert any(v < batch for v in after.values()) and all(after[k] == v or after[k] in (batch, -1) for k, v in before.items())
        rebuilt = f"file://{tmp_path}/rebuilt{batch}"
        graph_refresh.refresh(change([(f, False) for f in now]), 0, rebuilt, extract)
        assert tables(spark, followed) == tables(spark, rebuilt)
    same = tables(spark, followed)
    graph_refresh.refresh(change(rows), 2, followed, extract)  # a batch that is run again
    graph_refresh.refresh(change([]), 3, followed, extract)
    assert tables(spark, followed) == same and max(graph_refresh.versions(spark, followed).values()) == 2
    resolved = resolver.resolve(graph_refresh.table(spark, followed, "refs"), graph_refresh.table(spark, followed, "nodes")).collect()
    assert {r.ref_id: r.to_id for r in resolved} == {r.ref_id: r.to_id for r in graph_refresh.table(spark, followed, "edges").collect()}


def test_a_stream_of_changes_keeps_the_graph(spark, tmp_path):
    nodes = [("x", "Function", "parse_it", "a.parse_it", "a/m.py", "python")]
    refs = [("r", "b/m.py", "b", "CALLS", "parse_it", "python")]

    def extract(changed):
        own = {r.file for r in changed.collect()}
        return spark.createDataFrame([n for n in nodes if n[4] in own], graph_refresh.NODES), spark.createDataFrame([r for r in refs if r[1] in own], graph_refresh.REFS)

    def arrive(*rows):
        spark.createDataFrame(rows, "file string, deleted boolean").coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
        stream = spark.readStream.schema("file string, deleted boolean").json(f"file://{tmp_path}/in")
        graph_refresh.start(stream, f"file://{tmp_path}/g", f"file://{tmp_path}/c", extract, availableNow=True).awaitTermination()
        return [r.to_id for r in graph_refresh.table(spark, f"file://{tmp_path}/g", "edges").collect()]

    assert arrive(("b/m.py", False)) == [None]
    assert arrive(("a/m.py", False)) == ["x"]
    assert arrive(("a/m.py", True)) == [None]


@pytest.mark.parametrize("seed", [1, 2])
def test_members_of_bases_by_plain_search(spark, seed):
    """Chains, diamonds and cycles of bases, against a breadth-first search by hand."""
    random.seed(seed)
    classes = [f"K{i:02}" for i in range(14)]
    up = {c: random.sample(classes, random.randint(0, 2)) for c in classes}
    methods = {c: [m for m in ("save", "load") if random.random() < 0.25] for c in classes}
    language = {c: random.choice(["python", "python", "php"]) for c in classes}
    nodes = [(c, "Class", c, f"pkg.{c}", f"src/{c}.py", language[c]) for c in classes] + [(f"{c}.{m}", "Method", m, "", f"src/{c}.py", language[c]) for c in classes for m in methods[c]]
    refs = [(f"e{c}{b}", c, f"src/{c}.py", "EXTENDS", f"pkg.{b}", "") for c in classes for b in set(up[c])]
    refs += [(f"{c}.{m}", "app", "app/x.py", rel, f"{c}.{m}", "python") for c in classes for m in ("save", "load") for rel in ["CALLS"]] + [("no", "app", "app/x.py", "USES_TYPE", "K00.save", "python"), ("path", "app", "app/x.py", "CALLS", "a/K00.save", "python")]
    nodes_ = spark.createDataFrame(nodes, "id string, type string, label string, qname string, file_path string, language string")
    contains = spark.createDataFrame([(c, f"{c}.{m}") for c in classes for m in methods[c]], "from_id string, to_id string")
    rows = resolver.resolve_with_bases(spark.createDataFrame(refs, "ref_id string, from_id string, source_file string, relation string, target string, extractor string"), nodes_, contains).collect()

    def climb(c, m):
        level, seen = [c], {c}
        if language[c] != "python":
            return None
        while level:
            found = sorted(k for k in level if m in methods[k])
            if found:
                return f"{found[0]}.{m}"
            level = sorted({b for k in level for b in up[k] if b not in seen and language[b] == "python"})
            seen |= set(level)
        return None

    got = {r.ref_id: r.to_id for r in rows}
    assert {k: v for k, v in got.items() if k[0] == "e"} == {f"e{c}{b}": b for c in classes for b in set(up[c])}
    assert {k: v for k, v in got.items() if k[0] == "K"} == {f"{c}.{m}": climb(c, m) for c in classes for m in ("save", "load")}
    assert got["no"] in (None, "K00") and got["path"] is None  # a type by the name before the dot, never a member
