"""Queries on calls and nodes don't wait for the tables of the stored graph that they don't ask for."""

import pytest

from graphweft.plans import registry
from graphweft.sources import store
from graphweft.sources import testgraph as tg


@pytest.mark.parametrize("name", ["m2_insert_or_promote", "g27_feature_io", "m3_promotion_with_stash"])
def test_calls_are_read_without_storing_all_edges(spark, tmp_path, monkeypatch, name):
    for k in "ab":
        (tmp_path / k).symlink_to("/root/testdata/sf0.001")
    with monkeypatch.context() as m:
        m.setattr(tg, "_edges", lambda *a: pytest.fail("all edges were made"))
        alone = registry.QUERIES[name](spark, str(tmp_path / "a")).collect()
    tg.graph(spark, str(tmp_path / "b"))
    stored = registry.QUERIES[name](spark, str(tmp_path / "b")).collect()
    assert alone and sorted(map(tuple, alone), key=str) == sorted(map(tuple, stored), key=str)


def test_tables_are_stored_when_they_are_asked_for_and_once(spark, tmp_path, monkeypatch):
    (tmp_path / "c").symlink_to("/root/testdata/sf0.001")
    written, save = [], store.save
    monkeypatch.setattr(store, "save", lambda *a, names=(), **k: (written.extend(names), save(*a, names=names, **k)))
    for ask, more in ((tg.nodes, ["nodes"]), (tg.nodes, []), (tg.edges, ["outgoing"]), (tg.graph, ["incoming"]), (tg.incoming, [])):
        before = len(written)
        ask(spark, str(tmp_path / "c"))
        assert written[before:] == more
    g = tg.graph(spark, str(tmp_path / "c"))
    assert g.incoming.exceptAll(g.outgoing).count() == g.outgoing.exceptAll(g.incoming).count() == 0 < g.nodes.count()
