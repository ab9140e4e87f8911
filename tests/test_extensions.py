"""Plugins and languages that others add."""

import pytest

from graphweft import extensions
from graphweft.operators import ingest
from graphweft.sources import files


def test_plugins_run_where_they_detect_something(spark):
    tree = spark.createDataFrame([("CMakeLists.txt", None, "add_library(core a.c)\nadd_library(app b.c)\ntarget_link_libraries(app core)"), ("a.js", "javascript", "app.get('/x', show);")], "file_path string, language string, content string")
    found = extensions.built_in().run(tree)
    assert set(found) == {"routes", "cmake"}
    assert [r.label for r in found["routes"]["nodes"].collect()] == ["GET /x"]
    assert [r.relation for r in found["cmake"]["edges"].collect()] == ["LINKS"]
    own = extensions.Registry()
    own.add(extensions.Plugin("none", lambda t: False, lambda t: {}))
    assert own.run(tree) == {}
    with pytest.raises(ValueError):
        own.add(extensions.Plugin("none", lambda t: True, lambda t: {}))


def test_a_further_language(spark, monkeypatch):
    monkeypatch.setattr(files, "LANGUAGES", dict(files.LANGUAGES))
    monkeypatch.setattr(ingest, "RULES", dict(ingest.RULES))
    extensions.add_language("lua", ["lua"], [("Function", r"\bfunction\s+([A-Za-z_]\w*)")])
    tree = spark.createDataFrame([("a.lua", "x = 1\nfunction run() end")], "file_path string, content string")
    tree = tree.withColumn("language", files.language_of(tree.file_path))
    assert [(r.label, r.start_line, r.language) for r in ingest.ruled_symbols(tree).collect()] == [("run", 2, "lua")]
    with pytest.raises(ValueError):
        extensions.add_language("mine", ["py"], [])
