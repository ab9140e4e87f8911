"""Where others add to the engine: languages, frameworks and queries, as functions from DataFrames to DataFrames.

A plugin names what it reads and gives nodes, edges and references of its own; the engine runs all that detect
something in the files, one after the other, each on what the files hold and not on what others found.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from graphweft.operators import ingest
from graphweft.sources import files as source_files


@dataclass(frozen=True)
class Plugin:
    """name; detect(files) says whether there is anything for it; enrich(files) gives its tables by name (nodes, edges, refs)."""

    name: str
    detect: Callable[[DataFrame], bool]
    enrich: Callable[[DataFrame], dict[str, DataFrame]]


@dataclass
class Registry:
    plugins: dict[str, Plugin] = field(default_factory=dict)

    def add(self, plugin: Plugin) -> None:
        if plugin.name in self.plugins:
            raise ValueError(f"there is a plugin {plugin.name} already")
        self.plugins[plugin.name] = plugin

    def run(self, tree: DataFrame) -> dict[str, dict[str, DataFrame]]:
        """The tables of every plugin that detects something, by its name."""
        return {p.name: p.enrich(tree) for p in self.plugins.values() if p.detect(tree)}


def add_language(name: str, endings: list[str], rules: list[tuple[str, str]]) -> None:
    """A further language: its files' endings, and the kind of symbol that each pattern's first group names."""
    taken = [e for e in endings if source_files.LANGUAGES.get(e, name) != name]
    if taken:
        raise ValueError(f"{taken} belong to another language")
    source_files.LANGUAGES.update({e: name for e in endings})
    ingest.RULES[name] = list(rules)


def _has(pattern: str) -> Callable[[DataFrame], bool]:
    return lambda tree: not tree.filter(f"file_path rlike '{pattern}'").isEmpty()


def built_in() -> Registry:
    """The plugins that come with the engine."""
    own = Registry()
    own.add(Plugin("routes", _has(r"\\.(js|ts|mjs|cjs|py|java|rb|php)$"), lambda tree: dict(zip(("nodes", "refs"), ingest.routes(tree)))))
    own.add(Plugin("cpp", _has(r"\\.(c|cc|cpp|cxx|h|hpp)$"), lambda tree: dict(zip(("nodes", "refs"), ingest.cpp_frameworks(tree)))))
    own.add(Plugin("cmake", _has(r"(^|/)CMakeLists\\.txt$"), lambda tree: dict(zip(("nodes", "edges"), ingest.build_graph(tree)))))
    own.add(Plugin("shaders", _has(r"\\.(glsl|vert|frag|comp)$"), lambda tree: dict(zip(("bindings", "loads"), ingest.shader_bridge(tree)))))
    return own
