"""Predicates and measures of file paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Paths that compilers and code generators write.
GENERATED = [
    r"\.pb\.(cc|h)$", r"(^|/)moc_[^/]*\.(cc|cpp|cxx|h|hpp|hxx)$", r"(^|/)ui_[^/]*\.h$", r"(^|/)qrc_[^/]*\.(cc|cpp|cxx)$", r"_generated\.(h|hpp|cc|cpp)$",
    r"\.gen\.(h|hpp|cc|cpp)$", r"\.g\.dart$", r"(^|/)generated/", r"(^|/)__generated__/",
]
# Folders of tests, and endings of test files.
TEST_FOLDERS = ["tests/", "test/"]
TEST_ENDINGS = [".test.js", ".test.ts", ".spec.js", ".spec.ts", "_test.py", "_test.cpp", "_test.cc", "_tests.cpp", "_test.go", "_test.rs"]
# Folders that builds and tools leave behind.
SCRATCH = [
    r"^build[-_]", r"^build/", r"^dist/", r"^out/", r"^target/", r"^node_modules/", r"^__pycache__/", r"^\.next/", r"^\.cache/",
    r"^\.codex", r"^\.claude", r"^backup/", r"^saves/", r"^screenshots/", r"^test_screenshots/", r"^video/", r"^generated/", r"\.tmp\.",
]
# Folders of code that isn't the project's own, and what an endpoint there loses.
FOREIGN = {"vendor/": 4, "third_party/": 4, "thirdparty/": 4, "_deps/": 4, "external/": 4, "examples/": 1, "example/": 1, "tests/": 1, "test/": 1}


def _slashes(path: Column) -> Column:
    return F.translate(F.coalesce(path, F.lit("")), "\\", "/")


def is_generated(path: Column) -> Column:
    return _slashes(path).rlike("(?i)" + "|".join(f"(?:{p})" for p in GENERATED))


def is_test(path: Column, kind: Column) -> Column:
    """Nodes of tests: of that type, in a folder of tests, or with the ending of a test file."""
    own = F.lower(F.coalesce(path, F.lit("")))
    ending = "(" + "|".join(e.replace(".", r"\.") for e in TEST_ENDINGS) + ")$"
    return F.coalesce(kind == "Test", F.lit(False)) | own.rlike("^tests?/|/tests?/|/__tests__/") | own.rlike(ending)


def is_test_like(path: Column) -> Column:
    """Paths that look like tests, wherever they lie; folders count as written."""
    return F.coalesce(path.rlike("(^|/)tests?/") | path.rlike(r"(?i)\.(test|spec)\."), F.lit(False))


def is_scratch(path: Column) -> Column:
    return F.coalesce(path.rlike("|".join(f"(?:{p})" for p in SCRATCH)), F.lit(False))


def folder_of(path: Column) -> Column:
    """What stands before the last slash; empty without one."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def is_child_of(path: Column, folder: str) -> Column:
    """Whether the path lies directly in the folder."""
    return folder_of(path) == folder


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", "")


def normalised(path: Column) -> Column:
    """The path without . and .. segments; null if it leaves the root or names nothing."""

    def step(out: Column, part: Column) -> Column:
        up = F.when(F.size(out) > 0, F.slice(out, F.lit(1), F.size(out) - 1))
        return F.when(out.isNull() | (part == "") | (part == "."), out).when(part == "..", up).otherwise(F.concat(out, F.array(part)))

    parts = F.aggregate(F.split(_slashes(path), "/"), F.array().cast("array<string>"), step)
    return F.nullif(F.array_join(parts, "/"), F.lit(""))


def shared_folders(a: Column, b: Column) -> Column:
    """How many leading folders two paths have in common."""
    folders = lambda p: F.filter(F.split(_slashes(p), "/"), lambda x, i: i < F.size(F.split(_slashes(p), "/")) - 1)
    same = F.zip_with(folders(a), folders(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)).cast("int")


def foreign_penalty(path: Column) -> Column:
    """What a path loses as an endpoint: that of the first listed folder that it holds."""
    own = F.lower(_slashes(path))
    return F.coalesce(*[F.when(F.contains(own, F.lit(folder)), F.lit(loss)) for folder, loss in FOREIGN.items()], F.lit(0))


def probes(path: Column) -> Column:
    """array<string>: the files that an import of this path may mean, in the order in which they are tried."""
    endings = ["", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", "/index.js", "/index.jsx", "/index.ts", "/index.tsx"]  # fixed
    return F.array(*[F.concat(path, F.lit(e)) for e in endings])
