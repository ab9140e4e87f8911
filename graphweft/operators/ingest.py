"""From sources to nodes and references: Python by its syntax tree, other languages and frameworks by rules.

Files are (file_path, language, content). A syntax tree needs Python: each file is parsed once, in batches.
Everything else is rules on texts, as column expressions: (kind, pattern) by language, one pass over a file for each.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.functions import names, scalars, texts

_NODE = "id string, type string, label string, qname string, file_path string, start_line int, end_line int, language string, signature string"
_REF = "from_id string, relation string, target string, source_file string, source_line int, extractor string"


def _id(kind: str, path: str, qname: str) -> str:
    return hashlib.sha1("::".join((kind, path, qname)).encode()).hexdigest()


class _Walk(ast.NodeVisitor):
    """The symbols of one module, and what each refers to."""

    def __init__(self, path: str, module: str):
        self.path, self.nodes, self.refs = path, [], []
        self.scope: list[tuple[str, str, str]] = [("Module", module, _id("Module", path, module))]

    def _define(self, kind: str, node: ast.AST, signature: str) -> None:
        owner_kind, owner, owner_id = self.scope[-1]
        qname = f"{owner}.{node.name}"
        own = _id(kind, self.path, qname)
        self.nodes.append((own, kind, node.name, qname, self.path, node.lineno, node.end_lineno, "python", signature, owner_id))
        for decorator in node.decorator_list:
            target = ast.unparse(decorator.func if isinstance(decorator, ast.Call) else decorator)
            self.refs.append((own, "REFERENCES", target, self.path, decorator.lineno, "python"))
        self.scope.append((kind, qname, own))
        for child in node.body:
            self.visit(child)
        self.scope.pop()

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        own = _id("Class", self.path, f"{self.scope[-1][1]}.{node.name}")
        self.refs += [(own, "EXTENDS", ast.unparse(b), self.path, node.lineno, "python") for b in node.bases]
        self._define("Class", node, "")

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        tested = node.name.startswith("test_") or self.path.rpartition("/")[2].startswith("test_") and self.scope[-1][0] == "Class" and node.name.startswith("test")
        kind = "Test" if tested else "Method" if self.scope[-1][0] == "Class" else "Function"
        self._define(kind, node, f"{node.name}({ast.unparse(node.args)})")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Call(self, node: ast.Call) -> None:
        if isinstance(node.func, (ast.Name, ast.Attribute)):
            relation = "TESTS" if self.scope[-1][0] == "Test" else "CALLS"
            self.refs.append((self.scope[-1][2], relation, ast.unparse(node.func).rpartition(".")[2], self.path, node.lineno, "python"))
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        self.refs += [(self.scope[0][2], "IMPORTS", a.name, self.path, node.lineno, "python") for a in node.names]

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        base = "." * node.level + (node.module or "")
        self.refs += [(self.scope[0][2], "IMPORTS", f"{base}.{a.name}" if base.strip(".") else f"{base}{a.name}", self.path, node.lineno, "python") for a in node.names]


def python_symbols(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (with owner, the id of what contains them) and references of Python files; a file that doesn't parse gives neither."""
    own = files.filter("language = 'python' and content is not null").select("file_path", "content", names.module_name(F.col("file_path")).alias("module"))

    def walk(path: str, content: str, module: str) -> _Walk | None:
        try:
            tree = ast.parse(content)
        except (SyntaxError, ValueError, RecursionError):
            return None
        found = _Walk(path, module)
        try:
            found.visit(tree)
        except RecursionError:
            return None
        return found

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in f"{_NODE}, owner string".split(", ")]
        for batch in batches:
            walks = [walk(*row) for row in batch.itertuples(index=False)]
            yield pd.DataFrame([n for w in walks if w for n in w.nodes], columns=columns)

    def refs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in _REF.split(", ")]
        for batch in batches:
            walks = [walk(*row) for row in batch.itertuples(index=False)]
            yield pd.DataFrame([r for w in walks if w for r in w.refs], columns=columns)

    return own.mapInPandas(nodes, f"{_NODE}, owner string"), own.mapInPandas(refs, _REF)


# Rules by language: what a pattern's first group names. A table of own making, for languages without a parser here.
RULES = {
    "javascript": [("Class", r"\bclass\s+([A-Za-z_$][\w$]*)"), ("Function", r"\bfunction\s*\*?\s+([A-Za-z_$][\w$]*)\s*\("), ("Function", r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)\n]*\)|[\w$]+)\s*=>")],
    "go": [("Function", r"(?m)^func\s+([A-Za-z_]\w*)\s*\("), ("Method", r"(?m)^func\s+\([^)]*\)\s+([A-Za-z_]\w*)\s*\("), ("Type", r"(?m)^type\s+([A-Za-z_]\w*)\s")],
    "rust": [("Function", r"\bfn\s+([A-Za-z_]\w*)"), ("Class", r"\bstruct\s+([A-Za-z_]\w*)"), ("Type", r"\benum\s+([A-Za-z_]\w*)"), ("Interface", r"\btrait\s+([A-Za-z_]\w*)")],
    "java": [("Class", r"\bclass\s+([A-Za-z_]\w*)"), ("Interface", r"\binterface\s+([A-Za-z_]\w*)"), ("Method", r"(?m)^\s*(?:public|private|protected)[\w<>\[\], ]*\s([A-Za-z_]\w*)\s*\(")],
    "ruby": [("Class", r"(?m)^\s*class\s+([A-Z]\w*)"), ("Module", r"(?m)^\s*module\s+([A-Z]\w*)"), ("Method", r"(?m)^\s*def\s+(?:self\.)?([a-z_]\w*[?!]?)")],
    "php": [("Class", r"\bclass\s+([A-Za-z_]\w*)"), ("Interface", r"\binterface\s+([A-Za-z_]\w*)"), ("Function", r"\bfunction\s+([A-Za-z_]\w*)\s*\(")],
    "cpp": [("Class", r"\b(?:class|struct)\s+([A-Za-z_]\w*)\s*(?:final\s*)?[:{]"), ("Method", r"(?m)^[\w:<>&*\s]+?\w+::([A-Za-z_~]\w*)\s*\([^;{]*\)[^;{]*\{")],
    "css": [("Symbol", r"(?m)^\s*\.([A-Za-z_][\w-]*)[^{;]*\{")],
    "glsl": [("Function", r"(?m)^\s*(?:void|float|int|bool|[iub]?vec[234]|mat[234])\s+([A-Za-z_]\w*)\s*\(")],
}
RULES["typescript"] = [*RULES["javascript"], ("Interface", r"\binterface\s+([A-Za-z_$][\w$]*)"), ("Type", r"\btype\s+([A-Za-z_$][\w$]*)\s*[=<]")]
RULES["c"] = [("Type", r"\bstruct\s+([A-Za-z_]\w*)\s*\{"), ("Function", r"(?m)^[A-Za-z_][\w\s*]*?\b([A-Za-z_]\w*)\s*\([^;{]*\)\s*\{")]


def _line_of(text: Column, at: Column) -> Column:
    return F.length(F.regexp_replace(F.substring(text, F.lit(1), at), "[^\n]", "")) + 1


def _found(text: Column, pattern: str, groups: int = 1) -> Column:
    """array<struct<at, g1, ...>>: the matches of a pattern, with the place after which each next one is looked for.

    The n-th match's place is that of its text after the one before; texts of a file are short.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<at:int,whole:string>>").alias("out"))

    def step(state: Column, m: Column) -> Column:
        at = F.call_function("locate", m, text, state["next"])
        return F.struct((at + F.greatest(F.length(m), F.lit(1))).alias("next"), F.concat(state["out"], F.array(F.struct(at.alias("at"), m.alias("whole")))).alias("out"))

    places = F.aggregate(whole, start, step, lambda s: s["out"])
    return F.transform(places, lambda x: F.struct(x["at"].alias("at"), *[F.regexp_extract(x["whole"], pattern, k).alias(f"g{k}") for k in range(1, groups + 1)]))


def ruled_symbols(files: DataFrame) -> DataFrame:
    """(id, type, label, file_path, start_line, language): the symbols that the rules of a file's language find outside comments."""
    parts = []
    for language, rules in RULES.items():
        own = files.filter((F.col("language") == language) & F.col("content").isNotNull()).withColumn("code", texts.without_comments(F.col("content")))
        for kind, pattern in rules:
            hits = own.select("file_path", "language", F.col("code"), F.inline(_found(F.col("code"), pattern)))
            parts.append(hits.select(F.lit(kind).alias("type"), F.col("g1").alias("label"), "file_path", _line_of(F.col("code"), F.col("at")).alias("start_line"), "language"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.withColumn("id", scalars.stable_id(F.col("type"), F.col("file_path"), F.col("label"))).select("id", "type", "label", "file_path", "start_line", "language").dropDuplicates(["id"])


# How frameworks bind a method and a path to a handler. Groups: method, path, the rest of the arguments.
ROUTES = {
    "node": (["javascript", "typescript"], r"\b(?:app|router|server|fastify)\.(get|post|put|patch|delete|head|options|all)\s*\(\s*['\"`]([^'\"`]+)['\"`]\s*,([^;]*?)\)\s*;"),
    "django": (["python"], r"\b(path|re_path|url)\s*\(\s*r?['\"]([^'\"]*)['\"]\s*,\s*([\w.]+)"),
    "python": (["python"], r"@\w+\.(get|post|put|patch|delete|route)\(\s*['\"]([^'\"]+)['\"][^)]*\)\s*\n\s*(?:async\s+)?def\s+(\w+)"),
    "spring": (["java"], r"@(Get|Post|Put|Patch|Delete|Request)Mapping\(\s*(?:value\s*=\s*)?\"([^\"]+)\"[^)]*\)\s*(?:public|private|protected)?\s*[\w<>\[\], ]*?\s(\w+)\s*\("),
    "nest": (["typescript"], r"@(Get|Post|Put|Patch|Delete|All)\(\s*['\"]([^'\"]*)['\"]\s*\)\s*(?:async\s+)?(\w+)\s*\("),
    "rails": (["ruby"], r"(?m)^\s*(get|post|put|patch|delete)\s+['\"]([^'\"]+)['\"]\s*(?:=>|,\s*to:)\s*['\"]([\w/]+#\w+)['\"]"),
    "laravel": (["php"], r"Route::(get|post|put|patch|delete|any)\(\s*['\"]([^'\"]+)['\"]\s*,\s*\[?\s*([^;]*?)\)\s*;"),
}


def routes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Route nodes (id, label, file_path, start_line, framework) and references (from_id, from_target, relation, target, confidence).

    A route invokes its last argument; arguments before it are middlewares that the call passes through, one
    after the other, from the route to the handler.
    """
    parts = []
    for framework, (languages, pattern) in ROUTES.items():
        own = files.filter(F.col("language").isin(languages) & F.col("content").isNotNull())
        if framework == "django":
            own = own.filter(F.col("file_path").rlike(r"(^|/)urls\.py$"))
        hits = own.select("file_path", "content", F.inline(_found(F.col("content"), pattern, 3)))
        method = F.upper(F.when(F.col("g1").isin("path", "re_path", "url", "route", "all", "any", "All", "Request"), "ANY").otherwise(F.col("g1")))
        parts.append(hits.select(F.concat_ws(" ", method, "g2").alias("label"), "file_path", _line_of(F.col("content"), F.col("at")).alias("start_line"), F.lit(framework).alias("framework"), F.col("g3").alias("rest")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.withColumn("id", scalars.stable_id(F.lit("Route"), F.col("file_path"), F.col("label")))
    chain = F.filter(F.transform(F.split("rest", ","), lambda x: F.regexp_extract(x, r"([A-Za-z_$][\w$.#/]*)['\"\]\s]*$", 1)), lambda x: x != "")
    own = every.withColumn("chain", chain).filter(F.size("chain") > 0)
    handler = F.element_at("chain", -1)
    invokes = own.select(F.col("id").alias("from_id"), F.lit(None).cast("string").alias("from_target"), F.lit("INVOKES").alias("relation"), handler.alias("target"), F.lit(0.75).alias("confidence"))
    steps = F.transform("chain", lambda x, i: F.struct(F.when(i == 0, F.col("id")).alias("from_id"), F.when(i > 0, F.get(F.col("chain"), i - 1)).alias("from_target"), x.alias("target")))
    passes = own.filter(F.size("chain") > 1).select(F.inline(steps)).select("from_id", "from_target", F.lit("PASSES_THROUGH").alias("relation"), "target", F.lit(0.72).alias("confidence"))
    return every.select("id", "label", "file_path", "start_line", "framework"), invokes.unionByName(passes)


# How signals are bound to slots, and the macros of tests.
_SIGNAL = [r"connect\s*\([^,]+,\s*SIGNAL\s*\(\s*(\w+)\s*\([^)]*\)\s*\)\s*,\s*[^,]+,\s*SLOT\s*\(\s*(\w+)\s*\(", r"connect\s*\([^,]+,\s*&[\w:]*::(\w+)\s*,\s*[^,]+,\s*&[\w:]*::(\w+)"]
_TESTS = [r"\bTEST(?:_F|_P)?\s*\(\s*(\w+)\s*,\s*(\w+)\s*\)", r"\b(?:TEST_CASE|SCENARIO)\s*\(\s*\"([^\"]+)\""]


def cpp_frameworks(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tests (id, label, file_path) of C++ test macros, and calls (from_target, target, source_file) from signals to slots."""
    own = files.filter(F.col("language").isin("cpp", "c") & F.col("content").isNotNull())
    hits = lambda pattern, groups: own.select("file_path", F.inline(_found(F.col("content"), pattern, groups)))
    tests = hits(_TESTS[0], 2).select("file_path", F.concat_ws(".", "g1", "g2").alias("label")).unionByName(hits(_TESTS[1], 1).select("file_path", F.col("g1").alias("label")))
    signals = hits(_SIGNAL[0], 2).unionByName(hits(_SIGNAL[1], 2))
    return tests.select(scalars.stable_id(F.lit("Test"), F.col("file_path"), F.col("label")).alias("id"), "label", "file_path").distinct(), signals.select(F.col("g1").alias("from_target"), F.col("g2").alias("target"), F.col("file_path").alias("source_file"))


def build_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Targets and tests (id, type, label) of CMake files, and edges (from_id, to_id, relation) between declared ones: LINKS and RUNS."""
    own = files.filter(F.col("file_path").rlike(r"(^|/)CMakeLists\.txt$|\.cmake$") & F.col("content").isNotNull()).select("file_path", F.regexp_replace("content", "(?m)#.*$", "").alias("code"))
    words = lambda x: F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != "")
    calls = lambda name: own.select("file_path", F.explode(F.regexp_extract_all("code", F.lit(rf"\b{name}\s*\(([^)]*)\)"), F.lit(1))).alias("x")).select("file_path", words(F.col("x")).alias("w")).filter(F.size("w") > 0)
    plain = lambda c: F.col(c).rlike("^[A-Za-z0-9_]+$")
    made = lambda kind, c: scalars.stable_id(F.lit(kind), F.lit(""), c)
    targets = calls("add_executable").unionByName(calls("add_library")).select(F.col("w")[0].alias("label")).filter(plain("label")).distinct()
    after = lambda key: F.get(F.col("w"), F.array_position("w", key).cast("int"))
    named = F.array_contains("w", "NAME") & F.array_contains("w", "COMMAND")
    tests = calls("add_test").select(F.when(named, after("NAME")).otherwise(F.get("w", F.lit(0))).alias("label"), F.when(named, after("COMMAND")).otherwise(F.get("w", F.lit(1))).alias("target")).filter(plain("label")).distinct()
    nodes = targets.select(made("BuildTarget", F.col("label")).alias("id"), F.lit("BuildTarget").alias("type"), "label").unionByName(tests.select("label").distinct().select(made("BuildTest", F.col("label")).alias("id"), F.lit("BuildTest").alias("type"), "label"))
    linked = calls("target_link_libraries").select(F.col("w")[0].alias("a"), F.explode(F.slice("w", F.lit(2), F.size("w"))).alias("b")).filter(~F.col("b").isin("PUBLIC", "PRIVATE", "INTERFACE") & (F.col("a") != F.col("b")))
    known = lambda c: targets.select(F.col("label").alias(c))
    links = linked.join(known("a"), "a", "left_semi").join(known("b"), "b", "left_semi").select(made("BuildTarget", F.col("a")).alias("from_id"), made("BuildTarget", F.col("b")).alias("to_id"), F.lit("LINKS").alias("relation"))
    runs = tests.join(known("target"), "target", "left_semi").select(made("BuildTest", F.col("label")).alias("from_id"), made("BuildTarget", F.col("target")).alias("to_id"), F.lit("RUNS").alias("relation"))
    return nodes, links.unionByName(runs).distinct()


def shader_bridge(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bindings (shader, set, binding, kind, access, name) that shaders declare, and loads (source_file, shader) of shaders by files that name them."""
    shaders = files.filter("language = 'glsl' and content is not null")
    bindings = shaders.select(F.col("file_path").alias("shader"), F.inline(texts.shader_bindings(F.col("content"))))
    named = files.filter("language in ('cpp', 'c') and content is not null").select(F.col("file_path").alias("source_file"), F.explode(F.regexp_extract_all("content", F.lit(r"\"([\w./-]+\.(?:vert|frag|comp|glsl))(?:\.spv)?\""), F.lit(1))).alias("written"))
    tail = F.transform(F.sequence(F.lit(1), F.size(F.split("file_path", "/"))), lambda k: F.array_join(F.slice(F.split("file_path", "/"), -k, k), "/"))
    ends = shaders.select(F.col("file_path").alias("shader"), F.explode(tail).alias("written")).groupBy("written").agg(F.min("shader").alias("shader"), F.count("*").alias("n")).filter("n = 1")
    return bindings, named.join(ends, "written").select("source_file", "shader").distinct()


def import_evidence(files: DataFrame) -> DataFrame:
    """(file_path, local, source, exported): what names a script binds by its imports; `*` for a whole module, default for its default."""
    own = files.filter(F.col("language").isin("javascript", "typescript") & F.col("content").isNotNull())
    hits = own.select("file_path", F.inline(_found(F.col("content"), r"\bimport\s+(?:type\s+)?([^'\";]+?)\s+from\s+['\"]([^'\"]+)['\"]", 2)))
    braces = F.filter(F.split(F.regexp_extract("g1", r"\{([^}]*)\}", 1), ","), lambda x: F.trim(x) != "")
    parts = F.transform(braces, lambda x: F.struct(F.element_at(F.split(F.trim(x), r"\s+as\s+"), -1).alias("local"), F.element_at(F.split(F.trim(x), r"\s+as\s+"), 1).alias("exported")))
    bare = F.regexp_extract("g1", r"^([A-Za-z_$][\w$]*)", 1)
    star = F.regexp_extract("g1", r"\*\s+as\s+([A-Za-z_$][\w$]*)", 1)
    one = lambda name, exported: F.when(name != "", F.array(F.struct(name.alias("local"), F.lit(exported).alias("exported")))).otherwise(F.array().cast("array<struct<local:string,exported:string>>"))
    every = hits.select("file_path", F.col("g2").alias("source"), F.inline(F.concat(parts, one(bare, "default"), one(star, "*"))))
    required = own.select("file_path", F.inline(_found(F.col("content"), r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)", 2)))
    return every.select("file_path", "local", "source", "exported").unionByName(required.select("file_path", F.col("g1").alias("local"), F.col("g2").alias("source"), F.lit("*").alias("exported")))


def file_fingerprints(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """(file_path, structural, dependency): hashes of what a file declares and of what it refers to; line numbers don't count."""
    said = lambda *c: F.concat_ws("|", *c)
    a = nodes.groupBy("file_path").agg(F.collect_set(said("type", "qname", F.coalesce("signature", F.lit("")))).alias("own"))  # of one file
    b = refs.groupBy(F.col("source_file").alias("file_path")).agg(F.collect_set(said("relation", "target")).alias("out"))
    both = a.join(b, "file_path", "full")
    empty = F.array().cast("array<string>")
    return both.select("file_path", names.fingerprint(F.coalesce("own", empty)).alias("structural"), names.fingerprint(F.coalesce("out", empty)).alias("dependency"))
