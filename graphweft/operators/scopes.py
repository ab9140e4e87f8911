"""Symbols with their scopes of languages that this package has no parser for: tokens by a table, then a stack of scopes.

Files are (file_path, language, content). Each is read once, in a task of its own share of files; what is found is
written and split into nodes and references. Nothing here resolves a name: that is the resolver's work.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.functions import names
from graphweft.operators.lineage import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

_FOUND = "node boolean, id string, type string, label string, qname string, file_path string, start_line int, end_line int, language string, owner string, relation string, target string"

# Fixed values by language: keywords of types, of functions and of inheritance, of imports; what starts a comment; whether methods
# (in types) and functions (in files) come without a keyword.
_C_TYPES = {"class": "Class", "struct": "Class", "enum": "Type", "namespace": "Module"}
_JS = {"types": {"class": "Class", "interface": "Interface", "enum": "Type", "namespace": "Module"}, "functions": {"function"}, "bases": {"extends", "implements"}, "imports": {"import", "require"}, "bare": {"Class", "Interface"}}
_C = {"types": _C_TYPES, "functions": set(), "bases": {":"}, "imports": {"#include"}, "bare": {"Class", "Module", ""}}
LANGUAGES = {
    "javascript": _JS,
    "typescript": _JS,
    "java": {"types": {"class": "Class", "interface": "Interface", "enum": "Type", "record": "Class"}, "functions": set(), "bases": {"extends", "implements"}, "imports": {"import"}, "bare": {"Class", "Interface", "Type"}},
    "go": {"types": {}, "functions": {"func"}, "bases": set(), "imports": {"import"}, "bare": set()},
    "rust": {"types": {"struct": "Class", "enum": "Type", "trait": "Interface", "mod": "Module", "impl": "impl"}, "functions": {"fn"}, "bases": set(), "imports": {"use"}, "bare": set()},
    "php": {"types": {"class": "Class", "interface": "Interface", "trait": "Class", "enum": "Type"}, "functions": {"function"}, "bases": {"extends", "implements"}, "imports": {"use"}, "bare": set(), "hash": True},
    "ruby": {"types": {"class": "Class", "module": "Module"}, "functions": {"def"}, "bases": {"<"}, "imports": {"require", "require_relative"}, "bare": set(), "hash": True},
    "c": _C,
    "cpp": _C,
}
_NEVER_CALLED = set("if for while switch catch return sizeof new function func fn def else do elsif unless until super match typeof await yield and or not in when case throw delete alignof decltype static_assert".split())
_MODIFIERS = set("public private protected virtual final static abstract const".split())
#: Nothing is declared or referred to deeper than this.
DEEPEST = 80
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_RUBY_OPEN, _RUBY_AT_START = {"class", "module", "def", "do", "begin", "case"}, {"if", "unless", "while", "until", "for"}

_STRING = r"\"\"\"[\s\S]*?(?:\"\"\"|\Z)|\"(?:\\[\s\S]|[^\"\\])*?(?:\"|\Z)|`(?:\\[\s\S]|[^`\\])*(?:`|\Z)"
_QUOTED = {"rust": r"'(?:\\[^'\n]*|[^'\\\n])'|'\w+"}
_REGEX_LITERAL = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_BEFORE_REGEX = set("(,=:[!&|?{};") | {"return", "=>", ""}


def _tokenizer(language: str) -> re.Pattern:
    comment = r"/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*"
    if LANGUAGES[language].get("hash"):
        comment = r"#[^\n]*|^=begin[\s\S]*?(?:^=end|\Z)" if language == "ruby" else comment + r"|#(?!\[)[^\n]*"
    quoted = _QUOTED.get(language, r"'(?:\\[\s\S]|[^'\\\n])*'")
    name = r"[^\W\d][\w$]*[?!]?(?!=)|[^\W\d][\w$]*" if language == "ruby" else r"[$]?[^\W\d][\w$]*|[$]"
    include = r"|(?P<include>#\s*include\s*[<\"][^>\"\n]+[>\"])|#[^\n]*(?:\\\n[^\n]*)*" if language in ("c", "cpp") else ""
    return re.compile(rf"(?P<skip>{comment}){include}|(?P<string>{_STRING}|{quoted})|(?P<line>\n)|(?P<name>{name})|(?P<mark>::|=>|->|[^\s\w])|[\d][\w.]*|\s", re.M)


def _tokens(text: str, language: str) -> list[tuple[str, str, int]]:
    """(kind, text, line); comments and numbers are left out, ends of lines only stay for Ruby."""
    pattern, out, at, line = _tokenizer(language), [], 0, 1
    scripts = language in ("javascript", "typescript")
    while at < len(text):
        hit = None
        if scripts and text[at] == "/" and (out[-1][1] if out else "") in _BEFORE_REGEX:
            hit = _REGEX_LITERAL.match(text, at)
        kind = "string" if hit else None
        hit = hit or pattern.match(text, at)
        if hit is None:
            at += 1
            continue
        kind = kind or hit.lastgroup
        if kind in ("string", "name", "mark", "include") or kind == "line" and language == "ruby":
            out.append((kind, hit.group(), line))
        line += hit.group().count("\n")
        at = hit.end()
    return out


def _matches(tokens: list[tuple[str, str, int]], language: str) -> dict[int, int]:
    """Where what opens at a token closes; what never does closes with the file."""
    match, stack, loop = {}, [], False
    for i, (kind, text, _) in enumerate(tokens):
        if kind == "mark" and text in _OPEN:
            stack.append((i, _OPEN[text]))
        elif kind == "mark" and text in _CLOSE:
            if stack and stack[-1][1] == text:
                match[stack.pop()[0]] = i
        elif language == "ruby":
            before = tokens[i - 1][1] if i else "\n"
            starts = before in ("\n", ";", "=", "then", "else")
            loop = False if kind == "line" else loop or kind == "name" and text in ("while", "until", "for") and starts
            if kind == "name" and before != "." and (text in _RUBY_OPEN and not (text == "do" and loop) or text in _RUBY_AT_START and starts):
                stack.append((i, "end"))
            elif kind == "name" and text == "end" and before != "." and stack and stack[-1][1] == "end":
                match[stack.pop()[0]] = i
    return match | {i: len(tokens) - 1 for i, _ in stack}


def _id(kind: str, path: str, qname: str) -> str:
    return hashlib.sha1("::".join((kind, path, qname)).encode()).hexdigest()


def scanned(path: str, language: str, text: str, module: str) -> list[tuple]:
    """Rows of _FOUND of one file."""
    rules, tokens = LANGUAGES[language], _tokens(text, language)
    match, ruby, rows = _matches(tokens, language), language == "ruby", []
    top = ("", module, _id("Module", path, module))
    scopes: list[tuple[int, tuple, bool]] = [(len(tokens), top, True)]  # (where it closes, (kind, qname, id), whether its owner's own body)
    opens: dict[int, tuple] = {}  # bodies to come
    declared: set[int] = set()  # names that are not calls
    said = lambda k: tokens[k][1] if 0 <= k < len(tokens) else ""
    is_name = lambda k: 0 <= k < len(tokens) and tokens[k][0] == "name"

    def refer(scope: tuple, relation: str, target: str, line: int) -> None:
        rows.append((False, scope[2], None, None, None, path, line, None, language, None, relation, target))

    ends: dict[bool, dict[int, int | None]] = {False: {}, True: {}}

    def body(k: int, header: bool = False) -> int | None:
        """Where the body starts that follows token k; None if there is none. A header holds no operators. Each token is looked at once."""
        known, way = ends[header], []
        while k not in known:
            t = said(k)
            if t in ("{", ";", "", "}") or header and t in ("=", "=>", "+", "?", "!", "|", "/", "%"):
                known[k] = k if t == "{" else None
            else:
                way.append(k)
                k = match.get(k, k) + 1
        known.update(dict.fromkeys(way, known[k]))
        return known[k]

    def define(kind: str, k: int, at: int | None, first: int, owner: tuple) -> tuple:
        name = said(k)
        tested = kind in ("Function", "Method") and (re.match(r"Test[A-Z_]", name) if language == "go" else name.startswith("test_"))
        kind = "Test" if tested else kind
        qname = f"{owner[1]}.{name}"
        own = (kind, qname, _id(kind, path, qname))
        last = tokens[match.get(at, at)][2] if at is not None else tokens[k][2]
        rows.append((True, own[2], kind, name, qname, path, tokens[first][2], last, language, owner[2], None, None))
        declared.add(k)
        if at is not None:
            opens[at] = own
        return own

    def bases(own: tuple, k: int, stop: int) -> None:
        """What stands behind a word of inheritance up to the body, without modifiers and arguments."""
        on, k0 = False, k
        while k < stop:
            t = said(k)
            if t in rules["bases"]:
                on = True
            elif t == "<" and t not in rules["bases"]:
                while k < stop and said(k) != ">":
                    k += 1
            elif on and is_name(k) and t not in _MODIFIERS and k > k0:
                parts = [t]
                while said(k + 1) in (".", "::", "\\") and is_name(k + 2):
                    parts.append(said(k + 2))
                    k += 2
                refer(own, "EXTENDS", ".".join(parts), tokens[k][2])
            k += 1

    i = 0
    while i < len(tokens):
        kind, t, line = tokens[i]
        while len(scopes) > 1 and scopes[-1][0] <= i:
            scopes.pop()
        scope, direct = scopes[-1][1], scopes[-1][2]
        if i in opens:
            scopes.append((match.get(i, len(tokens)), opens[i], True))
        elif t == "{" or ruby and kind == "name" and i in match:
            scopes.append((match.get(i, len(tokens)), scope, False))
        if len(scopes) > DEEPEST:
            i += 1
            continue
        if kind == "include":
            refer(top, "IMPORTS", re.sub(r"^#\s*include\s*[<\"]|[>\"]$", "", t), line)
        elif kind == "name" and i not in declared and said(i - 1) not in (".", "->"):
            if t in rules["imports"] and scope is top:
                end = i + 1
                while end < len(tokens) and said(end) not in (";", "\n") and not (tokens[end][0] == "string" and said(end - 1) in ("from", "import", "require", "require_relative")):
                    end = match[end] if said(end) == "(" and end in match else end + 1
                    if said(end) == ")":
                        break
                strings = [x for k, x, _ in tokens[i : end + 1] if k == "string"]
                if strings:
                    for s in strings:
                        refer(top, "IMPORTS", s[1:-1], line)
                elif language in ("java", "rust", "php"):
                    refer(top, "IMPORTS", "".join(x for _, x, _ in tokens[i + 1 : end] if x != "static").partition("::{")[0], line)
                i = end
                continue
            if t in rules["types"] and is_name(i + 1) or t == "impl" and language == "rust":
                k, what = i + 1, rules["types"][t]
                k += said(k) == "class"  # enum class
                at = i if ruby else body(k + 1) if language not in ("c", "cpp") or said(k + 1) in ("{", ":", "final") else None
                if what == "impl":
                    head = [j for j in range(k, at or k) if is_name(j) and said(j) not in ("where", "mut", "dyn")]
                    over = next((j for j in head if said(j) == "for"), None)
                    named = [j for j in head if over is None or j > over]
                    if at is not None and named:
                        qname = f"{scope[1]}.{said(named[0])}"
                        opens[at] = own = ("Class", qname, _id("Class", path, qname))
                        if over is not None:
                            refer(own, "EXTENDS", said(head[0]), line)
                        i = at
                        continue
                elif at is not None or said(k + 1) == ";" and language == "rust" or said(k + 1) == "(" and language == "rust":
                    own = define(what, k, at, i, scope)
                    stop = at or k
                    if ruby and said(k + 1) == "<":
                        stop = k + 3
                        while said(stop) == "::":
                            stop += 2
                    bases(own, k + 1, stop if not ruby or said(k + 1) == "<" else k)
                    if ruby:
                        scopes[-1] = (match.get(i, len(tokens)), own, True)
                        opens.pop(i, None)
                    else:
                        i = at if at is not None else i + 1
                        continue
            elif language == "go" and t == "type" and is_name(i + 1) and direct and scope is top:
                define("Class" if said(i + 2) == "struct" else "Interface" if said(i + 2) == "interface" else "Type", i + 1, i + 3 if said(i + 3) == "{" else None, i, scope)
            elif t in rules["functions"]:
                k, owner = i + 1, scope
                if language == "go" and said(k) == "(":
                    inner = [j for j in range(k, match.get(k, k)) if is_name(j)]
                    if inner and is_name(match[k] + 1):
                        qname = f"{scope[1]}.{said(inner[-1])}"
                        owner, k = ("Class", qname, _id("Class", path, qname)), match[k] + 1
                k += 1 if said(k) in ("*", "&") else 2 if ruby and said(k) == "self" and said(k + 1) == "." else 0
                if is_name(k) and (ruby or said(k + 1) in ("(", "<")):
                    at = i if ruby else body(k + 1)
                    own = define("Method" if owner[0] in ("Class", "Interface") else "Function", k, at, i, owner)
                    if ruby:
                        scopes[-1] = (match.get(i, len(tokens)), own, True)
                        opens.pop(i, None)
            elif "function" in rules["functions"] and t in ("const", "let", "var") and is_name(i + 1) and said(i + 2) == "=":
                k = i + 3 + (said(i + 3) == "async")
                arrow = match.get(k, k) + 1
                if said(arrow) == "=>" and (said(k) == "(" or is_name(k)):
                    define("Function", i + 1, arrow + 1 if said(arrow + 1) == "{" else None, i, scope)
            elif said(i + 1) == "(" and t not in _NEVER_CALLED:
                at = body(match[i + 1] + 1, header=True) if direct and scope[0] in rules["bare"] and i + 1 in match and said(i - 1) not in ("=", "new", ",", "(") and (said(i - 1) != ":" or said(i - 2) in _MODIFIERS) else None
                if at is not None:
                    owner = scope
                    if said(i - 1) == "::" and is_name(i - 2):
                        qname = f"{scope[1]}.{said(i - 2)}"
                        owner = ("Class", qname, _id("Class", path, qname))
                    define("Method" if owner[0] in ("Class", "Interface", "Type") else "Function", i, at, i, owner)
                elif scope is not top and scope[0] not in ("Class", "Interface", "Type", "Module"):
                    refer(scope, "TESTS" if scope[0] == "Test" else "CALLS", t, line)
                elif language in ("c", "cpp") and said(i - 1) == "=":
                    refer(top, "CALLS", t, line)  # what a static value is made by
        elif kind == "name" and i not in declared and said(i + 1) == "(" and scope[0] in ("Function", "Method", "Test"):
            mine = said(i - 2) in ("this", "self", "$this") and scope[0] == "Method"
            refer(scope, "TESTS" if scope[0] == "Test" else "CALLS", f"{scope[1].split('.')[-2]}.{t}" if mine else t, line)
        i += 1
    return rows


def scoped_symbols(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, label, qname, file_path, start_line, end_line, language, owner) and references (from_id, relation, target, source_file, source_line, extractor).

    Types, functions and methods stand under what holds them: a class, a namespace, the type that a Go receiver, a
    Rust `impl` or a C++ `Box::run` names. References are IMPORTS of the module, EXTENDS of types, CALLS (TESTS from a test) of
    functions; a call on `this` or `self` is told as `Owner.name`, for the resolver's rule on members of bases. Strings,
    comments, regular expressions and macros hold no symbols. Brackets that stay open close with the file; calls without
    brackets aren't seen, nor what stands over DEEPEST brackets deep. Declarations of one name (overloads) are one node, the first. Files without text give nothing.
    """
    own = files.filter(F.col("language").isin(list(LANGUAGES)) & F.col("content").isNotNull()).select("file_path", "language", "content", names.module_name(F.col("file_path")).alias("module"))
    columns = [c.split()[0] for c in _FOUND.split(", ")]

    def told(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"start_line": "Int32", "end_line": "Int32", "node": "boolean"})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for row in batch.itertuples(index=False):
                rows += scanned(*row)
                if len(rows) > 20_000:
                    yield told(rows)
                    rows = []
        yield told(rows)

    found = cut(own.mapInPandas(read, _FOUND))
    nodes = found.filter("node").groupBy("id").agg(F.min_by(F.struct(*columns[2:10]), F.struct("start_line", "end_line")).alias("n")).select("id", "n.*")
    return nodes, found.filter("not node").select(F.col("id").alias("from_id"), "relation", "target", F.col("file_path").alias("source_file"), F.col("start_line").alias("source_line"), F.col("language").alias("extractor"))
