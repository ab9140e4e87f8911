"""What can be read off lines of documents, configurations and signatures, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How many characters of headings are kept, and the patterns of fences and headings.
HEADING_CHARS = 4000
_FENCE = r"^ {0,3}(?:```|~~~)"
_HEADING = r"^ {0,3}#{1,6}\s+(\S.*)$"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r?\n")


def unfenced_lines(text: Column) -> Column:
    """array<struct<no, line>>: the lines outside fences, without the fences, numbered from 1.

    Whether a line is fenced follows from how many fences stand before it: one fold over the lines.
    """

    def step(state: Column, line: Column) -> Column:
        fence = line.rlike(_FENCE)
        kept = ~fence & ~state["fenced"]
        own = F.array(F.struct((state["no"] + 1).alias("no"), line.alias("line")))
        return F.struct((state["no"] + 1).alias("no"), (state["fenced"] != fence).alias("fenced"), F.when(kept, F.concat(state["out"], own)).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("no"), F.lit(False).alias("fenced"), F.array().cast("array<struct<no:int,line:string>>").alias("out"))
    return F.aggregate(_lines(text), start, step, lambda s: s["out"])


def headings(text: Column, most: int = HEADING_CHARS) -> Column:
    """struct<headings, truncated>: the headings outside fences, up to `most` characters together; what is cut is said."""
    titles = F.transform(F.filter(unfenced_lines(text), lambda x: x["line"].rlike(_HEADING)), lambda x: F.trim(F.regexp_replace(F.regexp_extract(x["line"], _HEADING, 1), r"\s+#+\s*$", "")))
    titles = F.filter(titles, lambda t: t != "")

    def step(state: Column, t: Column) -> Column:
        full = state["truncated"] | (state["chars"] + F.length(t) > most)
        return F.struct(
            F.when(full, state["out"]).otherwise(F.concat(state["out"], F.array(t))).alias("out"), F.when(full, state["chars"]).otherwise(state["chars"] + F.length(t)).alias("chars"), full.alias("truncated")
        )

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("chars"), F.lit(False).alias("truncated"))
    return F.aggregate(titles, start, step, lambda s: F.struct(s["out"].alias("headings"), s["truncated"].alias("truncated")))


def config_keys(text: Column, name: Column) -> Column:
    """array<string>: the keys that a configuration file sets, by the kind that its name tells."""
    lines = F.filter(F.transform(_lines(text), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    env = F.transform(F.filter(lines, lambda x: F.contains(x, F.lit("="))), lambda x: F.trim(F.substring_index(x, "=", 1)))
    other = F.array_sort(F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"^([A-Za-z0-9_.-]+)\s*[:=]", 1)), lambda x: x != ""))
    json = F.coalesce(F.array_sort(F.json_object_keys(text)), F.array().cast("array<string>"))
    base = F.lower(F.element_at(F.split(name, "/"), -1))
    return F.when(base == ".env", env).when(base.endswith(".json"), json).otherwise(other)


def document_meta(text: Column) -> Column:
    """struct<title, summary>: the first line that isn't blank, without its hashes, and the second."""
    lines = F.filter(F.transform(_lines(text), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(F.trim(F.regexp_replace(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), r"^#+\s*", "")).alias("title"), F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("summary"))


def identifier_column(line: Column, leaf: str) -> Column:
    """Where a name stands in a line as a whole word, from 0: qualified, else called, else first; -1 if nowhere."""
    word = "".join(c if c.isalnum() or c == "_" else "\\" + c for c in leaf)
    whole = rf"(?<![A-Za-z0-9_$]){word}(?![A-Za-z0-9_$])"
    at = lambda pattern: F.nullif(F.regexp_instr(line, F.lit(pattern)), F.lit(0))
    return F.coalesce(at(rf"(?<=::|\.){whole}"), at(rf"{whole}(?=\s*[(<])"), at(whole), F.lit(0)) - 1


def parameter_list(signature: Column) -> Column:
    """What stands between the first parenthesis and the one that closes it; null without such a pair."""

    def step(state: Column, c: Column) -> Column:
        depth = state["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
        inside = (state["depth"] > 0) & (depth > 0) & ~state["done"]
        return F.struct(
            F.when(state["done"], state["depth"]).otherwise(depth).alias("depth"), F.when(inside, F.concat(state["out"], c)).otherwise(state["out"]).alias("out"), (state["done"] | ((state["depth"] > 0) & (depth == 0))).alias("done")
        )

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"), F.lit(False).alias("done"))
    return F.aggregate(F.split(signature, ""), start, step, lambda s: F.when(s["done"], s["out"]))


def parameter_count(signature: Column) -> Column:
    """The parameters of a signature: commas outside brackets of any kind; null if there is no list of them."""

    def step(state: Column, c: Column) -> Column:
        move = lambda name, opens, closes: F.greatest(state[name] + F.when(c == opens, 1).when(c == closes, -1).otherwise(0), F.lit(0)).alias(name)
        flat = (state["angle"] + state["round"] + state["square"]) == 0
        return F.struct(move("angle", "<", ">"), move("round", "(", ")"), move("square", "[", "]"), (state["n"] + (flat & (c == ",")).cast("int")).alias("n"))

    def count(own: Column) -> Column:
        start = F.struct(F.lit(0).alias("angle"), F.lit(0).alias("round"), F.lit(0).alias("square"), F.lit(1).alias("n"))
        return F.when(F.trim(own).isin("", "void"), F.lit(0)).otherwise(F.aggregate(F.split(own, ""), start, step, lambda s: s["n"]))

    return F.transform(F.array(parameter_list(signature)), lambda x: F.when(x.isNotNull(), count(x)))[0]


def is_const(signature: Column) -> Column:
    return F.coalesce(signature.rlike(r"\)[^)]*\bconst\b[^)]*$"), F.lit(False))


def days_ago(then: Column, now: Column) -> Column:
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 86400)


def relative_time(then: Column, now: Column) -> Column:
    """just now, or whole minutes, hours or days ago."""
    s = F.greatest(F.unix_timestamp(now) - F.unix_timestamp(then), F.lit(0))
    ago = lambda size, unit: F.concat(F.floor(s / size).cast("string"), F.lit(f"{unit} ago"))
    return F.when(then.isNull(), "unknown time").when(s < 45, "just now").when(s < 3600, ago(60, "m")).when(s < 86400, ago(3600, "h")).otherwise(ago(86400, "d"))


# Calls whose target only running the code would tell, by kind and language.
DYNAMIC = {
    "computed-call": r"[\w$)\]]\s*\[([^\[\]\n]{1,80})\]\s*\(",
    "dynamic-import": r"\b(?:import|require)\s*\(\s*(?!['\"`)\s])|\bimportlib\.import_module\s*\(|\b__import__\s*\(",
    "proxy-reflect": r"\bnew\s+Proxy\s*\(|\bReflect\.(?:get|apply|construct)\s*\(",
    "getattr-dispatch": r"\b(?:getattr|setattr)\s*\(\s*\w",
    "member-pointer": r"(?:->\*|\.\*)\s*\w+\s*\)?\s*\(|\bstd::invoke\s*\(",
    "typed-bus": r"\.(?:[Ss]end|[Pp]ublish|[Dd]ispatch|[Ee]xecute|[Ee]mit)(?:Async)?\s*(?:<[^<>\n]{0,80}>)?\s*\(\s*new\s+([A-Z]\w*)",
}


def without_comments(code: Column, python: bool = False) -> Column:
    """Code with comments gone and the contents of strings emptied, line by line for one-line forms."""
    strings = r"'(?:[^'\\\n]|\\.)*+'?|\"(?:[^\"\\\n]|\\.)*+\"?"
    comment = r"#[^\n]*" if python else r"//[^\n]*|/\*(?s:.*?)(?:\*/|$)"
    return F.regexp_replace(F.regexp_replace(code, rf"({strings})|(?:{comment})", "$1"), strings, '""')


def dynamic_calls(code: Column, python: bool = False) -> Column:
    """array<struct<form, n>>: how often each dynamic form occurs outside comments and strings; absent ones drop out."""
    plain = without_comments(code, python)
    found = F.array(*[F.struct(F.lit(form).alias("form"), F.regexp_count(plain, F.lit(pattern)).alias("n")) for form, pattern in DYNAMIC.items()])
    return F.filter(found, lambda x: x["n"] > 0)


# Fixed value: a shader's layout declaration.
_LAYOUT = r"layout\s*\(([^)]*)\)\s*((?:(?:readonly|writeonly|coherent|volatile|restrict|std430|std140|highp|mediump|lowp)\s+)*)(buffer|uniform)\s+([^;{]*?)\s*[;{]"


def shader_bindings(code: Column) -> Column:
    """array<struct<set, binding, kind, access, name>> of a shader's layout declarations; a set that isn't named is 0."""
    whole = F.regexp_extract_all(code, F.lit(_LAYOUT), F.lit(0))

    def one(x: Column) -> Column:
        part = lambda k: F.regexp_extract(x, _LAYOUT, k)
        number = lambda name: F.nullif(F.regexp_extract(part(1), rf"\b{name}\s*=\s*(\d+)", 1), F.lit("")).cast("int")
        words = F.concat_ws(" ", part(2), part(4))
        access = F.when(words.rlike(r"\breadonly\b"), "read").when(words.rlike(r"\bwriteonly\b"), "write").when(part(3) == "buffer", "read_write").otherwise("read")
        return F.struct(F.coalesce(number("set"), F.lit(0)).alias("set"), number("binding").alias("binding"), part(3).alias("kind"), access.alias("access"), F.regexp_extract(part(4), r"([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?$", 1).alias("name"))

    return F.filter(F.transform(whole, one), lambda x: x["binding"].isNotNull())



_DIAGNOSTIC = r"^(.+?):(\d+):(?:(\d+):)?\s*(?:fatal )?(error|warning|note):\s*(.*?)(?:\s*\[([^\[\]]+)\])?$"


def compiler_lines(lines: DataFrame) -> DataFrame:
    """(file, line, col, severity, message, code) of a compiler's output (value); lines that are no diagnostics drop out."""
    part = lambda k: F.nullif(F.regexp_extract("value", _DIAGNOSTIC, k), F.lit(""))
    found = lines.filter(F.col("value").rlike(_DIAGNOSTIC))
    return found.select(part(1).alias("file"), part(2).cast("int").alias("line"), part(3).cast("int").alias("col"), part(4).alias("severity"), part(5).alias("message"), part(6).alias("code"))
