"""Source trees: files with their language, what is ignored, special files and folders, windows and matches in texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.functions import scalars

# Languages by ending, and folders that hold no source of one's own.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "php": "php", "c": "c", "h": "cpp", "hpp": "cpp",
    "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hh": "cpp", "go": "go", "rs": "rust", "rb": "ruby", "java": "java", "glsl": "glsl", "vert": "glsl", "frag": "glsl", "comp": "glsl", "css": "css",
}
IGNORED = """.git .hg .svn node_modules vendor dist build out target coverage __pycache__ .venv venv .tox .mypy_cache .pytest_cache
.next .nuxt .cache .idea .vscode""".split()
MOST_BYTES = 1_000_000
_DOCUMENTS = ["md", "mdx", "rst", "txt", "adoc"]
_CONFIGS = ["json", "yaml", "yml", "toml", "ini", "cfg", "env", "properties"]
_SCHEMAS = ["sql", "proto", "graphql", "prisma", "xsd"]


def ending_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language_of(path: Column) -> Column:
    """The language that a file's ending names; null for others."""
    return F.coalesce(*[F.when(ending_of(path).isin([e for e, x in LANGUAGES.items() if x == name]), F.lit(name)) for name in dict.fromkeys(LANGUAGES.values())])


def ignore_rules(text: str) -> tuple[list[str], list[str]]:
    """Names of folders and globs of paths that a file of ignore rules lists; comments and re-includes are no rules."""
    lines = [x.strip().rstrip("/").lstrip("/") for x in text.splitlines()]
    lines = [x for x in lines if x and not x.startswith(("#", "!"))]
    return [x for x in lines if not re.search(r"[/*?]", x)], [x for x in lines if re.search(r"[/*?]", x)]


def is_ignored(path: Column, names: list[str], globs: list[str] | None = None, kept: list[str] | None = None) -> Column:
    """Whether a folder of the path has an ignored name, or the path or a folder above it matches a glob; kept names are not ignored."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    own = [n for n in names if n not in (kept or [])]
    hit = F.exists(folders, lambda f: f.isin(own)) if own else F.lit(False)
    for glob in globs or []:
        pattern = scalars.glob_pattern(glob if "/" in glob else f"**/{glob}", star_crosses=False)[1:-1]
        hit = hit | F.concat(F.lit("/"), path).rlike(f"^/?{pattern}(/|$)")
    return hit


def scan(spark: SparkSession, root: str, names: list[str] | None = None, globs: list[str] | None = None, most: int = MOST_BYTES, candidates: DataFrame | None = None) -> DataFrame:
    """(file_path, size, modified, language, content, skipped) of the files below root that aren't ignored.

    A file longer than `most` bytes, or that isn't text, keeps its row without its content; skipped says why. Spark
    lists no files of no bytes.
    candidates (file_path), if given, are the files that a version control lists: others don't count.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    bare = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), "^" + re.escape(re.sub("^[a-z]+:/+", "/", base)) + "/", "")

    def kept(part: DataFrame, content: Column) -> DataFrame:
        own = part.select(bare.alias("file_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), content.alias("content"))
        own = own.filter(~is_ignored(F.col("file_path"), IGNORED if names is None else names, globs))
        return own if candidates is None else own.join(candidates.select("file_path").distinct(), "file_path", "left_semi")

    # the source drops long files by their length before it opens any
    short, long = kept(files.filter(F.col("length") <= most), F.col("content")), kept(files.filter(F.col("length") > most), F.lit(None).cast("binary"))
    binary = F.contains(F.decode(F.substring("content", 1, 8000), "ISO-8859-1"), F.lit("\0"))
    why = F.when(F.col("size") > most, "too long").when(binary, "not text")
    text = F.when(why.isNull(), F.decode("content", "utf-8"))
    return short.unionByName(long).select("file_path", "size", "modified", language_of(F.col("file_path")).alias("language"), text.alias("content"), why.alias("skipped"))


def special_nodes(files: DataFrame) -> DataFrame:
    """(id, type, label, file_path): documents, configurations, schemas and folders among files (file_path)."""
    end = ending_of(F.col("file_path"))
    base = F.element_at(F.split("file_path", "/"), -1)
    kind = F.when(end.isin(_DOCUMENTS), "Document").when(end.isin(_CONFIGS) | base.startswith(".env"), "Config").when(end.isin(_SCHEMAS), "Schema")
    own = files.select("file_path", kind.alias("type"), base.alias("label")).filter("type is not null")
    parts = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    folders = files.filter(F.contains("file_path", F.lit("/"))).select(F.explode(above).alias("file_path")).distinct()
    folders = folders.select("file_path", F.lit("Directory").alias("type"), F.element_at(F.split("file_path", "/"), -1).alias("label"))
    return own.unionByName(folders).select(scalars.stable_id(F.col("type"), F.col("file_path"), F.col("label")).alias("id"), "type", "label", "file_path")


def window(files: DataFrame, path: str, first: int, last: int, most: int = 200) -> DataFrame:
    """(line_no, line) of a file (file_path, content) from line to line, at most `most` of them: a window is the feature."""
    lines = files.filter(F.col("file_path") == path).select(F.posexplode(F.split("content", r"\r?\n")).alias("at", "line"))
    return lines.filter(F.col("at").between(first - 1, min(last, first + most - 1) - 1)).select((F.col("at") + 1).alias("line_no"), "line")


def occurrences(files: DataFrame, word: str) -> DataFrame:
    """(file_path, line_no, line): the lines of files (file_path, content) that hold a word as a whole."""
    pattern = rf"(?<![A-Za-z0-9_$]){re.escape(word)}(?![A-Za-z0-9_$])"
    some = files.filter(F.contains("content", F.lit(word)))
    lines = some.select("file_path", F.posexplode(F.split("content", r"\r?\n")).alias("at", "line"))
    return lines.filter(F.col("line").rlike(pattern)).select("file_path", (F.col("at") + 1).alias("line_no"), "line")


def extract_of(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, language, lines, sha, symbols, imports_to, imported_by): what there is to say about each file (file_path, language, content)."""
    code = nodes.filter(F.col("type").isin("Function", "Method", "Class", "Interface", "Type", "Variable", "Test"))
    symbols = code.groupBy("file_path").agg(F.array_sort(F.collect_set("label")).alias("symbols"))  # those of one file
    ends = edges.filter("relation = 'IMPORTS'").select("from_file", "to_file").distinct()
    out = ends.groupBy(F.col("from_file").alias("file_path")).agg(F.count("*").alias("imports_to"))
    into = ends.groupBy(F.col("to_file").alias("file_path")).agg(F.count("*").alias("imported_by"))
    own = files.select("file_path", "language", F.size(F.split("content", "\n")).alias("lines"), F.sha2("content", 256).alias("sha"), F.length("content").alias("chars"))
    told = own.join(symbols, "file_path", "left").join(out, "file_path", "left").join(into, "file_path", "left")
    return told.withColumn("symbols", F.coalesce("symbols", F.array().cast("array<string>"))).fillna(0, ["imports_to", "imported_by"])


def batches(files: DataFrame, most_files: int = 20, most_chars: int = 50_000) -> DataFrame:
    """(file_path, batch): files (file_path, chars) in batches within both bounds, in order within each top folder.

    A new batch begins where the running sum of either passes a multiple of its bound, so that a batch holds at
    most twice a bound; a longer file is a batch of its own.
    """
    from pyspark.sql import Window as W

    order = W.partitionBy("top").orderBy("file_path")
    own = files.select("file_path", "chars", scalars.top_level_dir(F.col("file_path")).alias("top"))
    place, before = F.row_number().over(order) - 1, F.sum("chars").over(order) - F.col("chars")
    return own.select("file_path", F.concat_ws("#", "top", F.floor(place / most_files).cast("string"), F.floor(before / most_chars).cast("string")).alias("batch"))
