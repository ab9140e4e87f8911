"""Paths and globs joined by what a glob says literally; the pattern is tried only where both meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LANES = 64  # globs without a literal key meet every path, in as many places


def glob_column(glob: Column, star_crosses: bool = False) -> Column:
    """A column of globs as anchored regular expressions: `**` crosses folders, a star does so only if asked."""
    quoted = F.regexp_replace(glob, r"([.+^${}()|\\\[\]])", r"\\$1")
    held = F.regexp_replace(quoted, r"\*\*", "\u0001")
    one = F.regexp_replace(held, r"\*", ".*" if star_crosses else "[^/]*")
    any_ = F.regexp_replace(one, "\u0001", ".*")
    return F.concat(F.lit("^"), F.regexp_replace(any_, r"\?", ".") if star_crosses else F.regexp_replace(any_, r"\?", r"\\?"), F.lit("$"))


def _key(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"))


def _glob_keys(glob: Column, star_crosses: bool) -> Column:
    """The literal text that finds a glob's paths: all of it, its folder, its end, its start, or a folder on the way."""
    plain = "[^*?]" if star_crosses else "[^*]"
    start, end = F.regexp_extract(glob, f"^({plain}*)", 1), F.regexp_extract(glob, f"({plain}*)$", 1)
    between = F.regexp_extract(glob, "/([^*?/]+)/", 1)
    lanes = F.transform(F.sequence(F.lit(0), F.lit(_LANES - 1)), lambda n: _key("any", n.cast("string")))
    return (
        F.when(start == glob, F.array(_key("whole", glob))).when(F.contains(start, F.lit("/")), F.array(_key("folder", F.regexp_extract(start, "^(.*)/", 1))))
        .when(end != "", F.array(_key("end", end))).when(start != "", F.array(_key("start", start))).when(between != "", F.array(_key("between", between))).otherwise(lanes)
    )


def _path_keys(path: Column, lengths: dict[str, list[int]]) -> Column:
    """All keys that a path answers to; ends and starts only of the lengths that globs have."""
    parts = F.split(path, "/")
    folders = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda _, k: _key("folder", F.array_join(F.slice(parts, F.lit(1), k + 1), "/")))
    sizes = lambda kind: F.filter(F.lit(lengths.get(kind, [])).cast("array<int>"), lambda n: n <= F.length(path))
    ends = F.transform(sizes("end"), lambda n: _key("end", F.right(path, n)))
    starts = F.transform(sizes("start"), lambda n: _key("start", F.left(path, n)))
    lane = _key("any", F.pmod(F.xxhash64(path), F.lit(_LANES)).cast("string"))
    return F.concat(F.array(_key("whole", path), lane), folders, ends, starts, F.transform(F.array_distinct(parts), lambda p: _key("between", p)))


def matches(paths: DataFrame, globs: DataFrame, star_crosses: bool = False) -> DataFrame:
    """(path, glob): which paths (path) each glob (glob) matches, each pair once; nulls match nothing.

    One equality join for any number of globs. Only a glob that begins and ends with a wildcard and names no folder
    between two slashes is tried on every path.
    """
    keyed = globs.select("glob").distinct().withColumn("pattern", glob_column(F.col("glob"), star_crosses))
    keyed = keyed.select("glob", "pattern", F.inline(_glob_keys(F.col("glob"), star_crosses)))
    sizes = keyed.filter(F.col("kind").isin("end", "start")).groupBy("kind").agg(F.collect_set(F.length("value")).alias("sizes"))
    lengths = {r["kind"]: sorted(r["sizes"]) for r in sizes.collect()}  # two rows of as many numbers as there are lengths
    own = paths.select("path").distinct().select("path", F.inline(_path_keys(F.col("path"), lengths)))
    return own.join(keyed, ["kind", "value"]).filter(F.expr("kind = 'whole' or path rlike pattern")).select("path", "glob")
