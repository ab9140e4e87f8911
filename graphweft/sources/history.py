"""What a version control prints, as tables: files, log, changes between commits, working tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _path(text):
    """A path as printed: quoted ones without quotes, slashes forward."""
    return F.translate(F.regexp_replace(text, '^"|"$', ""), "\\", "/")


def listed(lines: DataFrame) -> DataFrame:
    """(file_path) of lines (value) that name a file each."""
    return lines.select(_path(F.trim("value")).alias("file_path")).filter("file_path <> ''").distinct()


def log(text: DataFrame) -> DataFrame:
    """(commit, time, author, subject, file_path) of a log (value) printed as `%x01%H%x02%ct%x02%an%x02%s` and the names of files.

    Commits are the parts between marks, so that the order of lines within a part is kept; a commit without files has a null path.
    """
    commits = text.select(F.explode(F.split("value", "\u0001")).alias("c")).filter(F.trim("c") != "")
    lines = F.split("c", "\n")
    head = F.split(F.get(lines, F.lit(0)), "\u0002")
    files = F.filter(F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: _path(F.trim(x))), lambda x: x != "")
    part = lambda k: F.get(head, F.lit(k))
    return commits.select(part(0).alias("commit"), F.timestamp_seconds(part(1).cast("bigint")).alias("time"), part(2).alias("author"), part(3).alias("subject"), F.explode_outer(files).alias("file_path"))


def changed(lines: DataFrame) -> DataFrame:
    """(status, file_path, old_path) of lines (value) of names with their status; a renamed file has its old path."""
    part = F.split("value", "\t")
    old = F.when(F.size(part) > 2, _path(F.get(part, F.lit(1))))
    return lines.filter(F.size(part) > 1).select(F.substring("value", 1, 1).alias("status"), _path(F.element_at(part, -1)).alias("file_path"), old.alias("old_path"))


def working_tree(lines: DataFrame) -> DataFrame:
    """(file_path, staged, untracked) of the short status lines (value)."""
    path = F.regexp_replace(F.substring(F.col("value"), 4, 1 << 20), "^.* -> ", "")
    own = lines.filter(F.length("value") > 3)
    return own.select(_path(path).alias("file_path"), (~F.substring("value", 1, 1).isin(" ", "?")).alias("staged"), F.col("value").startswith("??").alias("untracked"))


def removed_and_added(diff: DataFrame) -> DataFrame:
    """(file, line): the changed lines of a unified diff (value, one text for each diff), with their file and sign."""
    files = diff.select(F.explode(F.split("value", r"(?m)^diff --git ")).alias("part")).filter("part <> ''")
    name = F.regexp_extract("part", r"(?m)^\+\+\+ b/(.*)$", 1)
    old = F.regexp_extract("part", r"(?m)^--- a/(.*)$", 1)
    lines = files.select(F.coalesce(F.nullif(name, F.lit("")), old).alias("file"), F.explode(F.split("part", "\n")).alias("line"))
    return lines.filter(F.col("line").rlike(r"^[+-](?!\+\+ |-- )"))
