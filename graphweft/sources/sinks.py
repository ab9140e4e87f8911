"""What leaves the engine: a canonical dump and its digest, manifests, and briefs as text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical_line(frame: DataFrame) -> Column:
    """A row as text: its columns by name, as JSON, nulls included."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(frame.columns)]), {"ignoreNullFields": "false"})


def digest(frame: DataFrame) -> DataFrame:
    """One row (n, digest): what a table holds, whatever the order of its rows; repeated rows count.

    The sum of the rows' hashes, so that it is combined before the shuffle and needs no sort.
    """
    part = F.conv(F.substring(F.sha2(canonical_line(frame), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return frame.agg(F.count("*").alias("n"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("digest"))


def dump(frame: DataFrame, path: str) -> None:
    """The table as sorted lines of text under path; the files in the order of their names are in order."""
    frame.select(canonical_line(frame).alias("value")).orderBy("value").write.text(path)


def _write(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    beside = jvm.org.apache.hadoop.fs.Path(path + ".new")
    out = system.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    system.delete(target, False)
    system.rename(beside, target)


def write_manifest(spark: SparkSession, path: str, facts: dict) -> None:
    """Facts on an index (commit, counts, versions) as one JSON file, its keys in order; readers see the old file or the new."""
    _write(spark, path, json.dumps(facts, sort_keys=True, indent=1) + "\n")


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The facts of a manifest; none if there is no such file."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return {}
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def brief(sections: DataFrame, title: str) -> str:
    """A text of sections (place, heading, line): a heading for each, its lines below. For the few lines of an answer."""
    out, now = [f"# {title}"], None
    for row in sections.orderBy("place", "heading", "line").collect():
        if row["heading"] != now:
            now = row["heading"]
            out += ["", f"## {now}"]
        out.append(f"- {row['line']}")
    return "\n".join(out) + "\n"


def write_brief(spark: SparkSession, path: str, sections: DataFrame, title: str) -> None:
    _write(spark, path, brief(sections, title))
