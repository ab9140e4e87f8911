"""Counts, degrees, joins and ranked, capped lists over nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def capped(frame: DataFrame, order: list, limit: int) -> DataFrame:
    """The first rows with population and truncated: how many rows they were drawn from."""
    total = frame.agg(F.count("*").alias("population"))  # one row
    top = frame.orderBy(*order).limit(limit)
    return top.crossJoin(F.broadcast(total)).withColumn("truncated", F.col("population") > limit)


def by_keys(frame: DataFrame, **values) -> DataFrame:
    """The rows that equal every value that is given; a value of None asks for nothing."""
    for column, value in values.items():
        if value is not None:
            frame = frame.filter(F.col(column) == value)
    return frame


def of_ids(frame: DataFrame, ids: str, key: str = "id") -> DataFrame:
    """The rows whose key is in a JSON list of strings."""
    wanted = frame.sparkSession.range(1).select(F.explode(F.from_json(F.lit(ids), "array<string>")).alias(key))
    return frame.join(wanted, key, "left_semi")


def node_line(id_: Column, kind: Column, label: Column, path: Column, line: Column) -> Column:
    """One line of text for a node."""
    place = F.when(F.coalesce(path, F.lit("")).isin("", "external"), "external").otherwise(F.concat(path, F.lit(":"), F.coalesce(line, F.lit(0)).cast("string")))
    return F.concat_ws(" ", F.lit("NODE"), id_, F.lower(F.coalesce(kind, F.lit("unknown"))), label, place)


def edge_line(edges: DataFrame, compact: bool) -> Column:
    """One line of text for an edge (from_id, to_id, relation, source_file, source_line, confidence, provenance).

    The short form names the place first and the confidence only below 0.75. A verified edge is always marked.
    """
    col = lambda name: F.col(name)
    name = lambda end: F.coalesce(*[col(c) for c in (f"{end}_label", f"{end}_id") if c in edges.columns])
    place = F.concat(F.coalesce(col("source_file"), F.lit("?")), F.lit(":"), F.coalesce(col("source_line").cast("string"), F.lit("?")))
    sure = F.coalesce(col("confidence"), F.lit(1.0))
    said = F.concat(F.lit(" conf="), F.format_string("%.2f", sure))
    proof = F.coalesce(col("provenance"), F.lit("EXTRACTED"))
    mark = F.when(proof == "EXTRACTED", "").when(proof == "LSP_VERIFIED", " [lsp✓]").otherwise(F.concat(F.lit(" prov="), proof))
    if compact:
        return F.concat(place, F.lit(" "), name("from"), F.lit(" "), col("relation"), F.lit(" "), name("to"), F.when(sure < 0.75, said).otherwise(""), mark)
    return F.concat(F.lit("EDGE "), name("from"), F.lit("→"), name("to"), F.lit(" "), col("relation"), F.lit(" "), place, said, mark)


def top_per_group(frame: DataFrame, group: str, order: list, k: int) -> DataFrame:
    return frame.withColumn("rn", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("rn") <= k)


def degree(edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out, degree); a loop counts twice. One pass: each edge is unfolded into its two ends."""
    end = lambda column, i: F.struct(F.col(column).alias("id"), F.lit(i).alias("i"))
    ends = edges.select(F.inline(F.array(end("from_id", 0), end("to_id", 1))))
    counted = ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.count("*").alias("degree"))
    return counted.select("id", "fan_in", (F.col("degree") - F.col("fan_in")).alias("fan_out"), "degree")


def distribution(frame: DataFrame, column: str, declared: list[str]) -> DataFrame:
    """(value, n, declared): declared values with their count, zeros too, and those that weren't declared."""
    vocabulary = frame.sparkSession.createDataFrame([(v, True) for v in declared], "value string, declared boolean")
    counted = frame.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return vocabulary.join(counted, "value", "full").select("value", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce("declared", F.lit(False)).alias("declared"))


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """Either end: two joins on equality and a union, not a disjunction."""
    out = edges.filter(F.col("from_id") == node).select(F.col("to_id").alias("id"), "relation", F.lit("out").alias("direction"))
    into = edges.filter(F.col("to_id") == node).select(F.col("from_id").alias("id"), "relation", F.lit("in").alias("direction"))
    return out.unionAll(into).filter(F.col("id") != node)


def merge_last(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Upsert: rows of new replace those of old with the same key."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def first_wins(frame: DataFrame, key: list[str], order: list) -> DataFrame:
    return frame.withColumn("rn", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("rn = 1").drop("rn")


def innermost(points: DataFrame, spans: DataFrame, key: str, width: int | None = None) -> DataFrame:
    """For each point (key, point_id, at) the span (key, span_id, first, last) around it that begins last, then ends first.

    With a width, spans are also met by the stretches of that length which they reach into, so that a
    point meets the spans of its stretch and not all of its key; take about the usual length of a span.
    """
    keys = [key]
    if width:
        points = points.withColumn("_stretch", F.floor(F.col("at") / width))
        spans = spans.withColumn("_stretch", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))))
        keys.append("_stretch")
    around = points.join(spans, keys).filter("at between first and last")
    return around.groupBy(key, "point_id").agg(F.max_by("span_id", F.struct(F.col("first"), -F.col("last"), -F.col("span_id"))).alias("span_id"))


def counted_with_samples(frame: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """(group, n, samples): the rows of each group, and its first k items joined by bars.

    The count and the k first are taken before the shuffle too, so a group of any size goes through.
    """
    first = top_per_group(frame.select(group, item), group, [item], k)
    samples = first.groupBy(group).agg(F.array_join(F.sort_array(F.collect_list(item)), "|").alias("samples"))  # k each
    return frame.groupBy(group).agg(F.count("*").alias("n")).join(samples, group)


def median_of_counts(frame: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median, newer): the upper median of each group and how many rows lie above it.

    Equal values are counted first: what a task sorts are the distinct values of a group.
    """
    counted = frame.groupBy(group, value).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.partitionBy(group).orderBy(value))
    ranked = counted.withColumn("upto", upto).withColumn("n", F.sum("c").over(W.partitionBy(group)))
    half = F.floor(F.col("n") / 2) + 1
    at = ranked.filter((F.col("upto") >= half) & (F.col("upto") - F.col("c") < half))
    return at.select(group, F.col(value).alias("median"), (F.col("n") - F.col("upto")).alias("newer"))


def with_reserve(main: DataFrame, extra: DataFrame, order: str, limit: int, reserved: int) -> DataFrame:
    """A page of main's first rows, in which up to `reserved` places go to extra's first rows."""
    page = extra.orderBy(order).limit(reserved).withColumn("p", F.lit(0)).unionByName(main.orderBy(order).limit(limit).withColumn("p", F.lit(1)))
    return page.orderBy("p", order).limit(limit).drop("p")
