"""Orders of callers, callees and candidates, and what is kept of them under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft import model


def _verified() -> Column:
    return F.coalesce(F.col("provenance") == model.VERIFIED, F.lit(False))


def rank_callers(edges: DataFrame, ties: list[str]) -> DataFrame:
    """Edges with depth, confidence, from_test and fan_in: verified ones, near ones, sure ones, tests, much used ones first."""
    return edges.orderBy(F.desc(_verified()), "depth", F.desc("confidence"), F.desc("from_test"), F.desc("fan_in"), *ties)


def rank_callees(edges: DataFrame, label: str, ties: list[str]) -> DataFrame:
    """Edges with depth and source_line: verified ones, near ones, then in the order in which they are called, by label."""
    return edges.orderBy(F.desc(_verified()), "depth", F.asc_nulls_last("source_line"), label, *ties)


def within_limit(edges: DataFrame, most: int, ties: list[str]) -> DataFrame:
    """The `most` edges that matter most (verified, sure, near), each with how many were dropped."""
    top = edges.orderBy(F.desc(_verified()), F.desc("confidence"), "depth", *ties).limit(most)
    total = edges.agg(F.count("*").alias("total"))  # one row
    return top.crossJoin(F.broadcast(total)).withColumn("dropped", F.greatest(F.col("total") - most, F.lit(0))).drop("total")


def probed(frame: DataFrame, order: list, limit: int) -> DataFrame:
    """The first rows, and on each whether there are more: one row beyond the limit tells, without a count."""
    some = frame.orderBy(*order).limit(limit + 1).withColumn("truncated", F.lit(True))
    return some.limit(limit).withColumn("truncated", F.lit(some.count() > limit))


def candidate_order() -> list:
    return [F.desc("confidence"), "file_path", "start_line", "id"]


_CODE = ["Function", "Method", "Class", "Interface", "Type", "Variable", "Test", "Route", "Entrypoint"]  # fixed


def search_page(nodes: DataFrame, limit: int) -> DataFrame:
    """The first candidates of a search: code before anything else; `floor` says that the page was full."""
    code = F.col("type").isin(_CODE)
    return probed(nodes, [F.desc(code), *candidate_order()], limit).withColumnRenamed("truncated", "floor")


def rank_and_cap(items: DataFrame, limit: int | None, ties: list[str]) -> DataFrame:
    """Items with changed_files, task_anchors, code_intel_confidence (high, medium, low) and recency, in that order of weight."""
    sure = F.when(F.col("code_intel_confidence") == "high", 3).when(F.col("code_intel_confidence") == "medium", 2).when(F.col("code_intel_confidence") == "low", 1).otherwise(0)
    weight = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    own = items.orderBy(F.desc(weight("changed_files")), F.desc(weight("task_anchors")), F.desc(sure), F.desc(weight("recency")), *ties)
    return own if limit is None else own.limit(limit)


def clamp_sections(sections: DataFrame, budget: int) -> DataFrame:
    """(place, section, text, how): sections (place, section, text, collapsed, kept) of one answer, made to fit a budget.

    From the last section backwards, those that aren't `kept` are collapsed, and if that isn't enough dropped,
    again from the last backwards. Sections of one answer: a few rows in one task.
    """
    from pyspark.sql import Window as W

    back = W.partitionBy().orderBy(F.desc("place"))
    free = ~F.col("kept")
    saved = F.when(free, F.greatest(F.length("text") - F.length("collapsed"), F.lit(0))).otherwise(0)
    total = F.sum(F.length("text")).over(W.partitionBy())
    folded = sections.withColumn("over", total - budget).withColumn("before", F.sum(saved).over(back) - saved)
    folded = folded.withColumn("fold", free & (F.col("over") > F.col("before"))).withColumn("text", F.when(F.col("fold"), F.col("collapsed")).otherwise(F.col("text")))
    size = F.when(free, F.length("text")).otherwise(0)
    over = F.sum(F.length("text")).over(W.partitionBy()) - budget
    dropped = folded.withColumn("over", over).withColumn("before", F.sum(size).over(back) - size).withColumn("drop", free & (F.col("over") > F.col("before")))
    how = F.when(F.col("fold"), "collapsed").otherwise("whole")
    return dropped.filter("not drop").select("place", "section", "text", how.alias("how"))
