"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.llm.common import materialise, materialise_last, scratch_mark


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (u, v); component is the smallest node reachable.

    Each round points every node to the smallest node that it or its neighbours know, larger
    neighbours first, and is written to the shared folder; the rounds needed grow with the
    logarithm of the longest chain. Minima are combined before the shuffle, and the joins back
    are plain sort-merge joins, which Spark splits where one hub has most of the links.
    No links give an empty frame.
    """
    mark = scratch_mark()
    now = materialise(
        spark,
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "links",
    )
    before = _signature(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(spark, large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise_last(spark, small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star", mark)
        after = _signature(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
