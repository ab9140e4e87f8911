"""Breadth-first traversals: one frontier of distinct nodes per hop, joined with the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.operators.arguments import depth_of
from graphweft.operators.lineage import cut


def reach(edges: DataFrame, seeds: list[str] | DataFrame, relations: list[str] | None, depth: int, incoming: bool = True) -> DataFrame:
    """Edges that lead to the seeds (or from them) within `depth` hops, each with its smallest depth.

    A node is in one frontier only, the first that meets it: cycles end, and each edge is found once. A hop's
    edges are written to the shared folder once; the next frontier is read from there, and is broadcast only
    if its size allows. Seeds in a list (a short one) are named in a filter that reaches the scan. The depth is held to 1 to 10.
    """
    depth = depth_of(depth)
    here, there = ("to_id", "from_id") if incoming else ("from_id", "to_id")
    own = edges.select("from_id", "to_id", "relation", *(["confidence", "provenance", "source_line"] if "confidence" in edges.columns else []))
    if relations is not None:
        own = own.filter(F.col("relation").isin(relations))
    named = None if isinstance(seeds, DataFrame) else list(dict.fromkeys(seeds))
    if named is not None:
        seeds = edges.sparkSession.range(1).select(F.explode(F.lit(named).cast("array<string>")).alias("node"))
    frontier = seen = seeds.select("node").distinct()
    found = None
    for hop in range(1, depth + 1):
        if hop == 1 and named is not None:
            step = own.filter(F.col(here).isin(named))
        else:
            step = own.join(frontier, own[here] == frontier["node"], "left_semi")
        step = step.withColumn("depth", F.lit(hop))
        if hop < depth:
            step = cut(step)
            frontier = step.select(F.col(there).alias("node")).distinct().join(seen, "node", "left_anti")
            if hop > 1 or depth > 2:
                frontier = cut(frontier)
            seen = seen.unionByName(frontier)
        found = step if found is None else found.unionByName(step)
    return found


def per_depth(edges: DataFrame, seeds: list[str], relations: list[str], depth: int, incoming: bool) -> DataFrame:
    """(depth, n): distinct nodes first met at each depth."""
    there = "from_id" if incoming else "to_id"
    first = reach(edges, seeds, relations, depth, incoming).groupBy(there).agg(F.min("depth").alias("depth"))
    return first.groupBy("depth").agg(F.count("*").alias("n"))


def shortest_hops(pairs: DataFrame, start: int, most: int) -> DataFrame:
    """(node, hops) over (src, dst), up to `most` hops from start."""
    pairs = cut(pairs.select("src", "dst").distinct())
    seen = pairs.sparkSession.createDataFrame([(start, 0)], "node int, hops int")
    frontier = seen
    for hop in range(1, most + 1):
        step = pairs.join(frontier, pairs.src == frontier.node).select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen


def simple_cycles(pairs: DataFrame, longest: int) -> DataFrame:
    """(length, path): cycles of up to `longest` nodes, each once, starting at its smallest node."""
    pairs = cut(pairs.filter("src <> dst").select("src", "dst").distinct())
    paths = pairs.filter("src < dst").select(F.array("src", "dst").alias("p"))
    found = None
    for length in range(2, longest + 1):
        closed = paths.join(pairs, (F.element_at("p", -1) == F.col("src")) & (F.col("p")[0] == F.col("dst"))).select(F.lit(length).alias("length"), F.array_join(F.col("p").cast("array<string>"), ">").alias("path"))
        found = closed if found is None else found.unionByName(closed)
        grown = paths.join(pairs, F.element_at("p", -1) == F.col("src"))
        paths = cut(grown.filter((F.col("dst") > F.col("p")[0]) & ~F.array_contains("p", F.col("dst"))).select(F.concat("p", F.array("dst")).alias("p")))
    return found
