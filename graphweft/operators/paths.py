"""Paths and trees: the shortest path with its edges, endpoint pairs, pruned trees, chains, inherited members."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphweft.functions import paths as file_paths
from graphweft.operators.arguments import hops_of
from graphweft.operators.lineage import cut

_PATH = "hop int, from_id string, to_id string, relation string"

#: So many nodes of a level are counted first and then named in a filter that reaches the scan.
NAMED = 256


def _counted(frame: DataFrame) -> tuple[DataFrame, int, bool]:
    """The frame, written; its rows; whether any of them is `met`. Counted while it is written."""
    seen = Observation()
    level = cut(frame.observe(seen, F.count("*").alias("n"), F.max("met").alias("met")))
    return level, seen.get["n"], bool(seen.get["met"])


def shortest_path(edges: DataFrame, start: str, end: str, relations: list[str], most: int, incoming: DataFrame | None = None) -> DataFrame | None:
    """(hop, from_id, to_id, relation) of a shortest path over edges of the relations; None if there is none.

    Relations are in order of preference, bridges last: of the edges by which a node is first reached, that
    of the first relation and the least source is taken. A path to the start itself is empty, and one has `most`
    (1 to 15) edges at most. Two searches go from both ends, the one with fewer nodes on its edge a hop further,
    until they meet; each hop is one write of the nodes that it reaches first. `incoming` are the same edges as
    kept by their ends, for the search from the end. Up to NAMED nodes are named to the scan, which then skips
    ranges of the stored edges; more are joined. The way is read by joins of one row.
    """
    spark = edges.sparkSession
    if start == end:
        return spark.createDataFrame([], _PATH)
    rank = F.array_position(F.lit(relations), F.col("relation"))

    def own(frame: DataFrame) -> DataFrame:
        return frame.filter(F.col("relation").isin(relations)).select("from_id", "to_id", F.struct(rank.alias("rank"), "from_id", "relation").alias("via"))

    def hop(source: DataFrame, near: str, far: str, last: DataFrame, n: int | None = None) -> DataFrame:
        """(node, via): what one more edge reaches from the n nodes of `last`."""
        if n is not None and n <= NAMED:
            left = source.filter(F.col(near).isin([r.node for r in last.select("node").collect()]))
        else:
            left = source.join(last.select(F.col("node").alias(near)), near, "left_semi")
        return left.groupBy(F.col(far).alias("node")).agg(F.min("via").alias("via"))

    out, into = own(edges), own(edges if incoming is None else incoming)
    first = lambda node: spark.range(1).select(F.lit(node).alias("node"))
    ahead, behind = [first(start)], [first(end)]
    n_ahead = n_behind = 1
    met = False
    while not met:
        if len(ahead) + len(behind) - 2 == hops_of(most):
            return None
        forward = n_ahead <= n_behind
        levels, others = (ahead, behind) if forward else (behind, ahead)
        found = hop(out, "from_id", "to_id", levels[-1], n_ahead) if forward else hop(into, "to_id", "from_id", levels[-1], n_behind)
        known = reduce(DataFrame.unionByName, [x.select("node") for x in levels])
        found = found.join(known, "node", "left_anti").join(others[-1].select("node", F.lit(1).alias("met")), "node", "left")
        level, n, met = _counted(found)
        if n == 0:
            return None
        levels.append(level)
        n_ahead, n_behind = (n, n_behind) if forward else (n_ahead, n)
    ahead[-1] = ahead[-1].join(behind[-1].select("node"), "node", "left_semi")
    for level in behind[-2::-1]:  # from where they met to the end, among nodes that lie on shortest paths alone
        ahead.append(cut(hop(out, "from_id", "to_id", ahead[-1]).join(level.select("node"), "node", "left_semi")))
    way = first(end).withColumn("steps", F.array().cast("array<struct<hop:int,from_id:string,to_id:string,relation:string>>"))
    for number in range(len(ahead) - 1, 0, -1):
        step = F.struct(F.lit(number).alias("hop"), F.col("via.from_id").alias("from_id"), F.col("node").alias("to_id"), F.col("via.relation").alias("relation"))
        way = ahead[number].join(F.broadcast(way), "node").select(F.col("via.from_id").alias("node"), F.concat(F.array(step), "steps").alias("steps"))  # one row
    return way.select(F.inline("steps")).orderBy("hop")


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse, for undirected paths."""
    return edges.select("from_id", "to_id", "relation").unionByName(edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "relation"))


def best_pair(starts: DataFrame, ends: DataFrame, edges: DataFrame, bridge: str, most: int = 50) -> DataFrame:
    """(from_id, to_id, score): the pair of candidates (id, file_path, start_line, end_line) that a path most likely means.

    Shared folders, bodies and outgoing edges count for a pair, foreign folders against it, a direct edge
    most of all. The first `most` candidates by id of each side are tried, so that at most their square of pairs are.
    """

    def side(frame: DataFrame, name: str) -> DataFrame:
        body = (F.col("end_line") > F.col("start_line")).cast("int").alias("body")
        return frame.select("id", F.struct("file_path", file_paths.foreign_penalty(F.col("file_path")).alias("loss"), body).alias(name)).orderBy("id").limit(most).withColumnRenamed("id", f"{name}_id")

    a, b = side(starts, "a"), side(ends, "b")
    out = edges.join(F.broadcast(a.select(F.col("a_id").alias("from_id"))), "from_id", "left_semi")  # 50 rows at most
    degree = out.groupBy(F.col("from_id").alias("a_id")).agg(F.count("*").alias("out"))
    direct = out.join(F.broadcast(b.select(F.col("b_id").alias("to_id"))), "to_id", "left_semi").groupBy(F.col("from_id").alias("a_id"), F.col("to_id").alias("b_id")).agg(F.max(F.when(F.col("relation") == bridge, 8).otherwise(5)).alias("direct"))
    pairs = a.crossJoin(F.broadcast(b)).join(degree, "a_id", "left").join(direct, ["a_id", "b_id"], "left")
    score = 2 * file_paths.shared_folders(F.col("a.file_path"), F.col("b.file_path")) - F.col("a.loss") - F.col("b.loss") + 3 * F.col("a.body") + F.col("b.body")
    score = score + F.least(F.coalesce("out", F.lit(0)), F.lit(3)) + F.coalesce("direct", F.lit(0))
    scored = pairs.select(F.col("a_id").alias("from_id"), F.col("b_id").alias("to_id"), score.cast("int").alias("score")).filter("from_id <> to_id")
    return scored.orderBy(F.desc("score"), "from_id", "to_id").limit(1)


def without_shadowed(tree: DataFrame) -> DataFrame:
    """A tree (path array<string>, ranks array<int>) without the children that stand deeper under an earlier sibling.

    ranks are the places of a path's nodes among their siblings. A child goes with all that is under it.
    """
    at = tree.select("path", "ranks", F.size("path").alias("n"))
    child = at.filter("n > 1").select(F.expr("slice(path, 1, n - 1)").alias("parent"), F.element_at("path", -1).alias("node"), F.element_at("ranks", -1).alias("rank"))
    places = F.transform(F.sequence(F.lit(1), F.col("n") - 2), lambda k: F.struct(F.slice("path", F.lit(1), k).alias("parent"), F.get("ranks", k).alias("above")))
    deeper = at.filter("n > 2").select(F.element_at("path", -1).alias("node"), F.inline(places))
    met = child.join(deeper, ["parent", "node"]).filter("above < rank")
    shadowed = met.select(F.concat("parent", F.array("node")).alias("gone")).distinct()
    prefixes = at.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.slice("path", F.lit(1), k))).alias("gone"))
    bad = prefixes.join(shadowed, "gone").select("path").distinct()
    return tree.join(bad, "path", "left_anti")


def ranked_tree(edges: DataFrame, starts: list[str], relations: list[str], depth: int, width: int, incoming: bool = False, total: int | None = None) -> DataFrame:
    """(path array<string>, ranks array<int>, looped): simple paths from each start, each node followed by its `width` surest edges.

    Edges rank by confidence, then by end and relation. A node that stands on its own path already ends it and
    is marked as looped. With a total, a level stops growing when so many rows are there; it is the callers'
    to say that more exist.
    """
    here, there = ("to_id", "from_id") if incoming else ("from_id", "to_id")
    own = edges.filter(F.col("relation").isin(relations)).select(F.col(here).alias("a"), F.col(there).alias("b"), "relation", "confidence")
    spark = edges.sparkSession
    level = spark.createDataFrame([([s], [1], False) for s in starts], "path array<string>, ranks array<int>, looped boolean")
    found = level
    surest = W.partitionBy("path").orderBy(F.desc("confidence"), "b", "relation")
    for _ in range(depth):
        step = level.filter("not looped").join(own, F.element_at("path", -1) == F.col("a")).withColumn("rn", F.row_number().over(surest)).filter(F.col("rn") <= width)
        grown = step.select(F.concat("path", F.array("b")).alias("path"), F.concat("ranks", F.array("rn")).alias("ranks"), F.array_contains("path", F.col("b")).alias("looped"))
        level = cut(grown)
        found = found.unionByName(level)
    return found if total is None else found.orderBy(F.size("path"), "ranks", "path").limit(total)


def deepest_chains(tree: DataFrame) -> DataFrame:
    """(start, chain): of each start's paths of two nodes or more the longest, the first by rank of equally long ones."""
    own = tree.filter((F.size("path") >= 2) & ~F.col("looped"))
    best = own.groupBy(F.col("path")[0].alias("start")).agg(F.min(F.struct((-F.size("path")).alias("n"), "ranks", "path")).alias("best"))
    return best.select("start", F.col("best.path").alias("chain"))


def ancestors(pairs: DataFrame, most: int = 5) -> DataFrame:
    """(node, base, depth): for (src, dst), the dst reached from each src in up to `most` steps, with the fewest steps.

    Each node is its own base at depth 0. The rows grow with the nodes times what each reaches.
    """
    pairs = cut(pairs.select("src", "dst").distinct())
    frontier = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct().select("node", F.col("node").alias("base"), F.lit(0).alias("depth"))
    found = frontier = cut(frontier)
    for depth in range(1, most + 1):
        step = frontier.join(pairs, F.col("base") == F.col("src")).select("node", F.col("dst").alias("base")).distinct()
        frontier = cut(step.join(found, ["node", "base"], "left_anti").withColumn("depth", F.lit(depth)))
        found = found.unionByName(frontier)
    return found


def inherited_members(bases: DataFrame, members: DataFrame) -> DataFrame:
    """(node, label, base, depth): for each node and label the nearest base, itself first, that holds a member (base, label)."""
    held = bases.join(members.select("base", "label").distinct(), "base")
    return held.groupBy("node", "label").agg(F.min(F.struct("depth", "base")).alias("best")).select("node", "label", "best.base", "best.depth")


def overrides(methods: DataFrame, bases: DataFrame, most: int = 50) -> DataFrame:
    """(base_method, method): for methods (id, class, key) the one of the nearest base with the same key.

    Of a base method at most `most` overriding ones are named, the first by id: a cap of the feature.
    """
    above = bases.filter("depth > 0").select(F.col("node").alias("class"), F.col("base").alias("base_class"), "depth")
    other = methods.select(F.col("id").alias("base_method"), F.col("class").alias("base_class"), "key")
    met = methods.join(above, "class").join(other, ["base_class", "key"])
    nearest = met.groupBy("id").agg(F.min(F.struct("depth", "base_class", "base_method")).alias("best")).select(F.col("best.base_method").alias("base_method"), F.col("id").alias("method"))
    return nearest.withColumn("rn", F.row_number().over(W.partitionBy("base_method").orderBy("method"))).filter(F.col("rn") <= most).drop("rn")


def impact_set(edges: DataFrame, start: str, relations: list[str], depth: int, cap: int) -> DataFrame:
    """(id, depth, truncated): the nodes that reach start, nearest first, at most `cap` of them; truncated says that there are more."""
    from graphweft.operators.traverse import reach

    met = reach(edges, [start], relations, depth).groupBy(F.col("from_id").alias("id")).agg(F.min("depth").alias("depth")).filter(F.col("id") != start)
    met = cut(met)
    return met.orderBy("depth", "id").limit(cap).withColumn("truncated", F.lit(met.count() > cap))


def rolled_up(edges: DataFrame, nodes: DataFrame, start: str, relations: list[str], holds: str = "CONTAINS") -> DataFrame:
    """(from_id, fan_in, source_line): who refers to a node or, if it is a class or module, to what it holds.

    A source that refers to several of them is one row, with the line of its surest edge.
    """
    held = edges.filter((F.col("from_id") == start) & (F.col("relation") == holds)).select(F.col("to_id").alias("id"))
    owner = nodes.filter((F.col("id") == start) & F.col("type").isin("Class", "Interface", "Module")).select(F.lit(1).alias("owner"))
    own = held.crossJoin(F.broadcast(owner)).select("id").unionByName(edges.sparkSession.createDataFrame([(start,)], "id string"))  # one row or none
    into = edges.filter(F.col("relation").isin(relations)).join(own.distinct(), F.col("to_id") == F.col("id"), "left_semi")
    line = F.max_by("source_line", F.struct("confidence", -F.col("source_line")))
    return into.groupBy("from_id").agg(F.count("*").alias("fan_in"), line.alias("source_line"))
