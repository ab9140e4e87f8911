"""Queries that walk the graph: roll-ups, path trees, components, bridges."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphweft.functions import scalars
from graphweft.operators import algorithms, lineage, traverse
from graphweft.plans.base import query
from graphweft.sources import testgraph as tg


@query(
    """, targets as (select 'N3' as id union select to_id from edges where from_id = 'N3' and relation = 'CONTAINS')
    select from_id, count(*) as fan_in, arg_max(source_line, (confidence, -source_line)) as line from edges join targets on to_id = id group by 1"""
)
def rolled_up_with_a_class(spark, d):
    e = tg.edges(spark, d)
    held = e.filter("from_id = 'N3' and relation = 'CONTAINS'").select(F.col("to_id").alias("id"))
    targets = lineage.cut(held.union(spark.range(1).select(F.lit("N3"))).distinct())  # its size is known then: edges are shuffled only if it is large
    into = tg.incoming(spark, d).join(targets, F.col("to_id") == F.col("id"))
    return into.groupBy("from_id").agg(F.count("*").alias("fan_in"), F.max_by("source_line", F.struct("confidence", -F.col("source_line"))).alias("line"))


def _tree_sql(depth: int, width: int) -> str:
    levels = ["own as (select * from edges where relation in ('CALLS', 'REFERENCES', 'IMPORTS', 'USES_TYPE'))", "p0 as (select ['C1'] as path, 'C1' as last)"]
    for k in range(1, depth + 1):
        levels.append(
            f"""p{k} as (select list_append(path, to_id) as path, to_id as last from (select path, to_id, row_number() over (partition by path order by confidence desc, to_id, relation) as rn
            from p{k - 1} join own on last = from_id where not list_contains(path, to_id)) where rn <= {width})"""
        )
    return ", " + ", ".join(levels) + " " + " union all ".join(f"select {k}::int as depth, array_to_string(path, '>') as path from p{k}" for k in range(1, depth + 1))


@query(_tree_sql(3, 3))
def t7_w8_path_tree(spark, d):
    return algorithms.path_tree(tg.edges(spark, d), "C1", ["CALLS", "REFERENCES", "IMPORTS", "USES_TYPE"], 3, 3)


@query(
    """, both_ways as (select src, dst from trade union select dst, src from trade), walk(node, hops) as (select 0, 0 union select dst, hops + 1 from walk join both_ways on src = node where hops < 6)
    select node::int as node, min(hops)::int as hops from walk group by 1"""
)
def undirected_hops(spark, d):
    t = tg.trade(spark, d).select("src", "dst")
    return traverse.shortest_hops(t.union(t.select("dst", "src")).distinct(), 0, 6)


@query(
    """, walk(node, hops) as (select 9, 0 union select src, hops + 1 from walk join trade on dst = node where hops < 4), first as (select node, min(hops) as hops from walk group by 1)
    select hops::int as depth, count(*) as n, not exists (select 1 from first where hops = 4) as terminated from first where hops between 1 and 3 group by hops"""
)
def t12_transitive_importers(spark, d):
    back = tg.trade(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    first = traverse.shortest_hops(back, 9, 4).filter("hops > 0").groupBy(F.col("hops").alias("depth")).agg(F.count("*").alias("n"))
    beyond = first.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("deepest"))  # one row
    return first.crossJoin(F.broadcast(beyond)).filter("depth <= 3").select("depth", "n", (F.col("deepest") < 4).alias("terminated"))


@query("select a.src, a.dst from trade a join trade b on a.src = b.dst and a.dst = b.src where a.src < a.dst")
def t13_cycle_pairs(spark, d):
    t = tg.trade(spark, d).select("src", "dst")
    return t.filter("src < dst").join(t.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")


@query(
    """, reach(a, b) as (select src, dst from trade union select a, dst from reach join trade on b = src), ends as (select src as node from trade union select dst from trade)
    select node, least(node, coalesce(min(x.b), node)) as component from ends left join (select r.a, r.b from reach r join reach q on r.a = q.b and r.b = q.a) x on node = x.a group by node"""
)
def a6_strong_components(spark, d):
    return algorithms.strong_components(tg.trade(spark, d))


@query(
    "select n_nationkey as id, array_to_string(list_concat(l[i:], l[:i - 1]), '>') as cycle from (select n_nationkey, l, list_position(l, list_min(l)) as i from (select n_nationkey, [n_nationkey + 3, n_nationkey * 7 % 25, n_nationkey * 11 % 26] as l from nation))",
    graph=False,
)
def a7_rotation(spark, d):
    n = tg.table(spark, d, "nation").selectExpr("n_nationkey as id", "array(n_nationkey + 3, n_nationkey * 7 % 25, n_nationkey * 11 % 26) as l")
    return n.select("id", F.array_join(scalars.rotate_to_least(F.col("l")).cast("array<string>"), ">").alias("cycle"))


@query(
    """, bw as (select src, dst from trade union select dst, src from trade), walk(s, v, d) as (select distinct src, src, 0 from bw union all select s, dst, d + 1 from walk join bw on src = v where d < 5),
    first as (select s, v, min(d) as d from walk group by 1, 2), r as (select s, v, w.d as d, count(*) as paths from walk w join first using (s, v) where w.d = first.d group by 1, 2, 3)
    select least(e.src, e.dst) as a, greatest(e.src, e.dst) as b, round(sum(x.paths * y.paths * 1.0::double / z.paths) / 2, 4) as betweenness
    from bw e join r x on x.v = e.src join r y on y.s = e.dst join r z on z.s = x.s and z.v = y.v and z.d = x.d + 1 + y.d group by 1, 2"""
)
def a8_bridges(spark, d):
    return algorithms.edge_betweenness(tg.trade(spark, d), 5)


@query(", ends as (select to_id as id from edges where from_id = 'N3' union select from_id from edges where to_id = 'N3') select id, label from ends join nodes using (id)")
def u2_undirected_neighbours(spark, d):
    e = tg.edges(spark, d)
    ends = e.filter("from_id = 'N3'").select(F.col("to_id").alias("id")).union(e.filter("to_id = 'N3'").select("from_id")).distinct()
    return tg.nodes(spark, d).select("id", "label").join(ends, "id", "left_semi")


@query("select split_part(file_path, '/', 1) as top, relation, count(*) as n, count(distinct from_id) as sources from edges join nodes on from_id = id where relation = 'CALLS' group by all")
def callers_by_top_folder(spark, d):
    n = tg.nodes(spark, d).select("id", F.substring_index("file_path", "/", 1).alias("top"))
    e = tg.edges(spark, d).filter("relation = 'CALLS'").join(n, F.col("from_id") == F.col("id"))
    return e.groupBy("top", "relation").agg(F.count("*").alias("n"), F.countDistinct("from_id").alias("sources"))
