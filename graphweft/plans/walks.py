"""Queries for paths, trees and inheritance."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphweft import model
from graphweft.operators import paths
from graphweft.plans.base import in_list, query
from graphweft.sources import testgraph as tg

_ROUTE = ["CONTAINS", "CALLS", "REFERENCES", "IMPORTS"]


def _path_sql(start: str, end: str, own: str, most: int) -> str:
    """own is a relation (a, b, relation, rank)."""
    return f"""own as ({own}), walk(id, d) as (select '{start}', 0 union select b, d + 1 from walk join own on a = id where d < {most}),
    dist as (select id, min(d) as d from walk group by 1),
    par as (select b as id, arg_min({{'a': a, 'r': relation}}, (rank, a)) as via from own join dist x on x.id = a join dist y on y.id = b and y.d = x.d + 1 group by 1),
    way(id, d) as (select id, d from dist where id = '{end}' union all select par.via.a, d - 1 from way join par using (id) where d > 0)
    select d::int as hop, par.via.a as from_id, way.id as to_id, par.via.r as relation from way join par using (id) where d > 0"""


def _or_none(spark, path):
    """The path; no row where there is none."""
    return spark.createDataFrame([], "hop int, from_id string, to_id string, relation string") if path is None else path


_RANKS = " ".join(f"when '{r}' then {k}" for k, r in enumerate(_ROUTE, 1))


@query(", " + _path_sql("R0", "P5", f"select from_id as a, to_id as b, relation, case relation {_RANKS} end as rank from edges where relation in {in_list(_ROUTE)}", 6))
def t9_a14_v39_shortest_path(spark, d):
    return _or_none(spark, paths.shortest_path(tg.edges(spark, d), "R0", "P5", _ROUTE, 6, tg.incoming(spark, d)))


@query(", " + _path_sql("P1", "P2", "select from_id as a, to_id as b, relation, 1 as rank from edges where relation = 'REFERENCES' union all select to_id, from_id, relation, 1 from edges where relation = 'REFERENCES'", 6))
def t11_undirected_path(spark, d):
    return _or_none(spark, paths.shortest_path(paths.both_ways(tg.edges(spark, d)), "P1", "P2", ["REFERENCES"], 6))


@query(
    """, f as (select id, file_path, (substr(id, 2)::bigint % 40 > 0)::int as body from nodes where type = 'Function'), a as (select * from f where starts_with(id, 'O1') order by id limit 50), b as (select * from f where starts_with(id, 'O2') order by id limit 50),
    x as (select from_id as id, least(count(*), 3) as o from edges where from_id in (select id from a) group by 1)
    select a.id as from_id, b.id as to_id, (2 + 3 * a.body + b.body + coalesce(o, 0))::int as score from a cross join b left join x on x.id = a.id order by score desc, a.id, b.id limit 1"""
)
def t10_best_pair(spark, d):
    f = tg.nodes(spark, d).filter("type = 'Function'")
    return paths.best_pair(f.filter("startswith(id, 'O1')"), f.filter("startswith(id, 'O2')"), tg.edges(spark, d), "OVERRIDDEN_BY")


_TREE = ["CALLS", "REFERENCES", "USES_TYPE", "IMPORTS"]


def _tree_sql(depth: int, width: int, start: str = "C1", incoming: bool = False) -> str:
    here, there = ("to_id", "from_id") if incoming else ("from_id", "to_id")
    levels = [f"own as (select {here} as a, {there} as b, relation, confidence from edges where relation in {in_list(_TREE)})", f"p0 as (select ['{start}'] as path, [1::bigint] as ranks, false as looped)"]
    for k in range(1, depth + 1):
        levels.append(
            f"""p{k} as (select list_append(path, b) as path, list_append(ranks, rn) as ranks, list_contains(path, b) as looped from (select path, ranks, b, row_number() over (partition by path order by confidence desc, b, relation) as rn
            from p{k - 1} join own on path[-1] = a where not looped) where rn <= {width})"""
        )
    return ", " + ", ".join(levels) + ", tree as (" + " union all ".join(f"select * from p{k}" for k in range(depth + 1)) + ") "


@query(_tree_sql(3, 4) + "select array_to_string(path, '>') as path, array_to_string(ranks, '>') as ranks, looped from tree")
def t7_t16_ranked_tree(spark, d):
    tree = paths.ranked_tree(tg.edges(spark, d), ["C1"], _TREE, 3, 4)
    return tree.select(F.array_join("path", ">").alias("path"), F.array_join(F.col("ranks").cast("array<string>"), ">").alias("ranks"), "looped")


@query(_tree_sql(2, 3, "P1", True) + "select array_to_string(path, '>') as path, looped from tree order by len(path), ranks, path limit 9")
def t16_v14_hierarchy_with_a_total(spark, d):
    tree = paths.ranked_tree(tg.incoming(spark, d), ["P1"], _TREE, 2, 3, incoming=True, total=9)
    return tree.select(F.array_join("path", ">").alias("path"), "looped")


@query(
    _tree_sql(3, 4)
    + """, gone as (select distinct c.path from tree c join tree e on len(c.path) > 1 and len(e.path) > len(c.path) and e.path[:len(c.path) - 1] = c.path[:-2] and e.path[-1] = c.path[-1] and e.ranks[len(c.path)] < c.ranks[-1])
    select array_to_string(path, '>') as path from tree t where not exists (select 1 from gone g where t.path[:len(g.path)] = g.path)"""
)
def t8_without_shadowed(spark, d):
    tree = paths.ranked_tree(tg.edges(spark, d), ["C1"], _TREE, 3, 4)
    return paths.without_shadowed(tree).select(F.array_join("path", ">").alias("path"))


@query(_tree_sql(3, 4) + "select path[1] as start, array_to_string(arg_min(path, (-len(path), ranks, path)), '>') as chain from tree where len(path) >= 2 and not looped group by 1")
def t19_deepest_chain(spark, d):
    tree = paths.ranked_tree(tg.edges(spark, d), ["C1"], _TREE, 3, 4)
    return paths.deepest_chains(tree).select("start", F.array_join("chain", ">").alias("chain"))


_BASES = ", up(node, base, depth) as (select node, node, 0 from (select src as node from trade union select dst from trade) union select node, dst, depth + 1 from up join trade on base = src where depth < 5), bases as (select node, base, min(depth)::int as depth from up group by 1, 2) "


@query(_BASES + "select * from bases")
def t14_transitive_bases(spark, d):
    return paths.ancestors(tg.trade(spark, d), 5)


_MEMBERS = "(select distinct c_nationkey as base, c_mktsegment as label from customer where c_acctbal > 8000)"


@query(_BASES + f"select node, label, arg_min(base, (depth, base)) as base, min(depth) as depth from bases join {_MEMBERS} using (base) group by 1, 2")
def t15_inherited_members(spark, d):
    members = tg.table(spark, d, "customer").filter("c_acctbal > 8000").selectExpr("c_nationkey as base", "c_mktsegment as label")
    return paths.inherited_members(paths.ancestors(tg.trade(spark, d), 5), members)


@query(
    _BASES
    + """, methods as (select distinct c_nationkey || ':' || c_mktsegment as id, c_nationkey as class, c_mktsegment as key from customer where c_acctbal > 7000),
    near as (select m.id, arg_min(o.id, (b.depth, b.base, o.id)) as base_method from methods m join bases b on b.node = m.class and b.depth > 0 join methods o on o.class = b.base and o.key = m.key group by 1)
    select base_method, id as method from near qualify row_number() over (partition by base_method order by id) <= 50"""
)
def j10_a11_overrides(spark, d):
    methods = tg.table(spark, d, "customer").filter("c_acctbal > 7000").selectExpr("concat(c_nationkey, ':', c_mktsegment) as id", "c_nationkey as class", "c_mktsegment as key").distinct()
    return paths.overrides(methods, paths.ancestors(tg.trade(spark, d), 5))


_WALK = f", walk(id, depth) as (select 'P1', 0 union select e.from_id, w.depth + 1 from walk w join edges e on e.to_id = w.id where w.depth < 2 and e.relation in {in_list(model.IMPACT)}), met as (select id, min(depth)::int as depth from walk where id <> 'P1' group by 1) "


@query(_WALK + "select id, depth, (select count(*) from met) > 40 as truncated from met order by depth, id limit 40")
def t4_impact_set_with_cap(spark, d):
    return paths.impact_set(tg.incoming(spark, d), "P1", model.IMPACT, 2, 40)


@query(
    """, targets as (select 'N3' as id union select to_id from edges where from_id = 'N3' and relation = 'CONTAINS')
    select from_id, count(*) as fan_in, arg_max(source_line, (confidence, -source_line)) as source_line from edges join targets on to_id = id where relation in ('CALLS', 'REFERENCES', 'CONTAINS', 'USES_TYPE') group by 1"""
)
def t5_t6_g24_rolled_up(spark, d):
    return paths.rolled_up(tg.edges(spark, d), tg.nodes(spark, d), "N3", ["CALLS", "REFERENCES", "CONTAINS", "USES_TYPE"])


@query(
    """, changed as (select 'orders/f' || k || '.py' as file from range(1, 4) t(k)), own as (select id from nodes where file_path in (select file from changed))
    select file from changed union select n.file_path from edges join own on to_id = own.id join nodes n on n.id = from_id where n.file_path <> ''"""
)
def t18_affected_files(spark, d):
    n, changed = tg.nodes(spark, d).select("id", "file_path"), spark.range(1, 4).selectExpr("concat('orders/f', id, '.py') as file")
    own = n.join(changed, F.col("file_path") == F.col("file"), "left_semi").select(F.col("id").alias("to_id"))
    sources = tg.incoming(spark, d).join(own, "to_id", "left_semi").select(F.col("from_id").alias("id")).distinct()
    near = n.join(sources, "id", "left_semi").filter("file_path <> ''").select(F.col("file_path").alias("file"))
    return changed.union(near).distinct()


@query(", up(node, depth) as (select 3, 0 union select dst, depth + 1 from up join trade on node = src where depth < 10) select node::int as node, min(depth)::int as depth from up group by 1")
def t13_dependency_closure(spark, d):
    from graphweft.operators.traverse import shortest_hops

    return shortest_hops(tg.trade(spark, d), 3, 10).select("node", F.col("hops").alias("depth"))


@query(
    """select from_id, to_id, e.provenance, source_line from edges e join nodes on to_id = id where from_id in ('O1', 'O2', 'C3') order by (e.provenance = 'LSP_VERIFIED') desc, source_line, label, from_id, to_id limit 10"""
)
def k2_ranked_callees(spark, d):
    from graphweft.operators.ranking import rank_callees

    e = tg.edges(spark, d).filter("from_id in ('O1', 'O2', 'C3')").join(tg.nodes(spark, d).select(F.col("id").alias("to_id"), "label"), "to_id")
    return rank_callees(e.withColumn("depth", F.lit(1)), "label", ["from_id", "to_id"]).select("from_id", "to_id", "provenance", "source_line").limit(10)
