"""Composite queries: the census, report, lookups and digests that clients ask for by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphweft import model
from graphweft.operators import relational as rel
from graphweft.operators import lineage, traverse
from graphweft.plans.base import in_list, query
from graphweft.sources import testgraph as tg


@query("select relation, provenance, count(*) as n from edges group by grouping sets ((relation), (provenance), (relation, provenance), ())")
def v5_census(spark, d):
    """Every distribution of the edges in one pass."""
    r, p = F.col("relation"), F.col("provenance")
    return tg.edges(spark, d).groupingSets([(r,), (p,), (r, p), ()], r, p).agg(F.count("*").alias("n"))


@query("select id, file_path, language from nodes where label = 'blue rod' order by file_path, id limit 5")
def k6_v19_lookup(spark, d):
    return tg.nodes(spark, d).filter("label = 'blue rod'").orderBy(F.desc("confidence"), "file_path", "id").select("id", "file_path", "language").limit(5)


@query(
    """, degrees as (select id, count(*) as degree from (select from_id as id from edges union all select to_id from edges) group by 1)
    select 'type' as section, type as key, count(*) as n from nodes group by 2 union all select 'relation', relation, count(*) from edges group by 2
    union all select 'hub', id, degree from (select id, degree from degrees order by degree desc, id limit 5)"""
)
def v20_report(spark, d):
    n, e = tg.nodes(spark, d), tg.edges(spark, d)
    types = n.groupBy(F.lit("type").alias("section"), F.col("type").alias("key")).agg(F.count("*").alias("n"))
    relations = e.groupBy(F.lit("relation").alias("section"), F.col("relation").alias("key")).agg(F.count("*").alias("n"))
    hubs = rel.degree(e).orderBy(F.desc("degree"), "id").limit(5).select(F.lit("hub").alias("section"), F.col("id").alias("key"), F.col("degree").alias("n"))
    return types.unionByName(relations).unionByName(hubs)


@query(
    """, own as (select id, language from nodes where label = 'blue rod'), inbound as (select to_id as id, count(*) as fan_in from edges where to_id in (select id from own) group by 1)
    select id, language, coalesce(fan_in, 0)::bigint as fan_in, (select count(*) from own) as population, (select count(*) from own) > 10 as truncated from own left join inbound using (id) order by fan_in desc, id limit 10"""
)
def v26_whereis(spark, d):
    own = tg.nodes(spark, d).filter("label = 'blue rod'").select("id", "language")
    wanted = tg.incoming(spark, d).join(own.select(F.col("id").alias("to_id")), "to_id", "left_semi").groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("fan_in"))
    found = own.join(wanted, "id", "left").select("id", "language", F.coalesce("fan_in", F.lit(0)).cast("bigint").alias("fan_in"))
    return rel.capped(found, [F.desc("fan_in"), "id"], 10)


@query(
    "select array_to_string(string_split(file_path, '/')[:2], '/') as folder, type, count(*) as n from nodes where file_path = 'ASIA' or starts_with(file_path, 'ASIA/') group by all"
)
def v27_module_tree(spark, d):
    own = tg.nodes(spark, d).filter("file_path = 'ASIA' or startswith(file_path, 'ASIA/')")
    return own.groupBy(F.substring_index("file_path", "/", 2).alias("folder"), "type").agg(F.count("*").alias("n"))


@query(
    """select 'out' as direction, relation, b.file_path as other, count(*) as n from edges join nodes a on from_id = a.id join nodes b on to_id = b.id where a.file_path = 'orders/f1.py' and b.file_path <> a.file_path group by all
    union all select 'in', relation, a.file_path, count(*) from edges join nodes a on from_id = a.id join nodes b on to_id = b.id where b.file_path = 'orders/f1.py' and b.file_path <> a.file_path group by all"""
)
def v28_file_digest(spark, d):
    n = tg.nodes(spark, d).select("id", "file_path")
    own = lineage.cut(n.filter("file_path = 'orders/f1.py'").select(F.col("id").alias("own_id")))  # its size is known then
    others = n.filter("file_path <> 'orders/f1.py'").select(F.col("id").alias("other_id"), F.col("file_path").alias("other"))

    def side(direction: str, edges, here: str, there: str):
        met = edges.join(own, F.col(here) == F.col("own_id"), "left_semi")
        return met.groupBy(F.lit(direction).alias("direction"), "relation", F.col(there).alias("other_id")).agg(F.count("*").alias("n"))

    met = lineage.cut(side("out", tg.edges(spark, d), "from_id", "to_id").unionByName(side("in", tg.incoming(spark, d), "to_id", "from_id")))
    return met.join(others, "other_id").groupBy("direction", "relation", "other").agg(F.sum("n").alias("n"))


@query(
    """select file, count(distinct (from_id, to_id, relation)) as degree from (select a.file_path as file, e.* from edges e join nodes a on from_id = a.id
    union all select b.file_path, e.* from edges e join nodes b on to_id = b.id) where file <> '' group by 1 order by degree desc, file limit 20"""
)
def j6_v31_hot_files(spark, d):
    """An edge inside a file counts once: of the two ends' files the second counts only if it differs."""
    n = tg.nodes(spark, d).select("id", "file_path")
    a, b = (n.select(F.col("id").alias(f"{k}_id"), F.col("file_path").alias(f"{k}_file")) for k in ("from", "to"))
    ends = tg.edges(spark, d).select("from_id", "to_id").join(a, "from_id", "left").join(b, "to_id", "left")
    second = F.when(~F.col("to_file").eqNullSafe(F.col("from_file")), F.col("to_file"))
    files = ends.select(F.explode(F.array("from_file", second)).alias("file")).filter("file <> ''")
    return files.groupBy("file").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "file").limit(20)


@query(
    """select relation, count(*) filter (to_id = 'P1') as incoming, count(*) filter (from_id = 'P1') as outgoing, bool_or(provenance = 'LSP_VERIFIED') as verified
    from edges where to_id = 'P1' or from_id = 'P1' group by 1"""
)
def v33_preflight(spark, d):
    e = tg.edges(spark, d).filter("to_id = 'P1' or from_id = 'P1'")
    return e.groupBy("relation").agg(
        F.count_if(F.col("to_id") == "P1").alias("incoming"), F.count_if(F.col("from_id") == "P1").alias("outgoing"), F.bool_or(F.col("provenance") == model.VERIFIED).alias("verified")
    )


@query(
    f""", walk(id, depth) as (select 'P1', 0 union select e.from_id, w.depth + 1 from walk w join edges e on e.to_id = w.id where w.depth < 2 and e.relation in {in_list(model.CALL)}),
    hits as (select e.from_id, e.to_id, e.relation, min(w.depth + 1)::int as depth from walk w join edges e on e.to_id = w.id where e.relation in {in_list(model.CALL)} and w.depth < 2 group by all)
    select from_id, label, to_id, relation, depth from hits join nodes on from_id = id order by depth, from_id, to_id, relation limit 100"""
)
def t1_v34_callers(spark, d):
    hits = traverse.reach(tg.incoming(spark, d), ["P1"], model.CALL, 2).select("from_id", "to_id", "relation", "depth")
    top = hits.orderBy("depth", "from_id", "to_id", "relation").limit(100)  # each edge has its node: the cap comes first
    return top.join(tg.nodes(spark, d).select("id", "label"), F.col("from_id") == F.col("id")).select("from_id", "label", "to_id", "relation", "depth")
