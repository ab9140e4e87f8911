"""All queries of the graph engine by name, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphweft import model
from graphweft.functions import scalars
from graphweft.operators import relational as rel
from graphweft.operators import search, traverse
from graphweft.plans import answers, closures, clusters, details, following, indexes, linking, marts, merges, naming, ranking, reading, verbs, walks  # noqa: F401  their queries register themselves
from graphweft.plans.base import QUERIES, SQL, in_list, query  # noqa: F401
from graphweft.sources import testgraph as tg


# Counts


@query("select (select count(*) from nodes) as n_nodes, (select count(*) from edges) as n_edges")
def g1_global_counts(spark, d):
    n = tg.nodes(spark, d).agg(F.count("*").alias("n_nodes"))
    return n.crossJoin(tg.edges(spark, d).agg(F.count("*").alias("n_edges")))


@query("select relation, provenance, count(*) as n from edges group by all")
def g2_relation_counts(spark, d):
    return tg.edges(spark, d).groupBy("relation", "provenance").agg(F.count("*").alias("n"))


_VALUES = ", ".join(f"('{r}')" for r in model.RELATIONS)


@query(f"select coalesce(v.r, e.relation) as value, count(e.relation) as n, v.r is not null as declared from (values {_VALUES}) v(r) full join edges e on v.r = e.relation group by all")
def g3_zero_filled_distribution(spark, d):
    return rel.distribution(tg.edges(spark, d), "relation", model.RELATIONS)


@query("select id, sum(i)::bigint as fan_in, sum(o)::bigint as fan_out, count(*) as degree from (select from_id as id, 0 as i, 1 as o from edges union all select to_id, 1, 0 from edges) group by id")
def g4_degree(spark, d):
    return rel.degree(tg.edges(spark, d))


@query(
    """select n.id, n.label, x.fan_in, x.fan_out from (select id, sum(i)::bigint as fan_in, sum(o)::bigint as fan_out from
    (select from_id as id, 0 as i, 1 as o from edges union all select to_id, 1, 0 from edges) group by id) x join nodes n using (id)
    where n.type not in ('Directory', 'Module') order by fan_in + fan_out desc, n.label, n.id limit 20"""
)
def g5_hotspots(spark, d):
    nodes = tg.nodes(spark, d).filter(~F.col("type").isin("Directory", "Module")).select("id", "label")
    return nodes.join(rel.degree(tg.edges(spark, d)), "id").orderBy(F.desc("degree"), "label", "id").select("id", "label", "fan_in", "fan_out").limit(20)


@query(
    """select to_id, sum(n)::bigint as n, sum(case when provenance = 'LSP_VERIFIED' then n else 0 end)::bigint as verified, max(sources) as source_floor from
    (select to_id, provenance, count(*) as n, count(distinct from_id) as sources from edges where relation = 'CALLS' group by all) group by to_id"""
)
def g6_inbound_evidence(spark, d):
    calls = tg.edges(spark, d).filter("relation = 'CALLS'").groupBy("to_id", "provenance").agg(F.count("*").alias("n"), F.countDistinct("from_id").alias("sources"))
    verified = F.sum(F.when(F.col("provenance") == model.VERIFIED, F.col("n")).otherwise(0))
    return calls.groupBy("to_id").agg(F.sum("n").alias("n"), verified.alias("verified"), F.max("sources").alias("source_floor"))


@query("select a.language as src, b.language as dst, count(*) as n from edges e join nodes a on e.from_id = a.id join nodes b on e.to_id = b.id where a.type <> b.type group by all")
def edges_between_languages(spark, d):
    nodes = tg.nodes(spark, d)
    ends = [nodes.select(F.col("id").alias(f"{k}_id"), F.col("language").alias(k), F.col("type").alias(f"{k}_type")) for k in ("src", "dst")]
    joined = tg.edges(spark, d).join(ends[0], F.col("from_id") == F.col("src_id")).join(ends[1], F.col("to_id") == F.col("dst_id"))
    return joined.filter("src_type <> dst_type").groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"select provenance, count(*) as n, round(100.0 * count(*) / (select count(*) from edges where relation in {in_list(model.CALL)}), 1)::double as pct from edges where relation in {in_list(model.CALL)} group by 1")
def g9_provenance_mix(spark, d):
    own = tg.edges(spark, d).filter(F.col("relation").isin(model.CALL)).groupBy("provenance").agg(F.count("*").alias("n"))
    return own.select("provenance", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()), 1).alias("pct"))  # a row a provenance


@query("select from_id, count(*) filter (relation = 'REFERENCES') as refs, count(*) filter (relation = 'USES_TYPE') as uses from edges where relation in ('REFERENCES', 'USES_TYPE') group by 1")
def g10_conditional_sums(spark, d):
    e = tg.edges(spark, d).filter(F.col("relation").isin("REFERENCES", "USES_TYPE"))
    return e.groupBy("from_id").agg(F.count_if(F.col("relation") == "REFERENCES").alias("refs"), F.count_if(F.col("relation") == "USES_TYPE").alias("uses"))


@query("select label, count(distinct language) as languages, string_agg(distinct language, ',' order by language) as names from nodes where type = 'Type' group by 1")
def g12_distinct_and_concat(spark, d):
    t = tg.nodes(spark, d).filter("type = 'Type'")
    return t.groupBy("label").agg(F.countDistinct("language").alias("languages"), F.array_join(F.sort_array(F.collect_set("language")), ",").alias("names"))


@query("select file_path, count(*) as n, min(source_line) as first_line, bool_or(provenance = 'LSP_VERIFIED') as verified from edges join nodes on to_id = id where relation = 'CALLS' group by 1")
def calls_by_file(spark, d):
    nodes = tg.nodes(spark, d).select("id", "file_path")
    e = tg.edges(spark, d).filter("relation = 'CALLS'").join(nodes, F.col("to_id") == F.col("id"))
    return e.groupBy("file_path").agg(F.count("*").alias("n"), F.min("source_line").alias("first_line"), F.bool_or(F.col("provenance") == model.VERIFIED).alias("verified"))


@query("select c.from_id as parent, count(*) as n from edges c join edges e on c.to_id = e.from_id where c.relation = 'CONTAINS' and e.relation = 'CALLS' group by 1")
def g24_rollup_to_parent(spark, d):
    e = tg.edges(spark, d)
    held = e.filter("relation = 'CONTAINS'").select(F.col("from_id").alias("parent"), F.col("to_id").alias("child"))
    return held.join(e.filter("relation = 'CALLS'"), F.col("child") == F.col("from_id")).groupBy("parent").agg(F.count("*").alias("n"))


# Joins, filters and set operations


@query("select e.from_id, n.label, e.provenance from edges e join nodes n on e.from_id = n.id where e.to_id = 'P1' and e.relation = 'REFERENCES'")
def j1_callers_one_hop(spark, d):
    e = tg.incoming(spark, d).filter("to_id = 'P1' and relation = 'REFERENCES'")
    return e.join(tg.nodes(spark, d).select("id", "label"), F.col("from_id") == F.col("id")).select("from_id", "label", "provenance")


@query("select e.to_id, n.label, e.source_line from edges e join nodes n on e.to_id = n.id where e.from_id = 'O1' order by source_line, label, to_id limit 100")
def j2_callees_ranked(spark, d):
    e = tg.edges(spark, d).filter("from_id = 'O1'").join(tg.nodes(spark, d).select("id", "label"), F.col("to_id") == F.col("id"))
    return e.orderBy("source_line", "label", "to_id").select("to_id", "label", "source_line").limit(100)


@query("select a.type as src_type, e.relation, b.type as dst_type, count(*) as n from edges e join nodes a on a.id = e.from_id join nodes b on b.id = e.to_id group by all")
def j3_both_ends(spark, d):
    n = tg.nodes(spark, d)
    a, b = n.select(F.col("id").alias("a"), F.col("type").alias("src_type")), n.select(F.col("id").alias("b"), F.col("type").alias("dst_type"))
    return tg.edges(spark, d).join(a, F.col("from_id") == F.col("a")).join(b, F.col("to_id") == F.col("b")).groupBy("src_type", "relation", "dst_type").agg(F.count("*").alias("n"))


@query("select n.id, n.relation, n.direction from (select to_id as id, relation, 'out' as direction from edges where from_id = 'N3' union all select from_id, relation, 'in' from edges where to_id = 'N3') n where id <> 'N3'")
def j5_neighbours(spark, d):
    return rel.neighbours(tg.edges(spark, d), "N3")


@query("select id from nodes where type = 'Class' and id in (select from_id from edges where relation = 'CALLS' and provenance = 'INFERRED')")
def j8_semi_join(spark, d):
    wanted = tg.edges(spark, d).filter("relation = 'CALLS' and provenance = 'INFERRED'").select(F.col("from_id").alias("id"))
    return tg.nodes(spark, d).filter("type = 'Class'").select("id").join(wanted, "id", "left_semi")


@query("select id, type from nodes where id not in (select from_id from edges where relation = 'CALLS' union select to_id from edges where relation = 'CALLS') and type <> 'Type'")
def j9_u3_orphans(spark, d):
    e = tg.edges(spark, d).filter("relation = 'CALLS'")
    ends = e.select(F.col("from_id").alias("id")).unionAll(e.select("to_id"))
    return tg.nodes(spark, d).filter("type <> 'Type'").select("id", "type").join(ends, "id", "left_anti")


@query(
    """select user_id, point_id, span_id from (select p.user_id, p.event_id as point_id, s.event_id as span_id, row_number() over (partition by p.event_id order by s.first desc, s.last, s.event_id) as rn
    from (select user_id, event_id, epoch(ts)::bigint as at from events where event_type <> 'click') p join
    (select user_id, event_id, epoch(ts)::bigint as first, epoch(ts)::bigint + 21600 as last from events where event_type = 'click') s
    on p.user_id = s.user_id and p.at between s.first and s.last) where rn = 1""",
    graph=False,
)
def j11_w7_innermost_interval(spark, d):
    e = tg.table(spark, d, "events").withColumn("at", scalars.nearest_second(F.col("ts")))
    points = e.filter("event_type <> 'click'").selectExpr("user_id", "event_id as point_id", "at")
    spans = e.filter("event_type = 'click'").selectExpr("user_id", "event_id as span_id", "at as first", "at + 21600 as last")
    return rel.innermost(points, spans, "user_id", width=21600)


@query("select id, label from nodes where label ilike '%blue%'")
def p3_like(spark, d):
    return tg.nodes(spark, d).filter(F.lower("label").contains("blue")).select("id", "label")


@query("select id, file_path from nodes where file_path glob 'A[SM]*/[!C]*[13579]'")
def p4_glob(spark, d):
    return tg.nodes(spark, d).filter(F.col("file_path").rlike(scalars.glob_pattern("A[SM]*/[!C]*[13579]"))).select("id", "file_path")


@query("select id, file_path like 'ASIA/%' and not file_path like 'ASIA/%/%' as one, file_path like 'ASIA/%' as any_depth from nodes where file_path <> ''")
def p5_f20_glob_of_segments(spark, d):
    path = F.col("file_path")
    matches = lambda glob: path.rlike(scalars.glob_pattern(glob, star_crosses=False))
    return tg.nodes(spark, d).filter("file_path <> ''").select("id", matches("ASIA/*").alias("one"), matches("ASIA/**").alias("any_depth"))


@query("select id, label from nodes where label like 'order\\_1_' escape '\\' or lower(label) like '%tin' or label like 'CUSTOMER%'")
def p3_like_prefix_suffix_escape(spark, d):
    label = F.col("label")
    return tg.nodes(spark, d).filter(F.like(label, F.lit("order\\_1_")) | F.lower(label).endswith("tin") | label.startswith("CUSTOMER")).select("id", "label")


@query("select from_id, to_id, relation from edges where from_id = 'O1' and relation = 'USES_TYPE'")
def p1_edges_by_optional_keys(spark, d):
    return rel.by_keys(tg.edges(spark, d), from_id="O1", relation="USES_TYPE", to_id=None).select("from_id", "to_id", "relation")


@query("select id, type from nodes where id in (select unnest(['O1', 'P2', 'nothing', 'N3']))")
def p7_ids_of_a_list(spark, d):
    return rel.of_ids(tg.nodes(spark, d), '["O1", "P2", "nothing", "N3"]').select("id", "type")


@query(
    """select id, 'NODE ' || id || ' ' || lower(type) || ' ' || label || ' ' || case when file_path = '' then 'external' else file_path || ':' || case when type = 'Function' then 1 else 0 end end as line from nodes where type <> 'Type'"""
)
def p13_node_lines(spark, d):
    n = tg.nodes(spark, d).filter("type <> 'Type'")
    return n.select("id", rel.node_line(F.col("id"), F.col("type"), F.col("label"), F.col("file_path"), F.col("start_line")).alias("line"))


@query(
    """select from_id, to_id, '?:' || source_line || ' ' || from_id || ' CALLS ' || to_id || case when provenance = 'EXTRACTED' then '' when provenance = 'LSP_VERIFIED' then ' [lsp✓]' else ' prov=' || provenance end as compact,
    'EDGE ' || from_id || '→' || to_id || ' CALLS ?:' || source_line || ' conf=0.90' || case when provenance = 'EXTRACTED' then '' when provenance = 'LSP_VERIFIED' then ' [lsp✓]' else ' prov=' || provenance end as verbose from edges where relation = 'CALLS'"""
)
def p13_edge_lines(spark, d):
    e = tg.edges(spark, d).filter("relation = 'CALLS'").withColumn("source_file", F.lit(None).cast("string"))
    return e.select("from_id", "to_id", rel.edge_line(e, compact=True).alias("compact"), rel.edge_line(e, compact=False).alias("verbose"))


@query("select id, coalesce(nullif(file_path, ''), nullif(language, ''), '(none)') as place from nodes")
def p14_sentinels(spark, d):
    return tg.nodes(spark, d).select("id", F.coalesce(F.nullif("file_path", F.lit("")), F.nullif("language", F.lit("")), F.lit("(none)")).alias("place"))


@query("select id from nodes where qname like '%.' || (select min(label) from nodes where type = 'Type')")
def qname_suffix(spark, d):
    n = tg.nodes(spark, d)
    least = n.filter("type = 'Type'").agg(F.min("label").alias("least"))  # one row
    return n.crossJoin(F.broadcast(least)).filter(F.endswith("qname", F.concat(F.lit("."), "least"))).select("id")


@query("select o_custkey as k from orders intersect select c_custkey from customer where c_acctbal > 5000", graph=False)
def u7_intersect(spark, d):
    return tg.table(spark, d, "orders").select(F.col("o_custkey").alias("k")).intersect(tg.table(spark, d, "customer").filter("c_acctbal > 5000").select("c_custkey"))


@query("select c_custkey as k from customer except select o_custkey from orders where o_totalprice > 200000", graph=False)
def u4_except(spark, d):
    return tg.table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(tg.table(spark, d, "orders").filter("o_totalprice > 200000").select("o_custkey"))


# Windows, ranking and merges


@query("select id, label, count(*) over () as population, count(*) over () > 10 as truncated from nodes where type = 'Type' order by label, id limit 10")
def w1_population(spark, d):
    own = tg.nodes(spark, d).filter("type = 'Type'").select("id", "label")
    return rel.capped(own, ["label", "id"], 10)


@query("select type, id, degree, rn from (select type, id, degree, row_number() over (partition by type order by degree desc, id)::int as rn from nodes join (select id, count(*) as degree from (select from_id as id from edges union all select to_id from edges) group by 1) using (id)) where rn <= 5")
def w2_top_per_group(spark, d):
    own = tg.nodes(spark, d).select("id", "type").join(rel.degree(tg.edges(spark, d)).select("id", "degree"), "id")
    return rel.top_per_group(own, "type", [F.desc("degree"), "id"], 5)


@query("select l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_extendedprice desc, l_partkey, l_suppkey) as rn from lineitem) where rn = 1", graph=False)
def w4_first_wins(spark, d):
    kept = rel.first_wins(tg.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], [F.desc("l_extendedprice"), "l_partkey", "l_suppkey"])
    return kept.select("l_orderkey", "l_linenumber", "l_partkey")


@query("select user_id, arg_max(event_id, (ts, event_id)) as latest from events group by 1", graph=False)
def w6_latest_per_key(spark, d):
    return tg.table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


@query("select from_id, to_id, provenance, confidence, source_line from edges where relation = 'CALLS' order by (provenance = 'LSP_VERIFIED') desc, confidence desc, source_line, from_id, to_id limit 30")
def calls_ranked(spark, d):
    e = tg.edges(spark, d).filter("relation = 'CALLS'")
    order = [F.desc(F.col("provenance") == model.VERIFIED), F.desc("confidence"), "source_line", "from_id", "to_id"]
    return e.orderBy(*order).select("from_id", "to_id", "provenance", "confidence", "source_line").limit(30)


@query("select c_custkey, case when c_custkey % 3 = 0 then 'new' else 'old' end as origin from customer", graph=False)
def m1_upsert_last_wins(spark, d):
    old = tg.table(spark, d, "customer").select("c_custkey", F.lit("old").alias("origin"))
    new = tg.table(spark, d, "customer").filter("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("origin"))
    return rel.merge_last(old, new, ["c_custkey"])


@query("select user_id, event_type, min(event_id) as event_id from events group by 1, 2", graph=False)
def m8_record_dedupe(spark, d):
    return rel.first_wins(tg.table(spark, d, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


# Traversals


_IMPACT = """, walk(id, depth) as (select 'P1', 0 union select e.from_id, w.depth + 1 from walk w join edges e on e.to_id = w.id where w.depth < 2 and e.relation in {r})
select e.from_id, e.to_id, e.relation, min(w.depth + 1)::int as depth from walk w join edges e on e.to_id = w.id where e.relation in {r} and w.depth < 2 group by all"""


@query(_IMPACT.format(r=in_list(model.IMPACT)))
def t3_impact_min_depth(spark, d):
    return traverse.reach(tg.incoming(spark, d), ["P1"], model.IMPACT, 2).select("from_id", "to_id", "relation", "depth")


@query(
    """, walk(id, depth) as (select 'C1', 0 union select e.to_id, w.depth + 1 from walk w join edges e on e.from_id = w.id where w.depth < 2 and e.relation in ('CALLS', 'REFERENCES'))
    select e.from_id, e.to_id, e.relation, min(w.depth + 1)::int as depth from walk w join edges e on e.from_id = w.id where e.relation in ('CALLS', 'REFERENCES') and w.depth < 2 group by all"""
)
def t2_callees(spark, d):
    return traverse.reach(tg.edges(spark, d), ["C1"], ["CALLS", "REFERENCES"], 2, incoming=False).select("from_id", "to_id", "relation", "depth")


@query(
    """, walk(id, depth) as (select 'P2', 0 union select e.from_id, w.depth + 1 from walk w join edges e on e.to_id = w.id where w.depth < 3 and e.relation in ('CALLS', 'REFERENCES', 'IMPORTS', 'CONTAINS'))
    select depth, count(*) as n from (select id, min(depth)::int as depth from walk where depth > 0 group by id) group by depth"""
)
def t4_nodes_per_depth(spark, d):
    return traverse.per_depth(tg.incoming(spark, d), ["P2"], ["CALLS", "REFERENCES", "IMPORTS", "CONTAINS"], 3, True)


@query(", walk(node, hops) as (select 0, 0 union select dst, hops + 1 from walk join trade on src = node where hops < 6) select node::int as node, min(hops)::int as hops from walk group by 1")
def hops_from_a_node(spark, d):
    return traverse.shortest_hops(tg.trade(spark, d), 0, 6)


@query(
    """, pairs as (select distinct src, dst from trade), walk(start, node, p) as (select src, dst, [src, dst] from pairs where src < dst
    union all select start, dst, list_append(p, dst) from walk join pairs on src = node where dst > start and not list_contains(p, dst) and len(p) < 5)
    select len(p)::int as length, array_to_string(p, '>') as path from walk join pairs on src = node and dst = start"""
)
def a5_import_cycles(spark, d):
    return traverse.simple_cycles(tg.trade(spark, d), 5)


@query("select id, coalesce(degree, 0)::bigint as degree from nodes left join (select id, count(*) as degree from (select from_id as id from edges union all select to_id from edges) group by 1) using (id) where coalesce(degree, 0) <= 1")
def a4_isolated(spark, d):
    joined = tg.nodes(spark, d).select("id").join(rel.degree(tg.edges(spark, d)).select("id", "degree"), "id", "left")
    return joined.select("id", F.coalesce("degree", F.lit(0)).alias("degree")).filter("degree <= 1")


# Search and scalars


@query(
    """select id, label, ((case when type in ('Function', 'Method', 'Class') then 1000 when type in ('Interface', 'Type', 'Variable') then 500 else 100 end)
    + (case when lower(label) = 'order_1' then 500 when starts_with(lower(label), 'order_1') then 300 else 100 end) + 10.0)::double as score from nodes
    where contains(lower(label), 'order_1') order by score desc, id limit 25"""
)
def x2_x3_lexical_search(spark, d):
    return search.lexical(tg.nodes(spark, d), "order_1", 25)


@query(
    """select doc_id, (a + b)::bigint as hits from (select doc_id, count(*) filter (starts_with(t, 'th')) as a, count(*) filter (starts_with(t, 'rean')) as b
    from (select doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) as t from documents) group by 1) where a > 0 and b > 0""",
    graph=False,
)
def x1_prefix_search(spark, d):
    return search.prefix_tokens(tg.table(spark, d, "documents"), ["th", "rean"])


@query(
    """select vec_id, similarity from (select v.vec_id, round(list_cosine_similarity(v.embedding::double[], q.embedding::double[]), 6) as similarity
    from embeddings v, embeddings q where q.vec_id = 0 and v.vec_id <> 0) where similarity > 0 order by similarity desc, vec_id limit 10""",
    graph=False,
)
def x8_nearest_vectors(spark, d):
    return search.nearest(tg.table(spark, d, "embeddings"), 0, 10)


@query("""select page_id, target, count(*) as n from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as target from pages) group by all""", graph=False)
def page_links(spark, d):
    return search.links(tg.table(spark, d, "pages"))


@query("select id, sha1(type || '::' || file_path || '::' || label) as stable, case when contains(file_path, '/') then split_part(file_path, '/', 1) else '(root)' end as top, ceil(length(label) / 4)::bigint as tokens from nodes where type <> 'Function'")
def f1_f14_f24_scalars(spark, d):
    n = tg.nodes(spark, d).filter("type <> 'Function'")
    return n.select("id", scalars.stable_id(F.col("type"), F.col("file_path"), F.col("label")).alias("stable"), scalars.top_level_dir(F.col("file_path")).alias("top"), scalars.estimate_tokens(F.col("label")).alias("tokens"))


@query("select id, regexp_extract(qname, '^(.*)(::|\\.)([^:.]+)$', 1) as owner, regexp_extract(qname, '([^:.]*)$', 1) as member from nodes where type = 'Type'")
def f4_split_symbol(spark, d):
    owner, member = scalars.owner_and_member(F.col("qname"))
    return tg.nodes(spark, d).filter("type = 'Type'").select("id", owner.alias("owner"), member.alias("member"))


@query("select o_orderkey, round(greatest(greatest(o_custkey % 5 - 1, 0) * 1.5 + log2(1 + o_custkey % 40) + (o_orderkey % 3) * 2 - (o_orderkey % 2), 0), 1)::double as risk from orders", graph=False)
def f27_risk_score(spark, d):
    o = tg.table(spark, d, "orders")
    risk = scalars.risk_score(F.col("o_custkey") % 5, F.col("o_custkey") % 40, F.col("o_orderkey") % 3, F.col("o_orderkey") % 2 == 1)
    return o.select("o_orderkey", risk.alias("risk"))


@query(
    """select user_id, min(ts) as first_ts, count(*) as n from (select *, sum(fresh) over (partition by user_id order by ts, event_id) as s from
    (select *, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) < 3600000000 then 0 else 1 end as fresh from events)) group by user_id, s""",
    graph=False,
)
def r2_trailing_debounce(spark, d):
    e = tg.table(spark, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "1 hour")).agg(F.min("ts").alias("first_ts"), F.count("*").alias("n")).drop("session_window")
