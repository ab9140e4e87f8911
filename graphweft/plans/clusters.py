"""Queries on communities, hotspots, rankings and budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphweft import model
from graphweft.functions import verdicts
from graphweft.operators import clusters, lineage, ranking, search
from graphweft.operators import relational as rel
from graphweft.plans.base import in_list, query
from graphweft.sources import testgraph as tg

_ROUNDS = 6


def _labels_sql(rounds: int) -> str:
    """Moves by gain of modularity with their rounds written out, then numbered."""
    out = [
        "und as (select least(src, dst) as a, greatest(src, dst) as b, sum(n)::bigint as w from trade where src <> dst group by all)",
        "links as (select a as src, b as dst, w from und union all select b, a, w from und)",
        "degs as (select src as node, sum(w)::hugeint as k from links group by 1), whole as (select sum(k)::hugeint as m2 from degs)",
        "l0 as (select node, node as label from degs)",
    ]
    for r in range(rounds):
        out.append(f"tot{r} as (select label as seen, sum(k)::hugeint as total from l{r} join degs using (node) group by 1)")
        out.append(f"near{r} as (select node, seen, max(w) as w from (select src as node, label as seen, sum(w)::hugeint as w from links join l{r} on dst = node group by all union all select node, label, 0 from l{r}) group by 1, 2)")
        out.append(f"sc{r} as (select node, label, seen, w * m2 - k * (total - case when seen = label then k else 0 end) as gain from near{r} join tot{r} using (seen) join l{r} using (node) join degs using (node), whole)")
        out.append(f"l{r + 1} as (select node, case when (node::bigint >> {r // 2}) % 2 = {r % 2} and max(gain) > max(gain) filter (seen = label) then arg_min(seen, (-gain, seen)) else label end as label from sc{r} group by node, label)")
    out.append(f"sizes as (select label, count(*) as n, min(node) as least from l{rounds} group by 1)")
    out.append("numbers as (select label, row_number() over (order by n desc, least)::int as community from sizes)")
    out.append(f"classes as (select node, community from l{rounds} join numbers using (label))")
    return ", " + ", ".join(out) + " "


def _pairs(spark, d):
    return tg.trade(spark, d).select("src", "dst", F.col("n").alias("w"))


def _classes(spark, d):
    return clusters.communities(_pairs(spark, d), _ROUNDS)


@query(_labels_sql(_ROUNDS) + "select * from classes")
def a1_communities(spark, d):
    return _classes(spark, d)


@query(
    _labels_sql(_ROUNDS)
    + """, ends as (select a.community as a, b.community as b, w from links join classes a on a.node = src join classes b on b.node = dst), m as (select sum(w) as m2 from links),
    sums as (select a, sum(w) as total, sum(case when a = b then w else 0 end) as inside from ends group by 1)
    select round(sum(inside / m2 - (total / m2) * (total / m2)), 6)::double as modularity from sums, m"""
)
def a15_modularity(spark, d):
    return clusters.modularity(_pairs(spark, d), _classes(spark, d))


@query(_labels_sql(_ROUNDS) + "select a.community as src_community, b.community as dst_community, count(*) as n from trade join classes a on a.node = src join classes b on b.node = dst where a.community <> b.community group by 1, 2")
def g8_edges_between_communities(spark, d):
    return clusters.between(tg.trade(spark, d), _classes(spark, d))


@query(
    _labels_sql(_ROUNDS)
    + """, deg as (select node, count(*) as degree from (select src as node from trade union all select dst from trade) group by 1),
    ranked as (select community, node, row_number() over (partition by community order by degree desc nulls last, node) as rn from classes left join deg using (node))
    select community, (select count(*) from classes c where c.community = r.community) as n, string_agg(node, ',' order by rn) filter (rn <= 3) as top from ranked r group by 1"""
)
def a2_w3_v22_community_overview(spark, d):
    return clusters.overview(tg.trade(spark, d), _classes(spark, d), 3)


# Leiden on the customers, orders and parts of the whole graph. Its labels have no SQL; what holds of them has.


def _calls(spark, d):
    return tg.calls_and_references(spark, d).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.round(100 * F.col("confidence")).cast("int").alias("w"))


_found: dict[tuple[str, str], DataFrame] = {}


def _leiden(spark, d):
    """The communities, found with the first call of a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _found:
        _found[key] = lineage.cut(clusters.leiden(_calls(spark, d)))
    return _found[key]


@query()
def a1_leiden(spark, d):
    return _leiden(spark, d)


@query(
    """select count(distinct id)::bigint as nodes, true as all_connected, true as by_size, true as beats_one_level from (
    select from_id as id from edges where relation in ('CALLS', 'REFERENCES') union all select to_id from edges where relation in ('CALLS', 'REFERENCES'))"""
)
def a1_a15_leiden_against_one_level(spark, d):
    """What Leiden promises: every node once, communities that are connected, numbered by size, of no less modularity than one level of moves."""
    pairs = lineage.cut(_calls(spark, d))
    found, one = _leiden(spark, d), lineage.cut(clusters.communities(pairs))
    inside = clusters.connected_within(pairs, found.withColumnRenamed("community", "label")).groupBy("label").agg(F.countDistinct("component").alias("k"))
    sizes = found.groupBy("community").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("next", F.lead("n").over(W.partitionBy().orderBy("community")))  # a row a community
    more, less = (clusters.modularity(pairs, c).select(F.col("modularity").alias(n)) for c, n in ((found, "more"), (one, "less")))
    facts = [found.agg(F.count("*").alias("nodes"), F.countDistinct("node").alias("own")), inside.agg((F.max("k") == 1).alias("all_connected")), sizes.agg(F.min(F.coalesce(F.col("n") >= F.col("next"), F.lit(True))).alias("by_size")), more, less]
    row = reduce(lambda a, b: a.crossJoin(b), facts)  # one row each
    return row.select(F.when(F.col("nodes") == F.col("own"), F.col("nodes")).alias("nodes"), "all_connected", "by_size", (F.col("more") >= F.col("less")).alias("beats_one_level"))


@query()
def g8_edges_between_leiden_communities(spark, d):
    return clusters.between(_calls(spark, d), _leiden(spark, d))


@query()
def a2_leiden_overview(spark, d):
    return clusters.overview(_calls(spark, d), _leiden(spark, d), 3)


_LEXICON = [("size", "small", 0), ("size", "large", 0), ("surface", "steel", 1), ("surface", "cold", 1), ("hardware", "bolt", 2), ("hardware", "widg", 2), ("hardware", "red_gear", 2)]


@query(
    f""", lex(archetype, keyword, place) as (values {", ".join(f"('{a}', '{k}', {p})" for a, k, p in _LEXICON)}), hits as (select language as cluster, archetype, place,
    case when keyword = 'red_gear' then (list_contains(string_split(label, ' '), 'red') and len(list_filter(string_split(label, ' '), lambda t: starts_with(t, 'gear'))) > 0) else len(list_filter(string_split(label, ' '), lambda t: starts_with(t, keyword))) > 0 end as hit
    from nodes cross join lex where type = 'Type'),
    sums as (select cluster, archetype, min(place) as place, count(*) as score from hits where hit group by 1, 2), r as (select *, row_number() over (partition by cluster order by score desc, place) as rn from sums),
    best as (select cluster, max(case when rn = 1 then archetype end) as archetype, max(score) as score, max(case when rn = 2 then score end) as second from r group by 1)
    select c.cluster, case when coalesce(score, 0) < 2 then 'mixed' else archetype end as archetype, coalesce(score, 0)::bigint as score,
    case when score >= 3 and score >= 2 * coalesce(second, 0.5) then 'high' when score >= 2 then 'medium' else 'low' end as confidence from (select distinct language as cluster from nodes where type = 'Type') c left join best using (cluster)"""
)
def a10_archetypes(spark, d):
    samples = tg.nodes(spark, d).filter("type = 'Type'").selectExpr("language as cluster", "label", "file_path")
    return clusters.archetypes(samples, spark.createDataFrame(_LEXICON, "archetype string, keyword string, place int"))


_INBOUND = """select to_id, sum(n)::bigint as fan_in, sum(case when provenance in ('LSP_VERIFIED', 'CODE_INTEL') then n else 0 end)::bigint as verified, max(sources) as sources from
(select to_id, provenance, count(*) as n, count(distinct s.file_path) as sources from edges join nodes s on s.id = from_id group by 1, 2) group by 1"""


@query(f"select to_id, fan_in, verified, sources, verified = 0 and fan_in >= 25 and sources >= 10 as upper_bound from ({_INBOUND})")
def g7_heuristic_upper_bound(spark, d):
    return ranking_evidence(spark, d)


def ranking_evidence(spark, d):
    """Inbound evidence, with the flag of counts that no verified edge backs."""
    files = tg.nodes(spark, d).select(F.col("id").alias("from_id"), "file_path")
    own = tg.edges(spark, d).join(files, "from_id").groupBy("to_id", "provenance").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("sources"))
    verified = F.sum(F.when(F.col("provenance").isin(model.VERIFIED, "CODE_INTEL"), F.col("n")).otherwise(0))
    sums = own.groupBy("to_id").agg(F.sum("n").alias("fan_in"), verified.alias("verified"), F.max("sources").alias("sources"))
    return sums.withColumn("upper_bound", (F.col("verified") == 0) & (F.col("fan_in") >= 25) & (F.col("sources") >= 10))


@query(
    """, deg as (select id, sum(i)::bigint as fan_in, sum(o)::bigint as fan_out from (select from_id as id, 0 as i, 1 as o from edges union all select to_id, 1, 0 from edges) group by id),
    page as (select n.id, n.label, fan_in, fan_out from deg join nodes n using (id) where n.type not in ('Directory', 'Module') order by fan_in + fan_out desc, label, id limit 60)
    select id, label, fan_in, fan_out from page where label not like '%gear' order by fan_in + fan_out desc, label, id limit 10"""
)
def a3_v23_hotspots_without_noise(spark, d):
    """The page of candidates is cut before the noise goes, so that fewer than the limit can be left."""
    nodes = tg.nodes(spark, d).filter(~F.col("type").isin("Directory", "Module")).select("id", "label")
    label = F.when(F.col("label").endswith("gear"), F.lit("handle")).otherwise(F.col("label"))
    page = nodes.join(rel.degree(tg.edges(spark, d)), "id").orderBy(F.desc("degree"), "label", "id").limit(60)
    return page.filter(~verdicts.is_noise(label)).orderBy(F.desc("degree"), "label", "id").select("id", "label", "fan_in", "fan_out").limit(10)


@query(
    f"""select from_id, to_id, depth, confidence from (select from_id, to_id, provenance, confidence, 1 + source_line % 3 as depth, relation = 'REFERENCES' as from_test, (select count(*) from edges x where x.to_id = e.from_id) as fan_in from edges e
    where to_id in ('P1', 'P2', 'O3') and relation in {in_list(model.CALL)}) order by (provenance = 'LSP_VERIFIED') desc, depth, confidence desc, from_test desc, fan_in desc, from_id, to_id limit 12"""
)
def k1_ranked_callers(spark, d):
    e = tg.incoming(spark, d)
    own = e.filter(F.col("to_id").isin("P1", "P2", "O3") & F.col("relation").isin(model.CALL))
    used = e.join(own.select(F.col("from_id").alias("to_id")).distinct(), "to_id", "left_semi").groupBy(F.col("to_id").alias("from_id")).agg(F.count("*").alias("fan_in"))
    own = own.join(used, "from_id", "left").withColumn("fan_in", F.coalesce("fan_in", F.lit(0)))
    own = own.withColumn("depth", 1 + F.col("source_line") % 3).withColumn("from_test", F.col("relation") == "REFERENCES")
    return ranking.rank_callers(own, ["from_id", "to_id"]).select("from_id", "to_id", "depth", "confidence").limit(12)


@query(
    f"""select from_id, to_id, (select count(*) - 15 from edges where relation in {in_list(model.CALL)}) as dropped from edges where relation in {in_list(model.CALL)}
    order by (provenance = 'LSP_VERIFIED') desc, confidence desc, source_line % 2, from_id, to_id, relation limit 15"""
)
def k3_budget_with_dropped(spark, d):
    own = tg.edges(spark, d).filter(F.col("relation").isin(model.CALL)).withColumn("depth", F.col("source_line") % 2)
    return ranking.within_limit(own, 15, ["from_id", "to_id", "relation"]).select("from_id", "to_id", "dropped")


@query("select id, type, true as floor from nodes where contains(label, '1') or contains(label, 'bolt') order by type in ('Function', 'Class', 'Type') desc, file_path, id limit 20")
def k5_k7_k16_search_page(spark, d):
    own = tg.nodes(spark, d).filter("contains(label, '1') or contains(label, 'bolt')").withColumn("start_line", F.lit(0))
    return ranking.search_page(own, 20).select("id", "type", "floor")


@query(
    """select o_orderkey from orders order by (o_orderkey % 7) desc, case when o_custkey % 5 = 0 then 0 else o_custkey % 5 end desc, case o_orderstatus when 'F' then 3 when 'O' then 2 else 0 end desc, o_totalprice desc, o_orderkey limit 40""", graph=False
)
def k9_ranked_items(spark, d):
    sure = F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "medium")
    items = tg.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).alias("changed_files"), F.nullif(F.col("o_custkey") % 5, F.lit(0)).alias("task_anchors"), sure.alias("code_intel_confidence"), F.col("o_totalprice").alias("recency"))
    return ranking.rank_and_cap(items, 40, ["o_orderkey"]).select("o_orderkey")


@query(
    """with s as (select n_regionkey + 1 as place, r_name as section, string_agg(n_name, ', ' order by n_nationkey) as text, r_name || ': ' || count(*) as collapsed, n_regionkey = 1 as kept from nation join region on n_regionkey = r_regionkey group by n_regionkey, r_name),
    a as (select *, sum(length(text)) over () - 150 as over_, coalesce(sum(case when kept then 0 else greatest(length(text) - length(collapsed), 0) end) over (order by place desc rows between unbounded preceding and 1 preceding), 0) as before from s),
    f as (select place, section, kept, not kept and over_ > before as fold, case when not kept and over_ > before then collapsed else text end as text from a),
    b as (select *, sum(length(text)) over () - 150 as over_, coalesce(sum(case when kept then 0 else length(text) end) over (order by place desc rows between unbounded preceding and 1 preceding), 0) as before from f)
    select place::int as place, section, length(text)::int as size, case when fold then 'collapsed' else 'whole' end as how from b where kept or over_ <= before""",
    graph=False,
)
def k14_clamped_sections(spark, d):
    """An answer of a section a region, its nations, made to fit 150 characters; the second region's stays whole."""
    own = tg.table(spark, d, "nation").join(tg.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), ", ")
    sections = own.groupBy("n_regionkey", "r_name").agg(names.alias("text"), F.concat("r_name", F.lit(": "), F.count("*").cast("string")).alias("collapsed"))
    sections = sections.select((F.col("n_regionkey") + 1).cast("int").alias("place"), F.col("r_name").alias("section"), "text", "collapsed", (F.col("n_regionkey") == 1).alias("kept"))
    return ranking.clamp_sections(sections, 150).select("place", "section", F.length("text").alias("size"), "how")


@query(
    """, deg as (select id, count(*) as degree from (select from_id as id from edges union all select to_id from edges) group by 1)
    select * from (select 1 as step, 'entry' as what, id from nodes where type = 'Directory' order by id limit 2) union all
    select * from (select 2, 'region', c_nationkey::varchar from customer group by 3 order by count(*) desc, 3 limit 3) union all select * from (select 3, 'hub', id from deg order by degree desc, id limit 3)"""
)
def a12_v32_tour(spark, d):
    """Where to begin, the largest regions, the hubs: in that order."""
    n = tg.nodes(spark, d)
    entry = n.filter("type = 'Directory'").orderBy("id").limit(2).selectExpr("1 as step", "'entry' as what", "id")
    regions = tg.table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(3).selectExpr("2 as step", "'region' as what", "id")
    hubs = rel.degree(tg.edges(spark, d)).orderBy(F.desc("degree"), "id").limit(3).selectExpr("3 as step", "'hub' as what", "id")
    return entry.unionByName(regions).unionByName(hubs)


@query(
    """, blocks as (select 1 as place, 'nodes ' || count(*) as line from nodes union all select 2, 'edges ' || count(*) from edges union all select 3, 'types ' || string_agg(distinct type, ',' order by type) from nodes
    union all select 4, 'relations ' || string_agg(distinct relation, ',' order by relation) from edges), spent as (select *, sum(length(line)) over (order by place)::bigint as spent from blocks) select place, line from spent where spent <= 80"""
)
def a13_v21_digest(spark, d):
    n, e = tg.nodes(spark, d), tg.edges(spark, d)
    count = lambda place, name, frame: frame.agg(F.concat(F.lit(f"{name} "), F.count("*")).alias("line")).select(F.lit(place).alias("place"), "line")
    kinds = lambda place, name, frame, column: frame.select(column).distinct().agg(F.concat(F.lit(f"{name} "), F.array_join(F.sort_array(F.collect_set(column)), ",")).alias("line")).select(F.lit(place).alias("place"), "line")
    blocks = count(1, "nodes", n).unionByName(count(2, "edges", e)).unionByName(kinds(3, "types", n, "type")).unionByName(kinds(4, "relations", e, "relation"))
    return clusters.within_budget(blocks, "place", "line", 80).select("place", "line")


@query(
    """, tok as (select id, string_split(label, ' ') as t from nodes where type = 'Type'), c as (select id, len(t) as n, len(list_filter(t, lambda x: starts_with(x, 'co'))) as a, len(list_filter(t, lambda x: starts_with(x, 'w'))) as b from tok),
    s as (select count(*) as docs, avg(n) as mean, count(*) filter (a > 0) as da, count(*) filter (b > 0) as db from c)
    select id, round(ln(1 + (docs - da + 0.5) / (da + 0.5)) * (a * 2.2) / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * (b * 2.2) / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6)::double as score
    from c, s where a > 0 and b > 0 order by score desc, id limit 20"""
)
def x1_full_text_ranked(spark, d):
    return search.full_text(tg.nodes(spark, d).filter("type = 'Type'"), "id", "label", "Co W!", 20)


@query(
    """select layer, id, score from (select 'code' as layer, id, case when label = 'cold bolt' then 500 when starts_with(label, 'cold') then 300 else 100 end * 1.0 as score from nodes where type = 'Type' and contains(label, 'cold')
    union all select 'tasks', o_orderkey::varchar, 300 * 0.75 from orders where o_orderpriority like '1%' and o_orderkey % 50 = 0) qualify row_number() over (partition by layer order by score desc, id) <= 4""",
)
def x5_v43_find_across_layers(spark, d):
    code = tg.nodes(spark, d).filter("type = 'Type'").select(F.lit("code").alias("layer"), "id", F.col("label").alias("text"), F.lit(1.0).alias("weight"))
    tasks = tg.table(spark, d, "orders").filter("o_orderkey % 50 = 0 and o_orderpriority like '1%'").select(F.lit("tasks").alias("layer"), F.col("o_orderkey").cast("string").alias("id"), F.lit("cold start of the engine").alias("text"), F.lit(0.75).alias("weight"))
    return search.across_layers([code, tasks], ["cold", "cold bolt"], 4)


@query("select label, count(*) as n, count(distinct language) as languages, string_agg(distinct language, ',' order by language) as census from nodes where label = 'cold bolt' group by 1")
def g28_language_census(spark, d):
    own = tg.nodes(spark, d).filter("label = 'cold bolt'").groupBy("label", "language").agg(F.count("*").alias("n"))
    return own.groupBy("label").agg(F.sum("n").alias("n"), F.count("*").alias("languages"), F.array_join(F.sort_array(F.collect_list("language")), ",").alias("census"))  # a row a language


@query(
    """select kind, present, searched from (select type as kind, true as present, type in ('Function', 'Method', 'Class') as searched from nodes group by 1 union all select k, false, true from (values ('Method')) t(k)) where not (present and searched)"""
)
def x11_miss_scope(spark, d):
    return search.miss_scope(tg.nodes(spark, d), ["Function", "Method", "Class"])
