"""Tables of a dashboard and of briefs, compiler output, trust and receipts."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphweft import model
from graphweft.functions import paths, texts, verdicts
from graphweft.operators import paths as walks
from graphweft.operators import receipts, traverse
from graphweft.operators import relational as rel
from graphweft.plans.base import in_list, query
from graphweft.sources import testgraph as tg


@query(
    """, sizes as (select language as cluster, count(*) as n from nodes where type = 'Type' group by 1), r as (select *, row_number() over (order by n desc, cluster) as rn from sizes)
    select case when rn <= 8 then cluster else 'other' end as cluster, sum(n)::bigint as n, count(*) as folded from r group by 1"""
)
def e1_overview_with_other(spark, d):
    """The largest clusters by name, the rest folded into one."""
    sizes = tg.nodes(spark, d).filter("type = 'Type'").groupBy(F.col("language").alias("cluster")).agg(F.count("*").alias("n"))
    named = sizes.orderBy(F.desc("n"), "cluster").limit(8).select("cluster", F.lit(True).alias("named"))
    told = sizes.join(F.broadcast(named), "cluster", "left")  # eight rows
    return told.groupBy(F.when(F.col("named"), F.col("cluster")).otherwise("other").alias("cluster")).agg(F.sum("n").alias("n"), F.count("*").alias("folded"))


@query(
    """, deg as (select id, count(*) as degree from (select from_id as id from edges union all select to_id from edges) group by 1), kept as (select id from nodes left join deg using (id) order by coalesce(degree, 0) desc, id limit 400)
    select from_id, to_id, relation from edges where from_id in (select id from kept) and to_id in (select id from kept) order by 1, 2, 3 limit 100"""
)
def e1_capped_graph(spark, d):
    """What a screen can show: the nodes with most edges, and the edges between them, both capped."""
    degree = rel.degree(tg.edges(spark, d)).select("id", "degree")
    kept = tg.nodes(spark, d).select("id").join(degree, "id", "left").orderBy(F.desc(F.coalesce("degree", F.lit(0))), "id").limit(400)
    ends = [F.broadcast(kept.select(F.col("id").alias(c))) for c in ("from_id", "to_id")]  # the cap's rows
    own = tg.edges(spark, d).join(ends[0], "from_id", "left_semi").join(ends[1], "to_id", "left_semi")
    return own.select("from_id", "to_id", "relation").orderBy("from_id", "to_id", "relation").limit(100)


@query(
    """, into_ as (select to_id as id, count(*) as fan_in from edges where relation in ('CALLS', 'REFERENCES', 'IMPORTS') group by 1) select id, label, fan_in, case when fan_in >= 40 then 'high' when fan_in >= 20 then 'medium' else 'low' end as risk
    from into_ join nodes using (id) order by fan_in desc, label, id limit 10"""
)
def e2_hubs_and_risks(spark, d):
    into = tg.edges(spark, d).filter(F.col("relation").isin("CALLS", "REFERENCES", "IMPORTS")).groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("fan_in"))
    risk = F.when(F.col("fan_in") >= 40, "high").when(F.col("fan_in") >= 20, "medium").otherwise("low")
    return into.join(tg.nodes(spark, d).select("id", "label"), "id").orderBy(F.desc("fan_in"), "label", "id").select("id", "label", "fan_in", risk.alias("risk")).limit(10)


@query(
    """, e as (select distinct n.file_path as file, e.from_id, e.to_id, e.relation from edges e join nodes n on n.id = e.from_id or n.id = e.to_id where n.file_path <> '') select file, count(*) as degree, starts_with(file, 'orders/f1') as test from e group by 1, 3 order by test, degree desc, file limit 12"""
)
def e2_read_first(spark, d):
    """Files in the order to read them: those with most edges, tests last."""
    n = tg.nodes(spark, d).select("id", "file_path")
    a, b = (n.select(F.col("id").alias(f"{k}_id"), F.col("file_path").alias(f"{k}_file")) for k in ("from", "to"))
    both = tg.edges(spark, d).select("from_id", "to_id").join(a, "from_id").join(b, "to_id")
    degree = both.select(F.explode(F.array_distinct(F.array("from_file", "to_file"))).alias("file")).filter("file <> ''").groupBy("file").agg(F.count("*").alias("degree"))
    test = paths.is_test(F.regexp_replace("file", "^orders/f1", "tests/f1"), F.lit("File"))
    return degree.withColumn("test", test).orderBy("test", F.desc("degree"), "file").limit(12)


@query("select file_path, count(*) as cases, string_agg(label, ',' order by label) filter (rn <= 3) as shown from (select *, row_number() over (partition by file_path order by label) as rn from nodes where type = 'Function' and starts_with(file_path, 'orders/f1')) group by 1 order by cases desc, file_path limit 5")
def e2_test_anchors(spark, d):
    own = tg.nodes(spark, d).filter("type = 'Function' and startswith(file_path, 'orders/f1')")
    shown = rel.counted_with_samples(own, "file_path", "label", 3)
    return shown.select("file_path", F.col("n").alias("cases"), F.translate("samples", "|", ",").alias("shown")).orderBy(F.desc("cases"), "file_path").limit(5)


@query("select id, label from nodes where type in ('Class', 'Module') and id in (select from_id from edges where relation = 'CALLS') and id not in (select to_id from edges where relation in ('CALLS', 'REFERENCES')) order by label, id limit 15")
def e2_entry_points(spark, d):
    """What calls and isn't called."""
    e = tg.edges(spark, d)
    callers = e.filter("relation = 'CALLS'").select(F.col("from_id").alias("id"))
    called = e.filter("relation in ('CALLS', 'REFERENCES')").select(F.col("to_id").alias("id"))
    own = tg.nodes(spark, d).filter("type in ('Class', 'Module')").select("id", "label")
    return own.join(callers, "id", "left_semi").join(called, "id", "left_anti").orderBy("label", "id").limit(15)


@query(
    """select 'src/a' || n_nationkey || '.cpp' as file, n_nationkey + 1 as line, 5 as col, case when n_nationkey % 2 = 0 then 'error' else 'warning' end as severity, 'no member ''x'' in ''T''' as message, case when n_nationkey % 2 = 1 then '-Wx' end as code from nation""", graph=False
)
def v12_compiler_output(spark, d):
    line = "concat('src/a', n_nationkey, '.cpp:', n_nationkey + 1, ':5: ', if(n_nationkey % 2 = 0, 'error', 'warning'), ': no member \\'x\\' in \\'T\\'', if(n_nationkey % 2 = 1, ' [-Wx]', ''))"
    lines = tg.table(spark, d, "nation").selectExpr(f"{line} as value").unionAll(spark.createDataFrame([("In file included from x.h:3:",), ("",), ("1 error generated.",)], "value string"))
    return texts.compiler_lines(lines)


_IN = in_list([*model.CALL, "USES_TYPE", "TESTS"])


@query(
    f""", walk(id, depth) as (select 'S1', 0 union select e.from_id, w.depth + 1 from walk w join edges e on e.to_id = w.id where w.depth < 2 and e.relation in {_IN}),
    hits as (select e.from_id, e.to_id, e.relation, min(w.depth + 1)::int as depth from walk w join edges e on e.to_id = w.id where e.relation in {_IN} and w.depth < 2 group by all)
    select * from hits union all select from_id, to_id, relation, 1 from edges where from_id = 'S1' and relation = 'IMPORTS'"""
)
def t3_v37_impact_with_overriders(spark, d):
    """The edges that a change reaches, and one hop along the bridge to what overrides it."""
    hits = traverse.reach(tg.incoming(spark, d), ["S1"], [*model.CALL, "USES_TYPE", "TESTS"], 2).select("from_id", "to_id", "relation", "depth")
    bridge = tg.edges(spark, d).filter("from_id = 'S1' and relation = 'IMPORTS'").select("from_id", "to_id", "relation", F.lit(1).alias("depth"))
    return hits.unionByName(bridge)


@query(
    """, i as (select 'in' as side, from_id as other, relation, confidence, row_number() over (order by confidence desc, from_id, relation) as rn from edges where to_id = 'P2'), o as (select 'out' as side, to_id as other, relation, confidence, row_number() over (order by confidence desc, to_id, relation) as rn from edges where from_id = 'S2')
    select side, other, relation from i where rn <= 3 union all select side, other, relation from o where rn <= 3"""
)
def v26_expanded_whereis(spark, d):
    """The three surest edges into and out of what was found."""
    into = tg.incoming(spark, d).filter("to_id = 'P2'").orderBy(F.desc("confidence"), "from_id", "relation").limit(3).selectExpr("'in' as side", "from_id as other", "relation")
    out = tg.edges(spark, d).filter("from_id = 'S2'").orderBy(F.desc("confidence"), "to_id", "relation").limit(3).selectExpr("'out' as side", "to_id as other", "relation")
    return into.unionByName(out)


@query(
    """select case relation when 'CALLS' then 'CALLS' else 'rest' end as answer, count(*) as n, count(*) filter (provenance = 'LSP_VERIFIED') as verified, case when count(*) filter (provenance = 'LSP_VERIFIED') = 0 then 'heuristic' else 'partial' end as trust from edges group by 1 union all select 'none', 0, 0, 'nothing found'"""
)
def q1_trust_lines(spark, d):
    e = tg.edges(spark, d)
    line = lambda name, own: receipts.trust_line(own).select(F.lit(name).alias("answer"), "n", "verified", "trust")
    return line("CALLS", e.filter("relation = 'CALLS'")).unionByName(line("rest", e.filter("relation <> 'CALLS'"))).unionByName(line("none", e.filter("relation = 'NONE'")))


@query("select c_custkey, (c_custkey % 3 = 0 and c_custkey % 20 < 10) or (c_custkey % 7 >= 3 and c_custkey % 20 < c_custkey % 7) as warned from customer", graph=False)
def q2_warnings(spark, d):
    k = F.col("c_custkey")
    return tg.table(spark, d, "customer").select("c_custkey", receipts.warns(F.when(k % 3 == 0, "weak").otherwise("ok"), k % 20, k % 7).alias("warned"))


@query("""select n, sha256('what|c1|' || n || '|' || digest) as seal, true as intact from (select count(*) as n, sum(('0x' || substr(sha256('{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}'), 1, 15))::bigint)::varchar as digest from region)""", graph=False)
def q3_receipt(spark, d):
    return receipts.intact(receipts.receipt(tg.table(spark, d, "region"), "what", "c1")).select("n", "seal", "intact")


@query("select id, case when label like '%1' then true else false end as ranked_out, label like '%1' or label like '%2' as report_out, label like '%3' as brief_out from nodes where type = 'Class'")
def p11_sets_of_noise(spark, d):
    last = F.substring("label", -1, 1)
    label = F.when(last == "1", "toString").when(last == "2", "__str__").when(last == "3", "reduce").otherwise("plain")
    told = tg.nodes(spark, d).filter("type = 'Class'").select("id", label.alias("label"))
    ranked = verdicts.is_noise(F.col("label")) & ~F.col("label").isin("__str__")
    return told.select("id", ranked.alias("ranked_out"), verdicts.is_noise(F.col("label"), "report").alias("report_out"), (verdicts.is_noise(F.col("label"), "brief") & (F.col("label") == "reduce")).alias("brief_out"))


@query(
    """, e as (select from_id, to_id, relation from edges where relation in ('CONTAINS', 'CALLS')), w(id, hop) as (select 'N1', 0 union select to_id, hop + 1 from w join e on from_id = id where hop < 2) select id, min(hop)::int as hop from w where id <> 'N1' group by 1"""
)
def t2_outgoing_of_several_relations(spark, d):
    hits = traverse.reach(tg.edges(spark, d), ["N1"], ["CONTAINS", "CALLS"], 2, incoming=False)
    return hits.groupBy(F.col("to_id").alias("id")).agg(F.min("depth").alias("hop")).filter("id <> 'N1'")


@query("select from_id, to_id from edges where relation = 'IMPORTS' and false")
def t9_no_way(spark, d):
    """Where there is no path there is no row."""
    found = walks.shortest_path(tg.edges(spark, d), "P1", "R0", ["CALLS"], 3)
    return spark.createDataFrame([], "from_id string, to_id string") if found is None else found.select("from_id", "to_id")
