"""Composite answers over the stored graph: status, health, packets, plans and digests of a symbol, file or change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft import model
from graphweft.functions import paths as file_paths
from graphweft.functions import verdicts
from graphweft.operators import evidence, overlays, ranking, suggest, traverse
from graphweft.operators import relational as rel
from graphweft.plans import linking
from graphweft.plans.base import in_list, query
from graphweft.sources import sinks
from graphweft.sources import testgraph as tg


def _facts(**columns: Column | DataFrame) -> DataFrame:
    """One row a fact: name and value as text, from frames of one row and one column."""
    out = None
    for name, frame in columns.items():
        own = frame.select(F.lit(name).alias("fact"), F.col(frame.columns[0]).cast("string").alias("value"))
        out = own if out is None else out.unionByName(own)
    return out


@query("select 'nodes' as fact, count(*)::varchar as value from nodes union all select 'edges', count(*)::varchar from edges union all select 'verified', count(*)::varchar from edges where provenance = 'LSP_VERIFIED' union all select 'files', count(distinct file_path)::varchar from nodes where file_path <> ''")
def v1_status(spark, d):
    n, e = tg.nodes(spark, d), tg.edges(spark, d)
    return _facts(
        nodes=n.agg(F.count("*")), edges=e.agg(F.count("*")), verified=e.agg(F.count_if(F.col("provenance") == model.VERIFIED)), files=n.agg(F.countDistinct(F.nullif("file_path", F.lit(""))))
    )


@query("select type as kind, count(*) as n from nodes group by 1 union all select relation, count(*) from edges group by 1")
def v2_index(spark, d):
    """Builds the stored graph if the session has none, and says what is in it; edges of both copies must agree."""
    g = tg.graph(spark, d)
    both = g.outgoing.groupBy("relation").agg(F.count("*").alias("n")).join(g.incoming.groupBy("relation").agg(F.count("*").alias("n")), ["relation", "n"])
    return g.nodes.groupBy(F.col("type").alias("kind")).agg(F.count("*").alias("n")).unionByName(both.select(F.col("relation").alias("kind"), "n"))


@query(
    """, t as (select count(*) filter (provenance = 'INFERRED') as unresolved, count(*) filter (relation = 'CALLS') as calls, count(*) filter (relation = 'CALLS' and provenance = 'LSP_VERIFIED') as verified from edges),
    o as (select count(*) as isolated from nodes where id not in (select from_id from edges union select to_id from edges))
    select unresolved, case when unresolved > 2000 then 'weak' when unresolved > 500 then 'ok' else 'strong' end as trust, case when calls = 0 then 0 else round(100.0 * verified / calls) end::int as coverage, isolated from t, o"""
)
def v4_health(spark, d):
    n, e = tg.nodes(spark, d), tg.edges(spark, d)
    calls = F.col("relation") == "CALLS"
    sums = e.agg(F.count_if(F.col("provenance") == "INFERRED").alias("unresolved"), F.count_if(calls).alias("calls"), F.count_if(calls & (F.col("provenance") == model.VERIFIED)).alias("verified"))
    ends = e.select(F.explode(F.array("from_id", "to_id")).alias("id"))
    isolated = n.join(ends, "id", "left_anti").agg(F.count("*").alias("isolated"))
    pct = F.when(F.col("calls") == 0, 0).otherwise(F.round(F.lit(100.0) * F.col("verified") / F.col("calls"))).cast("int")
    return sums.crossJoin(isolated).select("unresolved", verdicts.trust_level(F.col("unresolved")).alias("trust"), pct.alias("coverage"), "isolated")  # one row each


_CALLERS = f"""select e.from_id, a.label, a.file_path, e.provenance, e.confidence, e.source_line from edges e join nodes a on a.id = e.from_id where to_id = 'P1' and relation in {in_list([*model.CALL, "USES_TYPE", "IMPORTS"])}"""


def _callers(spark, d, target: str = "P1") -> DataFrame:
    into = tg.incoming(spark, d).filter((F.col("to_id") == target) & F.col("relation").isin([*model.CALL, "USES_TYPE", "IMPORTS"]))
    return into.join(tg.nodes(spark, d).select(F.col("id").alias("from_id"), "label", "file_path"), "from_id")


@query(f", c as ({_CALLERS}) select file_path, count(*) as n, min(source_line) as first_line, string_agg(distinct label, ',' order by label) as labels from c group by 1 order by n desc, file_path limit 30")
def v30_change_plan(spark, d):
    """Who breaks if the symbol changes, by file; the most affected first."""
    own = _callers(spark, d).groupBy("file_path").agg(F.count("*").alias("n"), F.min("source_line").alias("first_line"), F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"))
    return own.orderBy(F.desc("n"), "file_path").limit(30)


@query(f", c as ({_CALLERS}) select file_path, count(*) as n, bool_or(provenance = 'LSP_VERIFIED') as verified, array_to_string(list_sort(list(distinct label))[:8], ',') as labels from c group by 1")
def g13_g14_affected_by_file(spark, d):
    labels = F.slice(F.sort_array(F.collect_set("label")), 1, 8)
    return _callers(spark, d).groupBy("file_path").agg(F.count("*").alias("n"), F.bool_or(F.col("provenance") == model.VERIFIED).alias("verified"), F.array_join(labels, ",").alias("labels"))


@query(
    f""", c as ({_CALLERS}), t as (select count(*) as callers, count(distinct file_path) > 1 as crosses, count(*) filter (file_path like '%test%') as tests, coalesce(bool_or(provenance = 'LSP_VERIFIED'), false) as verified from c)
    select callers, tests, case when callers > 5 and crosses or callers > 10 then 'CONFIRM' when callers > 1 or not verified then 'REVIEW' else 'SAFE' end as decision from t"""
)
def v33_preflight_decision(spark, d):
    own = _callers(spark, d).agg(
        F.count("*").alias("callers"), (F.countDistinct("file_path") > 1).alias("crosses"), F.count_if(file_paths.is_test_like(F.col("file_path"))).alias("tests"), F.coalesce(F.bool_or(F.col("provenance") == model.VERIFIED), F.lit(False)).alias("verified")
    )
    decision = verdicts.change_decision(F.col("callers"), F.col("tests"), F.lit(0), F.col("crosses"), F.col("verified"), F.lit(True))
    return own.select("callers", "tests", decision.alias("decision"))


@query(
    """, t as (select id, language from nodes where label = 'cold bolt' and type <> 'External'), e2 as (select e.*, 1 as depth from edges e join t on to_id = t.id where relation in ('REFERENCES', 'IMPORTS'))
    select from_id, to_id, relation, (select count(distinct language) from t) as groups from e2 order by (provenance = 'LSP_VERIFIED') desc, confidence desc, from_id, to_id, relation limit 15"""
)
def v34_callers_of_a_name(spark, d):
    """The name is resolved, its groups are counted, and the callers of all of them are ranked."""
    found = suggest.resolve(tg.nodes(spark, d), "cold bolt").join(tg.nodes(spark, d).filter("type <> 'External'").select("id", "language"), "id")
    hits = traverse.reach(tg.incoming(spark, d), found.select(F.col("id").alias("node")), ["REFERENCES", "IMPORTS"], 1)
    groups = found.agg(F.countDistinct("language").alias("groups"))  # one row
    own = hits.withColumn("from_test", F.lit(False)).withColumn("fan_in", F.lit(0)).crossJoin(F.broadcast(groups))
    return ranking.rank_callers(own, ["from_id", "to_id", "relation"]).select("from_id", "to_id", "relation", "groups").limit(15)


@query(
    """, walk(id, depth) as (select 'N3', 0 union select case when e.from_id = w.id then e.to_id else e.from_id end, depth + 1 from walk w join edges e on (e.from_id = w.id or e.to_id = w.id) and relation in ('CONTAINS', 'CALLS') where depth < 2)
    select id, min(depth)::int as depth from walk where id <> 'N3' group by 1"""
)
def v36_neighbours_to_a_depth(spark, d):
    e = tg.edges(spark, d)
    both = e.unionByName(e.withColumn("x", F.col("from_id")).withColumn("from_id", F.col("to_id")).withColumn("to_id", F.col("x")).drop("x"))
    met = traverse.reach(both, ["N3"], ["CONTAINS", "CALLS"], 2)
    return met.groupBy(F.col("from_id").alias("id")).agg(F.min("depth").alias("depth")).filter("id <> 'N3'")


@query(
    """select 'self' as layer, id as item, type as said from nodes where id = 'C3' union all select 'holds', to_id, relation from edges where from_id = 'C3' union all select 'held by', from_id, relation from edges where to_id = 'C3'
    union all select 'features', 'r' || r_regionkey, 'file' from region join nodes n on n.id = 'C3' and starts_with(n.file_path, r_name || '/')"""
)
def v42_pull(spark, d):
    """A node in its layers: itself, its edges both ways, and the features that its file belongs to."""
    own = tg.nodes(spark, d).filter("id = 'C3'")
    out = tg.edges(spark, d).filter("from_id = 'C3'").selectExpr("'holds' as layer", "to_id as item", "relation as said")
    into = tg.incoming(spark, d).filter("to_id = 'C3'").selectExpr("'held by' as layer", "from_id as item", "relation as said")
    members = overlays.membership(own.select(F.col("file_path").alias("file")), linking._features(spark, d)).selectExpr("'features' as layer", "feature as item", "'file' as said")
    return own.selectExpr("'self' as layer", "id as item", "type as said").unionByName(out).unionByName(into).unionByName(members)


_CHANGED = ["orders/f1.py", "orders/f2.py", "ASIA/NATION_2"]


@query(
    f""", own as (select id from nodes where file_path in {in_list(_CHANGED)}), hit as (select distinct e.from_id, n.file_path from edges e join own on to_id = own.id join nodes n on n.id = from_id where relation in ('CALLS', 'REFERENCES', 'USES_TYPE', 'CONTAINS')),
    layers as (select count(distinct split_part(file_path, '/', 1)) as k from (select unnest({_CHANGED}) as file_path)), t as (select count(*) as affected, count(distinct split_part(file_path, '/', 1)) as tops from hit)
    select affected, tops, round(greatest(greatest(k - 1, 0) * 1.5 + log2(1 + affected), 0), 1)::double as risk from t, layers"""
)
def v17_explain_diff(spark, d):
    """What a change of files reaches, and how risky that is."""
    n = tg.nodes(spark, d).select("id", "file_path")
    changed = spark.createDataFrame([(f,) for f in _CHANGED], "file_path string")
    own = n.join(F.broadcast(changed), "file_path", "left_semi").select(F.col("id").alias("to_id"))  # the files of one change
    hit = tg.incoming(spark, d).filter(F.col("relation").isin("CALLS", "REFERENCES", "USES_TYPE", "CONTAINS")).join(own, "to_id", "left_semi").select(F.col("from_id").alias("id")).distinct().join(n, "id")
    top = F.substring_index("file_path", "/", 1)
    sums = hit.agg(F.count("*").alias("affected"), F.countDistinct(top).alias("tops")).crossJoin(changed.agg(F.countDistinct(top).alias("k")))  # one row each
    from graphweft.functions.scalars import risk_score

    return sums.select("affected", "tops", risk_score(F.col("k"), F.col("affected"), F.lit(0), F.lit(False)).alias("risk"))


@query(
    f""", own as (select id from nodes where file_path = 'orders/f1.py'), into_ as (select 'caller' as what, from_id as item from edges join own on to_id = id union all select 'callee', to_id from edges join own on from_id = id),
    f as (select 'feature' as what, 'r1' as item), n as (select what, item, count(*) as n from into_ group by 1, 2 union all select what, item, 1 from f), r as (select *, row_number() over (partition by what order by n desc, item) as rn from n)
    select what, item, n from r where rn <= 5"""
)
def v16_consequences(spark, d):
    """What a file's symbols call, who calls them, and the features that hold it: the first five of each."""
    own = tg.nodes(spark, d).filter("file_path = 'orders/f1.py'").select("id", F.col("file_path").alias("file"))
    into = tg.incoming(spark, d).join(own.select(F.col("id").alias("to_id")), "to_id", "left_semi").selectExpr("'caller' as what", "from_id as item")
    out = tg.edges(spark, d).join(own.select(F.col("id").alias("from_id")), "from_id", "left_semi").selectExpr("'callee' as what", "to_id as item")
    held = overlays.membership(own.select("file").distinct(), linking._features(spark, d)).selectExpr("'feature' as what", "feature as item")
    counted = into.unionByName(out).unionByName(held).groupBy("what", "item").agg(F.count("*").alias("n"))
    return rel.top_per_group(counted, "what", [F.desc("n"), "item"], 5).select("what", "item", "n")


@query(
    f""", c as ({_CALLERS}), target as (select id, label from nodes where id = 'P1'), s(place, section, text) as (select 1, 'target', id || ' ' || label from target union all select 2, 'callers', count(*)::varchar || ' callers' from c
    union all select 3, 'files', string_agg(distinct file_path, ' ' order by file_path) from c) select place::int as place, section, case when section = 'files' and length(text) > 20 then 'files: ' || (select count(distinct file_path) from c) else text end as text from s"""
)
def v6_packet(spark, d):
    """A target with what surrounds it, folded to a budget; the target itself always stays."""
    c = _callers(spark, d)
    target = tg.nodes(spark, d).filter("id = 'P1'").select(F.lit(1).alias("place"), F.lit("target").alias("section"), F.concat_ws(" ", "id", "label").alias("text"), F.lit("").alias("collapsed"), F.lit(True).alias("kept"))
    count = c.agg(F.concat(F.count("*"), F.lit(" callers")).alias("text")).select(F.lit(2).alias("place"), F.lit("callers").alias("section"), "text", F.col("text").alias("collapsed"), F.lit(False).alias("kept"))
    places = c.agg(F.array_join(F.sort_array(F.collect_set("file_path")), " ").alias("text"), F.concat(F.lit("files: "), F.countDistinct("file_path")).alias("collapsed"))
    files = places.select(F.lit(3).alias("place"), F.lit("files").alias("section"), "text", "collapsed", F.lit(False).alias("kept"))
    return ranking.clamp_sections(target.unionByName(count).unionByName(files), 60).select("place", "section", "text")


@query("select n.id, n.type, n.label, (select count(*) from edges where to_id = n.id) as incoming, (select count(*) from edges where from_id = n.id) as outgoing from nodes n where n.id = 'S1'")
def v41_summary(spark, d):
    into = tg.incoming(spark, d).filter("to_id = 'S1'").agg(F.count("*").alias("incoming"))
    out = tg.edges(spark, d).filter("from_id = 'S1'").agg(F.count("*").alias("outgoing"))
    return tg.nodes(spark, d).filter("id = 'S1'").select("id", "type", "label").crossJoin(into).crossJoin(out)  # one row each


@query(
    """, own as (select id, file_path from nodes where id in ('O1', 'C3', 'O98')), near as (select n.file_path, count(*) as n from edges e join own on e.from_id = own.id or e.to_id = own.id join nodes n on n.id = case when e.from_id = own.id then e.to_id else e.from_id end where n.file_path <> '' group by 1)
    select file_path, (sum(n))::bigint as n from (select file_path, 100 * count(*) as n from own group by 1 union all select * from near) group by 1 order by n desc, file_path limit 4"""
)
def v40_explore(spark, d):
    """The files to open for some symbols: their own first, then those with most edges to them."""
    n = tg.nodes(spark, d).select("id", "file_path")
    own = n.filter(F.col("id").isin("O1", "C3", "O98"))
    ids = [F.broadcast(own.select(F.col("id").alias(c))) for c in ("from_id", "to_id")]  # the few that were asked for
    other = tg.edges(spark, d).join(ids[0], "from_id", "left_semi").select(F.col("to_id").alias("id")).unionAll(tg.incoming(spark, d).join(ids[1], "to_id", "left_semi").select("from_id"))
    near = other.join(n, "id").filter("file_path <> ''").groupBy("file_path").agg(F.count("*").alias("n"))
    return own.groupBy("file_path").agg((F.count("*") * 100).alias("n")).unionByName(near).groupBy("file_path").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "file_path").limit(4)


@query("select file_path, count(*) as n from nodes where starts_with(file_path, 'orders/') group by 1 order by n desc, file_path limit 10")
def v31_read_order(spark, d):
    own = tg.nodes(spark, d).filter("startswith(file_path, 'orders/')").groupBy("file_path").agg(F.count("*").alias("n"))
    return own.orderBy(F.desc("n"), "file_path").limit(10)


def _records(spark, d):
    return tg.table(spark, d, "events").selectExpr("event_id as seq", "concat('col', user_id % 3) as collection", "event_type as kind", "concat('s', user_id) as symbol", "concat('f', event_id % 20, '.cpp') as file", "int(event_id % 300) as line", "value")


_RECORDS = "records as (select event_id as seq, 'col' || (user_id % 3) as collection, event_type as kind, 's' || user_id as symbol, 'f' || (event_id % 20) || '.cpp' as file, (event_id % 300)::int as line, value from events)"


@query(f"with {_RECORDS} select seq, kind, file, line from records where collection = 'col1' and symbol = 's4' and kind = 'click' order by file, line, seq limit 20", graph=False)
def v11_replayed_records(spark, d):
    own = rel.by_keys(_records(spark, d), collection="col1", symbol="s4", kind="click", file=None)
    return own.orderBy("file", "line", "seq").select("seq", "kind", "file", "line").limit(20)


@query(f"with {_RECORDS} select seq, symbol, line from records where file = 'f3.cpp' and kind = 'signup' order by line, symbol, seq limit 30", graph=False)
def v13_symbols_of_a_file(spark, d):
    return rel.by_keys(_records(spark, d), file="f3.cpp", kind="signup").orderBy("line", "symbol", "seq").select("seq", "symbol", "line").limit(30)


@query(f"with {_RECORDS} select file, count(*) as n, max(value) as worst from records where kind = 'error' group by 1", graph=False)
def v7_diagnostics_by_file(spark, d):
    return _records(spark, d).filter("kind = 'error'").groupBy("file").agg(F.count("*").alias("n"), F.max("value").alias("worst"))


@query(f"with {_RECORDS}, defs as (select distinct file, line from records where symbol = 's4' and kind = 'signup') select seq, exists (select 1 from defs x where x.file = r.file and x.line = r.line) as is_definition from records r where symbol = 's4'", graph=False)
def v8_v9_references_and_definitions(spark, d):
    own = _records(spark, d).filter("symbol = 's4'")
    return evidence.split_definitions(own, own.filter("kind = 'signup'").select("file", "line")).select("seq", "is_definition")


@query(f"with {_RECORDS} select file, arg_max(seq, (line, seq)) as seq from records where kind = 'view' or kind = 'purchase' group by 1", graph=False)
def v10_latest_hover(spark, d):
    return _records(spark, d).filter("kind in ('view', 'purchase')").groupBy("file").agg(F.max_by("seq", F.struct("line", "seq")).alias("seq"))


@query(f"with {_RECORDS} select collection, kind, count(*) as n, count(distinct file) as files from records group by 1, 2", graph=False)
def v12_v15_collections_at_a_glance(spark, d):
    return _records(spark, d).groupBy("collection", "kind").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


@query("select id, type, label, count(*) over () as total from nodes where type = 'Type' and contains(label, 'bolt') order by label, id limit 10 offset 5")
def e1_page_of_nodes(spark, d):
    """A page of a dashboard's table, with how many rows there are in all."""
    own = tg.nodes(spark, d).filter("type = 'Type' and contains(label, 'bolt')").select("id", "type", "label")
    total = own.agg(F.count("*").alias("total"))  # one row
    return own.orderBy("label", "id").offset(5).limit(10).crossJoin(F.broadcast(total))


@query("select type, relation, count(*) as n from edges join nodes on id = from_id group by all union all select type, '(nodes)', count(*) from nodes group by 1")
def e1_dashboard_counts(spark, d):
    n = tg.nodes(spark, d)
    by = tg.edges(spark, d).join(n.select(F.col("id").alias("from_id"), "type"), "from_id").groupBy("type", "relation").agg(F.count("*").alias("n"))
    return by.unionByName(n.groupBy("type").agg(F.count("*").alias("n")).select("type", F.lit("(nodes)").alias("relation"), "n"))


@query("select file_path, count(*) as symbols, min(label) as first from nodes where file_path <> '' and type in ('Function', 'Class') group by 1 order by symbols desc, file_path limit 12")
def e2_mart_of_files(spark, d):
    own = tg.nodes(spark, d).filter("file_path <> '' and type in ('Function', 'Class')")
    return own.groupBy("file_path").agg(F.count("*").alias("symbols"), F.min("label").alias("first")).orderBy(F.desc("symbols"), "file_path").limit(12)


@query("select count(*) as n from edges")
def s17_digest_of_the_stored_graph(spark, d):
    """The two copies of the edges hold the same rows: their digests agree."""
    g = tg.graph(spark, d)
    return sinks.digest(g.outgoing).join(sinks.digest(g.incoming), ["n", "digest"]).select("n")
