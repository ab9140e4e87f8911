"""Queries that resolve references, read documents, and lay features and evidence over the graph.

The inputs are derived from the driver's tables, so that the SQL can say what must come out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from graphweft.operators import documents, evidence, overlays, resolver
from graphweft.plans.base import query
from graphweft.sources import testgraph as tg

# References of orders to parts: qualified names, suffixes, paths and labels, in two languages.


def _code(spark, d):
    label = "concat(translate(p_name, ' ', '_'), p_size % 4)"
    brand = "translate(p_brand, '#', '')"
    path = f"concat('src/', {brand}, '/f', p_partkey % 3, '.py')"
    own = tg.table(spark, d, "part").selectExpr(
        "concat('P', p_partkey) as id", "'Function' as type", f"{label} as label", f"concat('pkg', p_size % 5, '.', {brand}, '.', {label}) as qname", f"{path} as file_path", "if(p_size % 2 = 0, 'python', 'cpp') as language"
    )
    files = own.select("file_path").distinct().selectExpr("concat('F:', file_path) as id", "'File' as type", "element_at(split(file_path, '/'), -1) as label", "'' as qname", "file_path", "'python' as language")
    return own.unionByName(files)


def _refs(spark, d):
    parts = tg.table(spark, d, "part").selectExpr("p_partkey", "translate(p_brand, '#', '') as brand", "concat(translate(p_name, ' ', '_'), p_size % 4) as label", "concat('pkg', p_size % 5) as pkg", "p_partkey % 3 as f")
    o = tg.table(spark, d, "orders").selectExpr("o_orderkey as ref_id", "o_orderkey % 150 as p_partkey", "int(o_orderkey % 4) as form", "o_custkey")
    return o.join(parts, "p_partkey").selectExpr(
        "ref_id", "concat('src/Brand', o_custkey % 25 + 1, '/f', o_custkey % 3, '.py') as source_file", "case when form = 2 then 'IMPORTS' when ref_id % 3 = 0 then 'LINKS_TO' else 'CALLS' end as relation",
        "case form when 0 then concat(pkg, '.', brand, '.', label) when 1 then concat(brand, '.', label) when 2 then concat(brand, '/f', f, '.py') else label end as target", "if(ref_id % 5 = 4, 'php', 'python') as extractor",
    )


_CODE = """n as (select 'P' || p_partkey as id, 'Function' as type, replace(p_name, ' ', '_') || (p_size % 4) as label, 'pkg' || (p_size % 5) || '.' || replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '_') || (p_size % 4) as qname,
'src/' || replace(p_brand, '#', '') || '/f' || (p_partkey % 3) || '.py' as file_path, case when p_size % 2 = 0 then 'python' else 'c_cpp' end as family from part),
nn as (select * from n union all select distinct 'F:' || file_path, 'File', string_split(file_path, '/')[-1], '', file_path, 'python' from n),
r as (select o_orderkey as ref_id, o_orderkey % 4 as form, 'src/Brand' || (o_custkey % 25 + 1) || '/f' || (o_custkey % 3) || '.py' as source_file, 'src/Brand' || (o_custkey % 25 + 1) || '/' as dir,
case when o_orderkey % 4 = 2 then 'IMPORTS' when o_orderkey % 3 = 0 then 'LINKS_TO' else 'CALLS' end as relation, case when o_orderkey % 5 = 4 then 'php' else 'python' end as family,
case o_orderkey % 4 when 0 then n.qname when 1 then replace(p_brand, '#', '') || '.' || n.label when 2 then replace(p_brand, '#', '') || '/f' || (p_partkey % 3) || '.py' else n.label end as target
from orders join part on p_partkey = o_orderkey % 150 join n on n.id = 'P' || p_partkey),
cand as (select r.*, n.id, n.file_path, n.family = r.family as same from r join nn n on (form = 0 and n.qname = target) or (form = 1 and ends_with(n.qname, '.' || target)) or (form = 2 and n.type = 'File' and ends_with(n.file_path, '/' || target)) or (form = 3 and n.label = target)),
c as (select * from cand qualify same or (count(*) filter (same) over (partition by ref_id) = 0 and relation <> 'CALLS')),
a as (select ref_id, any_value(form) as form, count(*) as k, min(id) as one, count(*) filter (file_path = source_file) as kf, min(id) filter (file_path = source_file) as f1, count(*) filter (starts_with(file_path, dir)) as kd, min(id) filter (starts_with(file_path, dir)) as d1 from c group by 1),
ans as (select ref_id, form, k, case when k = 1 then one when kf = 1 then f1 when kd = 1 then d1 end as to_id from a),
res as (select r.ref_id, r.relation, r.target, r.family, to_id, case when to_id is null then null when k > 1 then 'AMBIGUOUS' when ans.form in (0, 3) then 'EXTRACTED' else 'INFERRED' end as provenance, case when to_id is null then null when ans.form = 3 then 4 else ans.form end as rule from r left join ans using (ref_id))"""


@query(f"with {_CODE} select ref_id, to_id, provenance, coalesce(rule, -1)::int as rule from res", graph=False)
def i3_j13_j23_resolved_references(spark, d):
    own = resolver.resolve(_refs(spark, d), _code(spark, d))
    return own.select("ref_id", "to_id", "provenance", F.coalesce("rule", F.lit(-1)).alias("rule"))


# Customers as classes, each with two bases; some have methods, and orders call them through a class.


def _classes(spark, d):
    c = tg.table(spark, d, "customer")
    own = c.selectExpr("concat('K', c_custkey) as id", "'Class' as type", "concat('C', c_custkey) as label", "concat('pkg', c_nationkey, '.C', c_custkey) as qname", "concat('src/', c_nationkey, '/f', c_custkey % 3, '.py') as file_path", "'python' as language")
    members = c.selectExpr("c_custkey", "c_nationkey", "inline(array(struct('save' as name, c_custkey % 7 = 0 as has), struct('load' as name, c_custkey % 11 = 0 as has)))").filter("has")
    members = members.selectExpr("concat('K', c_custkey, '.', name) as id", "'Method' as type", "name as label", "'' as qname", "concat('src/', c_nationkey, '/f', c_custkey % 3, '.py') as file_path", "'python' as language")
    return own.unionByName(members), members.selectExpr("substring_index(id, '.', 1) as from_id", "id as to_id")


def _class_refs(spark, d):
    c = tg.table(spark, d, "customer").filter("c_custkey > 2")
    bases = c.selectExpr("explode(array(2, 3)) as k", "c_custkey", "c_nationkey").selectExpr("concat('e', c_custkey, '/', k) as ref_id", "concat('K', c_custkey) as from_id", "concat('src/', c_nationkey, '/f', c_custkey % 3, '.py') as source_file", "if(k = 2, 'EXTENDS', 'IMPLEMENTS') as relation", "concat('C', c_custkey div k) as target", "'python' as extractor")
    calls = tg.table(spark, d, "orders").selectExpr("concat('o', o_orderkey) as ref_id", "concat('O', o_orderkey) as from_id", "'app/main.py' as source_file", "'CALLS' as relation", "concat('C', o_custkey, if(o_orderkey % 2 = 0, '.save', '.load')) as target", "if(o_orderkey % 5 = 4, 'php', 'python') as extractor")
    return bases.unionByName(calls)


@query(
    """with recursive ext as (select c_custkey as src, c_custkey // k as dst from customer, (select unnest([2, 3]) as k) where c_custkey > 2),
    up(src, class, depth) as (select c_custkey, c_custkey, 0 from customer union select up.src, ext.dst, up.depth + 1 from up join ext on ext.src = up.class),
    level as (select src, class, min(depth) as depth from up group by 1, 2),
    met as (select src, name, arg_min('K' || class || '.' || name, (depth, 'K' || class)) as to_id from level join customer on c_custkey = class, (select unnest(['save', 'load']) as name) where class % (case name when 'save' then 7 else 11 end) = 0 group by 1, 2)
    select 'o' || o_orderkey as ref_id, to_id, case when to_id is not null then 5 else -1 end as rule from orders left join met on src = o_custkey and name = case when o_orderkey % 2 = 0 then 'save' else 'load' end and o_orderkey % 5 <> 4
    union all select 'e' || src || '/' || k, 'K' || (src // k), 4 from (select c_custkey as src, unnest([2, 3]) as k from customer where c_custkey > 2)""",
    graph=False,
)
def i3_t15_members_of_bases(spark, d):
    nodes, contains = _classes(spark, d)
    found = resolver.resolve_with_bases(_class_refs(spark, d), nodes, contains)
    return found.select("ref_id", "to_id", F.coalesce("rule", F.lit(-1)).alias("rule"))


@query(
    f"with {_CODE} select distinct 'external:' || substr(sha1(family || ':' || target), 1, 16) as id, target as label, family as language from res where to_id is null and relation in ('CALLS')", graph=False
)
def i4_externals(spark, d):
    open_ = resolver.resolve(_refs(spark, d), _code(spark, d)).filter("to_id is null")
    return resolver.externals(open_)


@query(
    """with names as (select 'm' || k as target, 'N' || k as to_id from range(20) t(k)) select distinct a.to_id as from_id, b.to_id, 'PASSES_THROUGH' as relation from (select 'm' || (o_custkey % 30) as f, 'm' || (o_orderkey % 25) as t from orders) x join names a on a.target = f join names b on b.target = t""",
    graph=False,
)
def i5_symbolic_chains(spark, d):
    refs = tg.table(spark, d, "orders").selectExpr("o_orderkey as ref_id", "concat('m', o_custkey % 30) as from_target", "concat('m', o_orderkey % 25) as target", "'PASSES_THROUGH' as relation")
    return resolver.chains(refs, spark.range(20).selectExpr("concat('m', id) as target", "concat('N', id) as to_id"))


@query("select c_custkey as id, case when c_custkey % 3 = 0 then 'stored' else 'pending' end as origin from customer", graph=False)
def u9_stored_and_pending(spark, d):
    c = tg.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return resolver.merged(c.filter("id % 3 = 0").withColumn("origin", F.lit("stored")), c.withColumn("origin", F.lit("pending"))).select("id", "origin")


@query(
    "select o_orderkey as ref_id, case o_orderkey % 5 when 0 then 'src/m' || (o_orderkey % 5) || '.ts' when 1 then 'src/m1.js' when 2 then 'src/m2/index.ts' when 3 then 'src/m3' end as file from orders", graph=False
)
def f18_probed_imports(spark, d):
    files = spark.createDataFrame([("src/m0.ts",), ("src/m1.js",), ("src/m1.ts",), ("src/m2/index.ts",), ("src/m3",), ("src/m3.js",)], "file string")
    imports = tg.table(spark, d, "orders").selectExpr("o_orderkey as ref_id", "concat('src/m', o_orderkey % 5) as path")
    return resolver.probed(imports, files).select("ref_id", "file")


@query(
    """select o_orderkey, case o_orderkey % 6 when 0 then null when 1 then 'app/lib/x' || o_custkey when 2 then 'src/x' || o_custkey when 3 then 'src/deep/x' || o_custkey when 4 then 'pkg/x' || o_custkey end as path from orders""", graph=False
)
def f19_import_specifiers(spark, d):
    x = F.concat(F.lit("x"), F.col("o_custkey"))
    spelt = F.element_at(F.array(F.lit("node:fs"), F.concat(F.lit("../lib/"), x), F.concat(F.lit("@/"), x), F.concat(F.lit("@/deep/"), x), F.concat(F.lit("pkg/"), x), x), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return tg.table(spark, d, "orders").select("o_orderkey", resolver.aliased(spelt, F.lit("app/main/a.ts"), {"@/*": "src/*", "@/deep/*": "src/deep/*"}).alias("path"))


# Documents of nations: links, paths and names of code.

_TEXT = "concat('# Doc\\nsee [a](../src/f', k, '.py#L3) and `src/f', k, '.py` and [b](https://x.org/y)\\n```\\n[hidden](src/f0.py)\\n```\\n`f', k, '.py` `tools/call` `gone/x.py` [self](n', k, '.md)\\n`pkg.f', k, '.run()` and `src/f', k, '.py` has `main`')"


def _docs(spark, d):
    return tg.table(spark, d, "nation").selectExpr("n_nationkey as k").selectExpr("k", "concat('docs/n', k, '.md') as doc", f"{_TEXT} as text")


def _files(spark, d):
    n = tg.table(spark, d, "nation").selectExpr("n_nationkey as k")
    return n.filter("k % 2 = 0").selectExpr("concat('F', k) as id", "concat('src/f', k, '.py') as file_path").unionByName(n.selectExpr("concat('D', k) as id", "concat('docs/n', k, '.md') as file_path"))


def _classified(spark, d):
    return documents.classified(documents.references(_docs(spark, d)), _files(spark, d))


@query(
    """select 'docs/n' || k || '.md' as doc, line_no, seq, rule, replace(target, '#K', k::varchar) as target from (select n_nationkey as k from nation) n cross join
    (values (2, 0, 'markdown', '../src/f#K.py#L3'), (2, 1, 'markdown', 'https://x.org/y'), (2, 2, 'inline-path', 'src/f#K.py'), (6, 0, 'markdown', 'n#K.md'), (6, 1, 'inline-path', 'f#K.py'), (6, 2, 'inline-path', 'tools/call'),
    (6, 3, 'inline-path', 'gone/x.py'), (7, 0, 'inline-path', 'src/f#K.py')) t(line_no, seq, rule, target)""",
    graph=False,
)
def d1_document_references(spark, d):
    return documents.references(_docs(spark, d))


@query(
    """select 'docs/n' || k || '.md' as doc, line_no, seq, kind, case when kind = 'resolved' then id end as id, reason from (select k, line_no, seq, case when x = 'out' then 'external' when x = 'self' or x = 'src' and k % 2 = 0 then 'resolved' else 'unresolved' end as kind,
    case when x = 'self' then 'D' || k when x = 'src' then 'F' || k end as id, case when x = 'src' and k % 2 = 1 or x = 'gone' then 'no_such_path' when x = 'prose' then 'not_a_file_reference' end as reason from (select n_nationkey as k from nation) n cross join
    (values (2, 0, 'src'), (2, 1, 'out'), (2, 2, 'src'), (6, 0, 'self'), (6, 1, 'gone'), (6, 2, 'prose'), (6, 3, 'gone'), (7, 0, 'src')) t(line_no, seq, x))""",
    graph=False,
)
def d2_f17_classified_targets(spark, d):
    return _classified(spark, d).select("doc", "line_no", "seq", "kind", "id", "reason")


def _links(spark, d):
    return documents.links(_classified(spark, d), _docs(spark, d).selectExpr("doc", "concat('D', k) as doc_id"))


@query("select 'D' || n_nationkey as from_id, 'F' || n_nationkey as to_id, 2 as source_line, 'markdown' as rule, 0.95::double as confidence from nation where n_nationkey % 2 = 0", graph=False)
def d3_document_links(spark, d):
    return _links(spark, d)


@query("select reason, (case reason when 'no_such_path' then 2 * (select count(*) from nation) + 3 * (select count(*) from nation where n_nationkey % 2 = 1) else (select count(*) from nation) end)::bigint as n from (values ('no_such_path'), ('not_a_file_reference')) t(reason)", graph=False)
def d3_missed_links(spark, d):
    return documents.misses(_classified(spark, d))


@query("select 'docs/n' || n_nationkey || '.md' as doc, 7 as line_no, 'pkg.f' || n_nationkey || '.run' as name from nation", graph=False)
def d4_qualified_names(spark, d):
    return documents.qualified_names(_docs(spark, d))


def _mentions(spark, d):
    n = tg.table(spark, d, "nation").selectExpr("n_nationkey as k")
    symbols = n.selectExpr("concat('S', k) as id", "'main' as label", "concat('src/f', k, '.py') as file_path")
    suffixes = n.selectExpr("concat('pkg.f', k, '.run') as suffix", "if(k = 3, null, concat('R', k)) as resolved")
    return documents.mentions(_docs(spark, d), symbols, _files(spark, d), suffixes)


@query(
    """select 'docs/n' || n_nationkey || '.md' as doc, 'R' || n_nationkey as to_id, 7 as source_line, 'qualified' as rule, 0.9::double as confidence from nation where n_nationkey <> 3
    union all select 'docs/n' || n_nationkey || '.md', 'S' || n_nationkey, 7, 'path-scoped', 0.85 from nation where n_nationkey % 2 = 0""",
    graph=False,
)
def d7_d8_mentions(spark, d):
    return _mentions(spark, d)


def _doc_edges(spark, d):
    named = _mentions(spark, d).selectExpr("concat('D', regexp_extract(doc, 'n([0-9]+)', 1)) as from_id", "to_id", "'MENTIONS' as relation", "rule as provenance")
    return _links(spark, d).selectExpr("from_id", "to_id", "'LINKS_TO' as relation", "rule as provenance").unionByName(named)


@query("select 'both' as how, count(*) as n from nation where n_nationkey % 2 = 0 union all select 'mention_only', count(*) from nation where n_nationkey % 2 = 1 and n_nationkey <> 3", graph=False)
def g11_document_relations(spark, d):
    return documents.breakdown(_doc_edges(spark, d))


@query("select 'D' || n_nationkey as from_id, 2 as n_nodes, 'markdown,qualified' as provenances from nation where n_nationkey % 2 = 0 order by 1 limit 5", graph=False)
def j17_documents_that_mention(spark, d):
    n = tg.table(spark, d, "nation")
    targets = n.selectExpr("concat('F', n_nationkey) as id").unionAll(n.filter("n_nationkey % 2 = 0").selectExpr("concat('R', n_nationkey)"))
    return documents.mentioned_in(_doc_edges(spark, d), targets, 5).withColumn("n_nodes", F.col("n_nodes").cast("int"))


@query(
    """select 'D' || n_nationkey as id, 0::bigint as inbound, case when n_nationkey % 2 = 0 then 1 else 0 end::bigint as outbound, (case when n_nationkey = 3 then 0 else 1 end + case when n_nationkey % 2 = 0 then 1 else 0 end)::bigint as mentions from nation
    order by n_nationkey % 4 desc, (case when n_nationkey % 2 = 0 then 3 when n_nationkey = 3 then 0 else 1 end) desc, 'docs/n' || n_nationkey || '.md' limit 8""",
    graph=False,
)
def d9_documents_to_read(spark, d):
    own = tg.table(spark, d, "nation").selectExpr("concat('D', n_nationkey) as id", "concat('docs/n', n_nationkey, '.md') as file_path", "n_nationkey % 4 as changed")
    return documents.candidates(own, _doc_edges(spark, d), 8)


# Features of regions over the graph's files.


def _features(spark, d):
    return tg.table(spark, d, "region").selectExpr(
        "concat('r', r_regionkey) as id", "array(concat('orders/f', r_regionkey, '*.py'), concat(r_name, '/**'), 'orders/f96.py') as files", "array(concat('order_', r_regionkey), 'nothing') as symbols", "array(r_name) as docs", "array('GET /') as routes",
        "if(r_regionkey % 2 = 0, array('t'), array()) as tests", "if(r_regionkey = 1, array('r0'), array()) as depends_on",
    )


_MEMBERS = """files as (select distinct file_path as file from nodes where file_path <> ''), members as (select distinct file, 'r' || r_regionkey as feature from files join region on file glob ('orders/f' || r_regionkey || '*.py') or starts_with(file, r_name || '/') or file = 'orders/f96.py')"""


def _file_table(spark, d):
    return tg.nodes(spark, d).filter("file_path <> ''").select(F.col("file_path").alias("file")).distinct()


@query(f", {_MEMBERS} select * from members")
def j15_features_of_files(spark, d):
    return overlays.membership(_file_table(spark, d), _features(spark, d))


@query(
    """select 'r' || r_regionkey as feature, 7::bigint as declared, ((select count(*) > 0 from nodes where type = 'Function' and label = 'order_' || r_regionkey)::int + (select count(*) > 0 from nodes where type = 'Directory' and starts_with(file_path, r_name || '/'))::int)::bigint as resolved, true as broken from region"""
)
def j14_validated_anchors(spark, d):
    return overlays.anchors(_features(spark, d), tg.nodes(spark, d))


def _tasks(spark, d):
    return tg.table(spark, d, "orders").selectExpr(
        "concat('T', o_orderkey) as id", "if(o_orderkey % 10 = 0, concat('mend F', o_orderkey % 97, ' now'), 'other') as title", "case o_orderstatus when 'F' then 'Done' when 'O' then 'in progress' else 'someday' end as status",
        "if(o_orderkey % 4 = 0, array(), array(concat('r', o_custkey % 5))) as features", "if(o_orderkey % 7 = 0, array(concat('f', o_orderkey % 97, '.py')), array()) as files_hint", "if(o_orderkey % 3 = 0, 'commit: x', 'roadmap') as evidence", "cast(null as string) as link_strength",
    )


_TASKS = """tasks as (select 'T' || o_orderkey as id, o_orderkey as k, o_custkey % 5 as r, o_orderstatus as status, o_orderkey % 4 <> 0 as linked, o_orderkey % 7 = 0 as hinted, o_orderkey % 3 = 0 as strong from orders)"""


@query(
    f""", {_MEMBERS}, {_TASKS}, own as (select file from files where file in ('orders/f14.py', 'orders/f2.py', 'ASIA/NATION_2'))
    select file, id as task, how from (select file, id, 'files_hint' as how, 0 as p from own join tasks on hinted and ends_with(file, '/f' || (k % 97) || '.py') union all select file, id, 'feature', 1 from own join members using (file) join tasks on linked and feature = 'r' || r)
    qualify row_number() over (partition by file, id order by p) = 1"""
)
def j16_tasks_of_files(spark, d):
    own = _file_table(spark, d).filter(F.col("file").isin("orders/f14.py", "orders/f2.py", "ASIA/NATION_2"))
    return overlays.tasks_of_files(_tasks(spark, d), own, overlays.membership(own, _features(spark, d)))


@query(
    f"""with {_TASKS} select (select count(*) from region) as features, (select count(*) from region where r_regionkey % 2 = 0) as with_tests, (select count(*) from region) as with_docs, (select count(*) from region where r_regionkey = 1) as with_depends_on, count(*) as tasks,
    count(*) filter (linked and (strong or hinted) and (strong or not (hinted and not strong))) as strong, count(*) filter (linked and hinted and not strong) as mixed, count(*) filter (linked and not strong and not hinted) as broad, count(*) filter (not linked) as unlinked from tasks""",
    graph=False,
)
def g19_overlay_quality(spark, d):
    return overlays.quality(_features(spark, d), _tasks(spark, d))


@query(
    """, dirty as (select unnest(['orders/f1.py', 'orders/f1.py', 'build/x.o', 'orders/f96.py', 'nowhere.txt', 'ASIA/NATION_2']) as file)
    select seam, count(*) as n from (select distinct file, seam from (select file, case when starts_with(file, 'build/') then '(scratch)' end as seam from dirty) where seam is not null
    union select distinct 'orders/f1.py', 'r1' union all select 'orders/f96.py', 'r' || r_regionkey from region union all select 'ASIA/NATION_2', 'r' || r_regionkey from region where r_name = 'ASIA' union all select 'nowhere.txt', '(orphan)') group by 1"""
)
def g21_dirty_seams(spark, d):
    dirty = spark.createDataFrame([(f,) for f in ["orders/f1.py", "orders/f1.py", "build/x.o", "orders/f96.py", "nowhere.txt", "ASIA/NATION_2", ""]], "file string")
    return overlays.dirty_seams(dirty, _features(spark, d))


@query(
    """, own as (select distinct file_path as file from nodes where file_path in ('ASIA/NATION_2', 'AFRICA/NATION_0', 'AFRICA/NATION_5', 'orders/f1.py')), told as (select case when starts_with(file, 'orders') then '(unassigned)' else split_part(file, '/', 1) end as layer, count(*) as n from own group by 1)
    select layer, n, (select count(*) from told where layer <> '(unassigned)') as crossing from told"""
)
def g23_layer_span(spark, d):
    own = _file_table(spark, d)
    changed = own.filter(F.col("file").isin("ASIA/NATION_2", "AFRICA/NATION_0", "AFRICA/NATION_5", "orders/f1.py"))
    layers = own.filter("file not like 'orders/%'").select(F.col("file").alias("path"), F.substring_index("file", "/", 1).alias("layer"))
    return overlays.layer_span(changed, layers)


@query(
    f""", {_MEMBERS}, ee as (select distinct a.file_path as from_file, b.file_path as to_file from edges join nodes a on from_id = a.id join nodes b on to_id = b.id where relation = 'CALLS' and a.file_path <> '' and b.file_path <> ''),
    both_ as (select m.feature, 'in' as direction, from_file, to_file, from_file as other_file from ee join members m on m.file = to_file union all select m.feature, 'out', from_file, to_file, to_file from ee join members m on m.file = from_file),
    told as (select b.feature, direction, from_file || '>' || to_file as edge, coalesce((select min(feature) from members x where x.file = other_file and x.feature <> b.feature), 'external') as other, exists (select 1 from members x where x.file = other_file and x.feature = b.feature) as own from both_ b)
    select feature, direction, other, count(*) as n, string_agg(edge, '|' order by edge) filter (rn <= 2) as shown from (select *, row_number() over (partition by feature, direction, other order by edge) as rn from told where not (own and other = 'external')) group by 1, 2, 3"""
)
def g27_feature_io(spark, d):
    n = tg.nodes(spark, d).filter("file_path <> ''").select("id", "file_path")
    a, b = (n.select(F.col("id").alias(f"{k}_id"), F.col("file_path").alias(f"{k}_file")) for k in ("from", "to"))
    crossing = tg.calls(spark, d).join(a, "from_id").join(b, "to_id").select("from_file", "to_file").distinct()
    return overlays.feature_io(crossing, overlays.membership(_file_table(spark, d), _features(spark, d)))


@query(
    f"""with {_TASKS} select case when linked then 'r' || r else '(none)' end as feature, count(*) filter (status <> 'F') as open, count(*) filter (status = 'F') as completed from tasks group by 1""", graph=False
)
def g32_task_counts(spark, d):
    return overlays.task_counts(_tasks(spark, d))


@query(
    f"""with {_TASKS} select 'r' || r as feature, row_number() over (partition by r order by case when strong then 1 when hinted then 2 else 3 end, id)::int as place, id from tasks where linked and status <> 'F'""", graph=False
)
def g32_open_tasks(spark, d):
    return overlays.open_tasks(_tasks(spark, d))


def _imports(spark, d):
    return tg.table(spark, d, "orders").selectExpr("concat(if(o_orderkey % 3 = 0, 'tests/t', 'src/t'), o_orderkey % 50, '.py') as source_file", "concat('orders/f', o_custkey % 97, '.py') as target_file")


@query("select distinct 'tests/t' || (o_orderkey % 50) || '.py' as test from orders where o_orderkey % 3 = 0 and o_custkey % 97 in (1, 2)", graph=False)
def j18_import_linked_tests(spark, d):
    return overlays.import_tests(_imports(spark, d), spark.createDataFrame([("orders/f1.py",), ("orders/f2.py",)], "file string"))


@query(f", {_MEMBERS}, bare as (select 'r' || r_regionkey as feature from region where r_regionkey % 2 = 1) select feature, count(*) as n from orders join members on file = 'orders/f' || (o_custkey % 97) || '.py' join bare using (feature) where o_orderkey % 3 = 0 group by 1")
def g19_inferred_tests(spark, d):
    return overlays.inferred_tests(_features(spark, d), _imports(spark, d))


@query("select 'lib/p' || p_partkey || '.cpp' as source, 'lib/p' || p_partkey || '.h' as header from part where p_size % 3 = 0", graph=False)
def j19_companion_files(spark, d):
    p = tg.table(spark, d, "part")
    return overlays.companions(p.selectExpr("concat('lib/p', p_partkey, '.cpp') as file").unionAll(p.filter("p_size % 3 = 0").selectExpr("concat('lib/p', p_partkey, '.h')")).unionAll(p.selectExpr("concat('inc/p', p_partkey, '.h')")))


@query(
    """, gone as (select id, label, file_path from nodes where type = 'Function' and id in ('O1', 'O3', 'O5')) select 'order_1' as name, file_path as file, count(distinct from_id) as callers from gone join edges on to_id = id where id = 'O1' and provenance = 'LSP_VERIFIED' group by 2
    union all select 'order_5', file_path, count(distinct from_id) from gone join edges on to_id = id where id = 'O5' and provenance = 'LSP_VERIFIED' group by 2"""
)
def j20_deleted_with_callers(spark, d):
    diff = [("orders/f1.py", "-export function order_1(a) {"), ("orders/f3.py", "-export function order_3() {"), ("lib/x.py", "+export async function order_3() {"), ("orders/f5.py", "-export class order_5 {"), ("orders/f5.py", "-function order_7() {"), ("orders/f5.py", "+  return order_5()")]
    return overlays.deleted_with_callers(spark.createDataFrame(diff, "file string, line string"), tg.nodes(spark, d), tg.edges(spark, d))


@query("select 'error' as level, 'unknown layer' as message, count(*) as n from nation where n_nationkey % 5 = 4 union all select 'error', 'no such file', count(*) from nation where n_nationkey % 7 = 0 union all select 'warning', 'layer without files', 1", graph=False)
def d12_validated_layers(spark, d):
    n = tg.table(spark, d, "nation")
    assigned = n.selectExpr("concat('n', n_nationkey) as path", "concat('L', n_nationkey % 5) as layer")
    return overlays.validated(assigned, spark.createDataFrame([(f"L{k}",) for k in (0, 1, 2, 3, 9)], "layer string"), n.filter("n_nationkey % 7 <> 0").selectExpr("concat('n', n_nationkey) as file"))


# Evidence of a compiler.


@query(
    """select 'c' || n_nationkey as collectionId, n_nationkey % 5 not in (0, 1, 2) as may_invalidate, n_nationkey % 5 = 4 and n_nationkey % 2 = 0 and n_nationkey % 3 <> 0 as may_replace,
    case n_nationkey % 5 when 0 then 'not ok' when 1 then 'no references' when 2 then 'empty scope' end as why_not_invalidate,
    case n_nationkey % 5 when 0 then 'not ok' when 1 then 'no references' when 2 then 'empty scope' else case when n_nationkey % 2 = 1 then 'no records' when n_nationkey % 3 = 0 then 'continues another' when n_nationkey % 5 = 3 then 'held to files' end end as why_not_replace from nation""",
    graph=False,
)
def m4_collection_authority(spark, d):
    case = F.col("n_nationkey") % 5
    files = F.when(case == 2, F.array().cast("array<string>")).when(case == 3, F.array(F.lit("a.cpp")))
    scope = F.struct(F.when(case.isin(2, 3), "files").alias("kind"), files.alias("files"))
    own = tg.table(spark, d, "nation").select(
        F.concat(F.lit("c"), F.col("n_nationkey")).alias("collectionId"), F.lit("clangd").alias("provider"), F.when(case == 0, "partial").otherwise("ok").alias("status"),
        F.struct(F.when(F.col("n_nationkey") % 3 == 0, 5).otherwise(0).alias("resumedFrom"), scope.alias("scope")).alias("session"),
        F.create_map(F.lit("references"), F.struct(F.when(case == 1, "not_collected").otherwise("ok").alias("status"))).alias("operations"),
        F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("records"),
    )
    return evidence.authority(own).drop("provider")


@query("select o_orderkey, o_orderkey % 4 = 0 as is_definition from orders", graph=False)
def j21_definitions_among_references(spark, d):
    refs = tg.table(spark, d, "orders").selectExpr("o_orderkey", "concat('f', o_orderkey % 10) as file", "o_orderkey as line")
    return evidence.split_definitions(refs, refs.filter("o_orderkey % 4 = 0").select("file", "line")).select("o_orderkey", "is_definition")


def _spans(spark, d):
    return tg.table(spark, d, "part").selectExpr(
        "concat('P', p_partkey) as id", "if(p_partkey % 3 = 0, 'Class', 'Method') as type", "concat('s', p_partkey % 8, '.cpp') as file_path", "int(p_partkey div 8 * 4 + 1) as start_line", "int(p_partkey div 8 * 4 + 1 + p_size) as end_line"
    )


_SPANS = "spans as (select 'P' || p_partkey as id, case when p_partkey % 3 = 0 then 0 else 1 end as callable, 's' || (p_partkey % 8) || '.cpp' as file, p_partkey // 8 * 4 + 1 as first, p_partkey // 8 * 4 + 1 + p_size as last from part)"
_DEFS = "defs as (select p_partkey as seq, 'y' || p_partkey as symbol, 's' || (p_partkey % 8) || '.cpp' as file, p_partkey // 8 * 4 + 2 as line from part where p_partkey % 5 = 0)"
_SYMBOLS = f"""{_SPANS}, {_DEFS}, best as (select seq, arg_max(id, (callable, first, -last, id)) as id, max((callable, first, -last, id)) as b from defs join spans using (file) where line between first and last group by 1),
symbols as (select symbol, file, coalesce(id, 'ci:lsp:' || sha1(symbol)) as node, coalesce(b[2], line)::int as first, coalesce(-b[3], line)::int as last from defs left join best using (seq))"""


def _defined(spark, d):
    records = tg.table(spark, d, "part").filter("p_partkey % 5 = 0").selectExpr("p_partkey as seq", "concat('y', p_partkey) as symbol", "concat('s', p_partkey % 8, '.cpp') as file", "int(p_partkey div 8 * 4 + 2) as line")
    return evidence.defined_symbols(records, _spans(spark, d), width=20)


@query(f"with {_SYMBOLS} select symbol, node, first, last, file from symbols", graph=False)
def j12_defined_symbols(spark, d):
    return _defined(spark, d)


@query(
    f"""with {_SYMBOLS}, refs as (select o_orderkey as ref, 'y' || (o_custkey % 40 * 5) as symbol, 's' || (o_orderkey % 9) || '.cpp' as file, o_orderkey % 120 as line from orders),
    inn as (select ref, arg_max(id, (s.first, -s.last)) as caller from refs r join spans s using (file) where line between s.first and s.last group by 1)
    select coalesce(caller, 'file:' || r.file) as from_id, node as to_id, r.file as source_file, line::int as source_line, case when max(ref % 2) = 1 then 0.95 else 0.6 end::double as confidence from refs r join symbols y using (symbol) left join inn using (ref)
    where not (r.file = y.file and line between y.first and y.last) and coalesce(caller, 'file:' || r.file) <> node group by 1, 2, 3, 4""",
    graph=False,
)
def m6_proven_calls(spark, d):
    refs = tg.table(spark, d, "orders").selectExpr("o_orderkey as ref", "concat('y', o_custkey % 40 * 5) as symbol", "concat('s', o_orderkey % 9, '.cpp') as file", "int(o_orderkey % 120) as line", "if(o_orderkey % 2 = 1, 'high', 'low') as confidence")
    return evidence.proven_calls(refs, _defined(spark, d), _spans(spark, d), width=20)


@query("select c_custkey as id from customer where c_custkey % 20 not in (select k from range(0, 20, 4) t(k))", graph=False)
def m7_unchanged_evidence(spark, d):
    own = tg.table(spark, d, "customer").selectExpr("c_custkey as id", "c_custkey % 20 as file")
    return evidence.unchanged_only(own, spark.range(0, 20, 4).select(F.col("id").alias("file"))).select("id")


@query("select c_custkey as file from customer where false", graph=False)
def u8_r7_unknown_changes_keep_nothing(spark, d):
    return evidence.unchanged_only(tg.table(spark, d, "customer").select(F.col("c_custkey").alias("file")), None)


@query(
    """, own as (select from_id, to_id, case when source_line % 3 = 0 then 'LSP_VERIFIED' else provenance end as provenance, case when source_line % 3 = 0 then 'clangd' else 'generic' end as extractor, case when source_line % 3 = 0 and source_line % 2 = 0 then 'EXTRACTED' end as was from edges where relation = 'CALLS')
    select from_id, to_id, case when extractor = 'clangd' and hit then was else provenance end as provenance, case when extractor = 'clangd' and hit then null else was end as was from (select o.*, n.file_path in ('orders/f1.py', 'orders/f2.py') as hit from own o join nodes n on n.id = to_id) where not (extractor = 'clangd' and hit and was is null)"""
)
def m5_invalidated_in_scope(spark, d):
    third = F.col("source_line") % 3 == 0
    own = tg.edges(spark, d).filter("relation = 'CALLS'").select(
        "from_id", "to_id", F.when(third, "LSP_VERIFIED").otherwise(F.col("provenance")).alias("provenance"), F.when(third, "clangd").otherwise("generic").alias("extractor"), F.when(third & (F.col("source_line") % 2 == 0), "EXTRACTED").alias("was")
    )
    scope = spark.createDataFrame([("orders/f1.py",), ("orders/f2.py",)], "file string")
    return evidence.invalidated(own, tg.nodes(spark, d), "clangd", scope).select("from_id", "to_id", "provenance", "was")


@query("select c_nationkey as provider, arg_max(c_custkey, (c_acctbal > 0, c_mktsegment, c_custkey)) as collection from customer group by 1", graph=False)
def m9_compacted_collections(spark, d):
    own = tg.table(spark, d, "customer").selectExpr("c_nationkey as provider", "c_custkey as collection", "if(c_acctbal > 0, 3, 0) as n", "c_mktsegment as collected_at")
    return evidence.compacted(own)


@query("select event_type as kind, count(*) as n from events group by 1", graph=False)
def g29_operation_counts(spark, d):
    return evidence.operation_counts(tg.table(spark, d, "events").select(F.col("event_type").alias("kind")))


@query(", f as (select distinct file_path as file from nodes where ends_with(file_path, '.py')) select count(*) as eligible, count(*) filter (file in (select 'orders/f' || k || '.py' from range(0, 200, 3) t(k))) as covered from f")
def g30_covered_files(spark, d):
    return evidence.coverage(_file_table(spark, d), spark.range(0, 200, 3).selectExpr("concat('orders/f', id, '.py') as file"), [".py", ".pyi"])


@query("select c_custkey, c_custkey * 1000000 >= 52428800 and c_custkey % 100 >= 25 as advised from customer", graph=False)
def m12_compaction_advice(spark, d):
    size = F.col("c_custkey") * 1_000_000
    return tg.table(spark, d, "customer").select("c_custkey", evidence.vacuum_advice(size, size * (F.col("c_custkey") % 100) / 100).alias("advised"))
