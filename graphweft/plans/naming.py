"""Queries that show the scalar functions on names, paths, texts and counts of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphweft.functions import names, paths, scalars, texts, verdicts
from graphweft.plans.base import query
from graphweft.sources import testgraph as tg


def _symbols(spark, d):
    """Parts as symbols of a language with templates: Brand#11::Box<red, X<7>>::run and the like."""
    return tg.table(spark, d, "part").selectExpr(
        "p_partkey as id", "p_brand", "p_name", "p_size",
        "concat(p_brand, '::Box<', p_name, ', X<', p_size, '>>::run', p_size % 3) as symbol",
        "case when p_size % 4 = 0 then '' else concat(p_brand, '.Box<', p_name, '>.run') end as qname",
        "case when p_size % 4 = 1 then '' else concat('ns::', p_brand, '<', p_size, '>') end as parent",
    )


_SYMBOLS = """(select p_partkey as id, p_brand, p_name, p_size, p_brand || '::Box<' || p_name || ', X<' || p_size || '>>::run' || (p_size % 3) as symbol,
case when p_size % 4 = 0 then '' else p_brand || '.Box<' || p_name || '>.run' end as qname, case when p_size % 4 = 1 then '' else 'ns::' || p_brand || '<' || p_size || '>' end as parent from part)"""


@query("select c_custkey, sha256(to_json({l0: list_sort(list_distinct([c_mktsegment, lower(c_mktsegment), c_mktsegment])), l1: list_sort(list_distinct(['n' || c_nationkey, 'm']))})) as fp from customer", graph=False)
def f2_list_fingerprint(spark, d):
    c = tg.table(spark, d, "customer")
    one = F.array("c_mktsegment", F.lower("c_mktsegment"), F.lit(""), "c_mktsegment")
    return c.select("c_custkey", names.fingerprint(one, F.array(F.concat(F.lit("n"), "c_nationkey"), F.lit("m"), F.lit(None))).alias("fp"))


@query("""select n_nationkey, '{"a":[{"x":"' || n_name || '","y":' || n_regionkey || '}],"n":' || n_nationkey || ',"z":null}' as canonical from nation""", graph=False)
def f3_canonical_json(spark, d):
    written = "concat('{\"z\": null, \"n\": ', n_nationkey, ', \"a\": [{\"y\": ', n_regionkey, ', \"x\": \"', n_name, '\"}]}')"
    return tg.table(spark, d, "nation").select("n_nationkey", names.canonical_json(F.expr(written)).alias("canonical"))


@query(f"select id, regexp_replace(regexp_replace(symbol, '<[^<>]*>', '', 'g'), '<[^<>]*>', '', 'g') as stripped, 'run' || (p_size % 3) as part from {_SYMBOLS}", graph=False)
def f5_f6_template_args(spark, d):
    return _symbols(spark, d).select("id", names.strip_template_args(F.col("symbol")).alias("stripped"), names.qualified_part(F.col("symbol")).alias("part"))


@query(
    f"""select id, case when qname <> '' then 'Method:' || p_brand || '.Box.run' when parent <> '' then 'Method:' || p_brand || '.' || p_name else 'Method:' || p_name || ':src/a.h' end as key,
    case when qname <> '' then p_brand || '::Box::run' when parent <> '' then p_brand || '::' || p_name else p_name end as shown from {_SYMBOLS}""",
    graph=False,
)
def f7_f8_symbol_keys(spark, d):
    s, c = _symbols(spark, d), F.col
    key = names.canonical_key(F.lit("Method"), c("qname"), c("parent"), c("p_name"), F.lit("src/a.h"))
    return s.select("id", key.alias("key"), names.display_name(c("qname"), c("parent"), c("p_name")).alias("shown"))


@query(
    """select o_orderkey, array_to_string(list_distinct_in_order, '|') as spellings, f || '.py' as bare from (select o_orderkey, f, ['"lib/' || f || '.py"', 'lib/' || f || '.py', 'lib.' || f || '.py', f || '.py', 'lib/' || f] as list_distinct_in_order
    from (select o_orderkey, 'f' || (o_orderkey % 97) as f from orders where o_orderkey % 10 = 1))""",
    graph=False,
)
def f9_f11_lookup_candidates(spark, d):
    f = F.concat(F.lit("f"), F.col("o_orderkey") % 97)
    o = tg.table(spark, d, "orders").filter("o_orderkey % 10 = 1").select("o_orderkey", F.concat(F.lit('"lib/'), f, F.lit('.py"')).alias("t"), F.concat(F.lit(" <"), f, F.lit(".py> ")).alias("u"))
    return o.select("o_orderkey", F.array_join(names.lookup_candidates(F.col("t")), "|").alias("spellings"), names.external_target(F.col("u")).alias("bare"))


@query(
    f"select id, case when p_size % 2 = 0 then 'a.b' end as owner, case when p_size % 2 = 0 then 'm' || p_size end as member, 'run' as call, 'x' || p_size as reference from {_SYMBOLS}", graph=False
)
def f10_f12_targets(spark, d):
    s = _symbols(spark, d)
    target = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('"a.b.m'), "p_size", F.lit('"'))).otherwise(F.concat(F.lit("a/b.m"), "p_size"))
    own = names.member_target(target)
    return s.select("id", own["owner"].alias("owner"), own["member"].alias("member"), names.call_target(F.concat(F.lit(" a::b->run ("), "p_name")).alias("call"), names.reference_target(F.concat(F.lit("q::p.x"), "p_size")).alias("reference"))


@query("select id, replace(regexp_replace(file_path, '\\.py$', ''), '/', '.') as module, 'pkg.sub.__init__' as package, 'web.app' as page from nodes where type = 'Function'")
def f13_module_names(spark, d):
    n = tg.nodes(spark, d).filter("type = 'Function'")
    return n.select("id", names.module_name(F.col("file_path")).alias("module"), names.module_name(F.lit("pkg/sub/__init__.py")).alias("package"), names.module_name(F.lit("web\\app/index.ts")).alias("page"))


@query(
    """select o_orderkey, case when o_orderkey % 97 = o_custkey % 97 then 3 else 2 end as shared, case when o_custkey % 3 = 0 then 4 when o_custkey % 3 = 1 then 1 else 0 end as penalty from orders""",
    graph=False,
)
def f15_path_proximity(spark, d):
    o = tg.table(spark, d, "orders")
    a, b = (F.concat(F.lit("src/lib/f"), F.col(k) % 97, F.lit(f"/{k}.py")) for k in ("o_orderkey", "o_custkey"))
    at = F.element_at(F.array(F.lit("Third_Party/x/a.c"), F.lit("src\\tests\\a.c"), F.lit("src/a.c")), (F.col("o_custkey") % 3 + 1).cast("int"))
    return o.select("o_orderkey", paths.shared_folders(a, b).alias("shared"), paths.foreign_penalty(at).alias("penalty"))


@query("select n_nationkey, 'a/' || n_name || '/c.md' as inside, null::varchar as outside, n_name as plain from nation", graph=False)
def f16_normalised_paths(spark, d):
    n = F.col("n_name")
    inside = F.concat(F.lit("./a//b/../"), n, F.lit("/./c.md"))
    return tg.table(spark, d, "nation").select("n_nationkey", paths.normalised(inside).alias("inside"), paths.normalised(F.concat(F.lit("a/../../"), n)).alias("outside"), paths.normalised(F.concat(n, F.lit("/"))).alias("plain"))


@query(f"select id, case when p_size % 5 = 0 then -1 when p_size % 5 = 1 then 8 + length(p_brand) when p_size % 5 = 2 then 12 when p_size % 5 = 3 then 4 else 0 end as at from {_SYMBOLS}", graph=False)
def f21_identifier_columns(spark, d):
    forms = [F.lit("Builder builds it"), F.concat(F.lit("build = "), "p_brand", F.lit(".build(x)")), F.lit("rebuild1, x build (build2)"), F.lit("int build, build;"), F.lit("build(build)")]
    forms[1] = F.concat(F.lit("Box foo"), "p_brand", F.lit(".build(build)"))
    forms[2] = F.lit("x rebuild y build (build)")
    line = F.element_at(F.array(*forms), (F.col("p_size") % 5 + 1).cast("int"))
    return _symbols(spark, d).select("id", texts.identifier_column(line, "build").alias("at"))


@query(f"select id, (p_size % 4)::int as arity, p_size % 2 = 0 as constant, true as unclosed from {_SYMBOLS}", graph=False)
def f22_signatures(spark, d):
    k = F.col("p_size") % 4
    inner = F.when(k == 0, F.lit("void")).otherwise(F.expr("left(repeat('map<a, b> f(int, int)[1, 2], ', int(p_size % 4)), 28 * int(p_size % 4) - 2)"))
    signature = F.concat(F.lit("T run<a, b>("), inner, F.when(F.col("p_size") % 2 == 0, F.lit(") const noexcept")).otherwise(F.lit(")")))
    return _symbols(spark, d).select("id", texts.parameter_count(signature).alias("arity"), texts.is_const(signature).alias("constant"), texts.parameter_count(F.lit("run(a")).isNull().alias("unclosed"))


@query(
    """select event_id, (epoch(timestamp '2024-02-01 00:00:00') - epoch(ts))::bigint // 86400 as days, case when s < 45 then 'just now' when s < 3600 then (s // 60) || 'm ago' when s < 86400 then (s // 3600) || 'h ago' else (s // 86400) || 'd ago' end as said
    from (select *, greatest(epoch(timestamp '2024-01-30 12:00:00')::bigint - floor(epoch(ts))::bigint, 0) as s from events)""",
    graph=False,
)
def f23_ages(spark, d):
    at = lambda s: F.to_timestamp(F.lit(s))
    nearest = F.timestamp_seconds(scalars.nearest_second(F.col("ts")))  # whole days are told from the nearest second, the rest from the one begun
    return tg.table(spark, d, "events").select("event_id", texts.days_ago(nearest, at("2024-02-01 00:00:00")).alias("days"), texts.relative_time(F.date_trunc("second", "ts"), at("2024-01-30 12:00:00")).alias("said"))


@query(
    """select o_orderkey, case o_orderstatus when 'F' then 'closed' when 'O' then 'open' else 'unknown' end as state, case when o_custkey % 4 = 0 then 'unlinked' when o_custkey % 4 = 1 then 'strong' when o_custkey % 4 = 2 then 'broad' else 'mixed' end as strength from orders""",
    graph=False,
)
def f25_g20_tasks(spark, d):
    o = tg.table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "Won't do").when(F.col("o_orderstatus") == "O", "In-Progress").otherwise("someday")
    case = F.col("o_custkey") % 4
    linked = F.when(case == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("f1")))
    evidence = F.when(case == 1, "commit: abc").when(case == 2, "fuzzy title match").otherwise("commit: abc, roadmap")
    return o.select("o_orderkey", verdicts.task_status(status).alias("state"), verdicts.link_strength(linked, F.lit(None).cast("string"), evidence, F.array().cast("array<string>")).alias("strength"))


@query(
    """select id, case when starts_with(file_path, 'orders/f1') then 'fn' when type = 'Function' then 'pipeline' when type = 'Class' and label like '%7' then 'factory' when type = 'Class' then 'class' else lower(type) end as role
    from nodes where type not in ('Type', 'External')"""
)
def f26_roles(spark, d):
    n = tg.nodes(spark, d).filter("type not in ('Type', 'External')")
    path = F.when((F.col("type") == "Function") & ~F.col("file_path").startswith("orders/f1"), F.concat(F.lit("Ingest/"), "file_path")).otherwise(F.lit("x.py"))
    label = F.when((F.col("type") == "Class") & F.col("label").endswith("7"), F.concat(F.lit("WidgetBuilder"), "label")).otherwise(F.lit("x"))
    return n.select("id", verdicts.role_of(label, path, F.col("type")).alias("role"))


@query(
    """select c_custkey, case when a > 5 and x or a > 10 or u > 100 and a > 3 then 'CONFIRM' when a > 1 or not v then 'REVIEW' else 'SAFE' end as decision,
    case when u > 100 and a <= 1 and o >= 10 then 'CONFIRM' when a > 5 and x or a > 10 or u > 100 and a > 3 then 'CONFIRM' when a > 1 or not v then 'REVIEW' when u > 100 and o > 1 then 'REVIEW' else 'SAFE' end as stricter
    from (select c_custkey, c_custkey % 13 as a, c_custkey % 2 = 0 as x, c_custkey % 150 as u, c_custkey % 3 = 0 as v, c_custkey % 17 as o from customer)""",
    graph=False,
)
def f28_f29_decisions(spark, d):
    k = F.col("c_custkey")
    decision = verdicts.change_decision(k % 13, F.lit(1), k % 150, k % 2 == 0, k % 3 == 0, F.lit(True))
    return tg.table(spark, d, "customer").select("c_custkey", decision.alias("decision"), verdicts.with_occurrences(decision, k % 13, k % 150, k % 17).alias("stricter"))


@query(
    """select p_partkey, case when p_size % 2 = 0 then 'computed-call:2' else '' end || case when p_size % 3 = 0 then (case when p_size % 2 = 0 then ',' else '' end) || 'typed-bus:1' else '' end as found from part""",
    graph=False,
)
def f30_dynamic_calls(spark, d):
    code = F.concat(
        F.lit('x = "table[k](1)"; // table[k](2)\n'), F.when(F.col("p_size") % 2 == 0, F.lit("table[k](a); y = other['b'](c);\n")).otherwise(F.lit("")),
        F.when(F.col("p_size") % 3 == 0, F.lit("bus.Send<int>(new OrderPlaced(1)); /* bus.send(new X(1)) */")).otherwise(F.lit("")),
    )
    found = F.transform(texts.dynamic_calls(code), lambda x: F.concat_ws(":", x["form"], x["n"].cast("string")))
    return tg.table(spark, d, "part").select("p_partkey", F.array_join(found, ",").alias("found"))


@query("select p_partkey, 0 as set_no, p_size % 9 as binding, 'buffer' as kind, 'read' as access, 'Deltas' as name from part union all select p_partkey, 2, 7, 'uniform', 'read', 'albedo' from part", graph=False)
def f31_shader_bindings(spark, d):
    code = F.concat(F.lit("layout(std430, binding = "), F.col("p_size") % 9, F.lit(") readonly buffer Deltas { int a; };\nlayout(set=2, binding=7) uniform sampler2D albedo[4];\nlayout(location = 1) in vec2 uv;"))
    found = tg.table(spark, d, "part").select("p_partkey", F.inline(texts.shader_bindings(code)))
    return found.select("p_partkey", F.col("set").alias("set_no"), "binding", "kind", "access", "name")


@query("select doc_id, 'Title|' || lang || ' two' as headings, false as cut, 3 as n_lines, 'T1' as title, 'and more' as summary from documents where lang is not null", graph=False)
def f32_d10_headings(spark, d):
    text = F.concat(F.lit("# Title\n```\n# a comment\n```\n ## "), "lang", F.lit(" two ##\n#no heading"))
    own = texts.headings(text)
    meta = texts.document_meta(F.lit("\n\n## T1\n\nand more\n"))
    return tg.table(spark, d, "documents").filter("lang is not null").select(
        "doc_id", F.array_join(own["headings"], "|").alias("headings"), own["truncated"].alias("cut"), F.size(texts.unfenced_lines(text)).alias("n_lines"), meta["title"].alias("title"), meta["summary"].alias("summary")
    )


@query(
    """select n_nationkey, case n_nationkey % 3 when 0 then 'B,A' when 1 then 'a,z' else 'k1,k2' end as keys from nation""", graph=False
)
def f33_config_keys(spark, d):
    case = F.col("n_nationkey") % 3
    text = F.when(case == 0, F.lit("# c\nB=1\nA = 2\nnothing")).when(case == 1, F.lit('{"z": 1, "a": {"q": 2}}')).otherwise(F.lit("k2: 1\nk1 = 2\n# x: 1\n- item"))
    name = F.when(case == 0, F.lit("conf/.env")).when(case == 1, F.lit("a/b.JSON")).otherwise(F.lit("c.yml"))
    return tg.table(spark, d, "nation").select("n_nationkey", F.array_join(texts.config_keys(text, name), ",").alias("keys"))


@query("select event_id, props ->> '$.k' as k, props ->> '$.page' as page from events", graph=False)
def f34_p6_json_field(spark, d):
    return tg.table(spark, d, "events").select("event_id", names.json_field(F.col("props"), "k").alias("k"), names.json_field(F.col("props"), "page").alias("page"))


@query("select id, array_to_string(regexp_extract_all(lower(label), '[a-z0-9]+'), ' ') as tokens from nodes where type = 'Type'")
def f37_tokens(spark, d):
    return tg.nodes(spark, d).filter("type = 'Type'").select("id", F.array_join(names.name_tokens(F.col("label")), " ").alias("tokens"))


@query(
    """select o_orderkey, o_orderkey % 4 = 0 as generated, o_orderkey % 4 = 1 as test, o_orderkey % 4 in (1, 2) as test_like, o_orderkey % 4 = 3 as scratch, o_orderkey % 4 = 2 as child from orders""", graph=False
)
def p8_p9_p10_p12_path_kinds(spark, d):
    f = F.concat(F.lit("f"), F.col("o_custkey"))
    path = F.element_at(F.array(F.concat(F.lit("src/moc_"), f, F.lit(".cpp")), F.concat(F.lit("src/Tests/../test/"), f, F.lit("_test.py")), F.concat(F.lit("lib/"), f, F.lit(".SPEC.md")), F.concat(F.lit("build-linux/"), f, F.lit(".o"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return tg.table(spark, d, "orders").select(
        "o_orderkey", paths.is_generated(path).alias("generated"), paths.is_test(path, F.lit("File")).alias("test"), paths.is_test_like(path).alias("test_like"), paths.is_scratch(path).alias("scratch"), paths.is_child_of(path, "lib").alias("child")
    )


@query(
    """select bucket, count(*) as n, count(*) filter (relation <> 'CONTAINS' and starts_with(bucket, 'fixable')) as for_trust from (select relation,
    case o_custkey % 7 when 0 then 'external-by-design:node-builtin' when 1 then 'external-by-design:pip' when 2 then 'shape-issue:contains-missing-target' when 3 then 'shape-issue:operator-only' when 4 then 'denylisted-by-design:common-name'
    when 5 then 'fixable:call-short-name' else 'fixable:qualified-path' end as bucket from (select o_custkey, case o_custkey % 7 when 0 then 'IMPORTS' when 1 then 'IMPORTS' when 2 then 'CONTAINS' when 6 then 'CALLS' else 'CALLS' end as relation from orders)) group by 1""",
    graph=False,
)
def g15_g16_unresolved(spark, d):
    case = F.col("o_custkey") % 7
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (case + 1).cast("int"))
    relation = pick("IMPORTS", "IMPORTS", "CONTAINS", "CALLS", "CALLS", "CALLS", "CALLS")
    bucket = verdicts.unresolved_bucket(relation, pick("fs.promises", "numpy.linalg", " ", "[]()", "parse", "runAll", "a.b"), F.lit("python"))
    own = tg.table(spark, d, "orders").select(relation.alias("relation"), bucket.alias("bucket"))
    return own.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(verdicts.counts_for_trust(F.col("relation"), F.col("bucket"))).alias("for_trust"))


@query(
    """select c_custkey, case when c_custkey % 900 * 4 > 2000 then 'weak' when c_custkey % 900 * 4 > 500 then 'ok' else 'strong' end as trust, case when n <= 800 then 'tiny' when n <= 4000 then 'small' when n <= 15000 then 'medium' when n <= 40000 then 'large' else 'huge' end as tier,
    case when n <= 800 then 1500 when n <= 4000 then 2800 when n <= 15000 then 4500 when n <= 40000 then 7000 else 10000 end as tokens,
    case when c_custkey % 3 = 1 or c_custkey % 25 > 20 then 'risk' when c_custkey % 25 > 10 or c_custkey % 2 = 0 then 'watch' else 'healthy' end as health from (select *, c_custkey * 37 as n from customer)""",
    graph=False,
)
def g17_g31_k13_tiers(spark, d):
    k = F.col("c_custkey")
    budget = verdicts.token_budget(k * 37)
    health = verdicts.feature_health(F.when(k % 3 == 1, 1).otherwise(F.when(k % 3 == 2, 0).otherwise(2)), F.when(k % 3 == 2, 0).otherwise(2), k % 25, k % 2)
    return tg.table(spark, d, "customer").select("c_custkey", verdicts.trust_level(k % 900 * 4).alias("trust"), budget["tier"].alias("tier"), budget["tokens"].alias("tokens"), health.alias("health"))


@query("select count(*) as n, count(*) filter (label like '%1%') as noisy from nodes where type = 'Class'")
def p11_noise_labels(spark, d):
    label = F.when(F.col("label").contains("1"), F.lit("toString")).otherwise(F.col("label"))
    return tg.nodes(spark, d).filter("type = 'Class'").agg(F.count("*").alias("n"), F.count_if(verdicts.is_noise(label)).alias("noisy"))


@query("select o_orderkey, round(s, 1)::double as risk, case when s >= 6 then 'high' when s >= 3 then 'medium' else 'low' end as band from (select o_orderkey, round(greatest(greatest(o_custkey % 5 - 1, 0) * 1.5 + log2(1 + o_custkey % 40) + (o_orderkey % 3) * 2 - (o_orderkey % 2), 0), 1)::double as s from orders)", graph=False)
def f27_risk_bands(spark, d):
    o = tg.table(spark, d, "orders")
    risk = scalars.risk_score(F.col("o_custkey") % 5, F.col("o_custkey") % 40, F.col("o_orderkey") % 3, F.col("o_orderkey") % 2 == 1)
    return o.select("o_orderkey", risk.alias("risk"), verdicts.risk_band(risk).alias("band"))
