"""Queries that count, rank and cap: flags, samples, coverage, budgets, suggestions, resolution."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphweft import model
from graphweft.operators import relational as rel
from graphweft.operators import suggest
from graphweft.plans.base import in_list, query
from graphweft.sources import testgraph as tg


@query(
    """select category, count(*) as n, string_agg(target, '|' order by target) filter (rn <= 5) as samples from (select *, row_number() over (partition by category order by target) as rn from
    (select target, case when starts_with(target, 'http') then 'external' when starts_with(target, '#') then 'anchor' when starts_with(target, '/') then 'rooted' else 'relative' end as category
    from (select distinct unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as target from pages))) group by 1""",
    graph=False,
)
def w9_targets_with_samples(spark, d):
    targets = tg.table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target")).distinct()
    t = F.col("target")
    kind = F.when(t.startswith("http"), "external").when(t.startswith("#"), "anchor").when(t.startswith("/"), "rooted").otherwise("relative")
    own = targets.withColumn("category", kind)
    return rel.counted_with_samples(own, "category", "target", 5)


@query(
    """select coalesce(lang, '') as lang, count(*) as eligible, count(l.doc_id) as covered, round(count(l.doc_id) * 1.0 / count(*), 4)::double as ratio
    from documents left join (select distinct doc_id from labels) l using (doc_id) group by 1""",
    graph=False,
)
def g18_coverage(spark, d):
    labelled = tg.table(spark, d, "labels").select("doc_id").distinct().withColumn("has", F.lit(1))
    own = tg.table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang")).join(labelled, "doc_id", "left")
    return own.groupBy("lang").agg(F.count("*").alias("eligible"), F.count("has").alias("covered"), F.round(F.count("has") / F.count("*"), 4).alias("ratio"))


@query("select r_name as layer, count(n.id) as n from region left join nodes n on split_part(n.file_path, '/', 1) = r_name group by 1")
def g22_layer_counts(spark, d):
    held = tg.nodes(spark, d).groupBy(F.substring_index("file_path", "/", 1).alias("layer")).agg(F.count("*").alias("n"))
    layers = tg.table(spark, d, "region").select(F.col("r_name").alias("layer"))
    return layers.join(held, "layer", "left").select("layer", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@query("select ext, count(*) as files, sum(n)::bigint as n from (select regexp_extract(file_path, '\\.([^./]+)$', 1) as ext, file_path, count(*) as n from nodes where type = 'Function' group by all) group by 1")
def g25_inventory_by_extension(spark, d):
    files = tg.nodes(spark, d).filter("type = 'Function'").groupBy("file_path").agg(F.count("*").alias("n"))
    return files.groupBy(F.regexp_extract("file_path", r"\.([^./]+)$", 1).alias("ext")).agg(F.count("*").alias("files"), F.sum("n").alias("n"))


@query(
    """select array_to_string(parts[:i], '/') as folder, count(*) as n, count(distinct file_path) as files from
    (select file_path, parts, unnest(range(1, len(parts) + 1)) as i from (select file_path, string_split(file_path, '/') as parts from nodes where file_path <> '')) group by 1"""
)
def g26_folder_stats(spark, d):
    files = tg.nodes(spark, d).filter("file_path <> ''").groupBy("file_path").agg(F.count("*").alias("n"))  # before paths are unfolded
    parts = F.split("file_path", "/")
    up = files.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("folder"))
    return up.groupBy("folder").agg(F.sum("n").alias("n"), F.count("*").alias("files"))


@query(
    """, ranked as (select language, id, degree, row_number() over (partition by language order by degree desc, id) as rn from nodes join
    (select id, count(*) as degree from (select from_id as id from edges union all select to_id from edges) group by 1) using (id) where language <> '')
    select c.language, c.n, string_agg(r.id, ',' order by r.rn) as top from (select language, count(*) as n from nodes where language <> '' group by 1) c join ranked r on c.language = r.language where rn <= 3 group by 1, 2"""
)
def a2_w3_cluster_overview(spark, d):
    own = tg.nodes(spark, d).filter("language <> ''").select("id", "language")
    ranked = rel.top_per_group(own.join(rel.degree(tg.edges(spark, d)).select("id", "degree"), "id"), "language", [F.desc("degree"), "id"], 3)
    top = ranked.groupBy("language").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "id"))), lambda x: x["id"]), ",").alias("top"))  # three each
    return own.groupBy("language").agg(F.count("*").alias("n")).join(top, "language")


@query(
    """select id, arg_max(token, (score, -seq)) as token, max(score)::double as score from (select id, t.token, t.seq, case when starts_with(label, t.token) then 0.75 else 0.5 end as score
    from nodes join (values ('rod', 0), ('blue', 1), ('a', 2)) t(token, seq) on contains(label, t.token) where type = 'Type') group by 1"""
)
def w5_best_score(spark, d):
    n = tg.nodes(spark, d).filter("type = 'Type'").select("id", "label")
    score = lambda t: F.when(F.col("label").startswith(t), 0.75).otherwise(0.5)
    hits = [F.when(F.col("label").contains(t), F.struct(score(t).alias("score"), F.lit(-k).alias("seq"), F.lit(t).alias("token"))) for k, t in enumerate(["rod", "blue", "a"])]
    best = n.withColumn("best", F.greatest(*hits)).filter("best is not null").groupBy("id").agg(F.max("best").alias("best"))
    return best.select("id", "best.token", "best.score")


@query(
    """select s as status, m as median, (select count(*) from orders where o_orderstatus = s and o_orderdate > m) as newer from
    (select o_orderstatus as s, list_sort(list(o_orderdate))[(count(*) // 2 + 1)::int] as m from orders group by 1)""",
    graph=False,
)
def w10_median_and_newer(spark, d):
    return rel.median_of_counts(tg.table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), "o_orderdate"), "status", "o_orderdate")


@query("select file_path, arg_min(id, (case type when 'Directory' then 0 when 'Module' then 1 else 2 end, length(label), id)) as root from nodes where file_path <> '' group by 1")
def k4_best_root(spark, d):
    order = F.struct(F.when(F.col("type") == "Directory", 0).when(F.col("type") == "Module", 1).otherwise(2), F.length("label"), F.col("id"))
    return tg.nodes(spark, d).filter("file_path <> ''").groupBy("file_path").agg(F.min_by("id", order).alias("root"))


@query(
    """, wide as (select id, type from nodes where type = 'Module' order by id limit 4), code as (select id, type from nodes where type = 'Type' order by id limit 12)
    select id, type from (select *, 0 as p from wide union all select *, 1 from code) order by p, id limit 12"""
)
def k8_reserved_quota(spark, d):
    n = tg.nodes(spark, d).select("id", "type")
    return rel.with_reserve(n.filter("type = 'Type'"), n.filter("type = 'Module'"), "id", 12, 4)


@query(
    """select o_orderkey, 6 - substr(o_orderpriority, 1, 1)::int as weight from orders
    order by 6 - substr(o_orderpriority, 1, 1)::int desc, case o_orderstatus when 'O' then 3 when 'P' then 2 else 1 end desc, o_orderkey desc limit 50""",
    graph=False,
)
def k10_ranked_tasks(spark, d):
    o = tg.table(spark, d, "orders").withColumn("weight", 6 - F.substring("o_orderpriority", 1, 1).cast("int"))
    status = F.when(F.col("o_orderstatus") == "O", 3).when(F.col("o_orderstatus") == "P", 2).otherwise(1)
    return o.orderBy(F.desc("weight"), F.desc(status), F.desc("o_orderkey")).select("o_orderkey", "weight").limit(50)


@query(
    """select c_nationkey as region, count(*) as n, (count(*) * (1 + coalesce(any_value(x.w), 0)))::bigint as rank from customer left join
    (select k, sum(n)::bigint as w from (select src as k, n from trade union all select dst, n from trade) group by 1) x on k = c_nationkey group by 1"""
)
def k11_region_rank(spark, d):
    t = tg.trade(spark, d)
    weight = t.select(F.col("src").alias("region"), "n").union(t.select("dst", "n")).groupBy("region").agg(F.sum("n").alias("w"))
    own = tg.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("region")).agg(F.count("*").alias("n"))
    return own.join(weight, "region", "left").select("region", "n", (F.col("n") * (1 + F.coalesce("w", F.lit(0)))).alias("rank"))


@query("select language, count(*) as n, count(*) > 5 as truncated, string_agg(id, '|' order by id) filter (rn <= 5) as samples from (select *, row_number() over (partition by language order by id) as rn from nodes where type = 'Type') group by 1")
def k12_capped_collection(spark, d):
    own = rel.counted_with_samples(tg.nodes(spark, d).filter("type = 'Type'").select("language", "id"), "language", "id", 5)
    return own.withColumn("truncated", F.col("n") > 5)


@query("select n_nationkey, n_name, spent from (select n_nationkey, n_name, sum(length(n_name)) over (order by n_nationkey)::bigint as spent from nation) where spent <= 60", graph=False)
def k14_budget_prefix(spark, d):
    spent = F.sum(F.length("n_name")).over(W.partitionBy().orderBy("n_nationkey"))  # the blocks of one digest: 25 rows
    return tg.table(spark, d, "nation").select("n_nationkey", "n_name", spent.alias("spent")).filter("spent <= 60")


_DECLARED = ", ".join(f"('{r}')" for r in model.RELATIONS)


@query(f"select coalesce(v.r, e.relation) as relation, v.r is not null as declared from (values {_DECLARED}) v(r) full join (select distinct relation from edges where relation <> 'USES_TYPE') e on v.r = e.relation where v.r is null or e.relation is null")
def u5_u6_declared_or_seen_only(spark, d):
    seen = rel.distribution(tg.edges(spark, d).filter("relation <> 'USES_TYPE'"), "relation", model.RELATIONS)
    return seen.filter("n = 0 or not declared").select(F.col("value").alias("relation"), "declared")


@query(
    f"""select label, rank from (select label, least(case when lower(label) = 'blue rdo' then 0 end, case when starts_with(lower(label), 'blue rdo') then 2 end, case when contains(lower(label), 'blue rdo') then 3 end,
    case when damerau_levenshtein(lower(label), 'blue rdo') <= 1 then 4 + damerau_levenshtein(lower(label), 'blue rdo') end)::int as rank
    from (select distinct label from nodes where type in {in_list(["Type", "Class"])})) where rank is not null order by rank, label limit 5"""
)
def x6_x7_suggestions(spark, d):
    return suggest.suggestions(tg.nodes(spark, d).filter(F.col("type").isin("Type", "Class")), "blue rdo", 5)


_WORDS = "regexp_extract_all(lower(text), '[a-z]{4,}')"


@query(
    f"""with w as (select distinct unnest({_WORDS}) as label from documents), n as (select min(substr(x, 1, 1) || substr(x, 3, 1) || substr(x, 2, 1) || substr(x, 4)) as name from (select doc_id, unnest({_WORDS}) as x from documents where doc_id % 20 = 0) group by doc_id),
    q as (select distinct name, least(3, greatest(1, len(name) // 6)) as most from n),
    hits as (select name, label, case when label = name then 0 when starts_with(label, name) then 2 when contains(label, name) then 3 when damerau_levenshtein(label, name) <= most then 4 + damerau_levenshtein(label, name) end as rank
    from q join w on contains(label, name) or abs(len(label) - len(name)) <= most and damerau_levenshtein(label, name) <= most)
    select name, label, rank::int as rank from hits qualify row_number() over (partition by name order by rank, label) <= 5""",
    graph=False,
)
def x6_x7_suggestions_many(spark, d):
    """For a misspelled word of every twentieth document the best words of all documents: its first word by the alphabet after its second and third letters are swapped."""
    docs = tg.table(spark, d, "documents")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))
    swapped = lambda x: F.concat(F.left(x, F.lit(1)), F.substring(x, 3, 1), F.substring(x, 2, 1), F.substring(x, F.lit(4), F.length(x)))
    names = docs.filter("doc_id % 20 = 0").select(F.array_min(F.transform(words, swapped)).alias("name"))
    return suggest.suggestions_many(docs.select(F.explode(words).alias("label")).distinct(), names, 5)


@query(
    """, hits as (select id, 0 as rank from nodes where label = 'EUROPE' union all select id, 1 from nodes where qname = 'EUROPE' union all select id, 2 from nodes where ends_with(qname, '.EUROPE')
    union all select id, 3 from nodes where file_path = 'EUROPE')
    select id, rank::int as rank from hits where rank = (select min(rank) from hits)"""
)
def x9_resolution_cascade(spark, d):
    return suggest.resolve(tg.nodes(spark, d), "EUROPE")


@query(
    """select label, count(*) as population, count(distinct language) as groups, count(distinct language) > 1 as ambiguous, string_agg(id, '|' order by id) filter (rn <= 5) as samples from
    (select *, row_number() over (partition by label order by id) as rn from nodes where type = 'Type') group by 1"""
)
def x10_ambiguity(spark, d):
    own = tg.nodes(spark, d).filter("type = 'Type'").select("label", "id", "language")
    kinds = own.groupBy("label").agg(F.countDistinct("language").alias("groups"))
    shown = rel.counted_with_samples(own, "label", "id", 5).withColumnRenamed("n", "population")
    return shown.join(kinds, "label").withColumn("ambiguous", F.col("groups") > 1)


@query(
    """select suffix, count(distinct id) as n, case when count(distinct id) = 1 then min(id) end as resolved, case when count(distinct id) = 1 then 'unique' else 'ambiguous_symbol' end as verdict from
    (select id, array_to_string(parts[-k:], '.') as suffix from (select id, parts, unnest(range(2, least(len(parts), 4) + 1)) as k from
    (select id, string_split(replace(file_path, '/', '.') || '.' || label, '.') as parts from nodes where type in ('Class', 'Module')))) group by 1"""
)
def d5_d6_suffix_index(spark, d):
    n = tg.nodes(spark, d).filter(F.col("type").isin("Class", "Module"))
    return suggest.resolved_suffixes(n.select("id", F.concat(F.replace("file_path", F.lit("/"), F.lit(".")), F.lit("."), "label").alias("chain")))


@query("select doc_id, regexp_replace(regexp_extract(text, '(?:^|\\n) *([^ \\n][^\\n]*)', 1), '^#+ *', '') as title from documents", graph=False)
def d10_document_title(spark, d):
    title = F.regexp_extract("text", "(?:^|\n) *([^ \n][^\n]*)", 1)
    return tg.table(spark, d, "documents").select("doc_id", F.regexp_replace(title, "^#+ *", "").alias("title"))
