"""Queries on the stored indexes of texts and vectors, for one question and for many."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphweft.operators import lineage, text_index, vector_index
from graphweft.plans.base import query
from graphweft.sources import testgraph as tg

_TOKENS = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t <> '')"


def _documents(spark, d) -> text_index.TextIndex:
    path = lineage.scratch_path(spark, "text-index")
    text_index.build(tg.table(spark, d, "documents"), "doc_id", "text", path)
    return text_index.load(spark, path)


def _bm25_sql(tf: str, df: str) -> str:
    return f"ln(1 + (docs - {df} + 0.5) / ({df} + 0.5)) * ({tf} * 2.2) / ({tf} + 1.2 * (0.25 + 0.75 * n / mean))"


@query(
    f"""with c as (select doc_id, len(t) as n, len(list_filter(t, lambda x: starts_with(x, 'th'))) as a, len(list_filter(t, lambda x: starts_with(x, 're'))) as b from (select doc_id, {_TOKENS} as t from documents)),
    s as (select count(*) as docs, avg(n) as mean, count(*) filter (a > 0) as da, count(*) filter (b > 0) as db from c)
    select doc_id, round({_bm25_sql("a", "da")} + {_bm25_sql("b", "db")}, 6)::double as score from c, s where a > 0 and b > 0 order by score desc, doc_id limit 25""",
    graph=False,
)
def x1_index_search(spark, d):
    return text_index.search(_documents(spark, d), "th re", 25).withColumnRenamed("key", "doc_id")


@query(
    f"""with tok as (select doc_id, {_TOKENS} as t from documents), s as (select count(*) as docs, avg(len(t)) as mean from tok),
    q as (select doc_id as query_id, list_sort(list_distinct(list_filter(t, lambda x: len(x) >= 4)))[1:2] as w from tok where doc_id % 20 = 0),
    asked as (select query_id, len(w) as w_all, substr(unnest(w), 1, 4) as prefix from q),
    counted as (select doc_id, max(n) as n, term, count(*) as tf from (select doc_id, len(t) as n, unnest(t) as term from tok) group by doc_id, term),
    c as (select prefix, doc_id, max(n) as n, sum(tf) as tf from (select distinct prefix from asked) p join counted on starts_with(term, prefix) group by 1, 2),
    x as (select prefix, doc_id, {_bm25_sql("tf", "df")} as part from c join (select prefix, count(*) as df from c group by 1) using (prefix), s),
    hits as (select query_id, doc_id, round(sum(part), 6)::double as score from asked join x using (prefix) group by query_id, doc_id, w_all having count(*) = w_all)
    select query_id, doc_id, score from hits qualify row_number() over (partition by query_id order by score desc, doc_id) <= 5""",
    graph=False,
)
def x1_index_search_many(spark, d):
    """For every twentieth document the texts that hold words like its first two by the alphabet; a word is asked for by its first four letters."""
    docs = tg.table(spark, d, "documents")
    words = F.slice(F.array_sort(F.array_distinct(F.filter(text_index.tokens_of(F.col("text")), lambda t: F.length(t) >= 4))), 1, 2)
    asked = docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.array_join(F.transform(words, lambda t: F.left(t, F.lit(4))), " ").alias("query"))
    return text_index.search_many(_documents(spark, d), asked, 5).select("query_id", F.col("key").alias("doc_id"), "score")


@query(
    f"select term, count(distinct doc_id) as df from (select doc_id, unnest({_TOKENS}) as term from documents) where starts_with(term, 's') group by 1 order by df desc, term limit 20",
    graph=False,
)
def x1_index_terms(spark, d):
    return text_index.expand(_documents(spark, d), "s", 20)


@query(
    """select query_id, vec_id, similarity from (select q.vec_id as query_id, v.vec_id, round(list_cosine_similarity(v.embedding::double[], q.embedding::double[]), 6) as similarity
    from embeddings v, embeddings q where q.vec_id % 20 = 0 and v.vec_id <> q.vec_id) where similarity > 0 qualify row_number() over (partition by query_id order by similarity desc, vec_id) <= 10""",
    graph=False,
)
def x4_x8_index_nearest_many(spark, d):
    """The ten nearest vectors of every twentieth, from inverted cells."""
    vectors = tg.table(spark, d, "embeddings")
    index = vector_index.build(vectors, "vec_id", "embedding", 64)
    if index is None:
        return spark.createDataFrame([], "query_id bigint, vec_id bigint, similarity double")
    asked = vector_index.units(vectors.filter("vec_id % 20 = 0"), "vec_id", "embedding", 64).withColumnRenamed("id", "query_id")
    return vector_index.nearest_many(index, asked, 10).withColumnRenamed("id", "vec_id")
