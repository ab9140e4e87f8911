"""Name resolution, lexical and full-text search, nearest vectors and link extraction."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.functions.paths import is_generated
from graphweft.functions.scalars import cosine
from graphweft.functions.verdicts import text_match
from graphweft.operators.relational import top_per_group

TYPE_SCORE = {"Function": 1000, "Method": 1000, "Class": 1000, "Interface": 500, "Type": 500, "Variable": 500}


def lexical(nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """Scored by type, by how the label matches, and by confidence; ties by id."""
    label, q = F.lower("label"), query.lower()
    kind = F.coalesce(*[F.when(F.col("type") == t, F.lit(s)) for t, s in TYPE_SCORE.items()], F.lit(100))
    match = F.when(label == q, 500).when(label.startswith(q), 300).otherwise(100)
    scored = nodes.filter(F.instr(label, q) > 0).select("id", "label", (kind + match + F.col("confidence") * 10).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(limit)


MOST_TOKENS = 8


def query_tokens(query: str) -> list[str]:
    """What a query asks for: its first MOST_TOKENS runs of letters and digits, in small letters."""
    return re.findall("[a-z0-9]+", query.lower())[:MOST_TOKENS]


def prefix_tokens(docs: DataFrame, prefixes: list[str]) -> DataFrame:
    """(doc_id, hits): documents with a token for each prefix, and how many tokens match; within the row, no shuffle."""
    tokens = F.split(F.lower("text"), "[^a-z0-9]+")
    counts = F.transform(F.array(tokens), lambda own: F.array(*[F.size(F.filter(own, lambda t: F.startswith(t, F.lit(p)))) for p in prefixes]))[0]
    counted = docs.select("doc_id", counts.alias("counts")).filter(F.forall("counts", lambda n: n > 0))
    return counted.select("doc_id", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("hits"))


def full_text(docs: DataFrame, key: str, text: str, query: str, limit: int) -> DataFrame:
    """(key, score): the best documents that hold a token for each prefix of the query, by BM25.

    A prefix counts as a term: its frequency is the number of tokens that it begins, its document frequency
    the number of documents that hold one. One pass counts in each row; the totals are one row. A query
    without tokens finds nothing.
    """
    prefixes = query_tokens(query)
    if not prefixes:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")
    own = F.transform(F.array(tokens), lambda ts: F.struct(F.size(ts).alias("n"), F.array(*[F.size(F.filter(ts, lambda t: F.startswith(t, F.lit(p)))) for p in prefixes]).alias("tf")))[0]
    counted = docs.select(key, own.alias("own")).select(key, "own.n", "own.tf")
    held = [F.count_if(F.col("tf")[k] > 0).alias(f"df{k}") for k in range(len(prefixes))]
    totals = counted.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *held)  # one row
    hits = counted.filter(F.forall("tf", lambda n: n > 0)).crossJoin(F.broadcast(totals))
    score = F.lit(0.0)
    for k in range(len(prefixes)):
        idf = F.log(1 + (F.col("docs") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
        tf = F.col("tf")[k]
        score = score + idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * F.col("n") / F.col("mean")))
    return hits.select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def nearest(vectors: DataFrame, query_id: int, k: int) -> DataFrame:
    query = vectors.filter(F.col("vec_id") == query_id).select(F.col("embedding").cast("array<double>").alias("q"))  # one row
    other = vectors.filter(F.col("vec_id") != query_id).crossJoin(F.broadcast(query))
    near = other.select("vec_id", F.round(cosine(F.col("embedding").cast("array<double>"), F.col("q")), 6).alias("similarity"))
    return near.filter("similarity > 0").orderBy(F.desc("similarity"), "vec_id").limit(k)


def links(pages: DataFrame) -> DataFrame:
    """(page_id, target, n) of the link targets in each page."""
    found = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    return found.groupBy("page_id", "target").agg(F.count("*").alias("n"))


def across_layers(layers: list[DataFrame], needles: list[str], most: int) -> DataFrame:
    """(layer, id, score): the best rows of each layer (layer, id, text, weight) for any of the needles.

    A row scores its best match times its layer's weight; rows without a match drop out.
    """
    every = layers[0]
    for layer in layers[1:]:
        every = every.unionByName(layer)
    score = F.greatest(*[text_match(F.col("text"), n) for n in needles]) if len(needles) > 1 else text_match(F.col("text"), needles[0])
    scored = every.withColumn("score", score * F.col("weight")).filter("score > 0").groupBy("layer", "id").agg(F.max("score").alias("score"))
    return top_per_group(scored, "layer", [F.desc("score"), "id"], most).select("layer", "id", "score")


def miss_scope(nodes: DataFrame, searched: list[str]) -> DataFrame:
    """(kind, present, searched): why a search may have missed: kinds that it didn't search, and kinds that there are none of."""
    asked = nodes.sparkSession.createDataFrame([(k, True) for k in searched], "kind string, searched boolean")
    there = nodes.select(F.col("type").alias("kind")).distinct().withColumn("present", F.lit(True))
    both = there.join(asked, "kind", "full").select("kind", F.coalesce("present", F.lit(False)).alias("present"), F.coalesce("searched", F.lit(False)).alias("searched"))
    return both.filter("not (present and searched)")


def tokens_anywhere(nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """(id, score): nodes (id, type, label, file_path, place) that hold each token of a query in label or path.

    Scored by type, by how the label matches, and by confidence; what lies in a generated place comes last.
    """
    tokens = query_tokens(query)
    label, path = F.lower("label"), F.lower("file_path")
    hit = F.lit(bool(tokens))
    for t in tokens:
        hit = hit & (F.contains(label, F.lit(t)) | F.contains(path, F.lit(t)))
    q = " ".join(tokens)
    kind = F.coalesce(*[F.when(F.col("type") == t, F.lit(s)) for t, s in TYPE_SCORE.items()], F.lit(100))
    match = F.when(label == q, 500).when(label.startswith(q), 300).otherwise(100)
    score = kind + match + F.col("confidence") * 10 - F.when(is_generated(F.col("place")), 2000).otherwise(0)
    return nodes.filter(hit).select("id", score.cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def semantic(vectors: DataFrame, query_id: int, k: int, lexical: DataFrame) -> DataFrame:
    """(vec_id, similarity, mode): the nearest vectors, or the first lexical hits (vec_id, similarity) where no vector is near."""
    near = nearest(vectors, query_id, k)
    found = near.agg(F.count("*").alias("n"))  # one row
    other = lexical.orderBy(F.desc("similarity"), "vec_id").limit(k).crossJoin(F.broadcast(found)).filter("n = 0").drop("n")
    return near.withColumn("mode", F.lit("semantic")).unionByName(other.withColumn("mode", F.lit("lexical")))
