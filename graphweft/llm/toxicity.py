"""Toxicity by maximal scoring segments over token log-odds (free style).

Words get log-odds of toxic against clean documents with a Dirichlet prior from the whole corpus.
Words of the significant lexicon score their log-odds, all others a small loss, so that a text is
expected to lose. One linear scan finds all maximal scoring segments. Karlin-Altschul statistics
turn a segment's score into the bits by which it exceeds what a clean text of that length shows by
chance; a logistic curve over the best segment and the sum of all turns bits into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.llm.common import bounded_labels, distinct_text_sample, held_out, small_batches, tidy

FOLDS, HELD_OUT = 5, 0
MOST_LABELLED = 40_000  # labelled rows to learn from, at most
PRIOR = 1_000.0  # pseudo-documents of the corpus prior
LEAST_Z = 3.0
LOSS = 0.35
_FLUSH = 100_000  # words that a worker counts before it passes them on
_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def segments(hits: list[tuple[int, float]], loss: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence that scores `hits` (position,
    score), in order, and -loss everywhere else; linear in the number of hits.

    Each candidate keeps the running total before it (low) and with it (high). A new candidate
    swallows earlier ones for as long as the nearest of them that began lower also ended lower.
    """
    total, last = 0.0, -1
    stack: list[list] = []  # first, last, low, high, place of the nearest candidate with a smaller low
    for at, score in hits:
        total -= loss * (at - last - 1)
        low, high, first = total, total + score, at
        total, last = high, at
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append([first, at, low, high, j])
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, high - low) for a, b, low, high, _ in stack]


def corpus_counts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(word, n, toxic, clean): documents that hold the word, of all and of each label in the sample."""
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left").select("text", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [Counter(), Counter(), Counter()]

        def rows() -> pa.RecordBatch:
            words = list(sums[0])
            own = [pa.array([c[w] for w in words], pa.int64()) for c in sums]
            for c in sums:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array([w.encode("utf-8", "replace").decode() for w in words], pa.string()), *own], names=["word", "n", "toxic", "clean"])

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                own = set(tokens(text.as_py()))
                sums[0].update(own)
                if label is not None:
                    sums[1 if label else 2].update(own)
                if len(sums[0]) > _FLUSH:
                    yield rows()
        if sums[0]:
            yield rows()

    parts = labelled.mapInArrow(tidy(count), "word string, n bigint, toxic bigint, clean bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def lexicon(counts: DataFrame) -> list[tuple[str, float, float]]:
    """(word, log-odds, share among the clean words) of the words that mark toxic documents.

    Only words of the bounded sample's toxic documents, several of which must hold a word for it to reach
    LEAST_Z, can be in the list: it doesn't grow with the corpus.
    """
    totals = counts.agg(F.sum("n").alias("n"), F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    prior = F.col("w.n") / F.col("s.n") * PRIOR + 0.5
    t, c = F.col("toxic") + prior, F.col("clean") + prior
    size_t, size_c = F.col("s.t") + PRIOR, F.col("s.c") + PRIOR
    odds = F.log(t / (size_t - t)) - F.log(c / (size_c - c))
    scored = (
        counts.filter("toxic > 0").alias("w").crossJoin(F.broadcast(totals.filter("n is not null and t > 0 and c > 0")).alias("s"))  # one row
        .select("word", odds.alias("odds"), (odds / F.sqrt(1 / t + 1 / c)).alias("z"), (c / size_c).alias("share"))
    )
    best = scored.filter(F.col("z") >= LEAST_Z).orderBy("word")
    return [(r["word"], r["odds"], r["share"]) for r in best.collect()]


def karlin_lambda(scores: list[float], shares: list[float], loss: float) -> float:
    """The positive root of E[exp(lambda * score)] = 1 under the clean shares."""
    s, p = np.array([*scores, -loss]), np.array([*shares, max(1e-9, 1 - sum(shares))])
    low, high = 0.0, 1.0
    excess = lambda x: float(p @ np.exp(np.minimum(x * s, 700))) - 1
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return max(high, 1e-3)


def _scan(frame: DataFrame, words, column: str = "text") -> DataFrame:
    """frame with n_tokens and segments (first, last, score); `words` is a broadcast of the lexicon's scores."""
    schema = frame.withColumn("n_tokens", F.lit(0).cast("bigint")).withColumn("segments", F.array().cast("array<struct<first:int,last:int,score:double>>")).schema
    at_text = frame.columns.index(column)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = words.value
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            n, found = [], []
            for text in batch.column(at_text):
                own = tokens(text.as_py())
                hits = [(i, scores[w]) for i, w in enumerate(own) if w in scores]
                n.append(len(own))
                found.append([{"first": a, "last": b, "score": s} for a, b, s in segments(hits, LOSS)] if hits else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(found, kind)], names=[*batch.schema.names, "n_tokens", "segments"])

    return frame.mapInArrow(tidy(scan), schema)


def _features(lam: float, log_k: float):
    """Columns: the bits of the best segment, drawn below 40 without losing their order, and the logarithm of the bits of all."""
    chance = F.log(F.greatest("n_tokens", F.lit(1)).cast("double")) + log_k
    bits = F.transform("segments", lambda s: F.greatest(s["score"] * lam - chance, F.lit(0.0)))
    best = F.coalesce(F.array_max(bits), F.lit(0.0))
    whole = F.log1p(F.aggregate(bits, F.lit(0.0), lambda a, b: a + b))
    return best * 40.0 / (best + 40.0), whole


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method; the intercept comes first. No rows give a quarter for everything: nothing is known to be toxic."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    share = (y.sum() + 0.5) / (len(y) + 2)
    w[0] = math.log(share / (1 - share))
    if not len(y):
        return w
    penalty = np.eye(len(w)) * ridge
    penalty[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> dict:
    """The model: lexicon scores, lambda, log K and the logistic weights.

    At most MOST_LABELLED labelled rows outside the held-out fold are learnt from, one for each
    distinct text; the prior counts all documents. Without labels of both kinds the lexicon is
    empty and every document gets the toxic labels' share, without labels a quarter.
    """
    small_batches(spark)
    sample = distinct_text_sample(docs, bounded_labels(labels, "toxic", FOLDS, HELD_OUT, MOST_LABELLED)).collect()
    sample = spark.createDataFrame([(r["doc_id"], int(r["label"] > 0)) for r in sample], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int")
    words = lexicon(corpus_counts(docs, sample))
    scores = {w: s for w, s, _ in words}
    lam = karlin_lambda([s for _, s, _ in words], [p for _, _, p in words], LOSS) if words else 1.0
    learnt = _scan(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("label", "text"), spark.sparkContext.broadcast(scores)).drop("text")
    rows = learnt.select("label", "n_tokens", F.coalesce(F.array_max(F.col("segments.score")), F.lit(0.0)).alias("best"), "segments").cache()
    clean = rows.filter("label = 0").agg(F.count("*").alias("m"), F.sum(F.greatest("n_tokens", F.lit(1)) * F.exp(-F.col("best") * lam)).alias("e")).first()
    log_k = math.log(clean["m"] / clean["e"]) if clean["m"] and clean["e"] else 0.0
    got = rows.select("label", *(f.alias(n) for f, n in zip(_features(lam, log_k), ("best_bits", "all_bits")))).collect()
    rows.unpersist()
    x = np.array([[r["best_bits"], r["all_bits"]] for r in got], float).reshape(-1, 2)
    weights = fit_logistic(x, np.array([r["label"] for r in got], float))
    return {"scores": scores, "lambda": lam, "log_k": log_k, "weights": weights.tolist()}


def score(spark: SparkSession, docs: DataFrame, model: dict) -> DataFrame:
    """docs with n_tokens, segments (word positions and scores) and score, the probability of toxicity.

    A null or empty text has no segments and scores what clean-looking texts score. All rows and
    columns stay; columns of docs named n_tokens, segments or score are replaced.
    """
    frame = docs.drop("n_tokens", "segments", "score")
    found = _scan(frame, spark.sparkContext.broadcast(model["scores"]))
    best, whole = _features(model["lambda"], model["log_k"])
    a, b, c = model["weights"]
    return found.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(a + b * best + c * whole, F.lit(30.0)), F.lit(-30.0)))))


def report(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_segments, best_segment.

    Repeated rows are scored each; a null doc_id counts as held out. No documents give no rows.
    """
    model = fit(spark, docs, labels)
    scored = score(spark, docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("segments").alias("n_segments"), F.coalesce(F.array_max(F.col("segments.score")), F.lit(0.0)).alias("best_segment"),
    )


def keep_clean(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the documents that score 0.5 or more; the columns stay as they are.

    Null, empty and long texts and repeated rows are scored each as in score, so that null and empty ones stay
    where clean-looking texts do. Other columns keep their values whatever their names. No labels, or clean
    ones only, leave every document; toxic ones only leave none. No documents give no rows.
    """
    model = fit(spark, docs, labels)
    rest = [c for c in docs.columns if c != "text"]
    carried = docs.select("text", F.struct(*(f"`{c}`" for c in rest)).alias("row"))  # the text once, in and out of Python
    kept = score(spark, carried, model).filter("score < 0.5")
    return kept.select(*[(F.col("text") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
