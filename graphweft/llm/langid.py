"""Language identification by nearest centroids over character n-grams (free style).

Texts become normalised TF-IDF vectors of hashed letter n-grams; document frequencies are counted over all
texts that may be learnt from. Each language has several centroids, clustered by cosine from a bounded
sample of its texts, in one task a language; a text gets the language of the nearest one, and is marked as
rejected if it lies further from that centroid than nearly all texts that formed it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.llm.common import held_out

FOLDS, HELD_OUT = 4, 2
MOST_PER_LANGUAGE = 800  # documents to learn a language's centroids from, about
BINS = 4096
CENTROIDS = 4
REJECT = 0.01  # the share of a centroid's own texts that lie beyond its limit
_PIECE = 2_000_000

_letters = None


def _letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def grams(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams of 1 to 3 characters; each run of other characters is one space, as are both ends.

    None: no letter. Long texts are taken in pieces, with the last two characters of the piece before,
    so that each n-gram counts once wherever the borders fall.
    """
    if not text:
        return None
    table, text = _letter_table(), text.lower()
    counts = np.zeros(BINS, np.int64)
    before = np.array([32], np.uint32)
    any_letter = False
    for at in range(0, len(text) + 1, _PIECE):
        own = np.frombuffer(text[at : at + _PIECE].encode("utf-32-le", "surrogatepass"), "<u4")
        letter = table[own]
        any_letter |= bool(letter.any())
        own = np.where(letter, own, 32).astype(np.uint32)
        if at + _PIECE > len(text):
            own = np.append(own, np.uint32(32))
        line = np.concatenate((before, own))
        keep = np.ones(len(line), bool)
        keep[1:] = (line[1:] != 32) | (line[:-1] != 32)
        keep[: len(before)] = True
        old, line = len(before), line[keep]
        one = line * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (line[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
        three = (two[:-1] ^ (line[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        for h in (one[old if at else 0 :], two[old - 1 :], three[max(0, old - 2) :]):
            counts += np.bincount(h >> np.uint32(20), minlength=BINS)
        before = line[-2:]
    return counts if any_letter else None


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / max(float(np.linalg.norm(v)), 1e-9)


def _cluster(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Spherical k-means: unit rows in, unit centroids out."""
    random = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[random.choice(len(x), k, replace=False)]
    for _ in range(15):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[near == j].sum(axis=0) if (near == j).any() else centres[j] for j in range(k)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centres


def _document_frequencies(known: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts hold each bin, and how many texts have a letter: counted over all of known."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BINS + 1, np.int64)  # the last: texts
        for batch in batches:
            for text in batch.column(0):
                if (own := grams(text.as_py())) is not None:
                    sums[:-1] += own > 0
                    sums[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS + 1)), pa.array(sums)], names=["bin", "n"])

    rows = known.select("text").mapInArrow(count, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect()  # a row a bin
    sums = np.zeros(BINS + 1, np.int64)
    for r in rows:
        sums[r["bin"]] = r["n"]
    return sums[:-1], int(sums[-1])


def fit(spark: SparkSession, docs: DataFrame) -> dict:
    """idf, centroids, their languages and limits. Every value of lang is learnt.

    Document frequencies cover all texts that may be learnt from; centroids come from about MOST_PER_LANGUAGE
    texts a language, which a hash of the id and text chooses, clustered where a language's sample lies. The
    model has CENTROIDS rows a language and is all that reaches the driver. Rows of the held-out fold,
    without lang, without text or without a letter teach nothing.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, HELD_OUT)).select("doc_id", "lang", "text")
    held, n = _document_frequencies(known)
    if not n:
        return {}
    idf = (np.log((1 + n) / (1 + held)) + 1).astype(np.float32)
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit("langid")), F.lit(1 << 30))
    taken = known.join(F.broadcast(sizes), "lang").filter(place < F.lit(float(MOST_PER_LANGUAGE << 30)) / F.col("n"))  # a row a language
    taken = taken.select("lang", place.alias("place"), "text").dropDuplicates(["lang", "place"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [grams(text.as_py()) for text in batch.column(2)]
            packed = pa.array([None if g is None else g.astype("<u4").tobytes() for g in own], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["lang", "place", "grams"])

    counted = taken.mapInArrow(count, "lang string, place bigint, grams binary").filter("grams is not null")

    def cluster(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("place")
        x = np.stack([vector(np.frombuffer(g, "<u4"), idf) for g in own["grams"]]).astype(np.float32)
        found = _cluster(x, CENTROIDS, zlib.crc32(key[0].encode()))
        near = x @ found.T
        best = near.argmax(axis=1)
        limits = [float(np.quantile(near[best == j, j], REJECT)) if (best == j).any() else 0.0 for j in range(len(found))]
        return pd.DataFrame({"lang": [key[0]] * len(found), "centre": [c.astype(np.float32).tobytes() for c in found], "limit": limits})

    rows = counted.groupBy("lang").applyInPandas(cluster, "lang string, centre binary, limit double").collect()
    if not rows:
        return {}
    rows.sort(key=lambda r: (r["lang"], bytes(r["centre"])))
    centres = np.stack([np.frombuffer(r["centre"], np.float32) for r in rows])
    return {"idf": idf, "centres": centres, "names": [r["lang"] for r in rows], "limits": np.array([r["limit"] for r in rows])}


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected.

    score is the cosine to the nearest centroid; of equally near ones the first by language wins. A text
    that is null, empty or has no letter is `und`, with score 0, and rejected; so is every text if there is
    nothing to learn from. Whole texts of any length count. Repeated rows and null ids stay; a null id counts
    as held out. No documents give no rows. Other columns are ignored.
    """
    sent = spark.sparkContext.broadcast(fit(spark, docs))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            names, scores, rejected = [], [], []
            for text in batch.column(1):
                counts = grams(text.as_py()) if model else None
                if counts is None:
                    names.append("und"), scores.append(0.0), rejected.append(True)
                    continue
                near = model["centres"] @ vector(counts, model["idf"])
                best = int(near.argmax())
                names.append(model["names"][best]), scores.append(float(min(1.0, max(0.0, near[best])))), rejected.append(bool(near[best] < model["limits"][best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.select("doc_id").withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).withColumn("rejected", F.lit(True)).schema
    found = docs.select("doc_id", "text").mapInArrow(predict, kind)
    return found.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected")
