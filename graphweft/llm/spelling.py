"""Spelling variants grouped by a symmetric-delete join.

Every word emits itself and its distinct single deletions. Two words that are one insertion, deletion or replacement
apart share one of these: the shorter of the two, or what both leave without the place at which they differ. Deletions are
64-bit hashes made from the hashes of what stands before and after the deleted code point, so that a word of any length takes
work in proportion to its length; who meets is verified by the exact distance. No more words than (letters + 1) x (code points + 1) can
share a deletion, so that no key grows with the texts.

A word's form is its most frequent near word, if that is frequent enough beside it. Forms only lead to more
frequent words; following them doubles the step with each join.

Joins of words and of their keys are merges: Spark sizes words by their compressed files and keys as if each word had one, so
that it would broadcast tables that grow with the texts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.llm.common import materialise, small_batches, tidy

RUN = "[A-Za-zÀ-ÿ]+"
ONE_IN = 97  # of the runs of a document lose a code point, by their hash
LEAST_POINTS = 5
LEAST_TIMES = 3
TIMES_OVER = 2  # a form occurs so many times as often as the word
_WORDS_AT_ONCE = 200_000


def words_of(doc_id: object, text: str | None) -> Iterator[tuple[str, int]]:
    """(word, times) of a document: its runs, A-Z in lower case, of which one in 97 loses a code point."""
    low = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    for run, n in Counter(re.findall(RUN, low)).items():
        h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
        at = h % len(run)
        yield (run if h % ONE_IN else run[:at] + run[at + 1 :]), n


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all documents (doc_id, text): the words of enough code points and occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                for word, n in words_of(doc_id.as_py(), text.as_py()):
                    if len(word) >= LEAST_POINTS:
                        found[word] += n
                if len(found) > _WORDS_AT_ONCE:
                    yield rows()
                    found.clear()
        yield rows()

    counts = docs.select("doc_id", "text").mapInArrow(tidy(count), "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_TIMES)


_FACTOR = 0x9E3779B97F4A7C15


def deletions(word: str) -> np.ndarray:
    """The distinct hashes of a word and of its single deletions, as unsigned 64-bit integers.

    The hash of a text is the sum of code point times _FACTOR to the power of its place, so that what follows a
    deleted code point moves down by one power. Deleting any of a run of equal code points gives the same.
    """
    points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(points), np.uint64(_FACTOR))]), dtype=np.uint64)
        before = np.concatenate([[np.uint64(0)], np.cumsum((points * points + points) * powers[:-1], dtype=np.uint64)])
        lower = np.concatenate([[np.uint64(0)], np.cumsum((points[1:] * points[1:] + points[1:]) * powers[: len(points) - 1], dtype=np.uint64)]) if len(points) else before
        without = before[:-1] + (lower[-1] - lower)
    return np.unique(np.append(without, before[-1]))


def _keyed(words: DataFrame) -> DataFrame:
    """(key, id): a row for each key of a word; id is the word's hash, so that long words aren't repeated."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [deletions(w.as_py()) for w in batch.column(1)]
            at = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.uint64), *keys]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["id", "keys"])

    keyed = words.select("id", "word").mapInArrow(tidy(emit), "id bigint, keys array<bigint>")
    return keyed.select(F.explode("keys").alias("key"), "id")


def one_edit(a: str, b: str) -> bool:
    """Whether different words a and b differ by one inserted, deleted or replaced code point, in linear time."""
    if abs(len(a) - len(b)) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[at + (len(a) >= len(b)) :] == b[at + (len(b) >= len(a)) :]


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every pair of words (word, n) that are one inserted, deleted or replaced code point apart, both ways.

    Pairs that meet under several keys are one before they are verified.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [one_edit(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield batch.filter(pa.array(near, pa.bool_()))

    words = words.select(F.xxhash64("word").alias("id"), "word", "n")
    keyed = _keyed(words)
    met = keyed.join(keyed.withColumnRenamed("id", "other").hint("merge"), "key").filter("id < other").select("id", "other").distinct()
    x, y = (words.select(F.col("id").alias(i), F.struct("word", "n").alias(name)).hint("merge") for i, name in (("id", "x"), ("other", "y")))
    pairs = met.join(x, "id").join(y, "other").select(F.col("x.word").alias("a"), F.col("x.n").alias("a_n"), F.col("y.word").alias("b"), F.col("y.n").alias("b_n"))
    pairs = pairs.mapInArrow(tidy(verify), pairs.schema).select(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n")).alias("x"), F.struct(F.col("b").alias("word"), F.col("b_n").alias("n")).alias("y"))
    both = pairs.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("p"))
    return both.select("p.x.word", F.col("p.y.word").alias("near"), F.col("p.y.n").alias("near_n"))


def roots(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """(word, root) for forms (word, form), each word once and no word its own form in the end.

    Each round replaces what a word points to by what that points to, so that chains of any length take as
    many rounds as their length has binary digits.
    """
    now = materialise(spark, forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further")).hint("merge")
        after = now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        after = materialise(spark, after, "roots")
        now = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return now


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of docs (doc_id, text) of 5 code points and 3 occurrences or more.

    n counts occurrences in all documents, n_near the words one edit away. form is the one of these with the largest n,
    the smallest of equals in code-point order, if it occurs twice as often as the word; form_n is its n. root is where forms lead,
    the word itself if it has none. Null and empty texts have no words; a null doc_id counts as an empty one in the hash that shortens
    runs. Repeated rows count each time. Other columns are ignored. No documents give no rows.
    """
    small_batches(spark)
    words = materialise(spark, word_counts(docs), "words")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.max("near_n").alias("form_n"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best"))
    known = words.join(near.hint("merge"), "word", "left")
    has = F.col("form_n") >= TIMES_OVER * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, F.col("form_n")).alias("form_n"))
    known = materialise(spark, known, "forms")
    led = roots(spark, known.filter("form is not null"))
    return known.join(led.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
