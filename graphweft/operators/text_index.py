"""A stored inverted index: postings in sorted ranges of terms, searched by prefixes without a look at the texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphweft.operators.lineage import cut
from graphweft.operators.relational import top_per_group
from graphweft.operators.search import MOST_TOKENS, query_tokens

BLOCK = 8_000_000  # bytes of texts whose postings a task holds at once; a longer text is a block of its own
FIRST, STEPS = 256, 512  # how many texts of a list a query looks at first; the steps that weights are told apart by, up to 2.2
_AFTER = "{"  # the character behind z: tokens hold digits and small letters only


@dataclass(frozen=True)
class TextIndex:
    """postings (term, key, tf, n), terms (term, df), totals (docs, mean): n is the length of the text in tokens."""

    postings: DataFrame
    terms: DataFrame
    totals: DataFrame


def tokens_of(text: Column) -> Column:
    """The runs of letters a-z and digits, in small letters; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each term of about BLOCK bytes of texts (key, text): the keys that hold it, how often, and their lengths.

    Under the empty term stand all keys.
    """
    letter = np.zeros(256, bool)
    letter[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = True
    for batch in batches:
        sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
        block = np.maximum(np.cumsum(sizes) - 1, 0) // BLOCK
        for at, end in zip(starts := np.flatnonzero(np.r_[True, np.diff(block) > 0]), np.r_[starts[1:], len(block)]):
            keys, rows = batch.column(0).slice(at, end - at), int(end - at)
            texts = [t.lower().encode() for t in batch.column(1).slice(at, rows).to_pylist()]
            data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
            own = letter[data]
            edges = np.flatnonzero(np.diff(np.r_[False, own]))
            first, last = edges[::2], edges[1::2]
            doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), first, "right")
            offsets = np.r_[0, np.cumsum(last - first)].astype(np.int32)
            words = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data[own].tobytes())).dictionary_encode()
            met, tf = np.unique(words.indices.to_numpy().astype(np.int64) * rows + doc, return_counts=True)
            term, doc = np.r_[met // rows, np.full(rows, len(words.dictionary))], np.r_[met % rows, np.arange(rows)]
            n = np.bincount(met % rows, tf, rows).astype(np.int32)
            ends = pa.array(np.r_[0, np.cumsum(np.bincount(term, minlength=len(words.dictionary) + 1))], pa.int32())
            columns = (keys.take(pa.array(doc)), pa.array(np.r_[tf, np.zeros(rows)], pa.int32()), pa.array(n[doc]))
            names = pa.concat_arrays([words.dictionary, pa.array([""])])
            yield pa.RecordBatch.from_arrays([names, *(pa.ListArray.from_arrays(ends, c) for c in columns)], ["term", "key", "tf", "n"])


def build(docs: DataFrame, key: str, text: str, path: str) -> None:
    """Write the index of the texts under path. Keys are unique; texts without tokens count in the totals only.

    A task turns its texts into blocks of postings, a row a term, and blocks are shuffled once. They are ordered by
    term and first key, so that a frequent term spreads over ranges.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = own.schema["key"].dataType.simpleString()
    blocks = cut(own.mapInArrow(_in_blocks, f"term string, key array<{kind}>, tf array<int>, n array<int>"))
    lengths = blocks.filter("term = ''").select(F.explode("n").alias("n"))
    lengths.agg(F.count("*").alias("docs"), F.avg("n").alias("mean")).write.parquet(f"{path}/totals")
    ordered = blocks.filter("term <> ''").repartitionByRange("term", F.col("key")[0]).sortWithinPartitions("term", F.col("key")[0])
    ordered.write.parquet(f"{path}/postings")
    terms = spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.sum(F.size("key")).alias("df"))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")


def load(spark: SparkSession, path: str) -> TextIndex:
    blocks, terms, totals = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "totals"))
    return TextIndex(blocks.select("term", F.inline(F.arrays_zip("key", "tf", "n"))), terms, totals)


def _within(prefix: str) -> Column:
    """Terms with the prefix as a range, which row groups are skipped by."""
    return (F.col("term") >= prefix) & (F.col("term") < prefix + _AFTER)


def expand(index: TextIndex, prefix: str, limit: int) -> DataFrame:
    """(term, df): the most frequent terms with the prefix, read from the dictionary alone."""
    return index.terms.filter(_within(prefix.lower())).orderBy(F.desc("df"), "term").limit(limit)


def _bm25(tf: Column, n: Column, df: Column) -> Column:
    idf = F.log(1 + (F.col("docs") - df + 0.5) / (df + 0.5))
    return idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * n / F.col("mean")))


def search(index: TextIndex, query: str, limit: int) -> DataFrame:
    """(key, score): what search.full_text finds, from the ranges of the query's prefixes."""
    prefixes = query_tokens(query)
    if not prefixes:
        return index.postings.select("key", F.lit(0.0).alias("score")).limit(0)
    asked = F.lit(False)
    for p in prefixes:
        asked = asked | _within(p)
    tf = [F.coalesce(F.sum(F.when(_within(p), F.col("tf"))), F.lit(0)).alias(f"tf{k}") for k, p in enumerate(prefixes)]
    met = index.postings.filter(asked).groupBy("key").agg(F.max("n").alias("n"), *tf)
    held = met.agg(*[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(prefixes))])  # one row
    hits = met.filter(" and ".join(f"tf{k} > 0" for k in range(len(prefixes))))
    hits = hits.crossJoin(F.broadcast(held)).crossJoin(F.broadcast(index.totals))
    score = F.lit(0.0)
    for k in range(len(prefixes)):
        score = score + _bm25(F.col(f"tf{k}"), F.col("n"), F.col(f"df{k}"))
    return hits.select("key", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "key").limit(limit)


def search_many(index: TextIndex, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, key, score, rn): the best texts for each of many queries (query_id, query), each as in `search`.

    Queries of the same prefixes are answered once. What a text holds of the prefixes asked for is gathered into a row.
    Each prefix lists its texts by weight, BM25 without the idf. A query looks into the first `FIRST` of each of its
    lists, and scores what it meets there in full. It ends when its last hit beats the sum of the weights where its
    lists were left, which no other text can reach, or when one of its lists is read to its end; the others look eight times as
    deep, so that the rounds are the logarithm of the texts. A query without tokens, or without a hit, has no row.
    """
    first = F.array_sort(F.slice(tokens_of(F.col("query")), 1, MOST_TOKENS))
    own = cut(queries.select("query_id", first.alias("prefixes")).filter(F.size("prefixes") > 0))
    sets = cut(own.select("prefixes").distinct().withColumn("set", F.monotonically_increasing_id()))
    prefixes = sets.select(F.explode("prefixes").alias("prefix")).distinct()
    held = _held(index, prefixes)
    frequency = held.select(F.explode("held.prefix").alias("prefix")).groupBy("prefix").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    frequency = frequency.crossJoin(F.broadcast(index.totals)).select("prefix", idf.alias("idf"))
    parts = sets.select("set", F.size("prefixes").alias("size"), F.explode("prefixes").alias("prefix")).join(frequency, "prefix")
    parts = parts.groupBy("set", "size").agg(F.array_sort(F.collect_list(F.struct("prefix", "idf"))).alias("parts"))
    left = cut(parts.filter(F.size("parts") == F.col("size")).select("set", "parts"))
    # of texts that hold the same, only the first keys can be among the best
    kept = top_per_group(held, ["n", "held"], ["key"], limit).crossJoin(F.broadcast(index.totals.select("mean")))
    texts = cut(kept.select("key", "n", "mean", F.map_from_entries("held").alias("held")))
    each = texts.select("key", "n", "mean", F.explode("held").alias("prefix", "tf"))
    each = each.select("prefix", "key", F.floor(_weight(F.lit(1.0), F.col("tf")) * STEPS).cast("int").alias("step"))
    steps = each.groupBy("prefix", "step").agg(F.count("*").alias("n"))  # 2.2 * STEPS rows a prefix at most
    down = W.partitionBy("prefix").orderBy(F.desc("step"))
    steps = cut(steps.withColumn("seen", F.sum("n").over(down)).withColumn("last", F.min("step").over(W.partitionBy("prefix"))))
    kind = index.postings.schema["key"].dataType.simpleString()
    found, depth = own.sparkSession.createDataFrame([], f"set bigint, key {kind}, score double, rn int"), FIRST
    while not left.isEmpty():
        read = steps.filter((F.col("seen") >= depth) | (F.col("step") == F.col("last")))
        read = read.groupBy("prefix").agg(F.max("step").alias("least"), (F.max("step") == F.first("last")).alias("whole"))
        asked = left.select("set", F.explode("parts").alias("part")).select("set", "part.prefix", "part.idf")
        bounds = cut(asked.join(read, "prefix").groupBy("set").agg(F.sum(F.col("idf") * F.col("least") / STEPS).alias("bound"), F.bool_or("whole").alias("whole")))
        lists = each.join(read.join(asked, "prefix", "left_semi"), "prefix").filter("step >= least").select("prefix", "key")
        met = lists.join(asked.select("prefix", "set").distinct(), "prefix").select("key", "set").distinct()
        scored = met.join(texts, "key").join(left, "set").select("set", "key", F.round(_score(), 6).alias("score")).filter("score is not null")
        best = cut(top_per_group(scored, "set", [F.desc("score"), "key"], limit))
        worst = best.groupBy("set").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
        done = bounds.join(worst, "set", "left").filter((F.col("n") >= limit) & (F.col("worst") > F.col("bound") + 1e-6) | F.col("whole"))  # 1e-6: scores are rounded
        found = found.unionByName(best.join(done, "set", "left_semi"))
        left, depth = cut(left.join(done, "set", "left_anti")), depth * 8
    return own.join(sets, "prefixes").join(found, "set").select("query_id", "key", "score", "rn")


def _held(index: TextIndex, prefixes: DataFrame) -> DataFrame:
    """(key, n, held): how often a text holds words of each prefix asked for, by prefix."""
    lengths = prefixes.agg(F.collect_set(F.length("prefix")).alias("lengths"))  # one row of as many numbers as lengths of tokens
    started = index.postings.crossJoin(F.broadcast(lengths)).select("term", "key", "tf", "n", F.explode(F.filter("lengths", lambda k: k <= F.length("term"))).alias("size"))
    met = started.select("key", "n", "tf", F.expr("left(term, size)").alias("prefix")).join(prefixes, "prefix")
    counted = met.repartition("key").groupBy("key", "n", "prefix").agg(F.sum("tf").cast("int").alias("tf"))
    return cut(counted.groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("prefix", "tf"))).alias("held")))


def _weight(idf: Column, tf: Column) -> Column:
    return idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * F.col("n") / F.col("mean")))


def _score() -> Column:
    """BM25 of the text's `held` by the query's `parts`; null unless it holds all of them."""
    return F.aggregate("parts", F.lit(0.0), lambda sum_, p: sum_ + _weight(p["idf"], F.col("held")[p["prefix"]]))
