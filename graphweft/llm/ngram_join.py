"""Jaccard join of documents' sets of word shingles by a grouped prefix join, complete for a given similarity.

All sets are put in one order, shingles that many texts hold last. Two sets of n and m shingles whose index is
s or more share one of the first n - ceil(s n) + 1 of the one and of the first m - ceil(s m) + 1 of the other
(their prefixes). Sets with the same prefix and size are one group, and only groups meet under the shingles of
their prefixes. Pairs of groups go where their sizes, or the places at which they meet, leave too little to share;
what stays is expanded to members, whose prefixes and then whole sets are compared.

Any order gives the same result. How often a shingle occurs is counted over all texts in a table of WIDTH
counters by hash, whose size doesn't grow with the texts. Shingles in a busy counter come late; with more texts
only the most frequent ones stand out of their counters, which costs candidates but no links.

A class of linked documents is asked for, not each of its pairs. So the groups under a shingle first meet one of
them, the leader, and the members of a group its first member; then only groups whose members lie in different
classes so far meet each other. Nothing is gathered by key: meetings are joins, which Spark splits where a key is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.llm.common import materialise, small_batches, tidy
from graphweft.llm.components import connected_components
from graphweft.llm.shingles import shingle_set

WIDTH = 1 << 18
MOST_BROADCAST = 500_000  # rows of two longs
_COUNTED_AT_ONCE = 1_000_000


def _by_counter(sets: list[np.ndarray], width: int) -> np.ndarray:
    return np.bincount((np.concatenate(sets) % np.uint64(width)).astype(np.int64), minlength=width)


def counters(docs: DataFrame, words: int, width: int = WIDTH) -> np.ndarray:
    """How many (text, shingle) pairs of all docs fall into each of `width` counters by the shingle's hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, own, n = np.zeros(width, np.int64), [np.empty(0, "<u8")], 0
        for batch in batches:
            for text in batch.column(0):
                own.append(shingle_set(text.as_py(), words))
                n += len(own[-1])
                if n > _COUNTED_AT_ONCE:
                    found += _by_counter(own, width)
                    own, n = [], 0
        found += _by_counter(own, width) if own else 0
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(found[held])], names=["at", "n"])

    rows = docs.select("text").mapInArrow(tidy(count), "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros(width, np.int64)
    found[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return found


def prefix_of(shingles: np.ndarray, percent: int, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the common order: by their counter, then by hash."""
    most = len(shingles) - (-(-percent * len(shingles) // 100)) + 1
    if not len(shingles):
        return shingles
    busy = counts[shingles % np.uint64(len(counts))]
    return shingles[np.lexsort((shingles, busy))[:most]]


def _digest(values: np.ndarray, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(values.tobytes(), seed)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _prefixes(docs: DataFrame, words: int, percent: int, counts: np.ndarray) -> DataFrame:
    """docs without text, and of each row: node (the hash of its set), n (its size), grp (the hash of prefix and size) and prefix."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)
    names = [c for c in docs.columns if c != "text"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), words) for t in batch.column(len(names))]
            heads = [prefix_of(s, percent, sent.value) for s in sets]
            at = np.cumsum([0, *map(len, heads)]).astype(np.int32)
            flat = np.concatenate([np.empty(0, "<u8"), *heads]).view(np.int64)
            own = [_signed([_digest(s) for s in sets]), pa.array([len(s) for s in sets], pa.int32()), _signed([_digest(h, len(s)) for h, s in zip(heads, sets)])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *own, pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=[*names, "node", "n", "grp", "prefix"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names)
    return docs.select(*names, "text").mapInArrow(tidy(scan), f"{kinds}node bigint, n int, grp bigint, prefix array<bigint>")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), words) for t in batch.column(0)]
            at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate([np.empty(0, "<u8"), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([_signed([_digest(s) for s in sets]), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["node", "shingles"])

    return texts.select("text").mapInArrow(tidy(scan), "node bigint, shingles array<bigint>")


def _enough(shared: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether sets of n and m shingles that share so many have an index of percent or more."""
    return shared * (100 + percent) >= (n + m) * percent


def _can_meet(x: Column, y: Column, percent: int) -> Column:
    """Whether groups x and y (at, n) that share a shingle at those places, and none before, can hold linked sets."""
    return _enough(F.least(x["n"] - x["at"], y["n"] - y["at"]), x["n"], y["n"], percent)


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (u, v) of nodes whose sets have an index of `percent` or more.

    What two sets share and their prefixes do not lies after the end of the prefix that ends first:
    pairs whose prefixes share too little for the rest to make up for go before their texts are read.
    """
    spark = docs.sparkSession
    pairs = materialise(spark, pairs.select("u", "v").distinct(), "candidates")
    some = materialise(spark, pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "candidate-nodes")
    met = nodes.join(F.broadcast(some) if some.count() <= MOST_BROADCAST else some, "node", "left_semi")  # without the prefixes that meet nothing
    known = lambda node, name: met.select(F.col("node").alias(node), F.struct("n", "prefix").alias(name))
    rest = F.greatest(*(F.col(f"{x}.n") - F.size(f"{x}.prefix") for x in "ab"))
    able = pairs.join(known("u", "a"), "u").join(known("v", "b"), "v")
    able = able.filter(_enough(F.size(F.array_intersect("a.prefix", "b.prefix")) + rest, F.col("a.n"), F.col("b.n"), percent))
    able = materialise(spark, able.select("u", "v"), "able")
    some = able.select(F.col("u").alias("node")).union(able.select("v")).distinct()
    wanted = materialise(spark, nodes.join(some, "node", "left_semi").select("doc_id", "_h"), "wanted")
    small = wanted.count() <= MOST_BROADCAST
    texts = docs.join(F.broadcast(wanted) if small else wanted, ["doc_id", "_h"], "left_semi").dropDuplicates(["doc_id", "_h"])
    sets = materialise(spark, _sets(texts, words), "shingle-sets")
    of = lambda node, name: sets.select(F.col("node").alias(node), F.struct(F.size("shingles").alias("n"), "shingles").alias(name))
    both = able.join(of("u", "a"), "u").join(of("v", "b"), "v")
    return both.filter(_enough(F.size(F.array_intersect("a.shingles", "b.shingles")), F.col("a.n"), F.col("b.n"), percent)).select("u", "v").distinct()


def _ordered(u: Column, v: Column) -> list[Column]:
    return [F.greatest(u, v).alias("u"), F.least(u, v).alias("v")]


def _led(nodes: DataFrame, groups: DataFrame, entries: DataFrame, leaders: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v): of each node with its group's first, and of the first of each group with that of the leader under each key."""
    inside = nodes.join(groups.select("grp", "first"), "grp").filter("node <> first").select(*_ordered(F.col("node"), F.col("first")))
    met = entries.join(leaders, "key").filter(F.col("x.grp") != F.col("lead.grp")).filter(_can_meet(F.col("x"), F.col("lead"), percent))
    return inside.union(met.select(*_ordered(F.col("x.first"), F.col("lead.first"))))


def _apart(entries: DataFrame, nodes: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of nodes in different classes, of one group or of two groups that can meet under a key.

    Under a key that holds several classes the groups that aren't wholly of the leader's class meet all groups.
    """
    spark = entries.sparkSession
    placed = nodes.select("grp", "node").join(classes, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")
    placed = materialise(spark, placed, "placed-nodes")
    spans = placed.groupBy("grp").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    spans = materialise(spark, spans, "group-spans")
    mixed = spans.filter("low < high").select(F.col("grp").alias("g"), F.col("grp").alias("h"))
    keyed = entries.withColumn("grp", F.col("x.grp")).join(spans, "grp").select("key", F.struct("x.at", "x.n", "x.grp", "low", "high").alias("x"))
    mains = keyed.groupBy("key").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"), F.min_by("x.low", "x").alias("main")).filter("low < high")
    open_ = materialise(spark, keyed.join(mains.select("key", "main"), "key"), "open-keys")
    outside = open_.filter((F.col("x.low") != F.col("main")) | (F.col("x.high") != F.col("main")))
    met = outside.select("key", F.col("x").alias("y")).join(open_.select("key", "x"), "key").filter(F.col("x.grp") != F.col("y.grp"))
    met = met.filter((F.least("x.low", "y.low") < F.greatest("x.high", "y.high")) & _can_meet(F.col("x"), F.col("y"), percent))
    met = met.select(F.greatest("x.grp", "y.grp").alias("g"), F.least("x.grp", "y.grp").alias("h"))
    pairs = materialise(spark, met.union(mixed).distinct(), "group-pairs")
    kinds = materialise(spark, placed.select("grp", "class").distinct(), "group-classes")
    left, right = (kinds.select(F.col("grp").alias(g), F.col("class").alias(c)) for g, c in (("g", "a"), ("h", "b")))
    pairs = pairs.join(left, "g").join(right, "h").filter((F.col("a") != F.col("b")) & ((F.col("g") != F.col("h")) | (F.col("a") < F.col("b"))))
    left, right = (placed.select(F.col("grp").alias(g), F.col("class").alias(c), F.col("node").alias(x)) for g, c, x in (("g", "a", "u"), ("h", "b", "v")))
    return pairs.join(left, ["g", "a"]).join(right, ["h", "b"]).select(*_ordered(F.col("u"), F.col("v")))


def set_classes(spark: SparkSession, docs: DataFrame, words: int, percent: int, candidates: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, _h, node, n, component) for rows of docs (doc_id, _h, text), in which doc_id and _h name a text.

    node is the hash of the text's set of shingles, n its size, component the smallest node that it is linked with
    through any number of links. Texts without words have a node of their own, which links with nothing.
    `candidates` gives, for the nodes (node, doc_id, _h, ...), pairs (u, v), u > v, that another method takes for likely links:
    they are compared with the leaders' pairs, and what they link meets no more.
    """
    small_batches(spark)
    rows = materialise(spark, _prefixes(docs.select("doc_id", "_h", "text"), words, percent, counters(docs, words)), "shingle-prefixes")
    nodes = rows.filter("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "_h", "n", "grp", "prefix")).alias("least"))
    nodes = materialise(spark, nodes.select("node", "least.*"), "set-nodes")
    groups = nodes.groupBy("grp").agg(F.min("node").alias("first"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    groups = materialise(spark, groups, "prefix-groups")
    entries = groups.select("grp", "first", "n", F.posexplode("prefix").alias("at", "key")).select("key", F.struct("at", "n", "grp", "first").alias("x"))
    # most keys are of one group: they go by their number alone, before anything else of theirs is moved
    shared = materialise(spark, entries.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key"), "shared-keys")
    entries = materialise(spark, entries.join(shared, "key", "left_semi"), "key-entries")
    leaders = materialise(spark, entries.groupBy("key").agg(F.min("x").alias("lead")), "key-leaders")
    first = _led(nodes, groups, entries, leaders, percent)
    if candidates is not None:
        first = first.union(candidates(nodes))
    tried = materialise(spark, first.distinct(), "led")
    links = materialise(spark, _verified(tried, docs, nodes, words, percent), "set-links")
    classes = materialise(spark, connected_components(spark, links), "set-classes")
    more = _apart(entries, nodes, classes, percent).distinct().join(tried, ["u", "v"], "left_anti")
    links = links.unionByName(materialise(spark, _verified(more, docs, nodes, words, percent), "set-links"))
    classes = connected_components(spark, links)
    return rows.select("doc_id", "_h", "node", "n").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))


def report(spark: SparkSession, docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text); component_id is the smallest doc_id linked.

    Two documents link when 100 times the shingles that their sets share is percent times those of either or more.
    A text of fewer words is one shingle. Null and empty texts, and those without words, have none, are linked with nothing and
    keep their own id. Repeated rows stay, each with the same values. A null doc_id keeps its row: its component_id is the
    smallest id that is not null, or null if there is none. Other columns are ignored. No documents give no rows.
    Shingles are told apart by 64 bits of their hash, sets by 64 bits of the hash of theirs.
    """
    named = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))
    found = materialise(spark, set_classes(spark, named, words, percent), "document-classes")
    least = found.filter("n > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    known = found.join(least, "component", "left")
    return known.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
