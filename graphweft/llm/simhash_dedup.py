"""SimHash near-dedup by covering locality-sensitive hashing (free style).

A 64-bit fingerprint takes the majority of the bits of the XXH64 of all word shingles. Fingerprints
that differ in at most `radius` bits link; linked documents, and those linked through others, form a
component. Candidates come from covering tables: bit i gets a non-zero vector of radius+1 bits, and
the mask of vector v holds the bits whose vector has an odd inner product with v. Any `radius`
differing bits leave some v that is orthogonal to them all, so each close pair agrees on some mask.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.llm import ngram_join
from graphweft.llm.common import materialise
from graphweft.llm.components import connected_components
from graphweft.llm.shingles import shingle_hashes


def fingerprint_of(text: str | None, words_per_shingle: int = 3) -> int:
    """The fingerprint of one text as an unsigned integer; no words give 0."""
    ones = np.zeros(64, np.int64)
    n = 0
    for hashes in shingle_hashes(text, words_per_shingle):
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keys, and fp: one row per document, fp the 64 bits as a signed long."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint_of(t.as_py(), words_per_shingle) for t in batch.column(len(keys))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=[*keys, "fp"])

    kinds = "".join(f"`{k}` {docs.schema[k].dataType.simpleString()}, " for k in keys)
    return docs.select(*keys, "text").mapInArrow(scan, f"{kinds}fp bigint")


def covering_masks(radius: int = 2, bits: int = 64) -> list[int]:
    """2^(radius+1)-1 masks such that any `radius` bits are outside at least one of them."""
    most = (1 << (radius + 1)) - 1
    vectors = [1 + i % most for i in range(bits)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, most + 1)]


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("bigint")


def close_links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Links (u, v) that connect every pair of nodes (fp, node) whose fingerprints are close.

    All members of a covering bucket share the masked bits, so two close ones differ in the other
    bits only, and some fingerprint one bit from each lies between them. Members of buckets with company
    emit those fingerprints (itself and its flips outside the mask); who meets there is close without a
    further check, and at most 65 distinct fingerprints can meet, however large the bucket. No pairs within a bucket
    are emitted. For a radius of 1 only itself and what one flip leads to meet: who emits a flip, and who is it.
    """
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    masks = covering_masks(radius)
    keyed = nodes.select("fp", "node", F.posexplode(F.array(*[F.col("fp").bitwiseAND(_long(m)) for m in masks])).alias("t", "key"))
    company = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1").select("t", "key")
    members = keyed.join(company, ["t", "key"]).select("fp", "node", "t")
    flips = [F.array(*[_long(1 << i) for i in range(64) if not m >> i & 1]) for m in masks]
    around = F.transform(F.element_at(F.array(*flips), F.col("t") + 1), lambda bit: F.col("fp").bitwiseXOR(bit))
    if radius == 1:
        flipped = members.select("node", F.explode(around).alias("fp")).join(nodes.withColumnRenamed("node", "other"), "fp")
        return flipped.select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).distinct()
    met = members.select("node", F.explode(F.concat(F.array("fp"), around)).alias("z"))
    groups = met.groupBy("z").agg(F.collect_set("node").alias("nodes")).filter(F.size("nodes") > 1)
    return groups.select(F.explode("nodes").alias("u"), F.array_min("nodes").alias("v")).filter("u <> v").distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, words_per_shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text).

    Null and empty texts have fingerprint zero and link like any other. Repeated rows stay, each
    with the same values. A null doc_id keeps its row; component_id is the smallest id that is not
    null, or null if there is none. Other columns are ignored. No documents give no rows.
    """
    fps = materialise(spark, fingerprints(docs, words_per_shingle), "fingerprints")
    nodes = materialise(spark, fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    links = close_links(nodes.filter("least is not null").select("fp", F.col("fp").alias("node")), radius)
    components = connected_components(spark, links).withColumnRenamed("node", "fp")
    grouped = nodes.join(components, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    known = grouped.join(least, "component").select("fp", "component_id")
    return fps.join(known, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def near_pairs(spark: SparkSession, nodes: DataFrame, fps: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v), u > v: pairs of nodes (node, doc_id, _h) that connect all whose fingerprints (doc_id, _h, fp) are equal or close."""
    own = nodes.select("node", "doc_id", "_h").join(fps, ["doc_id", "_h"]).select("fp", "node").distinct()
    own = materialise(spark, own, "fingerprint-nodes")
    firsts = materialise(spark, own.groupBy("fp").agg(F.min("node").alias("node")), "fingerprint-firsts")
    equal = own.join(firsts.withColumnRenamed("node", "first"), "fp").filter("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    return equal.unionByName(close_links(firsts, radius)).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def keep_one(spark: SparkSession, docs: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """The rows of docs, one per group of near copies: that of the smallest doc_id. Rows with a null doc_id stay.

    Texts whose sets of word shingles have a Jaccard index of `similarity` or more are near copies,
    and so are those linked through others. Candidates are the texts whose fingerprints differ in at most `radius` bits
    (close_links); each pair's sets are compared. A pair of that index can differ in more bits: what the fingerprints left
    in different classes meets by shingles (ngram_join.set_classes), so that no link is lost. Texts without words, null ones
    too, have the same empty set. Of rows with equal id and text one stays. Other columns keep their values
    whatever their names. No documents give no rows.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    marked = docs.select("doc_id", "text", F.struct(*rest, F.lit(0)).alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))
    named = marked.filter("doc_id is not null").select("doc_id", "_h", "text")
    fps = materialise(spark, fingerprints(named, words_per_shingle, ("doc_id", "_h")), "fingerprints")
    known = ngram_join.set_classes(spark, named, words_per_shingle, round(100 * similarity), lambda nodes: near_pairs(spark, nodes, fps, radius))
    kept = known.groupBy("component").agg(F.min(F.struct("doc_id", "_h")).alias("kept")).select("kept.doc_id", "kept._h")
    # one row by id and text: of repeated ids the text that was chosen stays
    one = marked.join(kept, ["doc_id", "_h"], "left_semi").dropDuplicates(["doc_id", "_h"])
    every = one.unionByName(marked.filter("doc_id is null"))
    return every.select(*[(F.col(c) if c in ("doc_id", "text") else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
