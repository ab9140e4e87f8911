"""Document fingerprints: SimHash in DataFrame functions only.

The terms of a text are its shingles of five words (lower case, split at white space); fewer words
are one term. Each term votes with its number of occurrences as weight: for a set bit of its 128-bit
hash it votes up, else down. The signs of the sums are the fingerprint. The cosine of the angle that
the differing bits stand for estimates how alike two texts are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweft.llm.common import materialise

WORDS = 5
BITS = 128
ROWS_PER_BUCKET = 4_000
MOST_BUCKETS = 100_000
_LANES = (1 << 32) + 1  # two counters of 32 bits in a long


def terms(text: Column, words: int = WORDS) -> Column:
    """array<bigint>: the hash of each shingle, repeats included; no words give an empty array."""
    each = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    # the words are computed once for each row: the outer lambda binds them
    return F.flatten(
        F.transform(
            F.array(each),
            lambda ws: F.when(
                F.size(ws) > 0,
                F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - (words - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(ws, i, words))),
            ).otherwise(F.array().cast("array<bigint>")),
        )
    )


def votes(exploded: DataFrame, keys: list[str], term: str = "term") -> DataFrame:
    """keys with hi and lo, the two halves of the fingerprint of all terms that share the keys.

    A long holds the counters of two bits, so 64 sums count 128 bits. Sums are combined before the
    shuffle, which moves one row for each text. A null term stands for no terms and gives zeros.
    """
    halves = {"hi": F.col(term), "lo": F.xxhash64(F.lit(1), F.col(term))}
    sums = [
        F.coalesce(F.sum(F.when(F.col(term).isNotNull(), F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_LANES)))), F.lit(0)).alias(f"{name}{k}")
        for name, h in halves.items()
        for k in range(32)
    ]
    counted = exploded.groupBy(*keys).agg(F.count(term).alias("n_terms"), *sums)

    def half(name: str) -> Column:
        out = F.lit(0).cast("bigint")
        for k in range(32):
            for count, bit in ((F.col(f"{name}{k}").bitwiseAND(F.lit(0xFFFFFFFF)), 1 << k), (F.shiftrightunsigned(F.col(f"{name}{k}"), 32), 1 << (k + 32))):
                signed = bit - (1 << 64) if bit >> 63 else bit
                out = out.bitwiseOR(F.when(count * 2 > F.col("n_terms"), F.lit(signed)).otherwise(F.lit(0)))
        return out

    return counted.select(*keys, half("hi").alias("hi"), half("lo").alias("lo"))


def as_hex(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def likeness(hi: Column, lo: Column, hi2: Column, lo2: Column) -> Column:
    """0 to 1: the cosine that the share of differing bits stands for, 0 beyond a right angle."""
    differ = F.bit_count(hi.bitwiseXOR(hi2)) + F.bit_count(lo.bitwiseXOR(lo2))
    return F.greatest(F.cos(differ * (math.pi / BITS)), F.lit(0.0))


def _bucket(doc_id: Column, cuts: list[int]) -> Column:
    """The number of cuts that the id reaches, by binary search in a constant array."""
    if not cuts:
        return F.lit(0)
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    among = F.lit(cuts).cast("array<bigint>")

    def step(at: Column, width: Column) -> Column:
        to = at + width
        return F.when((to <= len(cuts)) & (F.get(among, to - 1) <= doc_id), to).otherwise(at)

    return F.coalesce(F.aggregate(F.lit(steps).cast("array<int>"), F.lit(0), step), F.lit(0))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_id, next_text): each document with the one after it in descending doc_id.

    After the last comes the first. Ids are dealt into buckets of consecutive ids by quantiles, and
    the first document of a bucket also goes to the end of the bucket before it, so one shuffle of
    the texts does. Rows with equal ids are ordered by text; of wholly equal rows one stays. A null
    id comes after all others.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    want = min(MOST_BUCKETS, max(1, n // ROWS_PER_BUCKET))
    cuts: list[int] = []
    if want > 1:
        shares = [k / want for k in range(1, want)]
        found = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * want)).alias("q")).first()["q"]
        cuts = sorted(set(found or []))
    bucketed = docs.withColumn("bucket", _bucket(F.col("doc_id"), cuts))
    tops = [(r["bucket"], r["top"]) for r in bucketed.groupBy("bucket").agg(F.max("doc_id").alias("top")).filter("top is not null").collect()]  # a row a bucket
    tops.sort()
    goes = [(top, tops[(k + 1) % len(tops)][0]) for k, (_, top) in enumerate(tops)]
    guests = docs.sparkSession.createDataFrame(goes, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("host", T.IntegerType())]))
    places = F.array_compact(F.array(F.struct(F.lit(0).alias("guest"), F.col("bucket")), F.when(F.col("host").isNotNull(), F.struct(F.lit(1).alias("guest"), F.col("host").alias("bucket")))))
    dealt = bucketed.join(F.broadcast(guests), "doc_id", "left").select("doc_id", "text", F.inline(places))
    row = F.struct("doc_id", "text", "guest")
    window = "partition by bucket order by guest, doc_id desc nulls last, text"
    dealt = dealt.withColumn("row", row).selectExpr("doc_id", "text", "guest", f"lead(row) over ({window}) as ahead")
    same = F.col("doc_id").eqNullSafe(F.col("ahead.doc_id")) & (F.col("text") == F.col("ahead.text")) & (F.col("ahead.guest") == 0)
    own = dealt.filter((F.col("guest") == 0) & ~F.coalesce(same, F.lit(False)))
    return own.select("doc_id", "text", F.col("ahead.doc_id").alias("next_id"), F.coalesce("ahead.text", F.lit("")).alias("next_text"))


def report(spark: SparkSession, docs: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near.

    The edited text has its last third replaced by as many first characters of the next document's
    text; n_near is, for the documents whose id is divisible by 20, how many other fingerprints the block
    tables find within `radius` bits, and null for the rest. A null text is empty; an empty text has a
    fingerprint of zeros, and two empty texts are alike. Repeated rows give a row each, all with the next
    document of the last of them; two texts under one id give two. Other columns are ignored. No documents
    give no rows.
    """
    pairs = with_next(docs)
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.expr("left(text, n_chars - third)"), F.expr("left(next_text, third)"))
    each = (
        pairs.withColumn("n_chars", F.length("text")).withColumn("third", third).withColumn("edited", edited)
        .select(
            "doc_id", F.xxhash64("text").alias("h"), "next_id", F.xxhash64("next_text").alias("next_h"), F.col("n_chars").cast("bigint").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"), F.posexplode(F.array("text", "edited")).alias("side", "body"),
        )
    )
    keys = ["doc_id", "h", "next_id", "next_h", "n_chars", "edited_sha256"]
    voted = votes(each.select(*keys, "side", F.explode_outer(terms(F.col("body"))).alias("term")), [*keys, "side"])
    side = lambda k, c: F.max(F.when(F.col("side") == k, F.col(c)))
    both = voted.groupBy(*keys).agg(*(side(k, c).alias(f"{c}{k}") for k in (0, 1) for c in ("hi", "lo")))
    both = materialise(spark, both, "fingerprints")
    ahead = both.select(F.col("doc_id").alias("to_id"), F.col("h").alias("to_h"), F.col("hi0").alias("to_hi"), F.col("lo0").alias("to_lo"))
    joined = both.join(ahead, (F.col("next_id").eqNullSafe(F.col("to_id"))) & (F.col("next_h") == F.col("to_h")), "left")
    queried = F.col("doc_id").cast("string").cast("decimal(38,0)") % 20 == 0
    index = both.select(F.col("hi0").alias("hi"), F.col("lo0").alias("lo")).distinct()
    asked = both.filter(queried).select(F.col("hi0").alias("hi"), F.col("lo0").alias("lo")).distinct()
    near = search(asked, index, radius).filter("distance > 0 or query_hi <> hi or query_lo <> lo").groupBy("query_hi", "query_lo").agg(F.count("*").alias("n_near"))
    joined = joined.join(near, (F.col("hi0") == F.col("query_hi")) & (F.col("lo0") == F.col("query_lo")), "left")
    again = docs.groupBy(F.col("doc_id").alias("again_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("again_h")).agg(F.count("*").alias("copies")).filter("copies > 1")
    joined = joined.join(again, F.col("doc_id").eqNullSafe(F.col("again_id")) & (F.col("h") == F.col("again_h")), "left")
    joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)).cast("int"))))
    return joined.select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("hi0"), F.col("lo0")).alias("fingerprint"), as_hex(F.col("hi1"), F.col("lo1")).alias("edited_fingerprint"),
        likeness(F.col("hi0"), F.col("lo0"), F.col("hi1"), F.col("lo1")).alias("near_edited"),
        F.coalesce(likeness(F.col("hi0"), F.col("lo0"), F.col("to_hi"), F.col("to_lo")), F.lit(0.0)).alias("near_next"),
        F.when(queried, F.coalesce("n_near", F.lit(0)).cast("bigint")).alias("n_near"),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, hi, lo): one row for each distinct document id and text."""
    each = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.explode_outer(terms(F.col("text"))).alias("term"))
    return votes(each, ["doc_id", "h"]).drop("h")


def search(queries: DataFrame, index: DataFrame, radius: int = 3) -> DataFrame:
    """(query_hi, query_lo, hi, lo, distance): all distinct index fingerprints within the radius.

    Block tables: the bits are cut into radius+1 blocks; of two fingerprints within the radius at
    least one block is equal, so every table that leads with another block is joined on it and
    the candidates are checked. Each pair is found once, in the first table that holds it.
    """
    width = BITS // (radius + 1)

    def block(k: int, hi: str, lo: str) -> Column:
        bits = F.concat(F.lpad(F.bin(hi), 64, "0"), F.lpad(F.bin(lo), 64, "0"))
        return F.substring(bits, k * width + 1, width if k < radius else BITS - radius * width)

    def keyed(frame: DataFrame, hi: str, lo: str) -> DataFrame:
        own = frame.select(F.col("hi").alias(hi), F.col("lo").alias(lo)).distinct()
        return own.select(hi, lo, F.posexplode(F.array(*[block(k, hi, lo) for k in range(radius + 1)])).alias("t", "key"))

    distance = F.bit_count(F.col("query_hi").bitwiseXOR(F.col("hi"))) + F.bit_count(F.col("query_lo").bitwiseXOR(F.col("lo")))
    found = keyed(queries, "query_hi", "query_lo").join(keyed(index, "hi", "lo"), ["t", "key"]).withColumn("distance", distance)
    return found.filter(F.col("distance") <= radius).select("query_hi", "query_lo", "hi", "lo", "distance").distinct()
