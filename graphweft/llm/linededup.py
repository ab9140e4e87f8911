"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Lines are compared as lists of words in lower case. Equal lines, and lines of at least LEAST words
that one word edit (a word replaced, added or left out) turns into each other, count as the same;
the earliest by doc_id and line stays. A line's deletion variants are its words less one; equal
variants meet by hash, and the edit distance of those that meet is checked.

Only lines that can have a partner emit variants: one edit leaves the first p or the last p words
of both lines alike, where p is the largest power of two up to half the words. Lines whose
first and last p words occur in no other line drop out before, whatever the size of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweft.llm.common import materialise

LEAST = 5  # one edit in five words is a similarity of 0.8
MOST_BROADCAST = 500_000  # rows of 50 bytes
HOT = 10_000  # a line that is more than this part of all lines is hot: there are fewer such lines
_PIECE = 512


def _order(doc_id: Column, kind: T.DataType) -> Column:
    """What documents are ordered by: whole numbers as such, other ids as their strings; a null id comes last."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.coalesce(doc_id.cast("bigint"), F.lit((1 << 63) - 1))
    return F.coalesce(F.concat(F.lit("0"), doc_id.cast("string")), F.lit("1"))


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, ord, h, text): the other columns in one struct, what orders documents, and a hash of the text; a null text is empty."""
    order = _order(F.col("doc_id"), docs.schema["doc_id"].dataType)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*rest).alias("row"), order.alias("ord"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")


def _raw_lines(docs: DataFrame) -> DataFrame:
    return docs.select("ord", "h", F.posexplode(F.split(F.lower("text"), "\n")).alias("line_no", "line"))


def _words(lines: DataFrame) -> DataFrame:
    """(ord, h, line_no, words, n, lh, ...): the lines that hold a word; spaces separate words."""
    # lines without a word go by a look at the line: a filter on the words would split each line twice
    each = lines.filter(F.trim("line") != "").withColumn("words", F.array_remove(F.split("line", " "), "")).drop("line")
    return each.withColumn("n", F.size("words")).withColumn("lh", F.xxhash64("words"))


def _half(n: Column) -> Column:
    """The largest power of two up to n/2; n is 2 at least."""
    return F.call_function("shiftleft", F.lit(1), (F.floor(F.log2(n.cast("double") + 0.5)) - 1).cast("int"))


def _ends(words: str, p: Column) -> Column:
    return F.array(F.xxhash64(F.lit("first"), p, F.slice(words, F.lit(1), p)), F.xxhash64(F.lit("last"), p, F.slice(words, -p, p)))


def _first(*more: str) -> Column:
    return F.min(F.struct("ord", "h", "line_no", *more))


def _bound(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _xor(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x))


def _without_each(here: Column, back: Column, base: Column) -> Column:
    """For each place: base, what stands before it (here) and after it (back), combined."""

    def step(a: Column, x: Column) -> Column:
        after = a["after"].bitwiseXOR(x["back"])
        out = F.concat(a["out"], F.array(a["before"].bitwiseXOR(after)))
        return F.struct(a["before"].bitwiseXOR(x["here"]).alias("before"), after.alias("after"), out.alias("out"))

    start = F.struct(base.alias("before"), _xor(back).alias("after"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(F.arrays_zip(here.alias("here"), back.alias("back")), start, step, lambda a: a["out"])


def _variants(words: str) -> Column:
    """array<bigint>: the hash of all words, then the hashes of the words less the first, the second, ...

    The hash of a list combines the hashes of its words with their places, so that each variant
    follows from the one before. Words are taken _PIECE at a time: the work grows with the words.
    """
    here = F.transform(words, lambda w, i: F.xxhash64(w, i))
    back = F.transform(words, lambda w, i: F.xxhash64(w, i - 1))  # its place once an earlier word is gone
    pieces = F.sequence(F.lit(0), F.floor((F.size(words) - 1) / _PIECE).cast("int"))
    cut = lambda x, k: F.slice(x, k * _PIECE + 1, F.lit(_PIECE))

    def each(x: Column) -> Column:
        around = _without_each(F.transform(pieces, lambda k: _xor(cut(x["here"], k))), F.transform(pieces, lambda k: _xor(cut(x["back"], k))), F.lit(0).cast("bigint"))
        cuts = _bound(around, lambda base: F.flatten(F.transform(pieces, lambda k: _without_each(cut(x["here"], k), cut(x["back"], k), F.get(base, k)))))
        return F.concat(F.array(_xor(x["here"])), cuts)

    return _bound(F.struct(here.alias("here"), back.alias("back")), each)


def distance_one(a: Column, b: Column) -> Column:
    """Whether at most one word edit lies between two lists: what they share at both ends leaves one word."""
    longest = F.greatest(F.size(a), F.size(b))
    both = F.least(F.size(a), F.size(b))

    def shared(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(F.slice(x, F.lit(1), both), F.slice(y, F.lit(1), both), lambda p, q: p == q),
            F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
            lambda s, same: F.struct((s["n"] + (s["on"] & same).cast("int")).alias("n"), (s["on"] & same).alias("on")),
            lambda s: s["n"],
        )

    return (longest - both <= 1) & (F.least(shared(a, b) + shared(F.reverse(a), F.reverse(b)), both) >= longest - 1)


def _near(spark: SparkSession, docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(lh, n, kp): the distinct lines with an earlier one at one word edit."""
    able = distinct.filter(F.col("n") >= LEAST - 1)
    keys = able.select("lh", "n", "kp", F.explode(F.concat(F.array("kp", "ks"), F.coalesce("more", F.array().cast("array<bigint>")))).alias("key"))
    company = keys.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
    suspects = keys.join(company, "key").select("lh", "n", "kp").distinct()
    suspects = materialise(spark, distinct.join(suspects, ["lh", "n", "kp"], "left_semi").select("lh", "n", "kp", "first"), "suspects")
    small = suspects.count() <= MOST_BROADCAST
    wanted = suspects.select(F.col("first.ord").alias("ord"), F.col("first.h").alias("h"), F.col("first.line_no").alias("line_no"), "kp")
    raw = _raw_lines(docs).join(F.broadcast(wanted) if small else wanted, ["ord", "h", "line_no"])
    lines = _words(raw).dropDuplicates(["ord", "h", "line_no"])  # of repeated rows
    lines = materialise(spark, lines.select("lh", "n", "kp", F.struct("ord", "h", "line_no").alias("first"), "words"), "suspect-lines")
    # written once: making variants costs more than reading them twice
    emitted = materialise(spark, lines.select("first", F.posexplode(_variants("words")).alias("i", "z")), "variants")
    company = emitted.groupBy("z").agg(F.count("*").alias("c")).filter("c > 1").select("z")
    met = materialise(spark, emitted.join(company, "z"), "equal-variants")
    # one word left out at the same place of two lines: replaced; of one line only: added or left out
    groups = met.groupBy("z", "i").agg(F.min("first").alias("m"))
    by_z = groups.groupBy("z").agg(F.min(F.when(F.col("i") == 0, F.col("m"))).alias("whole"), F.min(F.when(F.col("i") > 0, F.col("m"))).alias("cut"))
    earliest = groups.join(by_z, "z").select("z", "i", F.when(F.col("i") == 0, F.least("cut", "whole")).otherwise(F.least("m", "whole")).alias("partner"))
    pairs = met.join(earliest, ["z", "i"]).filter("partner < first").select("first", "partner").distinct()
    text = lines.select("first", "words", "lh", "n", "kp")
    other = lines.select(F.col("first").alias("partner"), F.col("words").alias("partner_words"), F.col("n").alias("partner_n"))
    checked = pairs.join(text, "first").join(other, "partner")
    return checked.filter((F.greatest("n", "partner_n") >= LEAST) & distance_one(F.col("words"), F.col("partner_words"))).select("lh", "n", "kp").distinct()


def duplicate_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(ord, h, drops array<int>): for each document with repeated lines, the numbers of those lines.

    docs has ord, h and text. Only hashes are shuffled to find the lines, not texts. Lines with many copies
    meet their first in a broadcast, the others in a shuffle.
    """
    lines = _words(_raw_lines(docs))
    p = F.when(F.col("n") >= 2, _half(F.greatest("n", F.lit(2)))).otherwise(F.lit(1))
    power = (F.col("n") >= 4) & (F.bit_count("n") == 1)  # one word less halves p
    hashed = lines.withColumn("p", p).withColumn("ends", _ends("words", F.col("p")))
    hashed = hashed.select(
        "ord", "h", "line_no", "lh", "n", F.col("ends")[0].alias("kp"), F.col("ends")[1].alias("ks"),
        F.when(power, _ends("words", F.greatest((F.col("p") / 2).cast("int"), F.lit(1)))).alias("more"),
    )
    hashed = materialise(spark, hashed, "lines")
    distinct = hashed.groupBy("lh", "n", "kp", "ks", "more").agg(_first().alias("first"), F.count("*").alias("copies"))
    distinct = materialise(spark, distinct, "distinct-lines")
    near = _near(spark, docs, distinct).withColumn("near", F.lit(True))
    joined = distinct.join(near, ["lh", "n", "kp"], "left").filter("near or copies > 1")
    doubtful = joined.select("lh", "n", "kp", F.struct("first", F.coalesce("near", F.lit(False)).alias("near")).alias("line"), "copies")
    doubtful = materialise(spark, doubtful, "doubtful-lines")
    least = hashed.count() // HOT
    hot = doubtful.filter(F.col("copies") > least).select("lh", "n", "kp", F.col("line").alias("hot"))
    marked = hashed.join(F.broadcast(hot), ["lh", "n", "kp"], "left")  # fewer than HOT rows: no task gets all copies of a line
    common = marked.filter("hot is not null").select("ord", "h", "line_no", F.col("hot").alias("line"))
    rare = marked.filter("hot is null").join(doubtful.filter(F.col("copies") <= least), ["lh", "n", "kp"]).select("ord", "h", "line_no", "line")
    gone = common.unionAll(rare).filter(F.col("line.near") | (F.struct("ord", "h", "line_no") != F.col("line.first")))
    return gone.groupBy("ord", "h").agg(F.collect_set("line_no").alias("drops"))


def _without_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(row, text, n_lines, n_dropped): docs with their texts cut; row holds the other columns."""
    keyed = _keyed(docs)
    # the side with the numbers of lines is the small one, and texts needn't be sorted
    joined = keyed.join(duplicate_lines(spark, keyed).hint("shuffle_hash"), ["ord", "h"], "left")
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drops"))
    # array_except works by hash: linear in the lines, whatever their number
    text = F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    return joined.select("row", text.alias("text"), F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).alias("n_dropped"))


def _as_before(docs: DataFrame, done: DataFrame, columns: list[str]) -> list[Column]:
    """The named columns of docs from done; n_chars is counted anew for the texts that changed."""
    out = {c: F.col(f"row.`{c}`") for c in columns if c != "text"} | {"text": F.col("text")}
    if "n_chars" in columns:
        out["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return [out[c].alias(c) for c in columns]


def dedup_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and any other columns) with n_lines, n_dropped, and the text without repeated lines.

    Lines without a word are never repeated lines. A null or empty text stays as it is, and has no or
    one line. Rows with equal id and text are one document: all keep the same lines. A null id comes
    after all others. Other columns keep their values whatever their names, but for n_lines and n_dropped, which
    are replaced, and n_chars, which is counted anew for the texts that change. No documents give no rows.
    """
    done = _without_repeats(spark, docs)
    return done.select(*_as_before(docs, done, [c for c in docs.columns if c not in ("n_lines", "n_dropped")]), "n_lines", "n_dropped")


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped and text, what stays of it.

    Nulls, empty and long texts, repeated rows and empty tables as in dedup_lines; other columns are ignored.
    """
    return dedup_lines(spark, docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


def keep_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs, all its columns, with repeated lines cut from the texts.

    Documents of which cutting leaves nothing but white space go; those that were null, empty or white space
    before stay, as do repeated rows. Otherwise as dedup_lines.
    """
    done = _without_repeats(spark, docs).filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    return done.select(*_as_before(docs, done, docs.columns))
