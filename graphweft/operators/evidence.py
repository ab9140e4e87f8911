"""Evidence of a compiler or language server: records, what a collection may replace, and the calls it proves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft import model
from graphweft.operators.relational import first_wins, innermost

# Fixed: how sure a record's word for it is.
SURE = {"high": 0.95, "medium": 0.8, "low": 0.6}
RECORD = (
    "kind string, symbolId string, qname string, name string, file string, language string, confidence string, result_state string, severity string, code string, message string,"
    " range struct<start:struct<line:int,col:int>,end:struct<line:int,col:int>>, from struct<file:string,line:int,qname:string,name:string>, to struct<file:string,line:int,qname:string,name:string>"
)
ENVELOPE = (
    "schema_version string, collectionId string, provider string, status string, session struct<collectedAt:string,resumedFrom:int,scope:struct<kind:string,files:array<string>>>,"
    f" operations map<string,struct<status:string,count:int>>, records array<struct<{RECORD.replace(' string', ':string').replace('range struct', 'range:struct').replace('from struct', 'from:struct').replace('to struct', 'to:struct')}>>"
)


def read_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records of JSON lines, and the lines that are no JSON (value); blank lines and comments are neither."""
    lines = spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> '' and value not like '#%'")
    parsed = lines.select("value", F.from_json("value", RECORD + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.filter("r._bad is null").select("r.*").drop("_bad"), parsed.filter("r._bad is not null").select("value")


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    """Collections, one JSON document a file: the envelope's fields with their records in an array."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.from_json("value", ENVELOPE).alias("e")).select("e.*").filter("schema_version = '0.2'")


def authority(collections: DataFrame) -> DataFrame:
    """Collections with may_invalidate and may_replace, and why not.

    To say that an edge is gone a run must have succeeded, have asked for references, and have walked something.
    To replace earlier runs it must also have records, have begun afresh, and not be held to some files.
    """
    asked = F.coalesce(F.col("operations")["references"]["status"] != "not_collected", F.lit(False))
    by_files = F.coalesce((F.col("session.scope.kind") == "files") & F.col("session.scope.files").isNotNull(), F.lit(False))
    nothing = by_files & (F.size("session.scope.files") == 0)
    shared = F.when(~F.coalesce(F.col("status") == "ok", F.lit(False)), "not ok").when(~asked, "no references").when(nothing, "empty scope")
    empty = F.coalesce(F.size("records"), F.lit(0)) <= 0
    more = F.coalesce(shared, F.when(empty, "no records").when(F.coalesce(F.col("session.resumedFrom"), F.lit(0)) > 0, "continues another").when(by_files, "held to files"))
    return collections.select("collectionId", "provider", shared.isNull().alias("may_invalidate"), more.isNull().alias("may_replace"), shared.alias("why_not_invalidate"), more.alias("why_not_replace"))


def split_definitions(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """references (file, line, ...) with is_definition: those at a definition's place."""
    places = definitions.select("file", "line").distinct().withColumn("is_definition", F.lit(True))
    return references.join(places, ["file", "line"], "left").withColumn("is_definition", F.coalesce("is_definition", F.lit(False)))


def defined_symbols(records: DataFrame, nodes: DataFrame, width: int = 200) -> DataFrame:
    """(symbol, node, first, last, file): the node that each symbol's definition lies in; callables before others, made up last.

    records are (seq, symbol, file, line), nodes (id, type, file_path, start_line, end_line). Of the nodes around a
    definition functions win, then the innermost. A definition in no node stands for itself. Nodes are met by the
    stretches of `width` lines that they reach into; take about the usual length of a node.
    """
    spans = nodes.filter("end_line >= start_line and file_path <> ''").select(F.col("file_path").alias("file"), "id", "type", F.col("start_line").alias("first"), F.col("end_line").alias("last"))
    callable_ = F.col("type").isin("Function", "Method").cast("int")
    met = spans.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))))
    around = records.withColumn("stretch", F.floor(F.col("line") / width)).join(met, ["file", "stretch"]).filter("line between first and last")
    best = around.groupBy("seq").agg(F.max(F.struct(callable_.alias("callable"), "first", (-F.col("last")).alias("end"), "id")).alias("b"))
    own = records.join(best, "seq", "left")
    made = F.concat(F.lit("ci:lsp:"), F.sha1("symbol"))
    ranked = own.select("symbol", "file", "seq", F.coalesce("b.id", made).alias("node"), F.coalesce(F.col("b.callable") + 1, F.lit(0)).alias("rank"), F.coalesce("b.first", "line").alias("first"), F.coalesce(-F.col("b.end"), F.col("line")).alias("last"))
    chosen = ranked.groupBy("symbol").agg(F.max(F.struct("rank", (-F.col("seq")).alias("early"), "node", "first", "last", "file")).alias("c"))
    return chosen.select("symbol", "c.node", "c.first", "c.last", "c.file")


def proven_calls(references: DataFrame, symbols: DataFrame, nodes: DataFrame, width: int = 200) -> DataFrame:
    """(from_id, to_id, source_file, source_line, confidence): the calls that found references (ref, symbol, file, line, confidence) prove.

    The caller is the innermost node around the reference, else the file. A reference inside the callee's own
    lines is its declaration, and nothing calls itself.
    """
    spans = nodes.filter("type <> 'File' and end_line >= start_line and file_path <> ''").select(F.col("file_path").alias("file"), F.col("id").alias("span_key"), F.col("start_line").alias("first"), F.col("end_line").alias("last"))
    # the pick among equal spans goes by a number
    spans = spans.withColumn("span_id", F.xxhash64("span_key"))
    # a line is looked up once, however many references stand on it
    points = references.select("file", F.col("line").alias("point_id"), F.col("line").alias("at")).distinct()
    inner = innermost(points, spans.drop("span_key"), "file", width).join(spans.select("span_id", F.col("span_key").alias("caller")), "span_id").select("file", F.col("point_id").alias("line"), "caller")
    met = references.join(inner, ["file", "line"], "left").join(symbols.select("symbol", "node", "first", "last", F.col("file").alias("own_file")), "symbol")
    caller = F.coalesce("caller", F.concat(F.lit("file:"), "file"))
    inside = (F.col("file") == F.col("own_file")) & F.col("line").between(F.col("first"), F.col("last"))
    calls = met.select(caller.alias("from_id"), F.col("node").alias("to_id"), F.col("file").alias("source_file"), F.col("line").alias("source_line"), "confidence", inside.alias("inside")).filter("not inside and from_id <> to_id")
    sure = F.coalesce(*[F.when(F.col("confidence") == k, F.lit(v)) for k, v in SURE.items()], F.lit(0.5))
    return calls.groupBy("from_id", "to_id", "source_file", "source_line").agg(F.max(sure).alias("confidence"))


def as_graph(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, label, file_path) and edges (from_id, to_id, relation, source_line) of single records.

    A symbol is defined by its file; references and calls go from end to end; an include imports; a diagnostic
    hangs on its file.
    """
    file_id = lambda f: F.concat(F.lit("file:"), f)
    named = lambda q: F.concat(F.lit("ci:"), F.sha1(q))
    line = F.col("range.start.line")
    symbols = records.filter("kind in ('symbol', 'definition') and qname is not null")
    ends = records.filter(F.col("kind").isin("reference", "call") & F.col("from.qname").isNotNull() & F.col("to.qname").isNotNull())
    includes = records.filter("kind = 'include' and to.file is not null")
    trouble = records.filter("kind = 'diagnostic' and file is not null and message is not null")
    diagnostic = F.concat(F.lit("diag:"), F.sha1(F.concat_ws("|", "file", line.cast("string"), F.coalesce("code", F.lit("")), "message")))
    files = records.select(F.explode(F.array("file", "from.file", "to.file")).alias("file_path")).filter("file_path is not null").distinct()
    nodes = (
        files.select(file_id(F.col("file_path")).alias("id"), F.lit("File").alias("type"), F.element_at(F.split("file_path", "/"), -1).alias("label"), "file_path")
        .unionByName(symbols.select(named(F.col("qname")).alias("id"), F.lit("Symbol").alias("type"), F.coalesce("name", "qname").alias("label"), F.col("file").alias("file_path")))
        .unionByName(trouble.select(diagnostic.alias("id"), F.lit("Symbol").alias("type"), F.col("message").alias("label"), F.col("file").alias("file_path")))
    )
    shells = ends.select(F.inline(F.array("from", "to"))).filter("qname is not null").select(named(F.col("qname")).alias("id"), F.lit("Symbol").alias("type"), F.coalesce("name", "qname").alias("label"), F.col("file").alias("file_path"))
    relation = F.when(F.col("kind") == "call", "CALLS").otherwise("REFERENCES")
    edges = (
        symbols.select(file_id(F.col("file")).alias("from_id"), named(F.col("qname")).alias("to_id"), F.lit("DEFINES").alias("relation"), line.alias("source_line"))
        .unionByName(ends.select(named(F.col("from.qname")).alias("from_id"), named(F.col("to.qname")).alias("to_id"), relation.alias("relation"), F.col("from.line").alias("source_line")))
        .unionByName(includes.select(file_id(F.col("file")).alias("from_id"), file_id(F.col("to.file")).alias("to_id"), F.lit("IMPORTS").alias("relation"), line.alias("source_line")))
        .unionByName(trouble.select(file_id(F.col("file")).alias("from_id"), diagnostic.alias("to_id"), F.lit("HAS_DIAGNOSTIC").alias("relation"), line.alias("source_line")))
    )
    own = first_wins(nodes.withColumn("seq", F.lit(0)).unionByName(shells.withColumn("seq", F.lit(1))), ["id"], ["seq", "label", "file_path"]).drop("seq")
    return own, edges.groupBy("from_id", "to_id", "relation").agg(F.min("source_line").alias("source_line"))


def unchanged_only(evidence: DataFrame, changed: DataFrame | None, column: str = "file") -> DataFrame:
    """The evidence on files that didn't change (file); if what changed isn't known, none of it."""
    if changed is None:
        return evidence.limit(0)
    return evidence.join(changed.select(F.col("file").alias(column)).distinct(), column, "left_anti")


def invalidated(edges: DataFrame, nodes: DataFrame, provider: str, scope: DataFrame | None) -> DataFrame:
    """edges (from_id, to_id, provenance, extractor, was) after a provider's earlier word is taken back.

    Promoted edges return to what they were, the provider's own go. A scope (file) holds both to edges into
    symbols of these files.
    """
    own = edges.withColumn("in_scope", F.lit(True))
    if scope is not None:
        inside = nodes.join(scope.select(F.col("file").alias("file_path")), "file_path", "left_semi").select(F.col("id").alias("to_id")).withColumn("in_scope", F.lit(True))
        own = edges.join(inside, "to_id", "left").withColumn("in_scope", F.coalesce("in_scope", F.lit(False)))
    theirs = (F.col("extractor") == provider) & (F.col("provenance") == model.VERIFIED) & F.col("in_scope")
    kept = own.filter(~(theirs & F.col("was").isNull()))
    return kept.select(*[c for c in edges.columns if c not in ("provenance", "was")], F.when(theirs, F.col("was")).otherwise(F.col("provenance")).alias("provenance"), F.when(~theirs, F.col("was")).alias("was"))


def compacted(collections: DataFrame) -> DataFrame:
    """(provider, collection): of each provider the collection to keep: one with records before an empty one, then the latest."""
    return collections.groupBy("provider").agg(F.max_by("collection", F.struct((F.col("n") > 0), F.col("collected_at"), F.col("collection"))).alias("collection"))


def operation_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("kind").agg(F.count("*").alias("n"))


def coverage(files: DataFrame, covered: DataFrame, endings: list[str]) -> DataFrame:
    """One row: eligible and covered files (file) by ending; null, not zero, if nothing is eligible."""
    ending = F.lower(F.regexp_extract("file", r"(\.[^./]+)$", 1))
    own = files.select("file").distinct().filter(ending.isin(endings)).join(covered.select("file").distinct().withColumn("c", F.lit(1)), "file", "left")
    return own.agg(F.nullif(F.count("*"), F.lit(0)).alias("eligible"), F.when(F.count("*") > 0, F.count("c")).alias("covered"))


def vacuum_advice(size: Column, free: Column) -> Column:
    """Whether a store of so many bytes, so many of them free, is worth compacting: 50 MB of which a quarter is free."""
    return (size >= 50 * 1024 * 1024) & (free >= 0.25 * size)
