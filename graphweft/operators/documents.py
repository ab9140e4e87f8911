"""What documents refer to: links, paths in code, qualified names; what they resolve to, and why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.functions import paths, texts

# How sure a rule is, and the patterns of links, code, paths and names in documents.
CONFIDENCE = {"markdown": 0.95, "inline-path": 0.85, "path-suffix": 0.80, "qualified": 0.90, "path-scoped": 0.85}
_LINK = r"\[[^\]\n]*\]\(\s*([^()\s]+?)(?:\s+[\"'][^\"']*[\"'])?\s*\)"
_CODE = r"`([^`\n]+)`"
_PATH = r"^[A-Za-z0-9._\-/@+]{1,300}$"
_ENDING = r"\.[A-Za-z][A-Za-z0-9]{0,9}$"
_OUTSIDE = r"(?i)^(?:[a-z][a-z0-9+.-]*:|//)"
_NAME = r"^([A-Za-z_$][\w$]*(?:(?:::|->|\.)[A-Za-z_$][\w$]*)+)(?:\(\s*\))?$"
_FILE = r"(?i)\.(?:md|json|js|mjs|cjs|ts|tsx|jsx|py|cpp|hpp|cc|h|c|yaml|yml|toml|ini|log|txt|sh|sql|lock|env)$"


def is_path(text: Column) -> Column:
    return text.rlike(_PATH) & (F.contains(text, F.lit("/")) | text.rlike(_ENDING))


def references(docs: DataFrame) -> DataFrame:
    """(doc, line_no, seq, rule, target): links and path-like code of docs (doc, text), outside fences, in order."""
    lines = docs.select("doc", F.inline(texts.unfenced_lines(F.col("text")))).withColumnRenamed("no", "line_no")
    found = lambda pattern, rule: F.transform(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)), lambda t: F.struct(F.lit(rule).alias("rule"), t.alias("target")))
    code = F.filter(found(_CODE, "inline-path"), lambda x: is_path(x["target"]))
    return lines.select("doc", "line_no", F.posexplode(F.concat(found(_LINK, "markdown"), code)).alias("seq", "x")).select("doc", "line_no", "seq", "x.rule", "x.target")


def written_path(target: Column) -> Column:
    """A target without its fragment and query."""
    return F.trim(F.regexp_extract(target, r"^([^#?]*)", 1))


def classified(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs (doc, target, ...) with kind (external, resolved, unresolved), id, tier and reason; files are (id, file_path).

    A path counts from the root and from the document's folder; if both exist and differ, neither does. What
    is neither may be the end of exactly one known path, on a border of segments.
    """
    own = refs.withColumn("path", written_path(F.col("target")))
    outside, empty = F.col("path").rlike(_OUTSIDE), ~F.col("path").rlike("[^./\\\\]")
    folder = paths.folder_of(F.col("doc"))
    own = own.withColumn("from_root", paths.normalised(F.col("path"))).withColumn("from_doc", paths.normalised(F.concat_ws("/", F.nullif(folder, F.lit("")), F.col("path"))))
    known = files.groupBy("file_path").agg(F.min("id").alias("id"))
    tails = F.transform(F.sequence(F.lit(2), F.size(F.split("file_path", "/"))), lambda k: F.array_join(F.slice(F.split("file_path", "/"), -k, k), "/"))
    suffix = known.filter(F.size(F.split("file_path", "/")) > 1).select("id", F.explode(tails).alias("tail")).groupBy("tail").agg(F.count("*").alias("n"), F.min("id").alias("tail_id")).filter("n = 1")
    at = lambda key, name: known.select(F.col("file_path").alias(key), F.col("id").alias(name))
    joined = own.join(at("from_root", "root_id"), "from_root", "left").join(at("from_doc", "doc_id"), "from_doc", "left").join(suffix.select(F.col("tail").alias("from_root"), "tail_id"), "from_root", "left")
    both = F.col("root_id").isNotNull() & F.col("doc_id").isNotNull() & (F.col("root_id") != F.col("doc_id"))
    exact = F.when(~both, F.coalesce("root_id", "doc_id"))
    neither = F.col("root_id").isNull() & F.col("doc_id").isNull()
    hit = F.when(outside | empty, F.lit(None)).otherwise(F.coalesce(exact, F.when(neither, F.col("tail_id"))))
    kind = F.when(empty, "unresolved").when(outside, "external").when(hit.isNotNull(), "resolved").otherwise("unresolved")
    tier = F.when(hit.isNotNull(), F.when(exact.isNotNull(), 1).otherwise(3))
    reason = F.when(kind == "unresolved", F.when(~empty & F.col("path").rlike(_ENDING), "no_such_path").otherwise("not_a_file_reference"))
    return joined.select(*refs.columns, kind.alias("kind"), hit.alias("id"), tier.alias("tier"), reason.alias("reason"))


def links(classified_refs: DataFrame, own_id: DataFrame) -> DataFrame:
    """(from_id, to_id, source_line, rule, confidence): one link for each document and target, by its first reference.

    own_id is (doc, doc_id). A document doesn't link to itself.
    """
    rule = F.when(F.col("tier") == 3, "path-suffix").otherwise(F.col("rule"))
    hits = classified_refs.filter("kind = 'resolved'").withColumn("rule", rule).join(own_id, "doc").filter("id <> doc_id")
    first = hits.groupBy(F.col("doc_id").alias("from_id"), F.col("id").alias("to_id")).agg(F.min(F.struct("line_no", "seq", "rule")).alias("first"))
    sure = F.coalesce(*[F.when(F.col("first.rule") == r, F.lit(c)) for r, c in CONFIDENCE.items()])
    return first.select("from_id", "to_id", F.col("first.line_no").alias("source_line"), F.col("first.rule").alias("rule"), sure.alias("confidence"))


def qualified_names(docs: DataFrame) -> DataFrame:
    """(doc, line_no, name): code in docs that joins identifiers by ::, -> or dots, spelt with dots; file names are none."""
    lines = docs.select("doc", F.inline(texts.unfenced_lines(F.col("text")))).withColumnRenamed("no", "line_no")
    spans = lines.select("doc", "line_no", F.explode(F.regexp_extract_all("line", F.lit(_CODE), F.lit(1))).alias("span"))
    name = F.regexp_replace(F.regexp_extract("span", _NAME, 1), "::|->", ".")
    return spans.filter(F.col("span").rlike(_NAME) & ~F.col("span").rlike(_FILE)).select("doc", "line_no", name.alias("name"))


def scoped_names(docs: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(doc, line_no, to_id): words in code on a line that names a file by its path, where that file has one symbol of that name.

    symbols are (id, label, file_path).
    """
    lines = docs.select("doc", F.inline(texts.unfenced_lines(F.col("text")))).withColumnRenamed("no", "line_no")
    spans = lines.select("doc", "line_no", F.explode(F.regexp_extract_all("line", F.lit(_CODE), F.lit(1))).alias("span"))
    named = spans.join(files.select(F.col("file_path").alias("span")).distinct(), "span").select("doc", "line_no", F.col("span").alias("file_path")).distinct()
    words = spans.filter(~is_path(F.col("span"))).select("doc", "line_no", F.regexp_extract("span", r"^([A-Za-z_$][\w$]*)", 1).alias("label")).filter("label <> ''").distinct()
    unique = symbols.groupBy("file_path", "label").agg(F.count("*").alias("n"), F.min("id").alias("to_id")).filter("n = 1")
    met = words.join(named, ["doc", "line_no"]).join(unique, ["file_path", "label"])
    one = met.groupBy("doc", "line_no", "label").agg(F.countDistinct("to_id").alias("n"), F.min("to_id").alias("to_id")).filter("n = 1")
    return one.select("doc", "line_no", "to_id")


def mentions(docs: DataFrame, symbols: DataFrame, files: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(doc, to_id, source_line, rule, confidence): what docs mention, by its surest rule, then its first line.

    suffixes is (suffix, resolved): names that mean one symbol.
    """
    known = suffixes.filter("resolved is not null").select(F.col("suffix").alias("name"), F.col("resolved").alias("to_id"))
    qualified = qualified_names(docs).join(known, "name").select("doc", "line_no", "to_id", F.lit("qualified").alias("rule"))
    scoped = scoped_names(docs, symbols, files).select("doc", "line_no", "to_id", F.lit("path-scoped").alias("rule"))
    sure = F.coalesce(*[F.when(F.col("rule") == r, F.lit(c)) for r, c in CONFIDENCE.items()])
    both = qualified.unionByName(scoped).withColumn("confidence", sure)
    best = both.groupBy("doc", "to_id").agg(F.max_by(F.struct("line_no", "rule", "confidence"), F.struct("confidence", -F.col("line_no"))).alias("best"))
    return best.select("doc", "to_id", F.col("best.line_no").alias("source_line"), "best.rule", "best.confidence")


def misses(classified_refs: DataFrame) -> DataFrame:
    """(reason, n): why references stayed unresolved."""
    return classified_refs.filter("kind = 'unresolved'").groupBy("reason").agg(F.count("*").alias("n"))


def breakdown(edges: DataFrame) -> DataFrame:
    """(how, n): documents (from_id) by whether they link, mention or both."""
    each = edges.groupBy("from_id").agg(F.bool_or(F.col("relation") == "LINKS_TO").alias("l"), F.bool_or(F.col("relation") == "MENTIONS").alias("m")).filter("l or m")
    how = F.when(F.col("l") & F.col("m"), "both").when(F.col("l"), "link_only").otherwise("mention_only")
    return each.groupBy(how.alias("how")).agg(F.count("*").alias("n"))


def mentioned_in(edges: DataFrame, targets: DataFrame, most: int = 15) -> DataFrame:
    """(from_id, n_nodes, provenances): the documents that mention or link to most of the targets (id)."""
    met = edges.filter(F.col("relation").isin("MENTIONS", "LINKS_TO")).join(targets.select(F.col("id").alias("to_id")).distinct(), "to_id", "left_semi")
    told = met.groupBy("from_id").agg(F.countDistinct("to_id").alias("n_nodes"), F.array_join(F.sort_array(F.collect_set("provenance")), ",").alias("provenances"))  # a few provenances
    return told.orderBy(F.desc("n_nodes"), "from_id").limit(most)


def candidates(documents: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """(id, inbound, outbound, mentions): documents (id, file_path, changed) to read first: much linked, new, well connected ones."""
    end = lambda column, relation, name: edges.filter(F.col("relation") == relation).groupBy(F.col(column).alias("id")).agg(F.count("*").alias(name))
    own = documents
    for part in (end("to_id", "LINKS_TO", "inbound"), end("from_id", "LINKS_TO", "outbound"), end("from_id", "MENTIONS", "mentions")):
        own = own.join(part, "id", "left")
    own = own.fillna(0, ["inbound", "outbound", "mentions"])
    return own.orderBy(F.desc("inbound"), F.desc_nulls_last("changed"), F.desc(F.col("outbound") + F.col("mentions")), "file_path").limit(limit).select("id", "inbound", "outbound", "mentions")
