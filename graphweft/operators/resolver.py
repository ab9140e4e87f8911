"""References to nodes: ordered rules as joins on equality, each refused where it stays ambiguous.

A rule looks a reference's key up in an index of how many nodes have it: in all, in the reference's own
file, and in its folder or below. Of an index only counts and one id cross the shuffle, so that a name that a
million nodes carry is one row, however many references name it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.functions import names, paths
from graphweft.functions.verdicts import COMMON_NAMES
from graphweft.operators.lineage import cut
from graphweft.operators.relational import first_wins

# Languages that share symbols, and the relations that stay within a family.
FAMILIES = {"laravel": "php", "javascript": "js_ts", "typescript": "js_ts", "c": "c_cpp", "cpp": "c_cpp"}
MEMBER_RELATIONS = ["CALLS", "INVOKES", "PASSES_THROUGH"]
BASES = ["EXTENDS", "IMPLEMENTS"]
CLASSLIKE = ["Class", "Interface", "Type"]
MEMBERS = ["Method", "Function"]
GATED = ["CALLS", "INVOKES", "PASSES_THROUGH", "EXTENDS", "IMPLEMENTS", "USES_TYPE", "TESTS", "REFERENCES"]


def family_of(language: Column) -> Column:
    known = F.coalesce(*[F.when(language == k, F.lit(v)) for k, v in FAMILIES.items()], language)
    return F.coalesce(F.nullif(known, F.lit("")), F.lit("unknown"))


def _suffixes(text: Column, separator: str) -> Column:
    parts = F.split(text, separator if separator != "." else r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, -k, k), separator))


RULES = ["qualified name", "suffix of a qualified name", "suffix of a path", "import of its file", "label", "member of a base"]


def node_keys(nodes: DataFrame) -> DataFrame:
    """(rule, key, id, family, file_path): every key of a rule under which nodes (id, label, qname, file_path, language, type) are found."""
    known = nodes.select("id", "type", "file_path", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("qname", F.lit("")).alias("qname"), family_of(F.col("language")).alias("family"))
    rule = lambda number, keys: F.transform(keys, lambda k: F.struct(F.lit(number).alias("rule"), k.alias("key")))
    none = F.array().cast("array<string>")
    keys = F.concat(
        rule(0, F.array("qname")), rule(1, _suffixes(F.col("qname"), ".")), rule(2, F.when(F.col("type") == "File", _suffixes(F.col("file_path"), "/")).otherwise(none)), rule(4, F.array("label"))
    )
    return known.select("id", "family", "file_path", F.inline(keys)).filter("key <> ''").select("rule", "key", "id", "family", "file_path")


def _folders(path: Column) -> Column:
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))


def _asked(refs: DataFrame) -> DataFrame:
    """refs with own_family and, a row each, the rule, spelling (its number) and key that they ask for."""
    member = F.col("relation").isin(MEMBER_RELATIONS) & names.member_target(F.col("target")).isNotNull()
    bare = F.when(member, names.lookup_candidates(F.col("target"), drop_extension=False)).otherwise(names.lookup_candidates(F.col("target")))
    dotted, path = F.col("target").rlike(r"[.\\/]"), (F.col("relation") == "IMPORTS") & F.col("target").rlike(r"[\\/]")
    ask = lambda rule, keys, when: F.transform(F.when(when, keys).otherwise(F.array().cast("array<string>")), lambda k, i: F.struct(F.lit(rule).alias("rule"), i.alias("spelling"), k.alias("key")))
    asked = F.concat(ask(0, bare, F.lit(True)), ask(1, bare, dotted), ask(2, F.array(names.external_target(F.col("target"))), path), ask(4, F.array("target"), F.lit(True)))
    return refs.select("ref_id", "source_file", "relation", "target", family_of(F.col("extractor")).alias("own_family"), F.inline(asked))


def asked_keys(refs: DataFrame) -> DataFrame:
    """(ref_id, source_file, rule, key): what the references ask for."""
    return _asked(refs).select("ref_id", "source_file", "rule", "key").distinct()


def _answers(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """(ref_id, rule, spelling, to_id, provenance) of what `_asked` gives, where a rule is sure.

    Most keys have one node: file and folder are only looked at where a key has several, or where a name is so common
    that nothing but the own file counts.
    """
    whole = cut(keys.groupBy("rule", "key", "family").agg(F.count("*").alias("n"), F.min("id").alias("id")))
    crowded = whole.groupBy("rule", "key").agg(F.sum("n").alias("k")).filter((F.col("k") > 1) | ((F.col("rule") == 4) & F.col("key").isin(COMMON_NAMES))).select("rule", "key")
    scoped = lambda file, folders: F.concat(F.array(F.struct(F.lit(1).alias("scope"), file.alias("place"))), F.transform(folders, lambda f: F.struct(F.lit(2).alias("scope"), f.alias("place"))))
    near = keys.join(crowded, ["rule", "key"], "left_semi").select("rule", "key", "family", "id", F.inline(scoped(F.col("file_path"), _folders(F.col("file_path")))))
    near = near.groupBy("rule", "key", "scope", "place", "family").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    folder = paths.folder_of(F.col("source_file"))
    close = asked.join(crowded, ["rule", "key"], "left_semi").select("*", F.inline(scoped(F.col("source_file"), F.array(folder)))).filter("scope < 2 or place <> ''")
    met = asked.join(whole, ["rule", "key"]).withColumn("scope", F.lit(0)).unionByName(close.join(near, ["rule", "key", "scope", "place"]).drop("place"))
    same = F.col("family") == F.col("own_family")
    found = met.groupBy("ref_id", "relation", "target", "own_family", "rule", "spelling").agg(
        *[F.sum(F.when((F.col("scope") == s) & w, F.col("n"))).alias(f"{name}{s}") for s in (0, 1, 2) for name, w in (("n", F.lit(True)), ("same_n", same))],
        *[F.min(F.when((F.col("scope") == s) & w, F.col("id"))).alias(f"{name}{s}") for s in (0, 1, 2) for name, w in (("id", F.lit(True)), ("same_id", same))],
    )
    inside = F.col("same_n0").isNotNull() & (F.col("own_family") != "unknown")
    gated = F.col("relation").isin(GATED) & (F.col("own_family") != "unknown")
    pick = lambda what, s: F.when(inside, F.col(f"same_{what}{s}")).when(~gated, F.col(f"{what}{s}"))
    one = [F.when(pick("n", s) == 1, pick("id", s)) for s in (0, 1, 2)]
    common = F.col("target").isin(COMMON_NAMES) & (F.col("rule") == 4)
    answer = F.when(common, one[1]).otherwise(F.coalesce(*one))
    sure = F.when(pick("n", 0) > 1, "AMBIGUOUS").when(F.col("rule").isin(0, 4), "EXTRACTED").otherwise("INFERRED")
    return found.select("ref_id", "rule", "spelling", answer.alias("to_id"), F.when(common, "INFERRED").otherwise(sure).alias("provenance")).filter("to_id is not null")


def imported(refs: DataFrame, nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """(ref_id, to_id) of refs whose target their file imports: the only node of the exported name in the file that it comes from.

    imports are (file_path, local, from_file, exported). A default export goes by the local name.
    """
    known = imports.select(F.col("file_path").alias("source_file"), F.col("local").alias("target"), F.col("from_file").alias("at"), F.when(F.col("exported") == "default", F.col("local")).otherwise(F.col("exported")).alias("label"))
    unique = nodes.filter("type <> 'File'").groupBy(F.col("file_path").alias("at"), "label").agg(F.count("*").alias("n"), F.min("id").alias("to_id")).filter("n = 1")
    met = refs.select("ref_id", "source_file", "target").join(known.distinct(), ["source_file", "target"]).join(unique, ["at", "label"])
    return met.groupBy("ref_id").agg(F.countDistinct("to_id").alias("n"), F.min("to_id").alias("to_id")).filter("n = 1").select("ref_id", "to_id")


def resolve(refs: DataFrame, nodes: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """refs (ref_id, source_file, relation, target, extractor) with to_id, rule and provenance; null where nothing was sure.

    The rules are tried in order for each spelling of the target: its qualified name; for a target with
    separators, a suffix of one; for an import by path, a suffix of a file's path; what its file imports
    under that name, if imports are given (see `imported`); its label. A rule answers
    with the only node there is, else the only one of the same file, else of the same folder. Nodes of the
    reference's own language family go first; for most relations others don't count. A common name resolves
    within its file only. The answer is ambiguous if several nodes had the key.
    What a reference asks is asked once, however many ask it (see `_questions`).
    """
    asked = _questions(refs)
    return _told(refs, _resolved(asked, nodes, imports))


#: What the answer to a reference depends on.
QUESTION = ["source_file", "relation", "target", "extractor"]


def _questions(refs: DataFrame) -> DataFrame:
    """The different questions that refs ask, with numbers as ref_id: a name that a million references of a file call is one row. Written, so that the numbers stay."""
    return cut(refs.select(QUESTION).distinct().withColumn("ref_id", F.monotonically_increasing_id()))


def _resolved(asked: DataFrame, nodes: DataFrame, imports: DataFrame | None) -> DataFrame:
    return resolve_by_keys(asked, node_keys(nodes), None if imports is None else imported(asked.filter(~F.col("target").isin(COMMON_NAMES)), nodes, imports))


def _told(refs: DataFrame, answers: DataFrame) -> DataFrame:
    """refs with what answers (QUESTION, rule, to_id, provenance) say; these are written first, and sent to refs if they are few."""
    known = cut(answers.filter("to_id is not null").select(*[F.col(c).alias(f"_{c}") for c in QUESTION], "rule", "to_id", "provenance"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in QUESTION]
    return refs.join(known, same, "left").select(*refs.columns, "rule", "to_id", "provenance")


def resolve_by_keys(refs: DataFrame, keys: DataFrame, proven: DataFrame | None = None) -> DataFrame:
    """resolve over the keys of nodes (see `node_keys`): of each key that a reference asks for (see `asked_keys`), all nodes must be there.

    proven: (ref_id, to_id) of what imports say.
    """
    answered = _answers(_asked(refs), keys)
    if proven is not None:
        answered = answered.unionByName(proven.select("ref_id", F.lit(3).alias("rule"), F.lit(0).alias("spelling"), "to_id", F.lit("INFERRED").alias("provenance")))
    best = answered.groupBy("ref_id").agg(F.min(F.struct("rule", "spelling", "to_id", "provenance")).alias("best"))
    return refs.join(best.select("ref_id", "best.rule", "best.to_id", "best.provenance"), "ref_id", "left")


def inherited(refs: DataFrame, nodes: DataFrame, contains: DataFrame, bases: DataFrame) -> DataFrame:
    """(ref_id, to_id) of refs (ref_id, source_file, relation, target, extractor) that name `owner.member`, where member stands in a base of owner.

    The owner is the class that has the name, or a suffix of its qualified name (rules 0 and 1 over classes). From there bases
    (from_id, to_id) are climbed level by level; the first level at which a class contains (from_id, to_id) one such method of the
    reference's language family, else one in its file, else in its folder, answers; of several such classes the least. A class is asked once
    for each reference, so that diamonds and cycles end. Each level is written to the shared folder: there are as many as the hierarchy is high.
    """
    split = names.member_target(F.col("target"))
    asked = refs.filter(F.col("relation").isin(MEMBER_RELATIONS)).withColumn("split", split).filter("split is not null")
    classes = nodes.filter(F.col("type").isin(CLASSLIKE))
    owners = asked.select("ref_id", "source_file", "relation", F.col("split.owner").alias("target"), family_of(F.col("extractor")).alias("own_family"))
    spelt = F.transform(names.lookup_candidates(F.col("target"), drop_extension=False), lambda k, i: F.struct(F.lit(1).alias("rule"), i.alias("spelling"), k.alias("key")))
    found = _answers(owners.select("*", F.inline(spelt)), node_keys(classes).filter("rule = 1"))
    found = found.groupBy("ref_id").agg(F.min_by("to_id", "spelling").alias("class"))
    own = F.col("own_family").isin("unknown") | (F.col("family") == F.col("own_family"))
    family = nodes.select(F.col("id").alias("to_id"), "type", "label", "file_path", family_of(F.col("language")).alias("family"))
    members = cut(contains.select("from_id", "to_id").join(family.filter(F.col("type").isin(MEMBERS)), "to_id").select(F.col("from_id").alias("class"), F.col("label").alias("member"), "to_id", "family", "file_path"))
    parents = cut(bases.select("from_id", "to_id").distinct().join(family.filter(F.col("type").isin(CLASSLIKE)), "to_id").select(F.col("from_id").alias("class"), F.col("to_id").alias("parent"), "family"))
    front = cut(asked.select("ref_id", "source_file", F.col("split.member").alias("member"), family_of(F.col("extractor")).alias("own_family")).join(found, "ref_id"))
    seen = front.select("ref_id", "class")
    answers = front.select("ref_id", F.lit(None).cast("string").alias("to_id")).limit(0)
    while not front.isEmpty():
        folder = paths.folder_of(F.col("source_file"))
        scopes = [F.lit(True), F.col("file_path") == F.col("source_file"), (folder != "") & F.startswith("file_path", F.concat(folder, F.lit("/")))]
        counts = [x for s, w in enumerate(scopes) for x in (F.sum(w.cast("int")).alias(f"n{s}"), F.min(F.when(w, F.col("to_id"))).alias(f"id{s}"))]
        met = front.join(members, ["class", "member"]).filter(own).groupBy("ref_id", "class").agg(*counts)
        met = met.select("ref_id", "class", F.coalesce(*(F.when(F.col(f"n{s}") == 1, F.col(f"id{s}")) for s in range(3))).alias("to_id")).filter("to_id is not null")
        got = cut(met.groupBy("ref_id").agg(F.min_by("to_id", "class").alias("to_id")))
        answers = answers.unionByName(got)
        above = front.join(got, "ref_id", "left_anti").join(parents, "class").filter(own).select("ref_id", "source_file", "member", "own_family", F.col("parent").alias("class")).distinct()
        front = cut(above.join(seen, ["ref_id", "class"], "left_anti"))
        seen = seen.unionByName(front.select("ref_id", "class"))
    return answers


def resolve_with_bases(refs: DataFrame, nodes: DataFrame, contains: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """resolve for refs that have from_id too, and then what is still open by the members of bases (rule 5).

    Bases are what the refs themselves say: those of EXTENDS and IMPLEMENTS are resolved with the others, before
    the first member is looked for. No base is found through a member, so that one pass of each is all.
    """
    asked = _questions(refs)
    first = cut(_resolved(asked, nodes, imports))
    bases = _told(refs.filter(F.col("relation").isin(BASES)), first.filter(F.col("relation").isin(BASES))).filter("to_id is not null")
    more = inherited(first.filter("to_id is null").select("ref_id", *QUESTION), nodes, contains, bases).withColumnRenamed("to_id", "found")
    late = F.col("found").isNotNull()
    rule, provenance = (F.when(late, F.lit(new)).otherwise(F.col(c)).alias(c) for c, new in (("rule", 5), ("provenance", "INFERRED")))
    return _told(refs, first.join(more, "ref_id", "left").select(*QUESTION, rule, F.coalesce("to_id", "found").alias("to_id"), provenance))


def externals(unresolved: DataFrame) -> DataFrame:
    """(id, label, language) of the symbols outside that unresolved refs (relation, target, extractor) may name.

    Calls, middlewares and types always do, references if they look like a type; common names never do.
    """
    label = names.external_target(F.col("target"))
    looks = label.rlike(r"[\\.]|::") | label.rlike("^[A-Z]")
    wanted = F.col("relation").isin("CALLS", "PASSES_THROUGH", "USES_TYPE") | ((F.col("relation") == "REFERENCES") & looks)
    family = family_of(F.col("extractor"))
    kept = unresolved.filter(wanted & (label != "") & ~label.isin(COMMON_NAMES)).select(names.external_id(family, label).alias("id"), label.alias("label"), F.nullif(family, F.lit("unknown")).alias("language"))
    return kept.distinct()


def chains(refs: DataFrame, resolved: DataFrame) -> DataFrame:
    """(from_id, to_id, relation) of refs (ref_id, from_target, target, relation) both of whose ends are known by name (target, to_id)."""
    known = resolved.select(F.col("target").alias("name"), "to_id").distinct()
    ends = refs.join(known.select(F.col("name").alias("from_target"), F.col("to_id").alias("from_id")), "from_target").join(known.withColumnRenamed("name", "target"), "target")
    return ends.select("from_id", "to_id", "relation").distinct()


def probed(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (ref_id, path) with file: the first of the probed files that exists, null if none does. Each path is probed once, however many imports name it."""
    tried = imports.select("path").distinct().select("path", F.posexplode(paths.probes(F.col("path"))).alias("rank", "file"))
    hit = tried.join(files.select("file").distinct(), "file").groupBy("path").agg(F.min_by("file", "rank").alias("file"))
    return imports.join(hit, "path", "left")


def aliased(specifier: Column, importer: Column, aliases: dict[str, str]) -> Column:
    """The path that an import specifier means: relative to its importer, by an alias (`@/*` to `src/*`), else as written; null for built-in modules."""
    folder = paths.folder_of(importer)
    relative = paths.normalised(F.concat_ws("/", F.nullif(folder, F.lit("")), specifier))
    known = [F.when(specifier.startswith(a[:-1]), F.concat(F.lit(t[:-1]), F.substring(specifier, len(a), 1 << 20))) for a, t in sorted(aliases.items(), key=lambda x: -len(x[0]))]
    written = F.when(F.contains(specifier, F.lit("/")), specifier)
    return F.when(specifier.startswith("node:"), F.lit(None)).when(specifier.startswith("."), relative).otherwise(F.coalesce(*known, written))


def merged(stored: DataFrame, pending: DataFrame) -> DataFrame:
    """Stored rows and those about to be stored, one for each id; stored ones win."""
    both = stored.withColumn("seq", F.lit(0)).unionByName(pending.withColumn("seq", F.lit(1)))
    return first_wins(both, ["id"], ["seq"]).drop("seq")
