"""Features and tasks laid over a graph: which files and symbols belong to them, and how well they are described.

A feature has an id and lists of globs (files), labels (symbols), routes and docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphweft.functions import paths, verdicts
from graphweft.operators import globs


def membership(files: DataFrame, features: DataFrame) -> DataFrame:
    """(file, feature): the features with a glob that a file (file) matches, each once."""
    own = features.select(F.col("id").alias("feature"), F.explode("files").alias("glob")).distinct()
    met = globs.matches(files.select(F.col("file").alias("path")), own.select("glob"))
    return met.join(own, "glob").select(F.col("path").alias("file"), "feature").distinct()


def anchors(features: DataFrame, nodes: DataFrame) -> DataFrame:
    """(feature, declared, resolved, broken): how many of a feature's anchors exist in the graph.

    Symbols are labels of code, files are globs over files and folders, docs are paths of documents. A feature
    is broken if it declares nothing, nothing is found, or less than half is.
    """
    code = nodes.filter(F.col("type").isin("Function", "Method", "Class", "Interface", "Type")).select(F.col("label").alias("anchor")).distinct()
    docs = nodes.filter("type = 'Document'").select(F.col("file_path").alias("anchor")).distinct()
    routes = nodes.filter("type = 'Route'").select(F.col("label").alias("anchor")).distinct()
    each = lambda column: features.select(F.col("id").alias("feature"), F.explode(column).alias("anchor"))
    hit = lambda column, known: each(column).join(known.withColumn("hit", F.lit(1)), "anchor", "left").select("feature", F.coalesce("hit", F.lit(0)).alias("hit"))
    places = nodes.filter(F.col("type").isin("File", "Directory")).select(F.col("file_path").alias("path"))
    met = globs.matches(places, each("files").select(F.col("anchor").alias("glob")), star_crosses=True)
    found = met.select(F.col("glob").alias("anchor")).distinct().withColumn("hit", F.lit(1))
    files = each("files").join(found, "anchor", "left").select("feature", F.coalesce("hit", F.lit(0)).alias("hit"))
    every = hit("symbols", code).unionByName(hit("docs", docs)).unionByName(hit("routes", routes)).unionByName(files)
    told = every.groupBy("feature").agg(F.count("*").alias("declared"), F.sum("hit").alias("resolved"))
    own = features.select(F.col("id").alias("feature")).join(told, "feature", "left").fillna(0, ["declared", "resolved"])
    return own.withColumn("broken", (F.col("resolved") == 0) | (F.col("resolved") * 2 < F.col("declared")))


def tasks_of_files(tasks: DataFrame, files: DataFrame, members: DataFrame) -> DataFrame:
    """(file, task, how): the tasks that a file's features, hints or titles lead to, by the surest way.

    tasks are (id, title, features, files_hint). A title counts if it holds the file's name without its ending,
    which must have eight letters or more, or a capital one.
    """
    hint = tasks.select("id", F.explode("files_hint").alias("hint"))
    tail = F.transform(F.sequence(F.lit(1), F.size(F.split("file", "/"))), lambda k: F.array_join(F.slice(F.split("file", "/"), -k, k), "/"))
    ends = files.select("file", F.explode(tail).alias("hint"))
    by_hint = ends.join(hint, "hint").select("file", F.col("id").alias("task"), F.lit(0).alias("rank"))
    by_feature = members.join(tasks.select("id", F.explode("features").alias("feature")), "feature").select("file", F.col("id").alias("task"), F.lit(1).alias("rank"))
    stem = F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    words = F.array_distinct(F.split(F.lower("title"), "[^a-z0-9_]+"))
    named = files.select("file", stem.alias("stem")).filter((F.length("stem") >= 8) | F.col("stem").rlike("[A-Z]")).withColumn("word", F.lower("stem"))
    by_title = named.join(tasks.select("id", F.explode(words).alias("word")), "word").select("file", F.col("id").alias("task"), F.lit(2).alias("rank"))
    best = by_hint.unionByName(by_feature).unionByName(by_title).groupBy("file", "task").agg(F.min("rank").alias("rank"))
    how = F.element_at(F.array(F.lit("files_hint"), F.lit("feature"), F.lit("title")), F.col("rank") + 1)
    return best.select("file", "task", how.alias("how"))


def quality(features: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row of counts: features with tests, docs and dependencies, tasks by how surely they are linked."""
    filled = lambda c: F.count_if(F.coalesce(F.size(c), F.lit(0)) > 0)
    own = features.agg(F.count("*").alias("features"), filled("tests").alias("with_tests"), filled("docs").alias("with_docs"), filled("depends_on").alias("with_depends_on"))
    strength = verdicts.link_strength(F.col("features"), F.col("link_strength"), F.col("evidence"), F.col("files_hint"))
    told = tasks.select(strength.alias("s")).agg(F.count("*").alias("tasks"), *[F.count_if(F.col("s") == k).alias(k) for k in ("strong", "mixed", "broad", "unlinked")])
    return own.crossJoin(told)  # one row each


def inferred_tests(features: DataFrame, imports: DataFrame) -> DataFrame:
    """(feature, n): features without tests of their own, and how many imports (source_file, target_file) lead from tests into their files."""
    bare = features.filter(F.coalesce(F.size("tests"), F.lit(0)) == 0)
    tests = imports.filter(paths.is_test_like(F.col("source_file")))
    members = membership(tests.select(F.col("target_file").alias("file")), bare)
    return tests.join(members, F.col("target_file") == F.col("file")).groupBy("feature").agg(F.count("*").alias("n"))


def dirty_seams(files: DataFrame, features: DataFrame) -> DataFrame:
    """(seam, n): changed files (file) by feature, and those that are scratch or belong to none."""
    own = files.select("file").filter("file <> ''").distinct().withColumn("scratch", paths.is_scratch(F.col("file")))
    members = membership(own.filter("not scratch"), features)
    seams = own.join(members, "file", "left").withColumn("seam", F.when(F.col("scratch"), "(scratch)").otherwise(F.coalesce("feature", F.lit("(orphan)"))))
    return seams.groupBy("seam").agg(F.count("*").alias("n"))


def layer_span(files: DataFrame, layers: DataFrame) -> DataFrame:
    """(layer, n, crossing): changed files (file) by layer (path, layer); unassigned ones apart; crossing counts the layers."""
    told = files.select("file").distinct().join(layers.select(F.col("path").alias("file"), "layer"), "file", "left")
    counted = told.groupBy(F.coalesce("layer", F.lit("(unassigned)")).alias("layer")).agg(F.count("*").alias("n"))
    crossing = counted.agg(F.count_if(F.col("layer") != "(unassigned)").alias("crossing"))  # one row
    return counted.crossJoin(F.broadcast(crossing))


def feature_io(edges: DataFrame, members: DataFrame, samples: int = 2) -> DataFrame:
    """(feature, direction, other, n, shown): edges (from_file, to_file) that cross a feature's border, by the first feature beyond or external."""
    first = members.groupBy("file").agg(F.min("feature").alias("first"), F.collect_set("feature").alias("all"))  # the few features of a file

    def side(here: str, there: str, direction: str) -> DataFrame:
        own = edges.join(members.select(F.col("file").alias(here), "feature"), here).join(first.select(F.col("file").alias(there), "all"), there, "left")
        foreign = F.filter(F.array_sort(F.coalesce("all", F.array().cast("array<string>"))), lambda f: f != F.col("feature"))
        inside = F.coalesce(F.array_contains("all", F.col("feature")), F.lit(False)) & (F.size(foreign) == 0)
        return own.filter(~inside).select("feature", F.lit(direction).alias("direction"), F.coalesce(F.get(foreign, F.lit(0)), F.lit("external")).alias("other"), F.concat_ws(">", "from_file", "to_file").alias("edge"))

    both = side("to_file", "from_file", "in").unionByName(side("from_file", "to_file", "out"))
    ranked = both.withColumn("rn", F.row_number().over(W.partitionBy("feature", "direction", "other").orderBy("edge"))).filter(F.col("rn") <= samples)
    shown = ranked.groupBy("feature", "direction", "other").agg(F.array_join(F.sort_array(F.collect_list("edge")), "|").alias("shown"))
    return both.groupBy("feature", "direction", "other").agg(F.count("*").alias("n")).join(shown, ["feature", "direction", "other"])


def task_counts(tasks: DataFrame) -> DataFrame:
    """(feature, open, completed): a feature's tasks by state; those of no feature under (none)."""
    state = verdicts.task_status(F.col("status"))
    done = F.col("status").rlike("(?i)done|complete|closed|resolved|merged|shipped")
    none = F.array(F.lit("(none)"))
    each = tasks.select(F.explode(F.when(F.coalesce(F.size("features"), F.lit(0)) == 0, none).otherwise(F.col("features"))).alias("feature"), state.alias("state"), done.alias("done"))
    return each.groupBy("feature").agg(F.count_if(F.col("state") != "closed").alias("open"), F.count_if(F.coalesce("done", F.lit(False))).alias("completed"))


def open_tasks(tasks: DataFrame) -> DataFrame:
    """(feature, place, id): open tasks of each feature, the surest linked first."""
    strength = verdicts.link_strength(F.col("features"), F.col("link_strength"), F.col("evidence"), F.col("files_hint"))
    rank = F.array_position(F.array(*map(F.lit, ("strong", "mixed", "broad", "unlinked"))), strength)
    own = tasks.filter(verdicts.task_status(F.col("status")) != "closed").select("id", rank.alias("rank"), F.explode("features").alias("feature"))
    return own.withColumn("place", F.row_number().over(W.partitionBy("feature").orderBy("rank", "id"))).select("feature", "place", "id")


def import_tests(imports: DataFrame, targets: DataFrame) -> DataFrame:
    """(test): files that look like tests and import one of the targets (file)."""
    own = imports.filter(paths.is_test_like(F.col("source_file")))
    return own.join(targets.select(F.col("file").alias("target_file")), "target_file", "left_semi").select(F.col("source_file").alias("test")).distinct()


def companions(files: DataFrame) -> DataFrame:
    """(source, header): sources and headers (file) with the same path but for the ending."""
    ending = F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1))
    own = files.select("file", paths.without_extension(F.col("file")).alias("stem"), ending.alias("ending")).distinct()
    sources = own.filter(F.col("ending").isin("c", "cc", "cpp", "cxx")).select("stem", F.col("file").alias("source"))
    return sources.join(own.filter(F.col("ending").isin("h", "hh", "hpp", "hxx")).select("stem", F.col("file").alias("header")), "stem").select("source", "header")


def deleted_with_callers(diff: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, file, callers): exported declarations that a diff (file, line) takes away while verified callers outside the edited files remain.

    A name that is added again anywhere counts as moved. A file that has no such declaration, or several of that
    name, says nothing.
    """
    shape = r"^%s\s*(export\s+)?(?:default\s+)?(?:async\s+)?(?:function\s*\*?|class|interface|type|def|const)\s+([A-Za-z_$][\w$]*)"
    found = lambda sign: (F.regexp_extract("line", shape % sign, 2), F.regexp_extract("line", shape % sign, 1))
    gone, exported = found("-")
    added, _ = found(r"\+")
    removed = diff.select("file", gone.alias("name"), (exported != "").alias("exported")).filter("name <> ''").groupBy("file", "name").agg(F.bool_or("exported").alias("exported")).filter("exported")
    removed = removed.join(diff.select(added.alias("name")).filter("name <> ''").distinct(), "name", "left_anti")
    declared = nodes.filter(F.col("type").isin("Function", "Method", "Class", "Interface", "Type")).select("id", F.col("label").alias("name"), F.col("file_path").alias("file"))
    targets = removed.join(declared, ["name", "file"]).groupBy("name", "file").agg(F.count("*").alias("n"), F.min("id").alias("to_id")).filter("n = 1")
    edited = diff.select(F.col("file").alias("file_path")).distinct()
    outside = nodes.select(F.col("id").alias("from_id"), "file_path").join(edited, "file_path", "left_anti")
    callers = edges.filter("provenance = 'LSP_VERIFIED'").join(targets.select("to_id", "name", "file"), "to_id").join(outside.select("from_id"), "from_id", "left_semi")
    return callers.groupBy("name", "file").agg(F.countDistinct("from_id").alias("callers"))


def validated(assignments: DataFrame, layers: DataFrame, files: DataFrame) -> DataFrame:
    """(level, message, n): errors of an architecture (path, layer): unknown layers, files that don't exist; layers without a file are warnings."""
    known, real = layers.select("layer").distinct(), files.select(F.col("file").alias("path")).distinct()
    say = lambda frame, level, message: frame.agg(F.count("*").alias("n")).select(F.lit(level).alias("level"), F.lit(message).alias("message"), "n")
    unknown = say(assignments.join(known, "layer", "left_anti"), "error", "unknown layer")
    absent = say(assignments.join(real, "path", "left_anti"), "error", "no such file")
    twice = say(assignments.groupBy("path").agg(F.countDistinct("layer").alias("k")).filter("k > 1"), "error", "two layers for a file")
    empty = say(known.join(assignments, "layer", "left_anti"), "warning", "layer without files")
    return unknown.unionByName(absent).unionByName(twice).unionByName(empty).filter("n > 0")
