"""Suggestions for a name that isn't found, and the cascade that resolves one that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphweft.functions.names import canonical_key, leaf_of
from graphweft.operators.lineage import cut


def alignment_distance(text: Column, name: str | Column, most: int | Column) -> Column:
    """Edits between a column and a name, a swap of neighbours counting as one; most + 1 stands for more.

    A column expression: one fold over the characters of the text carries the last two rows of the table of
    distances. Only the band of 2 most + 1 cells around the diagonal is filled: a cell further off costs more.
    Name and bound are values or columns.
    """
    name = F.lit(name) if isinstance(name, str) else name
    most = F.lit(most) if isinstance(most, int) else most
    far, n, letters = most + 1, F.length(name), F.split(name, "")

    def fold(state: Column, x: Column) -> Column:
        i, one, two = state["i"], state["one"], state["two"]

        def fill(made: Column, j: Column) -> Column:
            same = F.get(letters, j - 1)
            step = F.least(F.get(one, j) + 1, F.get(made, F.size(made) - 1) + 1, F.get(one, j - 1) + (x != same).cast("int"))
            swap = (i > 0) & (j > 1) & (x == F.get(letters, j - 2)) & (state["last"] == same)
            value = F.when(swap, F.least(step, F.coalesce(F.get(two, j - 2), far) + 1)).otherwise(step)
            return F.concat(made, F.array(F.when(F.abs(j - i - 1) > most, far).otherwise(F.least(value, far))))

        row = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.array(F.least(i + 1, far)), fill)
        return F.struct((i + 1).alias("i"), row.alias("one"), one.alias("two"), x.alias("last"))

    first = F.transform(F.sequence(F.lit(0), n), lambda j: F.least(j, far))
    start = F.struct(F.lit(0).alias("i"), first.alias("one"), first.alias("two"), F.lit("").alias("last"))
    folded = F.aggregate(F.split(text, ""), start, fold, lambda s: F.get(s["one"], n))
    gap = F.abs(F.length(text) - n)
    return F.when(gap > most, far).when((F.length(text) == 0) | (n == 0), F.least(F.greatest(F.length(text), n), far)).otherwise(folded)


def suggestions(nodes: DataFrame, name: str, limit: int) -> DataFrame:
    """(label, rank): the best labels for a missed name; equal, its leaf, prefix, contained, then by edits of the leaf.

    The leaf is what follows the last separator. Edits are bounded by a sixth of the name's length, from one
    to three; a label whose plain edit distance is twice the bound or more can't be near and isn't folded.
    """
    q = name.lower()
    leaf = q.replace("::", ".").rsplit(".", 1)[-1]
    most = min(3, max(1, len(leaf) // 6))
    label = F.lower("label")
    own = F.lower(leaf_of(F.col("label")))
    told = nodes.select("label").distinct().withColumn("rank", F.when(label == q, 0).when(own == leaf, 1).when(own.startswith(leaf), 2).when(label.contains(leaf), 3))
    plain = told.filter("rank is not null")
    near = told.filter(F.col("rank").isNull() & (F.levenshtein(own, F.lit(leaf), 2 * most) >= 0))
    near = near.withColumn("rank", alignment_distance(own, leaf, most) + 4)
    return plain.unionByName(near.filter(F.col("rank") <= 4 + most)).orderBy("rank", "label").limit(limit)


_GRAM = 3


def _grams(text: Column) -> Column:
    """The distinct pieces of a text of up to three characters."""
    at = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - k + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(k)))
    return F.array_distinct(F.filter(F.flatten(F.array(*[at(k) for k in range(1, _GRAM + 1)])), lambda g: g != ""))


def _without_one(text: Column) -> Column:
    """A text and all that is left of it without one of its characters."""
    rest = lambda i: F.concat(F.left(text, i - 1), F.substring(text, i + 1, F.length(text)))
    return F.array_distinct(F.concat(F.array(text), F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), rest)))


def _pieces(text: Column, bound: int, slack: int) -> Column:
    """array<struct<bound, length, piece, part>>: what lies where texts have their 2 bound + 1 pieces: texts as long as this, or up to `slack` longer or shorter, `slack` places around.

    An edit spoils two neighbouring pieces at most (a swap over their border), so that within the bound one stays whole.
    """
    count = 2 * bound + 1
    around = F.sequence(F.lit(-slack), F.lit(slack)) if slack else F.array(F.lit(0))

    def part(gap: Column, p: Column, shift: Column) -> Column:
        length = F.length(text) + gap
        start = F.floor(length * p / count).cast("int")
        size = F.floor(length * (p + 1) / count).cast("int") - start
        at = start + 1 + shift
        return F.when(at >= 1, F.struct(F.lit(bound).alias("bound"), length.alias("length"), p.alias("piece"), F.substring(text, at, size).alias("part")))

    of = lambda gap: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda p: F.transform(around, lambda shift: part(gap, p, shift))))
    return F.array_distinct(F.array_compact(F.flatten(F.transform(around, of))))


def suggestions_many(nodes: DataFrame, names: DataFrame, limit: int) -> DataFrame:
    """(name, label, rank): what `suggestions` says of each distinct name of (name), for all of them in one plan.

    Labels that contain a name's leaf share its rarest piece of up to three characters with it. Labels near a
    leaf meet it by a key: for one edit what is left without one character, for two and three edits one of 5
    or 7 pieces, of which one must stay whole. Keys are joined by equality, candidates are verified; neither names
    nor labels are compared with all of the other side. Null names and names without a leaf have no suggestions.
    """
    label = F.lower("label")
    own = cut(nodes.select("label").filter("label is not null").distinct()).withColumn("low", label).withColumn("own", F.lower(leaf_of(F.col("label"))))
    q = F.lower("name")
    asked = names.select("name").filter("name is not null").distinct().withColumn("q", q).withColumn("leaf", F.element_at(F.split(F.replace("q", F.lit("::"), F.lit(".")), r"\."), -1)).filter("leaf <> ''")
    asked = asked.withColumn("most", F.least(F.lit(3), F.greatest(F.lit(1), F.floor(F.length("leaf") / 6))).cast("int"))
    asked = cut(asked)

    grams = own.select("label", "low", "own", F.explode(_grams(F.col("low"))).alias("gram"))
    wanted = asked.select("name", "q", "leaf", F.explode(_grams(F.col("leaf"))).alias("gram")).filter(F.length("gram") == F.least(F.length("leaf"), F.lit(_GRAM)))
    counts = grams.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "gram", "left").groupBy("name", "q", "leaf").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    held = grams.join(rarest, "gram").filter(F.contains("low", F.col("leaf")))
    rank = F.when(F.col("low") == F.col("q"), 0).when(F.col("own") == F.col("leaf"), 1).when(F.startswith("own", F.col("leaf")), 2).otherwise(3)
    plain = held.select("name", "label", rank.alias("rank"))

    alone = lambda frame, text, bound, *kept: frame.select(*kept, F.explode(_without_one(F.col(text))).alias("part")).select(*kept, F.struct(F.lit(1).alias("bound"), F.lit(0).alias("length"), F.lit(0).alias("piece"), "part").alias("key"))
    size = F.length("own")
    labels = alone(own, "own", 1, "label", "own")
    keys = alone(asked.filter("most = 1"), "leaf", 1, "name", "leaf", "most")
    for bound in (2, 3):
        keys = keys.unionByName(asked.filter(F.col("most") == bound).select("name", "leaf", "most", F.explode(_pieces(F.col("leaf"), bound, bound)).alias("key")))
        fitting = size.between(5 * bound, 7 * bound + 5) if bound == 2 else size >= 5 * bound
        labels = labels.unionByName(own.filter(fitting).select("label", "own", F.explode(_pieces(F.col("own"), bound, 0)).alias("key")))
    met = labels.join(keys, "key").filter((F.abs(F.length("own") - F.length("leaf")) <= F.col("most")) & ~F.contains(label, F.col("leaf")) & (F.levenshtein("own", "leaf") <= 2 * F.col("most")))
    near = met.select("name", "label", "own", "leaf", "most").distinct().withColumn("d", alignment_distance(F.col("own"), F.col("leaf"), F.col("most")))
    told = plain.unionByName(near.filter(F.col("d") <= F.col("most")).select("name", "label", (F.col("d") + 4).alias("rank")))
    place = F.row_number().over(W.partitionBy("name").orderBy("rank", "label"))
    return told.withColumn("place", place).filter(F.col("place") <= limit).select("name", "label", "rank")


def resolve(nodes: DataFrame, symbol: str) -> DataFrame:
    """(id, rank): the nodes of the first rule that finds any: label, qualified name, its suffix, path."""
    rules = [F.col("label") == symbol, F.col("qname") == symbol, F.endswith("qname", F.lit(f".{symbol}")), F.col("file_path") == symbol]
    rank = F.coalesce(*[F.when(r, k) for k, r in enumerate(rules)])
    hits = nodes.select("id", rank.alias("rank")).filter("rank is not null")
    best = hits.agg(F.min("rank").alias("best"))  # one row
    return hits.join(F.broadcast(best), F.col("rank") == F.col("best")).select("id", "rank")


def resolved_suffixes(chains: DataFrame, most: int = 4) -> DataFrame:
    """(suffix, n, resolved, verdict) of the last two to `most` parts of each dotted chain (id, chain)."""
    parts = F.split("chain", r"\.")
    own = chains.filter(F.size(parts) >= 2)
    tails = F.transform(F.sequence(F.lit(2), F.least(F.size(parts), F.lit(most))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    found = own.select("id", F.explode(tails).alias("suffix")).groupBy("suffix").agg(F.countDistinct("id").alias("n"), F.min("id").alias("least"))
    unique = F.col("n") == 1
    return found.select("suffix", "n", F.when(unique, F.col("least")).alias("resolved"), F.when(unique, "unique").otherwise("ambiguous_symbol").alias("verdict"))


def cascade(nodes: DataFrame, symbol: str, most: int) -> DataFrame:
    """(id, rule, total): what a name means, by the first rule that finds any: its label, its whole qualified name, a suffix of one, its leaf under its parent.

    Nodes outside the project count only where no other is found. At most `most` are named, total says how many there are.
    """
    parts = [p for p in symbol.replace("::", ".").split(".") if p]
    dotted, leaf, parent = ".".join(parts), parts[-1], parts[-2] if len(parts) > 1 else ""
    qualified = len(parts) > 1
    owner = F.element_at(F.split("qname", r"\."), -2)
    rules = [F.col("label") == symbol, (F.col("qname") == dotted) & F.lit(qualified), F.endswith("qname", F.lit(f".{dotted}")) & F.lit(qualified), (F.col("label") == leaf) & (F.size(F.split("qname", r"\.")) > 1) & (owner == parent) & F.lit(qualified)]
    rule = F.coalesce(*[F.when(r, k) for k, r in enumerate(rules)])
    hits = nodes.select("id", (F.col("type") == "External").alias("outside"), rule.alias("rule")).filter("rule is not null")
    best = hits.groupBy("rule", "outside").agg(F.count("*").alias("total")).orderBy("rule", "outside").limit(1)
    return hits.join(F.broadcast(best), ["rule", "outside"]).select("id", "rule", "total").orderBy("id").limit(most)


def ambiguity(nodes: DataFrame, shown: int) -> DataFrame:
    """(key, members, shown, languages): nodes (id, type, label, qname, parent, file_path, confidence, language) of one name, by what they are.

    Nodes outside the project drop out if there is any other. Of each group the surest node is shown.
    """
    concrete = nodes.filter("type <> 'External'")
    any_ = concrete.agg((F.count("*") > 0).alias("some"))  # one row
    own = nodes.crossJoin(F.broadcast(any_)).filter("not some or type <> 'External'")
    keyed = own.withColumn("key", canonical_key(F.col("type"), F.col("qname"), F.col("parent"), F.col("label"), F.col("file_path")))
    least = F.min(F.struct((-F.col("confidence")).alias("c"), "id"))
    groups = keyed.groupBy("key").agg(F.count("*").alias("members"), least.alias("best"), F.countDistinct("language").alias("languages"))
    return groups.select("key", "members", F.col("best.id").alias("shown"), "languages").orderBy(F.desc("members"), "key").limit(shown)
