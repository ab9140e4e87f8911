"""Names of symbols: qualified parts, keys, look-up candidates and targets, as column expressions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SEPARATOR = r"::|\."
_QUOTES = "^[\"'<]+|[>\"']+$"


def leaf_of(name: Column) -> Column:
    """What follows the last ::, dot or hash."""
    return F.element_at(F.split(name, r"::|\.|#"), -1)


def strip_template_args(name: Column) -> Column:
    """The name without what stands in angle brackets, nested ones too; a closing bracket too many is dropped."""

    def step(state: Column, c: Column) -> Column:
        opens, closes = c == "<", c == ">"
        depth = F.when(opens, state["depth"] + 1).when(closes, F.greatest(state["depth"] - 1, F.lit(0))).otherwise(state["depth"])
        kept = ~opens & ~closes & (state["depth"] == 0)
        return F.struct(depth.alias("depth"), F.when(kept, F.concat(state["out"], c)).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))
    return F.aggregate(F.split(name, ""), start, step, lambda s: s["out"])


def qualified_part(name: Column) -> Column:
    """The last segment of a name without its template arguments; empty if there is none."""
    pieces = F.filter(F.transform(F.split(strip_template_args(F.trim(name)), _SEPARATOR), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.get(pieces, F.size(pieces) - 1), F.lit(""))


def qualified_parts(qname: Column) -> Column:
    """The parts of a dotted name, each reduced to its last segment; empty ones drop out."""
    return F.filter(F.transform(F.split(F.coalesce(qname, F.lit("")), r"\."), qualified_part), lambda x: x != "")


def canonical_key(kind: Column, qname: Column, parent: Column, label: Column, path: Column) -> Column:
    """What says that two rows are the same symbol: its qualified name, else its class and label, else label and file."""
    parts, owner = qualified_parts(qname), qualified_part(F.coalesce(parent, F.lit("")))
    kind, label = F.coalesce(kind, F.lit("Symbol")), F.coalesce(label, F.lit(""))
    by_owner = F.concat(kind, F.lit(":"), owner, F.lit("."), label)
    by_file = F.concat(kind, F.lit(":"), label, F.lit(":"), F.coalesce(path, F.lit("")))
    return F.when(F.size(parts) > 0, F.concat(kind, F.lit(":"), F.array_join(parts, "."))).when(owner != "", by_owner).otherwise(by_file)


def display_name(qname: Column, parent: Column, label: Column) -> Column:
    parts, owner = qualified_parts(qname), qualified_part(F.coalesce(parent, F.lit("")))
    return F.when(F.size(parts) > 0, F.array_join(parts, "::")).when(owner != "", F.concat(owner, F.lit("::"), label)).otherwise(F.coalesce(label, F.lit("(unknown)")))


def external_target(target: Column) -> Column:
    """A reference's target without quotes and angle brackets around it."""
    return F.regexp_replace(F.trim(F.coalesce(target, F.lit(""))), _QUOTES, "")


def lookup_candidates(target: Column, drop_extension: bool = True) -> Column:
    """array<string>: the spellings under which a target may be known: as written, bare, dotted, last segment, without extension."""
    bare = F.trim(F.regexp_replace(target, _QUOTES, ""))
    dotted = F.regexp_replace(F.regexp_replace(F.translate(bare, "\\/", ".."), r"^\.+", ""), r"\.{2,}", ".")
    last = F.when(F.contains(bare, F.lit("/")), F.element_at(F.split(bare, "/"), -1)).otherwise(F.lit(""))
    spelt = [target, bare, dotted, last]
    if drop_extension:
        spelt.append(F.regexp_replace(bare, r"\.[^.]+$", ""))
    return F.filter(F.array_distinct(F.array(*spelt)), lambda x: x != "")


def member_target(target: Column) -> Column:
    """struct<owner, member> of a target that names a member by a dot; null for paths and bare names."""
    bare = external_target(target)
    owner, member = F.regexp_extract(bare, r"^(.+)\.[^.]+$", 1), F.regexp_extract(bare, r"^.+\.([^.]+)$", 1)
    return F.when(~F.contains(bare, F.lit("/")) & (owner != ""), F.struct(owner.alias("owner"), member.alias("member")))


def reference_target(text: Column) -> Column:
    """The last part of a reference by ::, -> or a dot."""
    return F.element_at(F.split(F.trim(text), r"::|->|\."), -1)


def call_target(text: Column) -> Column:
    """As reference_target, of what stands before the first blank."""
    return reference_target(F.element_at(F.split(F.trim(text), r"\s+"), 1))


def module_name(path: Column) -> Column:
    """A file's module: no extension, no final __init, __main or index, dots for slashes."""
    bare = F.regexp_replace(F.translate(path, "\\", "/"), r"(?<=[^/])\.[^./]*$", "")
    return F.translate(F.regexp_replace(F.regexp_replace(bare, r"/__(init|main)$", ""), r"/index$", ""), "/", ".")


def name_tokens(text: Column) -> Column:
    """The runs of letters and digits, in small letters."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def json_field(text: Column, name: str) -> Column:
    """A field of a JSON object as a string; null if it isn't there, is empty, or the text isn't JSON."""
    return F.nullif(F.get_json_object(text, f"$.{name}"), F.lit(""))


def canonical_json(text: Column) -> Column:
    """JSON with its keys in order at every depth and no blanks; null for what isn't JSON.

    Built-in functions keep the order of keys as written and know no sorting at every depth.
    """

    def spell(text: str | None) -> str | None:
        try:
            return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    @F.pandas_udf("string")
    def canonical(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for own in texts:
            yield own.map(spell)

    return canonical(text)


def fingerprint(*lists: Column) -> Column:
    """sha256 of lists of strings: each without empty ones and repeats, in order."""
    own = [F.array_sort(F.array_distinct(F.filter(x, lambda v: v.isNotNull() & (v != "")))) for x in lists]
    return F.sha2(F.to_json(F.struct(*[x.alias(f"l{k}") for k, x in enumerate(own)])), 256)


def external_id(family: Column, label: Column) -> Column:
    """The id of a symbol outside the repository."""
    return F.concat(F.lit("external:"), F.substring(F.sha1(F.concat_ws(":", family, label)), 1, 16))
