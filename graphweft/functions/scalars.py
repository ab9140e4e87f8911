"""Scalar functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("::", *(F.coalesce(p, F.lit("")) for p in parts)))


def glob_pattern(glob: str, star_crosses: bool = True) -> str:
    """An anchored regular expression; a star crosses slashes in one dialect, only ** does in the other.

    Where a star crosses, a question mark is any character and brackets are a class, with ! for its opposite;
    in the other dialect both stand for themselves.
    """
    out = ""
    rest = glob
    while rest:
        here, rest = rest[0], rest[1:]
        closing = rest.find("]", 1) if rest[:1] != "!" else rest.find("]", 2)
        if here == "*" and rest[:1] == "*":
            out, rest = out + ".*", rest[1:]
        elif here == "*":
            out += ".*" if star_crosses else "[^/]*"
        elif star_crosses and here == "?":
            out += "."
        elif star_crosses and here == "[" and closing > 0:
            inner, rest = rest[:closing], rest[closing + 1 :]
            opposite = inner.startswith("!")
            out += "[" + "^" * opposite + re.sub(r"([\\\[\]^&])", r"\\\1", inner[opposite:]) + "]"
        else:
            out += re.escape(here) if here != "/" else here
    return f"^{out}$"


def top_level_dir(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(F.lit("(root)"))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def owner_and_member(symbol: Column) -> tuple[Column, Column]:
    """A qualified symbol split at its last :: or dot; the owner is empty if there is none."""
    return F.regexp_extract(symbol, r"^(.*)(::|\.)([^:.]+)$", 1), F.regexp_extract(symbol, r"([^:.]*)$", 1)


def risk_score(cross: Column, affected: Column, contracts: Column, tested: Column) -> Column:
    raw = F.greatest(cross - 1, F.lit(0)) * 1.5 + F.log2(1 + affected) + contracts * 2 - tested.cast("int")
    return F.round(F.greatest(raw, F.lit(0.0)), 1)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length or without a length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def rotate_to_least(values: Column) -> Column:
    """The array turned so that its smallest element comes first."""
    at = F.array_position(values, F.array_min(values)).cast("int")
    return F.concat(F.slice(values, at, F.size(values)), F.slice(values, F.lit(1), at - 1))


def nearest_second(at: Column) -> Column:
    """The seconds since 1970 that a timestamp is nearest to, the even one of two."""
    return F.rint(F.unix_micros(at.cast("timestamp")) / 1e6).cast("bigint")
