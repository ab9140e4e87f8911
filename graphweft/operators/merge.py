"""Merging edges with evidence: insert or promote, reversible promotion, pruning, carrying forward."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft import model


def insert_or_promote(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with equal keys a verified one stays, else the one that was there first."""
    both = old.withColumn("seq", F.lit(0)).unionByName(new.withColumn("seq", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    order = F.struct((F.col("provenance") != model.VERIFIED), F.col("seq"))
    best = both.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("best"))
    return best.select(*keys, *(F.col(f"best.{c}").alias(c) for c in rest))


def promote(edges: DataFrame) -> DataFrame:
    """edges as verified; `was` keeps the first provenance of those that weren't."""
    before = F.col("was") if "was" in edges.columns else F.lit(None).cast("string")
    was = F.coalesce(before, F.when(F.col("provenance") != model.VERIFIED, F.col("provenance")))
    return edges.withColumn("was", was).withColumn("provenance", F.lit(model.VERIFIED))


def restore(edges: DataFrame) -> DataFrame:
    """Undoes promote."""
    return edges.withColumn("provenance", F.coalesce("was", "provenance")).drop("was")


def latest_only(records: DataFrame, key: str, version: str) -> DataFrame:
    """The records of each key's latest version; a partial maximum goes through the shuffle, not the records."""
    latest = records.groupBy(key).agg(F.max(version).alias(version))
    return records.join(latest, [key, version], "left_semi")


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """The edges that end in no deleted node (id)."""
    kept = edges.join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_anti")
    return kept.join(gone.withColumnRenamed("id", "to_id"), "to_id", "left_anti")


def carry_forward(unresolved: DataFrame, reprocessed: DataFrame, existing: DataFrame) -> DataFrame:
    """Open references of files that weren't processed anew and still exist."""
    return unresolved.join(reprocessed, "file", "left_anti").join(existing, "file", "left_semi")
