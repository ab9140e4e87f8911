"""What is said beside an answer: how far it can be trusted, and a receipt that shows whether it was changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft import model
from graphweft.sources import sinks


def trust_line(edges: DataFrame) -> DataFrame:
    """One row (n, verified, trust): whether an answer's edges are all proven, some, or none; nothing can be said of no edges."""
    sums = edges.agg(F.count("*").alias("n"), F.count_if(F.col("provenance").isin(model.VERIFIED, "CODE_INTEL")).alias("verified"))
    trust = F.when(F.col("n") == 0, "nothing found").when(F.col("verified") == F.col("n"), "verified").when(F.col("verified") > 0, "partial").otherwise("heuristic")
    return sums.withColumn("trust", trust)


def warns(trust: Column, results: Column, namesakes: Column) -> Column:
    """Whether an answer should say that it may lack some: few results under weak trust, or fewer than there are nodes of that name."""
    return ((trust == "weak") & (results < 10)) | ((namesakes >= 3) & (results < namesakes))


def receipt(answer: DataFrame, question: str, commit: str) -> DataFrame:
    """One row (question, commit, n, digest, seal): what was asked of what, how many rows came, and a seal over all of it."""
    told = sinks.digest(answer).select(F.lit(question).alias("question"), F.lit(commit).alias("commit"), "n", "digest")
    return told.withColumn("seal", seal_of())


def seal_of() -> Column:
    return F.sha2(F.concat_ws("|", "question", "commit", F.col("n").cast("string"), "digest"), 256)


def intact(receipts: DataFrame) -> DataFrame:
    """receipts with intact: whether the seal is that of the other columns."""
    return receipts.withColumn("intact", F.col("seal") == seal_of())
