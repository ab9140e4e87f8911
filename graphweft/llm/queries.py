"""One query for each operator, over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphweft.llm import bpe, decontam, drift, fingerprint, langid, linededup, ngram_join, oracles, pii, quality, simhash_dedup, spelling, toxicity, warc
from graphweft.llm.common import table


PII_KEY = "spark.graphweft.pii.key"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.ranks_of(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.report(spark, table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the fallback is for the synthetic tables only; a deployment sets its secret
    return pii.report(table(spark, sf_dir, "documents"), spark.conf.get(PII_KEY, "synthetic tables"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(spark, table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(spark, table(spark, sf_dir, "documents"))


def op11_schema_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.report(spark, table(spark, sf_dir, "clients"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.report(spark, table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.report(spark, table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_quality": op4_quality,
    "op5_fingerprints": op5_fingerprints,
    "op6_pii": op6_pii,
    "op7_warc": op7_warc,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_language": op9_language,
    "op10_line_dedup": op10_line_dedup,
    "op11_schema_rewrite": op11_schema_rewrite,
    "op12_ngram_join": op12_ngram_join,
    "op13_spelling": op13_spelling,
}

#: The others have no SQL: it knows neither their hashes, nor their tokenizer, nor what they learn.
SQL: dict[str, str] = {"op2_decontamination": oracles.DECONTAMINATION, "op7_warc": oracles.WARC, "op10_line_dedup": oracles.LINE_DEDUP}
