"""A corpus from raw documents to token ids, in stages that each read what the one before kept.

Documents have doc_id, text, lang, source and n_chars; further columns stay as they are up to the last stage,
whatever their names. Every stage takes null, empty and very long texts, repeated rows, null ids and empty
tables; what becomes of them is in its docstring.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphweft.llm import bpe, decontam, linededup, simhash_dedup, toxicity
from graphweft.llm.common import discard, scratch_mark, scratch_path, table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score less than 0.5 for toxicity.

    Null and empty texts score what texts without toxic words do. Each of repeated rows is scored alike. No
    documents give none. No labels, or clean ones only, leave every document.
    """
    return toxicity.keep_clean(spark, docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that an earlier line equals, or nearly equals.

    Documents of which nothing but white space is left go; those that were null, empty or white space before stay.
    Rows with equal id and text keep the same lines; a null id comes after all others. No documents give none.
    """
    return linededup.keep_lines(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the document of the smallest id.

    All texts without words, null ones too, are near copies of each other. Of rows with equal id and text one
    stays; rows with a null id stay all. No documents give none.
    """
    return simhash_dedup.keep_one(spark, docs, words_per_shingle=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages that they share with benchmark items.

    A document of which more than half the words are such goes. Null, empty and clean texts stay as they are,
    and so do repeated rows. No benchmark items, or none with words, change nothing; no documents give none.
    """
    return decontam.decontaminate(spark, docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded_sha256 of each document.

    A null text is empty and has no ids. Repeated rows and null ids stay. No documents give no rows.
    """
    ranks = bpe.ranks_of(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity_filter),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte-level bpe", tokens),
]

#: No SQL expresses the stages; tests/llm/test_pipeline.py runs them on rows whose fate is known.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again.

    What a stage wrote on the way, and the result of the one before, is deleted when its own result is written.
    """
    docs = table(spark, sf_dir, "documents")
    mark = scratch_mark()
    for name, stage in STAGES:
        frame = stage(spark, docs, sf_dir)
        path = scratch_path(spark, "stage-" + name.replace(" ", "-"))
        frame.write.parquet(path)
        discard(spark, mark, keep=path)
        docs = spark.read.parquet(path)
    return docs
