"""A corpus pipeline: quality, recurring lines, near duplicates, personal data, packing.

Each stage takes all documents that its predecessor kept and returns what it keeps, with the columns of documents; the last
one returns the packed pieces. Where a stage changes texts, n_chars follows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import line_dedup, ngram_join, packing, pii, quality
from ledgerlark.llm.common import spool, table


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the trusted text's model stays within their language's threshold."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of recurring templates."""
    return _measured(line_dedup.drop_lines(docs).select(docs.columns))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity 0.8 or more."""
    return ngram_join.keep_one(docs, words=5, num=8, den=10)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return _measured(pii.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs, packing.definition(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality", good), ("lines", lines), ("near_duplicates", distinct), ("pii", redacted), ("packing", packed)]

#: The stages train models and follow links, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
