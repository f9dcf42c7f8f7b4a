"""A cleaning pipeline over `documents` made of the corpus operators.

quality       documents that the classifier rejects go
near_copies   of each group of documents with a similarity of at least 0.8 (five-word shingles) the one with the
              smallest doc_id stays
benchmark     documents that hold a benchmark item go
private       personal data and terms that disclose it are replaced by their kinds
tokens        doc_id, n_tokens, ids_sha256 and decoded_sha256 of the texts that are left

Each stage is written as Parquet and read again by the next, so a lost executor costs the work of one stage at most.
Documents with null or empty texts pass every stage but the first, which keeps them if most labels are good.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from terrane.llm import bpe, decontaminate, ngram_join, pii, quality
from terrane.llm.common import stored, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.without_near_copies(docs)


def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, public_tokenizers.path(bpe.RANKS))


STAGES = [("quality", good), ("near_copies", distinct), ("benchmark", untested), ("private", sanitised), ("tokens", encoded)]
#: Votes, similarity joins and merges of byte pairs are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return last(spark, docs, sf_dir)
