"""From raw documents to token shards, one operator a stage.

Every stage works on all that its predecessor kept, and all but the last
return the columns of documents.  Between stages the documents are written as
Parquet and read again, so that a lost executor costs one stage at most; a stage's
table is deleted once the next one is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from agentlake.llm import decontam, jaccard, langid, mixing, tokens
from agentlake.llm.common import remove, shared_folder, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be determined, with it as their lang (operator 6)."""
    return langid.keep_determined(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram Jaccard joins connect (operator 7)."""
    return jaccard.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (operator 2)."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix, as often as their source's weight asks for (operator 5)."""
    return mixing.interleave(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id shards with document boundaries (operator 1)."""
    return tokens.shards(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("decontaminate", decontaminate),
    ("mixed", mixed),
    ("token_ids", token_ids),
]

#: No SQL can express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := f"{folder}/{k}-{name}.parquet")
            if k:
                remove(spark, last)
            docs, last = spark.read.parquet(path), path
    return docs
