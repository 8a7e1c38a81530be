"""A corpus pipeline of five stages: what each keeps is all that the next one sees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import langid, neardup, packing, quality, substrings
from tidemark.llm.common import Scratch, read_table, shrink_heaps
from tidemark.plans.ship import ship


def ready(spark: SparkSession) -> None:
    """Workers have the package, and executors have given back what the stage before left in their heaps."""
    ship(spark)
    shrink_heaps(spark)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified and not rejected."""
    ready(spark)
    return langid.keep_identified(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their script's fertility bands."""
    ready(spark)
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: five-word shingles, similarity of 0.8 or more."""
    ready(spark)
    return neardup.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 50-byte strings that also start in a document of smaller doc_id."""
    ready(spark)
    return substrings.dedup(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 4096 tokens."""
    ready(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]
#: SQL can't express the models, tokenizers and sorts of these stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    ship(spark)
    scratch = Scratch(spark)
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs)
            scratch.release()
    return docs
