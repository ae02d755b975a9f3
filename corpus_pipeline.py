"""A corpus pipeline: its stages, each an operator of ``ticketlake.llm``, written and read again in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticketlake.llm.common import saved, table
from ticketlake.llm.exact_dedup import drop_exact_duplicates
from ticketlake.llm.mixing import mixed_documents
from ticketlake.llm.ngram_join import drop_near_duplicates
from ticketlake.llm.packing import packed_documents, tokenizer_path
from ticketlake.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; it learns from the labelled rows of these documents."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that share 0.8 or more of their five-word shingles one document stays."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, each with its place in a sequence."""
    return packed_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("ngram_join", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

# Stages score, hash into shingles, draw and pack step by step, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
