"""Exact duplicates by progressive refinement: length, then hash of a prefix, then hash of the whole text.

Each level only looks at rows that shared the key of the level before with another row, so whole
contents are hashed for the surviving groups alone. Keys are pre-aggregated on the map side; a group
of any size is one row after that. Surviving keys are broadcast when they were counted and are few, so
that a level reads contents of survivors only; else the level hashes in the scan and joins hashes, never texts.

Texts are equal when identical after white space ``[\\x20\\x09-\\x0D]`` is deleted. Null texts are empty
texts, and equal to each other. Of equal texts the row with most code points stays, then the one
with the smallest id; null ids come last. Rows that repeat an id count one by one in ``group_size``, and
share the decision of their id; ``drop_exact_duplicates`` decides by rows. Very long texts are read whole. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.llm.common import SPACES, is_small, saved, table, text_of

#: Characters of the second level's key.
PREFIX = 64


def normalised(column: str = "text") -> Column:
    """The text without white space: literal replacements, which scan bytes and need no regex."""
    return reduce(lambda text, space: F.replace(text, F.lit(space), F.lit("")), SPACES, text_of(column))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _refined(rows: DataFrame, survivors: DataFrame, on: list[str], name: str, key: Column) -> DataFrame:
    """Rows whose keys survived, with the next key."""
    if is_small(survivors):
        return rows.join(F.broadcast(survivors), on, "left_semi").withColumn(name, key)
    return rows.withColumn(name, key).drop("_text").join(survivors, on, "left_semi")


def duplicate_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per group of two or more equal texts: text_sha256, keep_id, keep_points (its code points), group_size."""
    rows = docs.select(F.col(key).alias("_id"), F.length(text_of(text)).alias("_points"), normalised(text).alias("_text"))
    rows = rows.withColumn("_length", F.length("_text"))
    several = lambda df, keys: saved(df.groupBy(*keys).count().where("count > 1").select(*keys))
    lengths = several(rows, ["_length"])
    begun = _refined(rows, lengths, ["_length"], "_prefix", F.xxhash64(F.substring("_text", 1, PREFIX)))
    prefixes = several(begun, ["_length", "_prefix"])
    rows = rows.withColumn("_prefix", F.xxhash64(F.substring("_text", 1, PREFIX)))
    whole = _refined(rows, prefixes, ["_length", "_prefix"], "text_sha256", digest(F.col("_text")))
    first = F.min(F.struct(-F.col("_points"), F.col("_id").isNull(), F.col("_id")))
    groups = whole.groupBy("text_sha256").agg(first.alias("_first"), F.count("*").alias("group_size"))
    return groups.where("group_size > 1").select("text_sha256", F.col("_first._id").alias("keep_id"), (-F.col("_first.col1")).alias("keep_points"), "group_size")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col(key), digest(normalised(text)).alias("text_sha256"))
    classes = saved(duplicate_classes(docs, key, text))
    marked = rows.join(classes.withColumn("_found", F.lit(True)), "text_sha256", "left")
    keep = F.when(F.col("_found"), F.col("keep_id")).otherwise(F.col(key))
    return marked.select(
        F.col(key),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        keep.eqNullSafe(F.col(key)).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: of each group of equal texts one row, whatever ids repeat or lack.

    Of several rows that have the id and the length of the one that stays, the least text stays.
    """
    classes = saved(duplicate_classes(docs, key, text)).select("text_sha256", F.struct("keep_id", "keep_points").alias("class"))
    # The columns of a row stay in a struct, so that none has the name of a working column.
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("id"), F.col(text).alias("text")).withColumn("sha", digest(normalised("text")))
    marked = rows.join(F.broadcast(classes) if is_small(classes) else classes, F.col("sha") == F.col("text_sha256"), "left")
    first = F.col("id").eqNullSafe(F.col("class.keep_id")) & (F.length(text_of("text")) == F.col("class.keep_points"))
    several = marked.where(F.col("class").isNotNull() & first).groupBy("sha").agg(F.min_by("row", text_of("text")).alias("row"))
    return marked.where(F.col("class").isNull()).select("row.*").unionByName(several.select("row.*"))


QUERY = "op7_exact_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


STATEMENT = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
groups AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST) AS keep_id
  FROM rows)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM groups
"""
