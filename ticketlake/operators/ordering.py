"""Orders, ranks, pages and running values that stay distributed on hot keys.

A window without a partition key, or with one that holds a third of all rows, would
put that group into one task. Global ranks are therefore counted per sorted partition
and shifted by the partition's start, and running values are computed per ordered
chunk of a key and combined over the (few) chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlake.functions.fixed_values import PAGE_SIZE
from ticketlake.session import durable


def ordered(column: str | Column, direction: str = "asc") -> Column:
    """Nulls last when ascending, first when descending."""
    column = F.col(column) if isinstance(column, str) else column
    return column.desc_nulls_first() if direction == "desc" else column.asc_nulls_last()


def with_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based position under a total order."""
    placed = durable(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the sorted copy, so the window and the broadcast are bounded.
    starts = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    position = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, position.cast("bigint"))
        .drop("_at", "_part", "_before")
    )


def adjacent(ranked: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """Previous and next key by rank: two equi-joins instead of a global window."""
    earlier = ranked.select((F.col(rank) + 1).alias(rank), F.col(key).alias(f"previous_{key}"))
    later = ranked.select((F.col(rank) - 1).alias(rank), F.col(key).alias(f"next_{key}"))
    return ranked.join(earlier, rank, "left").join(later, rank, "left")


def page_of(df: DataFrame, order: Sequence[Column], page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """Rows of one page with their position; sorted with a bounded heap, never fully."""
    start = (page - 1) * size
    rows = df.orderBy(*order).offset(start).limit(size)
    # At most one page of rows reaches this window.
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)) + F.lit(start))


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the greatest ``order`` tuple per key; partial aggregation, no sort."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*")


def earliest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*")


def with_rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """1-based position under a total order within each key.

    Rows are range-partitioned by key and order, so a hot key spans many chunks; each chunk counts for itself and
    starts after the chunks before it.
    """
    chunks = durable(df.repartitionByRange(*keys, *order).withColumn("_chunk", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each chunk of a key.
    starts = (
        chunks.groupBy(*keys, "_chunk")
        .agg(F.count("*").alias("_n"))
        .select(*keys, "_chunk", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before"))
    )
    ranked = chunks.withColumn("_inside", F.row_number().over(inside)).join(starts, [*keys, "_chunk"])
    return ranked.withColumn(name, (F.col("_inside") + F.col("_before")).cast("int")).drop("_inside", "_before", "_chunk")


def running_max_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Largest ``value`` among earlier rows of the same (non-null) key.

    Rows are range-partitioned by key and order, so one hot key spans many chunks; each
    chunk runs its own window and takes the maximum of the chunks before it.
    """
    chunks = durable(
        df.withColumn("_value", value)
        .repartitionByRange(*keys, *order)
        .withColumn("_chunk", F.spark_partition_id())
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    earlier = (
        chunks.groupBy(*keys, "_chunk")
        .agg(F.max("_value").alias("_most"))
        .select(*keys, "_chunk", F.max("_most").over(across).alias("_earlier"))
    )
    return (
        chunks.join(earlier, [*keys, "_chunk"])
        .withColumn(name, F.greatest(F.max("_value").over(inside), F.col("_earlier")))
        .drop("_value", "_chunk", "_earlier")
    )


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New snapshot: incoming rows replace current rows with the same key."""
    kept = current.join(incoming.select(*keys), list(keys), "left_anti")
    return kept.unionByName(incoming)
