"""The backlog of unmatched receipt lines, grouped by normalised label.

Line ids, stores and prices of a group stay rows: one label may hold a third of all
lines, so nothing here collects a group into an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlake.functions import text
from ticketlake.functions.fixed_values import TERMINAL_STATUSES
from ticketlake.operators.ordering import ordered, with_rank_within

# Queue sort fields and their default directions.
QUEUE_SORTS = {
    "line_count": "desc",
    "label": "asc",
    "first_purchased_at": "asc",
    "last_purchased_at": "desc",
}


def lines_with_receipts(lines: DataFrame, receipts: DataFrame) -> DataFrame:
    return lines.join(receipts, "receipt_id")


def without_terminal_decision(lines: DataFrame, matches: DataFrame) -> DataFrame:
    decided = matches.where(F.col("status").isin(TERMINAL_STATUSES)).select("line_id")
    return lines.join(decided, "line_id", "left_anti")


def eligible_lines(lines: DataFrame, receipts: DataFrame, matches: DataFrame) -> DataFrame:
    """Undecided item lines of reviewed, dated receipts, with store, date and normalised label."""
    dated = receipts.where((F.col("parser_status") == "reviewed") & F.col("purchased_at").isNotNull())
    items = lines.where(F.col("kind") == "item")
    joined = lines_with_receipts(items, dated.select("receipt_id", "store_id", "purchased_at"))
    return without_terminal_decision(joined, matches).withColumn("normalized_label", text.normalize_text(F.col("label")))


def receipt_unmatched_lines(lines: DataFrame, receipts: DataFrame, matches: DataFrame, wanted: DataFrame) -> DataFrame:
    """Eligible lines of the wanted receipts, placed by (position, line id) within each."""
    scoped = lines.join(wanted.select("receipt_id"), "receipt_id", "left_semi")
    return eligible_lines(scoped, receipts, matches)


def label_groups(eligible: DataFrame) -> DataFrame:
    """One row per normalised label with its count, dates and representative raw label.

    Counted per (normalised, raw) label first, so a hot label reaches the second
    aggregation as a handful of rows.
    """
    spellings = eligible.groupBy("normalized_label", "label").agg(
        F.count("*").alias("n"),
        F.min("purchased_at").alias("first_purchased_at"),
        F.max("purchased_at").alias("last_purchased_at"),
    )
    return spellings.groupBy("normalized_label").agg(
        F.max_by("label", F.struct("n", -F.length("label"), "label")).alias("representative_label"),
        F.sum("n").alias("line_count"),
        F.min("first_purchased_at").alias("first_purchased_at"),
        F.max("last_purchased_at").alias("last_purchased_at"),
    )


def price_context(eligible: DataFrame) -> DataFrame:
    """Distinct non-null totals, unit prices, quantities and units per label, as sorted rows."""
    kinds = ["total_cents", "unit_price_cents", "quantity", "unit_of_measure"]
    entries = F.array(
        *[
            F.struct(
                F.lit(kind).alias("attribute"),
                F.col(kind).cast("string").alias("value"),
                (F.lit(None) if kind == "unit_of_measure" else F.col(kind)).cast("decimal(18,3)").alias("_number"),
            )
            for kind in kinds
        ]
    )
    values = (
        eligible.select("normalized_label", F.inline(entries))
        .where(F.col("value").isNotNull())
        .distinct()
    )
    return with_rank_within(values, ["normalized_label", "attribute"], ["_number", "value"], "position").select(
        "normalized_label", "attribute", "value", "position"
    )


def group_stores(eligible: DataFrame, stores: DataFrame, brands: DataFrame) -> DataFrame:
    """Distinct stores per label in (brand, location, channel) order; at most one row per store and label."""
    named = stores.join(brands.select("retail_brand_id", F.col("name").alias("brand_name")), "retail_brand_id")
    pairs = eligible.select("normalized_label", "store_id").distinct()
    place = Window.partitionBy("normalized_label").orderBy("brand_name", "location_name", "channel", "store_id")
    return (
        pairs.join(named, "store_id")
        .withColumn("position", F.row_number().over(place))
        .select("normalized_label", "position", "store_id", "brand_name", "location_name", "channel")
    )


def filter_groups(groups: DataFrame, label_filter: str | None) -> DataFrame:
    """Label filter after grouping: on the representative label as typed, or on the normalised label."""
    wanted = F.lit((label_filter or "").strip())
    normal = text.normalize_text(wanted)
    typed = F.contains(F.lower("representative_label"), F.lower(wanted))
    return groups.where((wanted == "") | typed | ((normal != "") & F.contains("normalized_label", normal)))


def queue_order(sort: str | None = None, direction: str | None = None) -> list[Column]:
    field = sort if sort in QUEUE_SORTS else "line_count"
    way = direction if direction in ("asc", "desc") else QUEUE_SORTS[field]
    key = F.lower("representative_label") if field == "label" else F.col(field)
    return [ordered(key, way), ordered("normalized_label")]


def receipt_queue_counts(unmatched: DataFrame) -> DataFrame:
    return unmatched.groupBy("receipt_id").agg(F.count("*").alias("entry_count"))


def queue_line_total(groups: DataFrame) -> DataFrame:
    return groups.agg(F.coalesce(F.sum("line_count"), F.lit(0)).cast("bigint").alias("line_total"))
