"""Receipt browsing: filters, index orders, recent rows, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlake.functions import text
from ticketlake.functions.fixed_values import PARSER_STATUSES, RECENT_ROWS
from ticketlake.operators.ordering import ordered

# Index sort columns with their default direction and sort keys.
INDEX_SORTS = {
    "purchased_at": ("desc", ["purchased_at"]),
    "store": ("asc", ["brand_name", "location_name", "channel"]),
    "parser_status": ("asc", ["parser_status"]),
    "total": ("asc", ["total_cents"]),
    "parser_format": ("asc", ["parser_format"]),
}


def filter_by_status(receipts: DataFrame, status: str | None) -> DataFrame:
    """Rows of one parser status; an unknown status filters nothing."""
    return receipts.where(F.col("parser_status") == status) if status in PARSER_STATUSES else receipts


def with_store_and_brand(receipts: DataFrame, stores: DataFrame, brands: DataFrame) -> DataFrame:
    """Dimensions are joined by plain equi-joins; Spark broadcasts them only under its size threshold."""
    labelled = stores.join(brands.select("retail_brand_id", F.col("name").alias("brand_name")), "retail_brand_id")
    return receipts.join(labelled.select("store_id", "brand_name", "location_name", "channel"), "store_id")


def index_order(column: str | None, direction: str | None) -> list[Column]:
    """Sort keys for the receipt index; unknown values fall back to the defaults."""
    default, keys = INDEX_SORTS.get(column or "", INDEX_SORTS["purchased_at"])
    way = direction if direction in ("asc", "desc") else default
    return [ordered(key, way) for key in [*keys, "receipt_id"]]


def stores_order() -> list[Column]:
    return [ordered(c) for c in ("brand_name", "location_name", "channel", "store_id")]


def recent_rows(df: DataFrame, at: str, key: str, count: int = RECENT_ROWS) -> DataFrame:
    return df.orderBy(ordered(at, "desc"), ordered(key, "desc")).limit(count)


def dashboard_counts(documents: DataFrame, receipts: DataFrame) -> DataFrame:
    """Three counters as rows; each table is scanned once."""
    total = documents.agg(F.count("*").alias("value")).select(F.lit("documents").alias("counter"), "value")
    counted = receipts.agg(
        F.count("*").alias("receipts"),
        F.count_if(F.col("parser_status") == "needs_review").alias("needs_review"),
    ).selectExpr("stack(2, 'receipts', receipts, 'needs_review', needs_review) as (counter, value)")
    return total.unionByName(counted)


def next_child_position(receipts: DataFrame, children: DataFrame) -> DataFrame:
    last = children.groupBy("receipt_id").agg(F.max("position").alias("_last"))
    return receipts.join(last, "receipt_id", "left").select(
        "receipt_id", (F.coalesce(F.col("_last"), F.lit(0)) + 1).cast("bigint").alias("next_position")
    )


# Child columns that carry user content (defaulted columns do not count).
CONTENT_COLUMNS = {
    "lines": ["raw_text", "label", "unit_price_cents", "total_cents", "section_label"],
    "promotions": ["program", "delta", "label"],
    "payments": ["raw_label", "amount_cents"],
}


def drop_blank_child_rows(rows: DataFrame, child: str) -> DataFrame:
    """Drop edited rows whose content columns are all blank."""
    content = F.array(*[F.col(c).cast("string") for c in CONTENT_COLUMNS[child] if c in rows.columns])
    return rows.where(F.exists(content, lambda value: ~text.is_blank(value)))
