"""Receipt browsing queries."""

from pyspark.sql import functions as F

from ticketlake.operators import receipts as ops
from ticketlake.operators.ordering import page_of, with_rank
from ticketlake.plans.registry import query

RECEIPT = "receipt_id, store_id, parser_format, purchased_at, register_number, ticket_number, total_cents, declared_article_count, parser_status"


@query("filter_receipts_by_status", f"SELECT {RECEIPT} FROM receipts_v WHERE parser_status = 'parsed'")
def filter_receipts_by_status(t):
    return ops.filter_by_status(t.receipts, "parsed").selectExpr(*RECEIPT.split(", "))


@query("filter_receipts_by_unknown_status", f"SELECT {RECEIPT} FROM receipts_v")
def filter_receipts_by_unknown_status(t):
    return ops.filter_by_status(t.receipts, "archived").selectExpr(*RECEIPT.split(", "))


@query("needs_review_receipts", "SELECT receipt_id, store_id, total_cents FROM receipts_v WHERE parser_status = 'needs_review'")
def needs_review_receipts(t):
    return ops.filter_by_status(t.receipts, "needs_review").select("receipt_id", "store_id", "total_cents")


@query("receipts_with_store_brand", """SELECT r.receipt_id, s.brand_name, s.location_name, s.channel FROM receipts_v r JOIN store_names_v s USING (store_id)""")
def receipts_with_store_brand(t):
    return ops.with_store_and_brand(t.receipts, t.stores, t.retail_brands).select("receipt_id", "brand_name", "location_name", "channel")


def _index(name, column, direction, order):
    """One registered query per index sort."""
    sql = f"""SELECT receipt_id, row_number() OVER (ORDER BY {order}) AS rank
        FROM receipts_v JOIN store_names_v USING (store_id)"""

    @query(name, sql)
    def index(t):
        rows = ops.with_store_and_brand(t.receipts, t.stores, t.retail_brands)
        return with_rank(rows, ops.index_order(column, direction)).select("receipt_id", "rank")


_index("receipts_index", None, None, "purchased_at DESC NULLS FIRST, receipt_id DESC")
_index("receipts_index_by_store", "store", None, "brand_name, location_name, channel, receipt_id")
_index("receipts_index_by_store_desc", "store", "desc", "brand_name DESC, location_name DESC, channel DESC, receipt_id DESC")
_index("receipts_index_by_status", "parser_status", "asc", "parser_status, receipt_id")
_index("receipts_index_by_total", "total", "desc", "total_cents DESC, receipt_id DESC")
_index("receipts_index_by_format", "parser_format", "sideways", "parser_format, receipt_id")
_index("receipts_index_by_date_asc", "purchased_at", "asc", "purchased_at ASC NULLS LAST, receipt_id")


@query("recent_rows", """SELECT 'receipt' AS kind, receipt_id AS id, row_number() OVER (ORDER BY purchased_at DESC NULLS FIRST, receipt_id DESC) AS rank
    FROM receipts_v QUALIFY rank <= 5
    UNION ALL SELECT 'attempt', extraction_id, row_number() OVER (ORDER BY ran_at DESC, extraction_id DESC) AS rank FROM attempts_v QUALIFY rank <= 5""")
def recent_rows(t):
    def numbered(df, at, key, kind):
        rows = ops.recent_rows(df, at, key)
        # Five rows at most.
        return page_of(rows, [F.col(at).desc_nulls_first(), F.col(key).desc_nulls_first()], 1, ops.RECENT_ROWS).select(
            F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col("rank").cast("bigint").alias("rank")
        )

    return numbered(t.receipts, "purchased_at", "receipt_id", "receipt").unionByName(numbered(t.attempts, "ran_at", "extraction_id", "attempt"))


@query("page_of", """WITH ranked AS (SELECT receipt_id, row_number() OVER (ORDER BY total_cents DESC NULLS FIRST, receipt_id DESC) AS rank FROM receipts_v)
    SELECT receipt_id, rank, (SELECT count(*) FROM receipts_v) AS total_count FROM ranked WHERE rank BETWEEN 41 AND 60""")
def third_page(t):
    rows = page_of(t.receipts, ops.index_order("total", "desc"), page=3)
    total = t.receipts.agg(F.count("*")).scalar()
    return rows.select("receipt_id", F.col("rank").cast("bigint").alias("rank"), total.alias("total_count"))


@query("stores_ordered", "SELECT store_id, brand_name, row_number() OVER (ORDER BY brand_name, location_name, channel, store_id) AS rank FROM store_names_v")
def stores_ordered(t):
    named = t.stores.join(t.retail_brands.select("retail_brand_id", F.col("name").alias("brand_name")), "retail_brand_id")
    return with_rank(named, ops.stores_order()).select("store_id", "brand_name", "rank")


@query("dashboard_counts", """SELECT 'documents' AS counter, count(*) AS value FROM documents
    UNION ALL SELECT 'receipts', count(*) FROM receipts_v
    UNION ALL SELECT 'needs_review', count(*) FROM receipts_v WHERE parser_status = 'needs_review'""")
def dashboard_counts(t):
    return ops.dashboard_counts(t.table("documents"), t.receipts)


@query("next_child_position", """SELECT receipt_id, CAST(coalesce(max(position), 0) + 1 AS BIGINT) AS next_position
    FROM receipts_v LEFT JOIN lines_v USING (receipt_id) GROUP BY receipt_id""")
def next_child_position(t):
    return ops.next_child_position(t.receipts, t.table("lineitem").selectExpr("l_orderkey as receipt_id", "l_linenumber as position"))


@query("drop_blank_child_rows", """SELECT event_id, raw_label, amount_cents FROM (SELECT event_id,
    CASE WHEN event_type IN ('view', 'error') THEN '  ' ELSE event_type END AS raw_label,
    CASE WHEN event_id % 3 = 0 THEN CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT) END AS amount_cents FROM events)
    WHERE trim(raw_label) <> '' OR amount_cents IS NOT NULL""")
def drop_blank_child_rows(t):
    edited = t.table("events").selectExpr(
        "event_id",
        "case when event_type in ('view', 'error') then '  ' else event_type end as raw_label",
        "case when event_id % 3 = 0 then cast(cast(value as decimal(18,2)) * 100 as bigint) end as amount_cents",
    )
    return ops.drop_blank_child_rows(edited, "payments")
