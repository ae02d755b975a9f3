"""Queries over the backlog of unmatched lines."""

from pyspark.sql import functions as F

from ticketlake.operators import matching as ops
from ticketlake.operators.ordering import adjacent, page_of, with_rank
from ticketlake.plans.registry import query

WANTED = "SELECT receipt_id FROM receipts_v WHERE store_id = 3"


def eligible(t):
    return ops.eligible_lines(t.lines, t.receipts, t.matches)


def groups(t):
    return ops.label_groups(eligible(t))


@query("lines_with_receipts", "SELECT line_id, l.receipt_id, parser_status, purchased_at FROM lines_v l JOIN receipts_v r USING (receipt_id)")
def lines_with_receipts(t):
    return ops.lines_with_receipts(t.lines, t.receipts).select("line_id", "receipt_id", "parser_status", "purchased_at")


@query("lines_without_terminal_decision", """SELECT line_id, label FROM lines_v WHERE line_id NOT IN
    (SELECT line_id FROM matches_v WHERE status IN ('confirmed', 'ignored'))""")
def lines_without_terminal_decision(t):
    return ops.without_terminal_decision(t.lines, t.matches).select("line_id", "label")


@query("eligible_lines", "SELECT line_id, receipt_id, store_id, purchased_at, normalized_label FROM eligible_v")
def eligible_lines(t):
    return eligible(t).select("line_id", "receipt_id", "store_id", "purchased_at", "normalized_label")


@query("receipt_unmatched_lines", f"""SELECT line_id, receipt_id, row_number() OVER (PARTITION BY receipt_id ORDER BY position, line_id) AS place
    FROM eligible_v WHERE receipt_id IN ({WANTED})""")
def receipt_unmatched_lines(t):
    from pyspark.sql import Window

    wanted = t.receipts.where("store_id = 3")
    place = Window.partitionBy("receipt_id").orderBy("position", "line_id")
    rows = ops.receipt_unmatched_lines(t.lines, t.receipts, t.matches, wanted)
    return rows.select("line_id", "receipt_id", F.row_number().over(place).cast("bigint").alias("place"))


@query("receipt_queue_counts", "SELECT receipt_id, count(*) AS entry_count FROM eligible_v GROUP BY receipt_id")
def receipt_queue_counts(t):
    return ops.receipt_queue_counts(eligible(t))


@query("label_groups", "SELECT normalized_label, line_count, first_purchased_at, last_purchased_at FROM groups_v")
def label_groups(t):
    return groups(t).select("normalized_label", "line_count", "first_purchased_at", "last_purchased_at")


@query("representative_label", "SELECT normalized_label, representative_label FROM groups_v")
def representative_label(t):
    return groups(t).select("normalized_label", "representative_label")


@query("price_context", """SELECT normalized_label, attribute, value, row_number() OVER (PARTITION BY normalized_label, attribute ORDER BY number, value) AS position FROM (
    SELECT DISTINCT normalized_label, 'total_cents' AS attribute, CAST(total_cents AS VARCHAR) AS value, CAST(total_cents AS DECIMAL(18,3)) AS number FROM eligible_v
    UNION ALL SELECT DISTINCT normalized_label, 'unit_price_cents', CAST(unit_price_cents AS VARCHAR), CAST(unit_price_cents AS DECIMAL(18,3)) FROM eligible_v WHERE unit_price_cents IS NOT NULL
    UNION ALL SELECT DISTINCT normalized_label, 'quantity', CAST(quantity AS VARCHAR), CAST(quantity AS DECIMAL(18,3)) FROM eligible_v
    UNION ALL SELECT DISTINCT normalized_label, 'unit_of_measure', unit_of_measure, NULL FROM eligible_v)""")
def price_context(t):
    return ops.price_context(eligible(t)).withColumn("position", F.col("position").cast("bigint"))


@query("group_stores", """SELECT normalized_label, store_id, brand_name, location_name, channel,
    row_number() OVER (PARTITION BY normalized_label ORDER BY brand_name, location_name, channel, store_id) AS position
    FROM (SELECT DISTINCT normalized_label, store_id FROM eligible_v) JOIN store_names_v USING (store_id)""")
def group_stores(t):
    return ops.group_stores(eligible(t), t.stores, t.retail_brands).withColumn("position", F.col("position").cast("bigint"))


@query("filter_groups_by_label", """SELECT normalized_label, representative_label, line_count FROM groups_v
    WHERE contains(lower(representative_label), 'réd b') OR contains(normalized_label, 'red b')""")
def filter_groups_by_label(t):
    return ops.filter_groups(groups(t), " Réd B ").select("normalized_label", "representative_label", "line_count")


@query("filter_groups_by_symbol", "SELECT normalized_label, line_count FROM groups_v WHERE contains(lower(representative_label), '?')")
def filter_groups_by_symbol(t):
    return ops.filter_groups(groups(t), "?").select("normalized_label", "line_count")


@query("queue_line_total", "SELECT CAST(sum(line_count) AS BIGINT) AS line_total FROM groups_v")
def queue_line_total(t):
    return ops.queue_line_total(groups(t))


def _queue(name, sort, direction, order):
    @query(name, f"SELECT normalized_label, row_number() OVER (ORDER BY {order}, normalized_label) AS rank FROM groups_v")
    def queue(t):
        return with_rank(groups(t), ops.queue_order(sort, direction)).select("normalized_label", "rank")


_queue("queue_order", None, None, "line_count DESC")
_queue("queue_order_by_label_desc", "label", "desc", "lower(representative_label) DESC")
_queue("queue_order_by_first_date", "first_purchased_at", None, "first_purchased_at")
_queue("queue_order_by_last_date", "last_purchased_at", None, "last_purchased_at DESC")


@query("adjacent_groups", """SELECT normalized_label, lag(normalized_label) OVER w AS previous_normalized_label, lead(normalized_label) OVER w AS next_normalized_label
    FROM groups_v WINDOW w AS (ORDER BY line_count DESC, normalized_label)""")
def adjacent_groups(t):
    ranked = with_rank(groups(t).select("normalized_label", "representative_label", "line_count"), ops.queue_order())
    return adjacent(ranked, "normalized_label").select("normalized_label", "previous_normalized_label", "next_normalized_label")


@query("matching_queue", """WITH page AS (SELECT *, row_number() OVER (ORDER BY line_count DESC, normalized_label) AS rank FROM groups_v
    WHERE contains(lower(representative_label), 'l') OR contains(normalized_label, 'l') QUALIFY rank <= 20)
    SELECT rank, normalized_label, representative_label, line_count, first_purchased_at, last_purchased_at,
    count(DISTINCT e.store_id) AS store_count, min(e.total_cents) AS lowest_total_cents, max(e.total_cents) AS highest_total_cents
    FROM page JOIN eligible_v e USING (normalized_label) GROUP BY ALL""")
def matching_queue(t):
    lines = eligible(t)
    page = page_of(ops.filter_groups(ops.label_groups(lines), "l"), ops.queue_order())
    per_store = lines.groupBy("normalized_label", "store_id").agg(F.min("total_cents").alias("_low"), F.max("total_cents").alias("_high"))
    spread = per_store.groupBy("normalized_label").agg(
        F.count("*").alias("store_count"), F.min("_low").alias("lowest_total_cents"), F.max("_high").alias("highest_total_cents")
    )
    return page.join(spread, "normalized_label").withColumn("rank", F.col("rank").cast("bigint"))
