"""Reconciliation, duplicate and replacement queries."""

from pyspark.sql import functions as F

from ticketlake.functions import warnings
from ticketlake.operators import reconcile as ops
from ticketlake.operators.reparse import rerun_receipts as rerun_tables
from ticketlake.plans.registry import query
from ticketlake.plans.views import cents
from ticketlake.sources.graph import read_receipt_graph, receipt_graph
from ticketlake.sources.graph import write_receipt_graph as write_graph
from ticketlake.streaming.jobs import workspace

TOTAL = cents("l_extendedprice")
COUNT = "CASE WHEN l_returnflag = 'N' THEN CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE CAST(trunc(l_quantity) AS BIGINT) END ELSE 0 END"
SUMS = f"""SELECT c.receipt_id, c.total_cents, c.declared_article_count, s.line_total, s.article_count, s.line_total + CASE WHEN c.receipt_id % 6 = 0 THEN 2 * firsts ELSE 0 END AS payment_total FROM checked_v c
    JOIN (SELECT l_orderkey AS receipt_id, CAST(sum({TOTAL}) AS BIGINT) AS line_total, CAST(sum({COUNT}) AS BIGINT) AS article_count, count(*) FILTER (WHERE l_linenumber = 1) AS firsts FROM lineitem GROUP BY 1) s USING (receipt_id)"""


def judged(t):
    return ops.validator_results(t.checked_receipts, t.lines, t.checked_payments, "receipt_id")


@query("validate_totals_sum", f"SELECT receipt_id, line_total - total_cents AS gap, abs(line_total - total_cents) <= 1 AS passed FROM ({SUMS})")
def validate_totals_sum(t):
    return judged(t).select("receipt_id", F.col("totals_gap").alias("gap"), F.col("totals_ok").alias("passed"))


@query("validate_article_count", f"SELECT receipt_id, article_count - declared_article_count AS gap, coalesce(article_count = declared_article_count, true) AS passed FROM ({SUMS})")
def validate_article_count(t):
    return judged(t).select("receipt_id", F.col("article_gap").alias("gap"), F.col("articles_ok").alias("passed"))


@query("validate_payments_sum", f"SELECT receipt_id, payment_total - total_cents AS gap, abs(payment_total - total_cents) <= 1 AS passed FROM ({SUMS})")
def validate_payments_sum(t):
    return judged(t).select("receipt_id", F.col("payments_gap").alias("gap"), F.col("payments_ok").alias("passed"))


FAILED = f"""SELECT receipt_id, array_to_string(list_filter([CASE WHEN abs(line_total - total_cents) > 1 THEN 'validate_totals_sum' END, CASE WHEN article_count <> declared_article_count THEN 'validate_article_count' END,
    CASE WHEN abs(payment_total - total_cents) > 1 THEN 'validate_payments_sum' END], lambda x: x IS NOT NULL), ',') AS failed FROM ({SUMS})"""


@query("failed_validators", FAILED)
def failed_validators(t):
    return judged(t).select("receipt_id", F.array_join("failed_validators", ",").alias("failed"))


def repeated(t):
    """Lines as they are, plus copies; every third copy has an altered total."""
    base = t.table("lineitem").selectExpr(
        "l_orderkey as receipt_id", "l_linenumber * 10 as position", "concat('row ', l_partkey) as raw_text", "concat('item ', l_partkey) as label", "false as label_truncated",
        "cast(l_quantity as decimal(10,3)) as quantity", "'piece' as unit_of_measure", "if(l_suppkey % 2 = 0, 100L, null) as unit_price_cents",
        "cast(l_quantity * 100 as bigint) as total_cents", "550 as vat_rate_bp", "false as tr_eligible", "if(l_returnflag = 'R', 'discount', 'item') as kind", "l_partkey as part",
    )
    copies = base.selectExpr("* except (position, total_cents)", "position + 1 as position", "if(part % 3 = 0, total_cents + 1, total_cents) as total_cents")
    return base.unionByName(copies)


REPEATED = """SELECT l_orderkey AS receipt_id, l_linenumber * 10 AS position, l_partkey AS part, CAST(l_quantity AS DECIMAL(10,3)) AS quantity, CASE WHEN l_suppkey % 2 = 0 THEN CAST(100 AS BIGINT) END AS price,
    CAST(l_quantity * 100 AS BIGINT) AS total, CASE WHEN l_returnflag = 'R' THEN 'discount' ELSE 'item' END AS kind FROM lineitem"""
COALESCED = f"""WITH base AS ({REPEATED}), l AS (SELECT * FROM base UNION ALL SELECT receipt_id, position + 1, part, quantity, price, CASE WHEN part % 3 = 0 THEN total + 1 ELSE total END, kind FROM base),
    m AS (SELECT *, price IS NOT NULL AND price * quantity = total AS ok FROM l),
    g AS (SELECT receipt_id, part, quantity, price, kind, count(*) AS n, count(*) FILTER (WHERE ok) AS ok_n, min(total) AS lo, max(total) AS hi, sum(total) AS s, sum(total) FILTER (WHERE ok) AS ok_s FROM m WHERE kind = 'item' GROUP BY 1, 2, 3, 4, 5),
    d AS (SELECT *, CASE WHEN ok_n > 0 AND ok_n < n THEN 'ok' WHEN n > 1 AND lo = hi THEN 'all' ELSE 'none' END AS how FROM g)
    SELECT receipt_id, part, CAST(quantity * CASE how WHEN 'ok' THEN ok_n ELSE n END AS DECIMAL(10,3)) AS quantity, CAST(CASE how WHEN 'ok' THEN ok_s ELSE s END AS BIGINT) AS total_cents,
    coalesce(price, CASE WHEN how = 'all' AND s % CAST(quantity * n AS BIGINT) = 0 THEN CAST(s // CAST(quantity * n AS BIGINT) AS BIGINT) END) AS unit_price_cents FROM d WHERE how <> 'none'
    UNION ALL SELECT m.receipt_id, m.part, m.quantity, m.total, m.price FROM m LEFT JOIN d ON m.kind = 'item' AND d.receipt_id = m.receipt_id AND d.part = m.part AND d.quantity = m.quantity AND d.price IS NOT DISTINCT FROM m.price
    WHERE m.kind <> 'item' OR d.how = 'none'"""


@query("coalesce_repeated_lines", COALESCED)
def coalesce_repeated_lines(t):
    return ops.coalesce_repeated_lines(repeated(t), "receipt_id", "position").select("receipt_id", "part", "quantity", "total_cents", "unit_price_cents")


@query("coalesce_rules", COALESCED)
def coalesce_rules(t):
    return ops.coalesce_repeated_in_place(repeated(t), "receipt_id", "position").select("receipt_id", "part", "quantity", "total_cents", "unit_price_cents")


def with_warnings(t):
    old = F.array(
        F.when(F.col("receipt_id") % 3 == 0, warnings.build_warning("suspected_duplicate", F.lit("old"))),
        F.when(F.col("receipt_id") % 2 == 0, warnings.build_warning("totals_sum_mismatch", F.lit("stale"), "validate_totals_sum")),
    )
    receipts = t.checked_receipts.withColumn("parser_warnings", F.filter(old, lambda w: w.isNotNull()))
    return receipts.withColumn("parser_status", F.lit("parsed"))


def single_lines(t):
    """Lines whose raw text is unique, so that coalescing leaves them alone."""
    return t.lines.withColumn("raw_text", F.col("line_id"))


REVALIDATED = f"""SELECT receipt_id, CASE WHEN failed = '' AND receipt_id % 3 <> 0 THEN 'parsed' ELSE 'needs_review' END AS parser_status,
    array_to_string(list_filter([CASE WHEN receipt_id % 3 = 0 THEN 'suspected_duplicate' END, nullif(replace(replace(failed, 'validate_', ''), ',', '_mismatch,'), '') || '_mismatch'], lambda x: x IS NOT NULL), ',') AS codes, failed FROM ({FAILED})"""


def codes():
    return F.array_join(F.transform("parser_warnings", lambda w: w["code"]), ",").alias("codes")


@query("revalidate_receipts", f"SELECT receipt_id, parser_status, codes FROM ({REVALIDATED})")
def revalidate_receipts(t):
    return ops.revalidate_receipts(with_warnings(t), single_lines(t), t.checked_payments)[0].select("receipt_id", "parser_status", codes())


@query("merge_warnings", f"SELECT receipt_id, codes FROM ({REVALIDATED})")
def merge_warnings(t):
    return ops.revalidate_receipts(with_warnings(t), single_lines(t), t.checked_payments)[0].select("receipt_id", codes())


def promotions(t):
    return t.lines.where("kind = 'discount'").selectExpr("line_id as promotion_id", "receipt_id", "if(position % 2 = 0, line_id, null) as linked_line_id", "'parser_inferred' as linking_method")


@query("finalize_reviews", f"SELECT receipt_id, CASE WHEN failed = '' THEN 'reviewed' ELSE 'needs_review' END AS parser_status FROM ({FAILED})")
def finalize_reviews(t):
    done, _ = ops.finalize_reviews(with_warnings(t), single_lines(t), t.checked_payments, promotions(t))
    return done.select("receipt_id", "parser_status")


@query("finalize_promotion_links", f"SELECT line_id AS promotion_id, CASE WHEN failed <> '' THEN 'parser_inferred' WHEN position % 2 = 0 THEN 'user_confirmed' ELSE 'unallocated' END AS linking_method FROM lines_v JOIN ({FAILED}) USING (receipt_id) WHERE kind = 'discount'")
def finalize_promotion_links(t):
    return ops.finalize_reviews(with_warnings(t), single_lines(t), t.checked_payments, promotions(t))[1].select("promotion_id", "linking_method")


@query("strict_duplicates", "SELECT receipt_id, original_id FROM strict_v")
def strict_duplicates(t):
    return ops.strict_duplicates(t.arrivals)


SUSPECTED = """SELECT receipt_id, suspect_id FROM (SELECT receipt_id, arg_max(receipt_id, (purchased_at, receipt_id)) OVER (PARTITION BY store_id, CAST(purchased_at AS DATE), total_cents ORDER BY created_at, receipt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS suspect_id
    FROM arrivals_v WHERE receipt_id NOT IN (SELECT receipt_id FROM strict_v)) WHERE suspect_id IS NOT NULL"""


@query("suspected_duplicates", SUSPECTED)
def suspected_duplicates(t):
    return ops.suspected_duplicates(t.arrivals)


@query("arrival_order_duplicates", f"SELECT receipt_id, 'rejected' AS outcome, original_id AS other FROM strict_v UNION ALL SELECT receipt_id, 'suspected', suspect_id FROM ({SUSPECTED})")
def arrival_order_duplicates(t):
    strict = ops.strict_duplicates(t.arrivals).select("receipt_id", F.lit("rejected").alias("outcome"), F.col("original_id").alias("other"))
    return strict.unionByName(ops.suspected_duplicates(t.arrivals).select("receipt_id", F.lit("suspected").alias("outcome"), F.col("suspect_id").alias("other")))


def reparsed(t):
    fresh = t.receipts.where("receipt_id % 7 = 0").selectExpr(
        "receipt_id", "'parsed' as parser_status", "receipt_id % 14 = 0 as failed", "cast(timestamp_ntz'2024-05-05 10:00:00' as timestamp_ntz) as purchased_at", "'R1' as register_number",
        "if(receipt_id % 21 = 0, '', concat('N', receipt_id)) as ticket_number", "total_cents + 1 as total_cents", "declared_article_count",
    ).withColumn("parser_warnings", F.array().cast(f"array<{warnings.WARNING_TYPE}>"))
    lines = fresh.selectExpr("receipt_id", "concat('new-', receipt_id) as line_id", "1 as position", "'NEW' as label")
    return fresh, lines


def current_lines(t):
    return t.lines.select("receipt_id", "line_id", "position", "label")


def stored(t):
    return t.receipts.withColumn("parser_warnings", F.array().cast(f"array<{warnings.WARNING_TYPE}>"))


MATCHED = "SELECT DISTINCT receipt_id FROM lines_v WHERE tax_step >= 5"


@query("reparse_receipts", f"SELECT receipt_id, store_id, CASE WHEN again AND receipt_id % 14 <> 0 THEN total_cents + 1 ELSE total_cents END AS total_cents, CASE WHEN again THEN 'parsed' ELSE parser_status END AS parser_status FROM (SELECT *, receipt_id % 7 = 0 AND receipt_id NOT IN ({MATCHED}) AS again FROM receipts_v)")
def reparse_receipts(t):
    fresh, lines = reparsed(t)
    return ops.reparse_receipts(stored(t), current_lines(t), t.matches, fresh, lines)[0].select("receipt_id", "store_id", "total_cents", "parser_status")


@query("reparsed_lines", f"SELECT line_id, label FROM lines_v WHERE receipt_id % 7 <> 0 OR receipt_id IN ({MATCHED}) UNION ALL SELECT 'new-' || receipt_id, 'NEW' FROM receipts_v WHERE receipt_id % 7 = 0 AND receipt_id % 14 <> 0 AND receipt_id NOT IN ({MATCHED})")
def reparsed_lines(t):
    fresh, lines = reparsed(t)
    return ops.reparse_receipts(stored(t), current_lines(t), t.matches, fresh, lines)[1].select("line_id", "label")


@query("refused_reparses", f"SELECT receipt_id, 'lines_already_matched' AS reason FROM receipts_v WHERE receipt_id % 7 = 0 AND receipt_id IN ({MATCHED})")
def refused_reparses(t):
    fresh, lines = reparsed(t)
    return ops.reparse_receipts(stored(t), current_lines(t), t.matches, fresh, lines)[2]


def rerun(t):
    """Every third receipt parsed again; several ask for one key, some name a missing line, some fail."""
    asked = stored(t).where("receipt_id % 3 = 0")
    failure = F.array(warnings.build_warning("parser_exception", F.lit("failed")))
    fresh = asked.selectExpr(
        "receipt_id", "receipt_id % 14 = 0 as failed", "timestamp_ntz'2024-05-05 10:00:00' as purchased_at", "'R1' as register_number", "concat('N', receipt_id div 400) as ticket_number",
        "total_cents + 1 as total_cents", "cast(null as int) as declared_article_count", "if(receipt_id % 14 = 0, 'needs_review', 'parsed') as parser_status", "parser_warnings",
    ).withColumn("parser_warnings", F.when(F.col("failed"), failure).otherwise(F.col("parser_warnings")))
    lines = single_lines(t)
    new = asked.selectExpr(
        "concat('new-', receipt_id) as line_id", "receipt_id", "1 as position", "'NEW' as label", "false as label_truncated", "cast(1 as decimal(10,3)) as quantity", "'piece' as unit_of_measure",
        "total_cents + 1 as unit_price_cents", "total_cents + 1 as total_cents", "550 as vat_rate_bp", "false as tr_eligible", "'item' as kind", "concat('new-', receipt_id) as raw_text",
    )
    again = {
        "receipts": fresh,
        "lines": new,
        "promotions": asked.selectExpr("concat('new-', receipt_id) as promotion_id", "receipt_id", "if(receipt_id % 33 = 0, 2, 1) as linked_line_position", "'parser_inferred' as linking_method"),
        "payments": asked.selectExpr("receipt_id", "total_cents + if(receipt_id % 5 = 0, 51, 1) as amount_cents"),
    }
    tables = {"receipts": stored(t), "lines": lines.select(*new.columns), "promotions": promotions(t), "payments": t.receipts.selectExpr("receipt_id", "total_cents as amount_cents")}
    return rerun_tables(tables, t.matches, again)


RERUN = f"""WITH asked AS (SELECT receipt_id, store_id, created_at, receipt_id % 14 = 0 AS failed, CASE WHEN receipt_id IN ({MATCHED}) THEN 'lines_already_matched' WHEN receipt_id % 33 = 0 THEN 'missing_promotion_line' END AS barred,
        'N' || CAST(receipt_id // 400 AS VARCHAR) AS ticket FROM receipts_v WHERE receipt_id % 3 = 0),
    turns AS (SELECT *, row_number() OVER (PARTITION BY barred IS NULL AND NOT failed, store_id, ticket ORDER BY created_at, receipt_id) AS turn FROM asked),
    judged AS (SELECT *, coalesce(barred, CASE WHEN NOT failed AND turn > 1 THEN 'duplicate_receipt' END) AS reason FROM turns)"""


@query("rerun_receipts", RERUN + """ SELECT r.receipt_id, r.store_id, CASE WHEN done AND NOT failed THEN ticket ELSE ticket_number END AS ticket_number, CASE WHEN done AND NOT failed THEN total_cents + 1 ELSE total_cents END AS total_cents,
    CASE WHEN NOT done THEN parser_status WHEN failed OR r.receipt_id % 5 = 0 THEN 'needs_review' ELSE 'parsed' END AS parser_status,
    CASE WHEN NOT done THEN '' WHEN failed THEN 'parser_exception' WHEN r.receipt_id % 5 = 0 THEN 'payments_sum_mismatch' ELSE '' END AS codes
    FROM (SELECT v.*, failed, ticket, j.receipt_id IS NOT NULL AND reason IS NULL AS done FROM receipts_v v LEFT JOIN judged j ON j.receipt_id = v.receipt_id) r""")
def rerun_receipts(t):
    return rerun(t)["receipts"].select("receipt_id", "store_id", "ticket_number", "total_cents", "parser_status", codes())


@query("rerun_children", RERUN + """ SELECT 'line' AS kind, line_id AS child, total_cents AS cents FROM lines_v WHERE receipt_id NOT IN (SELECT receipt_id FROM judged WHERE reason IS NULL)
    UNION ALL SELECT 'promotion', line_id || coalesce(CASE WHEN position % 2 = 0 THEN ' on ' || line_id END, ''), NULL FROM lines_v WHERE kind = 'discount' AND receipt_id NOT IN (SELECT receipt_id FROM judged WHERE reason IS NULL)
    UNION ALL SELECT 'payment', CAST(receipt_id AS VARCHAR), total_cents FROM receipts_v WHERE receipt_id NOT IN (SELECT receipt_id FROM judged WHERE reason IS NULL)
    UNION ALL SELECT 'line', 'new-' || receipt_id, total_cents + 1 FROM receipts_v JOIN judged USING (receipt_id) WHERE reason IS NULL AND NOT failed
    UNION ALL SELECT 'promotion', 'new-' || receipt_id || ' on new-' || receipt_id, NULL FROM judged WHERE reason IS NULL AND NOT failed
    UNION ALL SELECT 'payment', CAST(receipt_id AS VARCHAR), total_cents + CASE WHEN receipt_id % 5 = 0 THEN 51 ELSE 1 END FROM receipts_v JOIN judged USING (receipt_id) WHERE reason IS NULL AND NOT failed""")
def rerun_children(t):
    out = rerun(t)
    lines = out["lines"].selectExpr("'line' as kind", "line_id as child", "total_cents as cents")
    linked = out["promotions"].selectExpr("'promotion' as kind", "concat(promotion_id, coalesce(concat(' on ', linked_line_id), '')) as child", "cast(null as bigint) as cents")
    return lines.unionByName(linked).unionByName(out["payments"].selectExpr("'payment' as kind", "cast(receipt_id as string) as child", "amount_cents as cents"))


@query("refused_reruns", RERUN + " SELECT receipt_id, reason FROM judged WHERE reason IS NOT NULL")
def refused_reruns(t):
    return rerun(t)["refused"]


@query("apply_review_edits", "SELECT receipt_id, CASE WHEN receipt_id % 7 = 1 THEN 'edited' ELSE ticket_number END AS ticket_number, total_cents FROM receipts_v WHERE receipt_id % 7 <> 2 UNION ALL SELECT receipt_id + 10000000, 'new', total_cents FROM receipts_v WHERE receipt_id % 7 = 3")
def apply_review_edits(t):
    current = t.receipts.select("receipt_id", "ticket_number", "total_cents")
    patch = current.where("receipt_id % 7 between 1 and 4").selectExpr(
        "if(receipt_id % 7 >= 3, receipt_id + 10000000, receipt_id) as receipt_id", "case receipt_id % 7 when 1 then 'edited' when 3 then 'new' else ' ' end as ticket_number", "if(receipt_id % 7 = 4, null, if(receipt_id % 7 = 1, 0, total_cents)) as total_cents",
        "if(receipt_id % 7 = 1, array('ticket_number'), array()) as provided", "receipt_id % 7 >= 3 as is_new", "receipt_id % 7 = 2 as destroy",
    )
    return ops.apply_review_edits(current, patch, "receipt_id", lambda rows: rows.where("trim(ticket_number) <> '' or total_cents is not null"))


@query("delete_receipts", f"SELECT line_id FROM lines_v WHERE receipt_id % 7 <> 0 OR receipt_id IN ({MATCHED})")
def delete_receipts(t):
    left, _ = ops.delete_receipts(t.receipts.where("receipt_id % 7 = 0"), {"lines": t.lines}, t.matches, t.lines)
    return left["lines"].select("line_id")


PROMISED = "SELECT o_orderkey AS receipt_id, CAST(o_orderkey % 9 AS INTEGER) AS p FROM orders"
PLACES = "SELECT DISTINCT l_orderkey AS receipt_id, l_linenumber AS p FROM lineitem"


def promised(t):
    places = t.table("lineitem").selectExpr("l_orderkey as receipt_id", "l_linenumber as position").distinct().withColumn("line_id", F.concat_ws("-", "receipt_id", "position"))
    return t.table("orders").selectExpr("o_orderkey as receipt_id", "nullif(cast(o_orderkey % 9 as int), 0) as linked_line_position"), places


@query("resolve_promotion_position", f"SELECT q.receipt_id, l.receipt_id || '-' || l.p AS linked_line_id FROM ({PROMISED}) q LEFT JOIN ({PLACES}) l USING (receipt_id, p) WHERE q.p = 0 OR l.p IS NOT NULL")
def resolve_promotion_position(t):
    return ops.resolve_promotion_positions(*promised(t))[0].select("receipt_id", "linked_line_id")


@query("write_receipt_graph", f"""WITH bad AS (SELECT receipt_id FROM ({PROMISED}) q LEFT JOIN ({PLACES}) l USING (receipt_id, p) WHERE q.p > 0 AND l.p IS NULL UNION SELECT o_orderkey FROM orders WHERE {cents('o_totalprice')} < 1000000)
    SELECT 'receipts' AS part, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT receipt_id FROM bad) UNION ALL SELECT 'receipt_lines', count(*) FROM ({PLACES}) WHERE receipt_id NOT IN (SELECT receipt_id FROM bad)
    UNION ALL SELECT 'receipt_promotions', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT receipt_id FROM bad) UNION ALL SELECT 'receipt_payments', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT receipt_id FROM bad)""")
def write_receipt_graph(t):
    asked, places = promised(t)
    payments = t.table("orders").selectExpr("o_orderkey as receipt_id", f"{'cast(cast(o_totalprice as decimal(18,2)) * 100 as bigint)'} - 999999 as amount_cents")
    documents = t.receipts.selectExpr("document_id", "store_id", "parser_format")
    graph = receipt_graph({"receipts": t.receipts, "lines": places.drop("line_id"), "promotions": asked, "payments": payments}, documents)
    folder = workspace(t.spark, "graph")
    for _ in range(2):  # the second write is a retry
        write_graph(graph, folder, "1")
    counted = None
    for name in ("receipts", "receipt_lines", "receipt_promotions", "receipt_payments"):
        part = read_receipt_graph(t.spark, folder, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        counted = part if counted is None else counted.unionByName(part)
    return counted


@query("write_receipt_graph_lines", f"""WITH bad AS (SELECT receipt_id FROM ({PROMISED}) q LEFT JOIN ({PLACES}) l USING (receipt_id, p) WHERE q.p > 0 AND l.p IS NULL UNION SELECT o_orderkey FROM orders WHERE {cents('o_totalprice')} < 1000000)
    SELECT receipt_id, CAST(p AS BIGINT) AS position FROM ({PLACES}) WHERE receipt_id NOT IN (SELECT receipt_id FROM bad)""")
def write_receipt_graph_lines(t):
    """The lines as they are read back from what was written."""
    asked, places = promised(t)
    payments = t.table("orders").selectExpr("o_orderkey as receipt_id", "cast(cast(o_totalprice as decimal(18,2)) * 100 as bigint) - 999999 as amount_cents")
    documents = t.receipts.selectExpr("document_id", "store_id", "parser_format")
    graph = receipt_graph({"receipts": t.receipts, "lines": places.drop("line_id"), "promotions": asked, "payments": payments}, documents)
    folder = workspace(t.spark, "graph")
    write_graph(graph, folder, "1")
    return read_receipt_graph(t.spark, folder, "receipt_lines").select("receipt_id", F.col("position").cast("bigint").alias("position"))
