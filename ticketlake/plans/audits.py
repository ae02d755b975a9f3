"""Audit queries."""

from pyspark.sql import functions as F

from ticketlake.operators import audit as ops
from ticketlake.plans.registry import query


@query("audit_unique", """SELECT receipt_id, position, count(*) AS copies FROM lines_v GROUP BY 1, 2 HAVING count(*) > 1""")
def audit_unique(t):
    lines = t.table("lineitem").selectExpr("l_orderkey as receipt_id", "l_linenumber as position")
    return ops.audit_unique(lines, ["receipt_id", "position"])


@query("audit_unique_partial", """SELECT store_id, register_number, ticket_number, purchased_at, count(*) AS copies FROM arrivals_v WHERE register_number <> '' GROUP BY ALL HAVING count(*) > 1""")
def audit_unique_partial(t):
    return ops.audit_unique(t.arrivals, ["store_id", "register_number", "ticket_number", "purchased_at"], "register_number <> ''")


CHECKED = ["stores.retail_brand_id", "receipts.store_id", "receipt_lines.receipt_id", "categories.parent_id"]
UNCHECKED = " ".join(
    f"UNION ALL SELECT '{k.table}.{k.column}', NULL, 'not_checked'" for k in ops.FOREIGN_KEYS if f"{k.table}.{k.column}" not in CHECKED
)


@query("audit_foreign_keys", f"""SELECT 'stores.retail_brand_id' AS reference, count(*) FILTER (WHERE retail_brand_id > 20) AS orphans, 'checked' AS state FROM stores_v
    UNION ALL SELECT 'receipts.store_id', count(*) FILTER (WHERE o_custkey NOT IN (SELECT store_id FROM stores_v)), 'checked' FROM orders WHERE o_orderkey % 100 <> 0
    UNION ALL SELECT 'receipt_lines.receipt_id', count(*) FILTER (WHERE l_orderkey % 100 = 0), 'checked' FROM lineitem
    UNION ALL SELECT 'categories.parent_id', 0, 'checked' {UNCHECKED}""")
def audit_foreign_keys(t):
    return ops.audit_foreign_keys(
        {
            "retail_brands": t.retail_brands.where("retail_brand_id <= 20"),
            "stores": t.stores,
            "receipts": t.table("orders").where("o_orderkey % 100 <> 0").selectExpr("o_orderkey as receipt_id", "o_custkey as store_id"),
            "receipt_lines": t.table("lineitem").selectExpr("l_orderkey as receipt_id"),
            "categories": t.categories,
        }
    )


@query("audit_immutability", """SELECT doc_id AS document_id, CASE WHEN doc_id % 5 = 0 THEN 'vanished' ELSE 'changed' END AS finding FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0""")
def audit_immutability(t):
    before = t.table("documents").selectExpr("doc_id as document_id", "sha2(text, 256) as content_hash", "case when doc_id % 3 = 0 then null else lang end as mime_type")
    after = before.where("document_id % 5 <> 0").withColumn("content_hash", F.when(F.col("document_id") % 7 == 0, F.lit("x")).otherwise(F.col("content_hash")))
    return ops.audit_immutability(before, after, "document_id", ["content_hash", "mime_type"])


@query("audit_checks", """SELECT event_id AS payment_id, array_to_string(list_filter([CASE WHEN NOT (amount > 0) THEN 'amount_positive' END, CASE WHEN event_type NOT IN ('view', 'click') THEN 'kind_domain' END], lambda x: x IS NOT NULL), ',') AS rules
    FROM (SELECT event_id, event_type, CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT) - 500 AS amount FROM events) WHERE NOT (amount > 0) OR event_type NOT IN ('view', 'click')""")
def audit_checks(t):
    payments = t.table("events").selectExpr("event_id as payment_id", "event_type as kind", "'cash' as category", "cast(cast(value as decimal(18,2)) * 100 as bigint) - 500 as amount_cents")
    rules = [*ops.ROW_RULES["receipt_payments"], ("kind_domain", "kind in ('view', 'click')")]
    return ops.audit_checks(payments, rules).select("payment_id", F.array_join("broken_rules", ",").alias("rules"))


@query("audit_match_checks", "SELECT match_id, 'variant_presence' AS rules FROM matches_v WHERE variant_id % 9 = 0")
def audit_match_checks(t):
    damaged = t.matches.withColumn("variant_id", F.when(F.col("variant_id") % 9 != 0, F.col("variant_id")))
    return ops.audit_checks(damaged, ops.ROW_RULES["receipt_line_matches"]).select("match_id", F.array_join("broken_rules", ",").alias("rules"))


@query("audit_json_shapes", "SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'keys' WHEN 2 THEN 'code' WHEN 3 THEN 'value' WHEN 4 THEN 'not an object' END AS problem FROM events WHERE event_id % 5 > 0")
def audit_json_shapes(t):
    warned = t.table("events").selectExpr(
        "event_id",
        """case event_id % 5 when 0 then concat('{"code":"', event_type, '","validator":null,"detail":"d","value":', value, '}') when 1 then props
           when 2 then '{"code":1,"validator":null,"detail":"d","value":null}' when 3 then '{"code":"c","validator":"v","detail":"d","value":"x"}' else concat('[', event_id, ']') end as document""",
    )
    return warned.select("event_id", ops.warning_problem(F.col("document")).alias("problem")).where("problem is not null")


@query("audit_observation_consistency", """SELECT match_id, CASE WHEN status <> 'confirmed' THEN 'not_confirmed' ELSE 'mismatch' END AS finding FROM matches_v
    WHERE variant_id IS NOT NULL AND (status <> 'confirmed' OR variant_id % 10 = 0)""")
def audit_observation_consistency(t):
    stored = t.matches.where("variant_id is not null").selectExpr("match_id", "line_id", "if(variant_id % 10 = 0, variant_id + 1, variant_id) as variant_id")
    return ops.audit_observation_consistency(stored, t.matches)


@query("audit_detection_extraction", "SELECT extraction_id, document_id + 1 AS document_id FROM attempts_v WHERE extraction_id % 6 = 0")
def audit_detection_extraction(t):
    detections = t.attempts.selectExpr("extraction_id", "if(extraction_id % 6 = 0, document_id + 1, document_id) as document_id")
    return ops.audit_detection_extraction(detections, t.attempts)


@query("restricted_deletes", """SELECT DISTINCT store_id, 'receipts' AS held_by FROM receipts_v WHERE store_id IN (SELECT store_id FROM stores_v) UNION ALL SELECT DISTINCT store_id, 'price_observations' FROM receipts_v r JOIN matches_v m ON m.status = 'confirmed' AND split_part(m.line_id, '-', 1) = CAST(r.receipt_id AS VARCHAR) WHERE purchased_at IS NOT NULL
    UNION ALL SELECT DISTINCT doc_id % 40, 'source_documents' FROM documents WHERE doc_id % 3 = 0 AND doc_id % 40 IN (SELECT store_id FROM stores_v)
    UNION ALL SELECT DISTINCT extraction_id % 7, 'source_document_detections' FROM attempts_v WHERE extraction_id % 7 IN (SELECT store_id FROM stores_v)""")
def restricted_deletes(t):
    from ticketlake.plans.decision import observations

    documents = t.table("documents").selectExpr("doc_id as document_id", "if(doc_id % 3 = 0, doc_id % 40, null) as store_id")
    detections = t.attempts.selectExpr("extraction_id", "extraction_id % 7 as store_id")
    given = {"receipts": t.receipts, "price_observations": observations(t), "source_documents": documents, "source_document_detections": detections}
    return ops.restricted_deletes("stores", t.stores, given)


@query("rekey_tables", """SELECT sha256('receipt_lines|' || l.line_id) AS line_id, sha256('receipts|' || l.receipt_id) AS receipt_id, sha256(CASE WHEN tax_step % 2 = 0 THEN 'receipts|' ELSE 'stores|' END || l.receipt_id) AS subject_id
    FROM lines_v l JOIN receipts_v r USING (receipt_id)""")
def rekey_tables(t):
    """Lines keep pointing at their re-keyed receipt, checked by joining the new keys."""
    lines = t.lines.selectExpr("line_id", "receipt_id", "if(tax_step % 2 = 0, 'Receipt', 'Store') as subject_type", "receipt_id as subject_id")
    out = ops.rekey_tables(
        {"receipts": (t.receipts.select("receipt_id"), "receipt_id"), "receipt_lines": (lines, "line_id")},
        ops.FOREIGN_KEYS,
        {"receipt_lines": ("subject_type", "subject_id", {"Receipt": "receipts", "Store": "stores"})},
    )
    return out["receipt_lines"].join(out["receipts"], "receipt_id").select("line_id", "receipt_id", "subject_id")
