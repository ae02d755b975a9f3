"""Document, extraction and seed queries."""

from pyspark.sql import functions as F

from ticketlake.operators import classify
from ticketlake.plans.registry import query
from ticketlake.sources import documents as ops
from ticketlake.sources import locations

EXT = "['pdf', 'png', 'JPG', 'txt'][CAST(doc_id % 4 + 1 AS INTEGER)]"


def uploads(t):
    return t.table("documents").selectExpr(
        "concat('/in/', doc_id, '.', element_at(array('pdf', 'png', 'JPG', 'txt'), cast(doc_id % 4 + 1 as int))) as path",
        "encode(text, 'utf-8') as content",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id % 50) as ingested_at",
    )


@query("register_documents", f"""SELECT sha256('/in/' || doc_id || '.' || {EXT}) AS document_id, sha256(text) AS content_hash,
    ['application/pdf', 'image/png', 'image/jpeg'][CAST(doc_id % 4 + 1 AS INTEGER)] AS mime_type, 'pending' AS source_detection_status FROM documents WHERE doc_id % 4 < 3""")
def register_documents(t):
    return ops.register_documents(uploads(t))[0].drop("ingested_at")


@query("rejected_documents", "SELECT '/in/' || doc_id || '.txt' AS path, 'unsupported_mime_type' AS reason FROM documents WHERE doc_id % 4 = 3")
def rejected_documents(t):
    return ops.register_documents(uploads(t))[1]


@query("dedup_documents_by_hash", """SELECT doc_id AS upload_id, first_value(doc_id) OVER (PARTITION BY text ORDER BY doc_id % 50, doc_id) AS document_id,
    doc_id <> first_value(doc_id) OVER (PARTITION BY text ORDER BY doc_id % 50, doc_id) AS duplicate FROM documents""")
def dedup_documents_by_hash(t):
    registered = t.table("documents").selectExpr("doc_id as document_id", "sha2(text, 256) as content_hash", "doc_id % 50 as ingested_at")
    return ops.dedup_documents_by_hash(registered)


@query("load_extractions", """SELECT doc_id AS extraction_id, sha256(CASE WHEN doc_id % 4 IN (1, 2) THEN '' ELSE text END) AS text_hash, doc_id % 4 NOT IN (1, 2) AS success,
    CASE doc_id % 4 WHEN 1 THEN 'layout returned empty text' WHEN 2 THEN 'broken file' END AS error_message FROM documents""")
def load_extractions(t):
    attempts = t.table("documents").selectExpr(
        "doc_id as extraction_id", "doc_id as document_id", "'layout' as engine", "if(doc_id % 4 = 1, ' \\n\\t ', text) as text",
        "cast(null as timestamp_ntz) as ran_at", "if(doc_id % 4 = 2, 'broken file', null) as error_message",
    )
    return ops.load_extractions(attempts).select("extraction_id", F.sha2("text", 256).alias("text_hash"), "success", "error_message")


STATE = "CASE WHEN user_id % 4 = 0 THEN 'needs_classification' ELSE 'classified' END"


def states(t):
    users = t.table("events").select("user_id").distinct()
    return users.selectExpr(
        "user_id as document_id", "if(user_id % 4 = 0, 'needs_classification', 'classified') as source_detection_status",
        "if(user_id % 4 = 1, null, user_id) as store_id", "if(user_id % 4 = 2, null, 'u.paper.v1') as parser_format",
    )


@query("parseable_extractions", "SELECT extraction_id, document_id FROM attempts_v WHERE success AND document_id % 4 = 3")
def parseable_extractions(t):
    return ops.parseable_extractions(t.attempts, states(t))[0].select("extraction_id", "document_id")


@query("refused_extractions", "SELECT extraction_id, document_id FROM attempts_v WHERE success AND document_id % 4 < 3")
def refused_extractions(t):
    return ops.parseable_extractions(t.attempts, states(t))[1].select("extraction_id", "document_id")


@query("latest_per_document", """SELECT document_id, 'reparse' AS purpose, arg_max(extraction_id, (ran_at, extraction_id)) AS extraction_id FROM attempts_v WHERE success GROUP BY 1
    UNION ALL SELECT document_id, 'manual', arg_max(extraction_id, (ran_at, created_at, extraction_id)) FROM attempts_v WHERE success GROUP BY 1
    UNION ALL SELECT document_id, 'status', arg_max(extraction_id, (ran_at, created_at, extraction_id)) FROM attempts_v GROUP BY 1""")
def latest_per_document(t):
    parts = [ops.latest_per_document(t.attempts, p).select("document_id", F.lit(p).alias("purpose"), "extraction_id") for p in ("reparse", "manual", "status")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("latest_extraction_lateral", """SELECT d.doc_id AS document_id, a.extraction_id, a.ran_at FROM documents d JOIN LATERAL (
    SELECT extraction_id, ran_at FROM attempts_v x WHERE x.document_id = d.doc_id AND success ORDER BY ran_at DESC, created_at DESC, extraction_id DESC LIMIT 1) a ON TRUE""")
def latest_extraction_lateral(t):
    latest = ops.latest_per_document(t.attempts, "manual").select("document_id", "extraction_id", "ran_at")
    return t.table("documents").select(F.col("doc_id").alias("document_id")).join(latest, "document_id")


LATEST = "SELECT document_id, arg_max(success, (ran_at, created_at, extraction_id)) AS success FROM attempts_v GROUP BY 1"


@query("processing_state", f"""SELECT doc_id AS document_id, CASE WHEN success THEN 'complete' WHEN success IS NOT NULL THEN 'failed' ELSE 'queued' END AS extraction_state,
    CASE WHEN doc_id % 10 = 0 THEN 'complete' WHEN success AND doc_id % 3 = 0 THEN 'queued' WHEN success AND doc_id % 3 = 1 THEN 'needs_classification' WHEN success IS NOT NULL THEN 'blocked' ELSE 'waiting' END AS parsing_state
    FROM documents LEFT JOIN ({LATEST}) ON doc_id = document_id""")
def processing_state(t):
    docs = t.table("documents").selectExpr("doc_id as document_id", "element_at(array('classified', 'needs_classification', 'pending'), cast(doc_id % 3 + 1 as int)) as source_detection_status")
    receipts = t.table("documents").where("doc_id % 10 = 0").selectExpr("doc_id as document_id")
    return ops.processing_state(docs, ops.latest_per_document(t.attempts, "status"), receipts)


@query("extraction_accuracy", """SELECT doc_id AS document_id, count(*) FILTER (WHERE hit) AS matched, count(*) AS total, CAST(round(CAST(count(*) FILTER (WHERE hit) AS DECIMAL(12,0)) * 100 / count(*), 1) AS DECIMAL(5,1)) AS accuracy,
    coalesce(string_agg(label, ', ' ORDER BY position) FILTER (WHERE NOT hit), '-') AS missed FROM (SELECT doc_id, unnest([1, 2, 3]) AS position, unnest(['digits', 'lang', 'licence']) AS label,
    unnest([regexp_matches(text, '[0-9]{3}'), regexp_matches(text, lang), regexp_matches(text, '(?i)licen[cs]e')]) AS hit FROM documents) GROUP BY 1""")
def extraction_accuracy(t):
    docs = t.table("documents").select(F.col("doc_id").alias("document_id"), "lang", "text", F.lit("raw").alias("variant"))
    expectations = docs.selectExpr("document_id", "inline(array(struct(1 as position, 'digits' as label, '[0-9]{3}' as pattern), struct(2 as position, 'lang' as label, lang as pattern), struct(3 as position, 'licence' as label, '(?i)licen[cs]e' as pattern)))")
    return ops.extraction_accuracy(docs, expectations).drop("variant")


def manual_requests(t):
    return t.table("documents").selectExpr("doc_id as document_id", "doc_id % 10 as store_id", "'u.paper.v2' as parser_format")


CHOSEN = "SELECT document_id, arg_max(extraction_id, (ran_at, created_at, extraction_id)) AS extraction_id FROM attempts_v WHERE success GROUP BY 1"


@query("manual_classification", f"SELECT doc_id AS document_id, extraction_id, 'classified' AS status, doc_id % 10 AS store_id, 'manual' AS store_confidence, 'manual_classification:' || doc_id % 10 AS evidence FROM documents JOIN ({CHOSEN}) ON doc_id = document_id")
def manual_classification(t):
    found, _ = classify.manual_classification(manual_requests(t), ops.latest_per_document(t.attempts, "manual"))
    return found.select("document_id", "extraction_id", "status", "store_id", "store_confidence", F.expr("concat(evidence[0].code, ':', evidence[0].store_id)").alias("evidence"))


@query("refused_manual_classification", "SELECT doc_id AS document_id FROM documents WHERE doc_id NOT IN (SELECT document_id FROM attempts_v WHERE success)")
def refused_manual_classification(t):
    return classify.manual_classification(manual_requests(t), ops.latest_per_document(t.attempts, "manual"))[1].select("document_id")


@query("backfill_detections", f"SELECT doc_id AS document_id, extraction_id, 'manual' AS parser_confidence, 'manual_backfill' AS evidence FROM documents JOIN ({CHOSEN}) ON doc_id = document_id")
def backfill_detections(t):
    found = classify.backfill_detections(manual_requests(t), ops.latest_per_document(t.attempts, "manual"))
    return found.select("document_id", "extraction_id", "parser_confidence", F.expr("evidence[0].code").alias("evidence"))


def seeds(t):
    brands = t.retail_brands.selectExpr("lower(name) as slug", "name", "array(name, concat(name, ' market')) as aliases", "retail_brand_id as seed_order")
    tracked = t.stores.selectExpr("cast(retail_brand_id as string) as brand_slug", "location_name", "channel", "concat('rue ', store_id) as address", "store_id as seed_order",
                                  """concat('{"legal_entities":["L', store_id, '"],"detection_hints":{"phone":"05', store_id, '","sites":["a","b"],"size":3}}') as identifiers""")
    local = t.stores.where("store_id % 2 = 0").selectExpr("cast(retail_brand_id as string) as brand_slug", "location_name", "if(store_id % 4 = 0, channel, 'kiosk') as channel", "concat('avenue ', store_id) as address", "store_id as seed_order",
                                                          """concat('{"legal_entities":["L', store_id, '","M"],"detection_hints":{"phone":"06","sites":["b","c"]}}') as identifiers""")
    return brands, tracked, local


@query("load_location_dimension", """SELECT location_name, channel, CASE WHEN store_id % 4 = 0 THEN 'avenue ' ELSE 'rue ' END || store_id AS address, false AS local_only FROM stores_v
    UNION ALL SELECT location_name, 'kiosk', 'avenue ' || store_id, true FROM stores_v WHERE store_id % 4 = 2""")
def load_location_dimension(t):
    _, tracked, local = seeds(t)
    return locations.merge_store_seeds(tracked, local).select("location_name", "channel", "address", "local_only")


@query("merge_brand_seeds", "SELECT lower(name) AS slug, CASE WHEN retail_brand_id % 2 = 0 THEN name || ' local' ELSE name END AS name, name || ',' || name || ' market' || CASE WHEN retail_brand_id % 2 = 0 THEN ',Extra' ELSE '' END AS aliases FROM retail_brands_v")
def merge_brand_seeds(t):
    brands, _, _ = seeds(t)
    local = brands.where("seed_order % 2 = 0").selectExpr("slug", "concat(name, ' local') as name", "array(name, 'Extra') as aliases", "seed_order")
    return locations.merge_brand_seeds(brands, local).select("slug", "name", F.array_join("aliases", ",").alias("aliases"))


@query("merge_identifiers", """SELECT location_name, path, CASE WHEN store_id % 4 = 0 THEN local ELSE tracked END AS value FROM (SELECT *, unnest(['legal_entities', 'detection_hints.phone', 'detection_hints.sites', 'detection_hints.size']) AS path,
    unnest(['["L' || store_id || '"]', '"05' || store_id || '"', '["a","b"]', '3']) AS tracked, unnest(['["L' || store_id || '","M"]', '"06"', '["a","b","c"]', '3']) AS local FROM stores_v)
    UNION ALL SELECT location_name || '/kiosk', unnest(['legal_entities', 'detection_hints.phone', 'detection_hints.sites']), unnest(['["L' || store_id || '","M"]', '"06"', '["b","c"]']) FROM stores_v WHERE store_id % 4 = 2""")
def merge_identifiers(t):
    _, tracked, local = seeds(t)
    merged = locations.merge_identifier_leaves(tracked, local, ["location_name", "channel"])
    return merged.select(F.when(F.col("channel") == "kiosk", F.concat("location_name", F.lit("/kiosk"))).otherwise(F.col("location_name")).alias("location_name"), "path", "value")


@query("upsert_dimension", "SELECT store_id, CASE WHEN store_id % 3 = 0 THEN upper(location_name) ELSE location_name END AS location_name FROM stores_v UNION ALL SELECT store_id + 1000000, location_name FROM stores_v WHERE store_id % 5 = 0")
def upsert_dimension(t):
    current = t.stores.select("store_id", "location_name")
    incoming = current.where("store_id % 3 = 0").selectExpr("store_id", "upper(location_name) as location_name").unionByName(
        current.where("store_id % 5 = 0").selectExpr("store_id + 1000000 as store_id", "location_name")
    )
    return locations.upsert_dimension(current, incoming, ["store_id"])


@query("normalize_store_identifiers", """SELECT store_id, CASE store_id % 3 WHEN 0 THEN 'C' || store_id WHEN 1 THEN 'A,B' END AS codes,
    array_to_string(list_filter([CASE WHEN store_id % 3 = 2 THEN 'receipt_store_codes must be an array' END, CASE WHEN store_id % 2 = 0 THEN 'default_parser_format must be a known format' END], lambda x: x IS NOT NULL), ';') AS problems FROM stores_v""")
def normalize_store_identifiers(t):
    stores = t.stores.selectExpr(
        "store_id",
        """concat('{"receipt_store_codes":', case store_id % 3 when 0 then concat('"C', store_id, '"') when 1 then '["A",null,"B"]' else '{"x":1}' end, ',"default_parser_format":"', if(store_id % 2 = 0, 'nope', 'u.paper.v1'), '"}') as identifiers""",
    )
    out = locations.normalize_identifiers(stores)
    return out.select("store_id", F.array_join("receipt_store_codes", ",").alias("codes"), F.array_join("problems", ";").alias("problems"))


@query("flatten_identifiers", """SELECT event_id, 'hints.' || path AS source, value FROM (SELECT event_id, unnest(['a', 'b.c', 'b.d', 'b.d']) AS path, unnest([event_type, 'x', 'p', 'q' || user_id]) AS value FROM events)""")
def flatten_identifiers(t):
    nested = t.table("events").selectExpr("event_id", """concat('{"a":"', event_type, '","n":', user_id, ',"b":{"c":"x","d":["p","q', user_id, '",7]}}') as hints""")
    return locations.flatten_identifiers(nested, ["event_id"], "hints", "hints")
