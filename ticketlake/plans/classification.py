"""Source classification queries. Texts are whole documents with receipt markers appended."""

from pyspark.sql import functions as F

from ticketlake.operators import classify as ops
from ticketlake.plans.registry import query
from ticketlake.session import durable

# Marker appended by doc_id % 8, as (text, SQL list of matching "format:tier:marker").
MARKS = [
    ("CB Web Drive", "leclerc.web.v1:hard:leclerc_web_payment"),
    ("Code   HT TVA TTC", "leclerc.paper.v2:hard:leclerc_paper_vat_table"),
    ("*** VENTE ***", "u.paper.v2:hard:u_omnipos_sale_banner"),
    (">>>> FRUITS", "u.paper.v1:fallback:u_legacy_section_marker"),
    (">>>> FRUITS\nHash: abc\nWAAOH", "u.paper.v1:hard:u_legacy_hash_footer,u.paper.v1:fallback:u_legacy_section_marker,auchan.paper.v1:hard:auchan_waaoh_account"),
    ("01/02/24 1 AB12 34CDE", "leclerc.paper.v1:fallback:leclerc_paper_legacy_ticket_line"),
    ("rien", ""),
    ("selfscan\n>>>> X", "u.paper.v1:fallback:u_legacy_section_marker,auchan.paper.v1:hard:auchan_selfscan_section"),
]
FOUND = "[" + ", ".join(f"'{m[1]}'" for m in MARKS) + "][CAST(doc_id % 8 + 1 AS INTEGER)]"
CHOSEN = ["leclerc.web.v1", "leclerc.paper.v2", "u.paper.v2", "u.paper.v1", "auchan.paper.v1|u.paper.v1", "leclerc.paper.v1", "", "auchan.paper.v1"]
FORMATS = "[" + ", ".join(f"'{c}'" for c in CHOSEN) + "][CAST(doc_id % 8 + 1 AS INTEGER)]"


def texts(t):
    marks = F.array(*[F.lit(m[0]) for m in MARKS])
    store = F.format_string("magasin Supplier#%09d merci", (F.col("doc_id") % 10))
    body = F.concat_ws("\n", "text", F.element_at(marks, (F.col("doc_id") % 8 + 1).cast("int")), F.when(F.col("doc_id") % 3 > 0, store), F.when(F.col("doc_id") % 5 == 0, F.lit("chez NATION_3 demain")))
    return t.table("documents").select(F.col("doc_id").alias("document_id"), body.alias("text"))


def ruled(t):
    return texts(t).select("document_id", ops.match_format_rules(F.col("text")).alias("matches"))


@query("match_format_rules", f"SELECT doc_id AS document_id, {FOUND} AS found FROM documents")
def match_format_rules(t):
    shown = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["format"], m["tier"], m["marker"])), ",")
    return ruled(t).select("document_id", shown.alias("found"))


@query("distinct_format_decision", f"SELECT doc_id AS document_id, {FORMATS} AS formats FROM documents")
def distinct_format_decision(t):
    return ops.choose_format(ruled(t)).select("document_id", F.array_join("detected_formats", "|").alias("formats"))


ONE = f"CASE WHEN {FORMATS} NOT IN ('', 'auchan.paper.v1|u.paper.v1') THEN {FORMATS} END"


@query("choose_format", f"SELECT doc_id AS document_id, {ONE} AS parser_format, CASE WHEN {ONE} IS NULL THEN 'none' ELSE 'high' END AS confidence, CASE doc_id % 8 WHEN 4 THEN 'parser_format_ambiguous' WHEN 6 THEN 'parser_format_not_detected' ELSE 'parser_format_marker' END AS last_code FROM documents")
def choose_format(t):
    chosen = ops.choose_format(ruled(t))
    return chosen.select("document_id", F.col("detected_format").alias("parser_format"), F.col("format_confidence").alias("confidence"), F.element_at("format_evidence", -1)["code"].alias("last_code"))


@query("store_scope_for_format", """SELECT f AS parser_format, store_id FROM (SELECT DISTINCT ['leclerc.web.v1', 'u.paper.v1', 'not.known.v1', NULL][CAST(doc_id % 4 + 1 AS INTEGER)] AS f FROM documents)
    JOIN stores_v ON CASE f WHEN 'leclerc.web.v1' THEN channel <> 'physical' WHEN 'u.paper.v1' THEN channel = 'physical' ELSE true END""")
def store_scope_for_format(t):
    formats = t.table("documents").selectExpr("doc_id as document_id", "element_at(array('leclerc.web.v1', 'u.paper.v1', 'not.known.v1', null), cast(doc_id % 4 + 1 as int)) as parser_format")
    return ops.store_scope_for_format(t.stores, formats).select("parser_format", "store_id")


def hints(t):
    return ops.store_hints(t.stores, t.retail_brands)


# A document names the store doc_id % 10 (unless doc_id % 3 = 0) and, every fifth time, brand NATION_3.
NAMED = "SELECT doc_id, doc_id % 10 AS store_id FROM documents WHERE doc_id % 3 > 0"
BRANDED = "SELECT doc_id, store_id FROM documents JOIN stores_v ON doc_id % 5 = 0 AND retail_brand_id = 3"


@query("store_hint_match", "SELECT doc_id AS document_id, 'supplier ' || lpad(CAST(doc_id % 10 AS VARCHAR), 9, '0') AS normalized_value FROM documents WHERE doc_id % 3 > 0 UNION ALL SELECT doc_id, 'nation 3' FROM documents WHERE doc_id % 5 = 0 AND 3 IN (SELECT retail_brand_id FROM stores_v)")
def store_hint_match(t):
    return ops.hint_hits(texts(t), hints(t))


SCOPED = f"""SELECT e.doc_id, e.store_id, e.source, e.specific FROM (SELECT doc_id, store_id, 'store.location_name' AS source, true AS specific FROM ({NAMED}) UNION ALL SELECT doc_id, store_id, 'retail_brand.aliases', false FROM ({BRANDED})) e
    JOIN stores_v s USING (store_id) JOIN (SELECT doc_id, {ONE} AS f FROM documents) d USING (doc_id) WHERE f IS NULL OR (f = 'leclerc.web.v1') = (channel <> 'physical')"""


def scoped(t):
    """Formats and hints found per document."""
    formats = ops.choose_format(ruled(t)).select("document_id", F.col("detected_format").alias("parser_format"))
    return formats, ops.hint_hits(texts(t), hints(t))


def entries(t, formats, hits):
    defaults = t.stores.selectExpr("store_id", "'none' as default_parser_format")
    return ops.store_evidence(formats, hits, hints(t), defaults)


@query("store_evidence", f"SELECT doc_id AS document_id, store_id, source FROM ({SCOPED})")
def store_evidence(t):
    return entries(t, *scoped(t)).select("document_id", "store_id", F.col("entry.source").alias("source"))


PICKED = f"""SELECT doc_id, CASE WHEN count(DISTINCT store_id) = 1 THEN min(store_id) END AS store, string_agg(DISTINCT CAST(store_id AS VARCHAR), ',' ORDER BY CAST(store_id AS VARCHAR)) AS stores
    FROM (SELECT *, max(specific) OVER (PARTITION BY doc_id) AS top FROM ({SCOPED})) WHERE specific = top GROUP BY doc_id"""


@query("choose_store", f"SELECT doc_id AS document_id, store AS detected_store, CASE WHEN store IS NULL THEN 'none' ELSE 'high' END AS store_confidence, stores FROM ({PICKED})")
def choose_store(t):
    """Stores are listed once per signature, not per document."""
    documents, *signed = ops.shared_signatures(*scoped(t))
    chosen = ops.choose_store(entries(t, *signed)).withColumnRenamed("document_id", "signature")
    listed = chosen.select("signature", "detected_store", "store_confidence", F.array_join("detected_stores", ",").alias("stores"))
    return documents.join(listed, "signature").select("document_id", "detected_store", "store_confidence", "stores")


def signatures(t):
    formats = ops.choose_format(ruled(t)).select("document_id", F.col("detected_format").alias("parser_format"))
    return ops.hint_signatures(formats, ops.hint_hits(texts(t), hints(t)))


@query("decide_stores", f"SELECT doc_id AS document_id, store AS detected_store, store IS NULL AS many FROM ({PICKED})")
def decide_stores(t):
    """The decision of ``choose_store`` without listing a store."""
    known = durable(signatures(t))
    return known.select("document_id", "signature").join(ops.decide_stores(known, hints(t)), "signature").select("document_id", "detected_store", "many")


@query("apply_explicit_hints", f"""SELECT doc_id AS document_id, CASE WHEN doc_id % 2 = 0 THEN 'u.paper.v2' ELSE {ONE} END AS parser_format, CASE WHEN doc_id % 2 = 0 THEN 'manual' WHEN {ONE} IS NULL THEN 'none' ELSE 'high' END AS parser_confidence,
    doc_id % 2 = 0 AND {FORMATS} NOT IN ('', 'u.paper.v2') AS conflict FROM documents""")
def apply_explicit_hints(t):
    hinted = ops.choose_format(ruled(t)).withColumn("hint_format", F.when(F.col("document_id") % 2 == 0, F.lit("u.paper.v2")))
    return ops.apply_explicit_format(hinted).select("document_id", "parser_format", "parser_confidence", F.exists("format_evidence", lambda e: e["code"] == "explicit_parser_format_conflict").alias("conflict"))


@query("classify_documents", f"""SELECT d.doc_id AS document_id, CASE WHEN d.doc_id % 7 = 0 THEN 'leclerc.web.v1' ELSE f END AS parser_format, coalesce(CASE WHEN d.doc_id % 11 = 0 THEN 5 END, store) AS store_id,
    CASE WHEN (d.doc_id % 7 = 0 OR f IS NOT NULL) AND (d.doc_id % 11 = 0 OR store IS NOT NULL) THEN 'classified' ELSE 'needs_classification' END AS status FROM (SELECT doc_id, {ONE} AS f FROM documents) d
    LEFT JOIN ({PICKED.replace(f"SELECT doc_id, {ONE} AS f FROM documents", f"SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'leclerc.web.v1' ELSE {ONE} END AS f FROM documents")}) p USING (doc_id)""")
def classify_documents(t):
    hinted = texts(t).selectExpr("*", "if(document_id % 7 = 0, 'leclerc.web.v1', null) as hint_format", "cast(if(document_id % 11 = 0, 5, null) as bigint) as hint_store")
    defaults = t.stores.selectExpr("store_id", "'none' as default_parser_format")
    return ops.classify_documents(hinted, hints(t), defaults).select("document_id", "parser_format", "store_id", "status")


def _marked(marks):
    """Format evidence of a mark as ``code:format:marker`` entries; hard markers shadow others."""
    found = [m.split(":") for m in marks.split(",") if m]
    kept = [m for m in found if m[1] == "hard"] or found
    formats = sorted({m[0] for m in kept})
    last = ["parser_format_not_detected::"] if not formats else ["parser_format_ambiguous:" + "|".join(formats) + ":"] if len(formats) > 1 else []
    return ",".join([f"parser_format_marker:{m[0]}:{m[2]}" for m in kept] + last)


MARKED = "[" + ", ".join(f"'{_marked(m[1])}'" for m in MARKS) + "][CAST(doc_id % 8 + 1 AS INTEGER)]"


@query("classification_evidence", f"""WITH found AS (SELECT doc_id, store_id, source, CASE source WHEN 'store.location_name' THEN location_name ELSE aliases[1] END AS value, specific, max(specific) OVER (PARTITION BY doc_id) AS top,
        max(specific) OVER (PARTITION BY doc_id, store_id) AS own, source = 'store.location_name' AS late FROM ({SCOPED}) JOIN stores_v USING (store_id) JOIN retail_brands_v USING (retail_brand_id)),
    listed AS (SELECT doc_id, string_agg('store_metadata_match:' || store_id || ':' || source || ':' || value, ',' ORDER BY store_id, late) AS entries, count(DISTINCT store_id) AS n,
        string_agg(DISTINCT CAST(store_id AS VARCHAR), '|' ORDER BY CAST(store_id AS VARCHAR)) AS ids FROM found WHERE own = top GROUP BY doc_id)
    SELECT d.doc_id AS document_id, {MARKED.replace('doc_id', 'd.doc_id')} AS format_evidence, CASE WHEN n IS NULL THEN 'store_not_detected:::' WHEN n = 1 THEN entries ELSE entries || ',store_ambiguous:' || ids || '::' END AS store_evidence
    FROM documents d LEFT JOIN listed USING (doc_id)""")
def classification_evidence(t):
    """Every evidence entry of every document, in order."""
    plain = texts(t).selectExpr("*", "cast(null as string) as hint_format", "cast(null as bigint) as hint_store")
    defaults = t.stores.selectExpr("store_id", "'none' as default_parser_format")
    found = ops.classify_documents(plain, hints(t), defaults)
    empty = F.lit("")

    def shown(about_format, *parts):
        kept = F.filter("evidence", lambda e: e["code"].startswith("parser_format") == about_format)
        return F.array_join(F.transform(kept, lambda e: F.concat_ws(":", e["code"], *[part(e) for part in parts])), ",")

    formats = shown(True, lambda e: F.coalesce(e["parser_format"], F.array_join(e["parser_formats"], "|"), empty), lambda e: F.coalesce(e["marker"], empty))
    stores = shown(False, lambda e: F.coalesce(e["store_id"], F.array_join(e["store_ids"], "|"), empty), lambda e: F.coalesce(e["source"], empty), lambda e: F.coalesce(e["value"], empty))
    return found.select("document_id", formats.alias("format_evidence"), stores.alias("store_evidence"))


@query("resolve_evidence_stores", "SELECT event_id AS key, coalesce((SELECT location_name FROM stores_v WHERE store_id = user_id), CAST(user_id AS VARCHAR)) || ', unknown' AS stores FROM events")
def resolve_evidence_stores(t):
    listed = t.table("events").selectExpr("event_id as key", "array(cast(user_id as string), 'unknown') as store_ids")
    labels = t.stores.selectExpr("cast(store_id as string) as store_id", "location_name as label")
    return ops.resolve_evidence_stores(listed, labels)
