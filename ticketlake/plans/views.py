"""SQL projections of the benchmark tables onto the receipt domain (names end in _v)."""

FORMAT_LIST = "['auchan.paper.v1','leclerc.paper.v1','leclerc.paper.v2','leclerc.web.v1','u.paper.v1','u.paper.v2']"


def norm(x: str) -> str:
    return f"trim(regexp_replace(replace(lower(strip_accents({x})), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'))"


def norm_marks(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', ' ', 'g'))"


def cents(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(18,2)) * 100 AS BIGINT)"


def _extent(wanted: str, ordered: str) -> str:
    """Best overlap of a trigram set with an extent; extents start and end on a wanted trigram."""
    hits = f"list_filter(range(1, len({ordered}) + 1), lambda k: list_contains({wanted}, {ordered}[k]))"
    return f"""coalesce(list_max(flatten(list_transform({hits}, lambda i: list_transform(list_filter({hits}, lambda m: m >= i),
        lambda j: len(list_intersect({wanted}, {ordered}[i:j]))::DOUBLE / len(list_distinct(list_concat({wanted}, {ordered}[i:j]))))))), 0)"""


# Views that several parts of one statement read and that are costly to repeat.
MATERIALIZED = {"scores_v", "ranked_hits_v", "candidates_v", "lines_v", "eligible_v", "tree_v"}

VIEWS = {
    "retail_brands_v": "SELECT n_nationkey AS retail_brand_id, n_name AS name, [n_name] AS aliases FROM nation",
    "stores_v": """SELECT s_suppkey AS store_id, s_nationkey AS retail_brand_id, s_name AS location_name,
        CASE s_suppkey % 3 WHEN 0 THEN 'physical' WHEN 1 THEN 'drive' ELSE 'click_collect' END AS channel FROM supplier""",
    "store_names_v": """SELECT s.*, b.name AS brand_name FROM stores_v s JOIN retail_brands_v b USING (retail_brand_id)""",
    "receipts_v": f"""SELECT o_orderkey AS receipt_id, o_custkey % 10 AS store_id, o_orderkey AS document_id,
        {FORMAT_LIST}[CAST(o_orderkey % 6 + 1 AS INTEGER)] AS parser_format,
        CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS purchased_at,
        o_orderpriority AS register_number, CAST(o_orderkey AS VARCHAR) AS ticket_number,
        {cents('o_totalprice')} AS total_cents, CAST(o_orderkey % 7 AS INTEGER) AS declared_article_count,
        CASE o_orderstatus WHEN 'F' THEN 'reviewed' WHEN 'P' THEN 'parsed' ELSE 'needs_review' END AS parser_status,
        o_orderdate + to_seconds(o_orderkey) AS created_at FROM orders""",
    "lines_v": f"""SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || {cents('l_extendedprice')} AS line_id,
        l_orderkey AS receipt_id, l_linenumber AS position, p_name,
        CASE l_linenumber % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name ELSE replace(p_name, 'e', 'é') END AS label,
        l_partkey % 17 = 0 AS label_truncated, CAST(l_quantity AS DECIMAL(10,3)) AS quantity,
        CASE WHEN l_suppkey % 5 = 0 THEN 'kg' ELSE 'piece' END AS unit_of_measure,
        CASE WHEN l_linenumber % 2 = 1 THEN CAST(round(CAST({cents('l_extendedprice')} AS DECIMAL(18,0)) / CAST(l_quantity AS DECIMAL(10,3))) AS BIGINT) END AS unit_price_cents,
        {cents('l_extendedprice')} AS total_cents, CASE WHEN l_suppkey % 2 = 0 THEN 550 ELSE 2000 END AS vat_rate_bp,
        l_suppkey % 3 = 0 AS tr_eligible, 'S' || l_suppkey % 4 AS section_label,
        CASE l_returnflag WHEN 'N' THEN 'item' WHEN 'R' THEN 'discount' ELSE 'fee' END AS kind,
        l_partkey AS part_id, CAST(round(l_tax * 100) AS INTEGER) AS tax_step, l_shipdate AS shipped_at
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "matches_v": """SELECT 'm-' || line_id AS match_id, line_id, CASE WHEN tax_step <> 6 THEN part_id END AS variant_id,
        CASE tax_step WHEN 5 THEN 'confirmed' WHEN 6 THEN 'ignored' WHEN 7 THEN 'rejected' ELSE 'suggested' END AS status,
        CASE tax_step WHEN 8 THEN 'heuristic' ELSE 'user' END AS source,
        CASE tax_step WHEN 8 THEN CAST(0.5 AS DECIMAL(5,4)) END AS confidence,
        label AS label_snapshot, p_name AS normalized_label_snapshot, shipped_at AS decided_at
        FROM lines_v WHERE tax_step >= 5""",
    "eligible_v": """SELECT l.*, r.store_id, r.purchased_at, l.p_name AS normalized_label FROM lines_v l
        JOIN receipts_v r USING (receipt_id)
        WHERE l.kind = 'item' AND r.parser_status = 'reviewed' AND r.purchased_at IS NOT NULL
        AND l.line_id NOT IN (SELECT line_id FROM matches_v WHERE status IN ('confirmed', 'ignored'))""",
    "spellings_v": """SELECT normalized_label, label, count(*) AS n, min(purchased_at) AS lo, max(purchased_at) AS hi
        FROM eligible_v GROUP BY ALL""",
    "groups_v": """SELECT normalized_label,
        arg_max(label, (n, -length(label), label)) AS representative_label, CAST(sum(n) AS BIGINT) AS line_count,
        min(lo) AS first_purchased_at, max(hi) AS last_purchased_at FROM spellings_v GROUP BY normalized_label""",
    "product_brands_v": """SELECT DISTINCT p_brand AS record_id, p_brand AS name,
        regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g') AS normalized_name,
        CASE WHEN CAST(substr(p_brand, 7) AS INTEGER) % 2 = 0 THEN CAST(substr(p_brand, 7) AS INTEGER) % 25 END AS retail_brand_id
        FROM part""",
    "products_v": """SELECT DISTINCT p_brand || '|' || p_type AS record_id, p_type AS name, lower(p_type) AS normalized_name,
        p_brand AS product_brand_id, p_type AS category_name FROM part""",
    "variants_v": """SELECT p_partkey AS record_id, p_name AS name, p_name AS normalized_name, p_brand || '|' || p_type AS product_id,
        p_brand AS product_brand_id, lower(p_type) AS product_normalized_name,
        regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g') AS brand_normalized_name,
        CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey % 3 AS INTEGER) END AS package_count,
        CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DECIMAL(10,3)) END AS quantity_value,
        CASE WHEN p_partkey % 4 <> 0 THEN 'unit-' || p_partkey % 4 END AS comparison_unit_id FROM part""",
    "categories_v": """SELECT p_partkey AS category_id, CASE WHEN p_partkey > 0 THEN (p_partkey - 1) // 2 END AS parent_id,
        p_name || ' ' || p_partkey AS name FROM part""",
    "checked_v": f"""SELECT l_orderkey AS receipt_id, CAST(sum({cents('l_extendedprice')}) AS BIGINT) + l_orderkey % 5 - 2 AS total_cents,
        CASE WHEN l_orderkey % 4 <> 0 THEN CAST(sum(CASE WHEN l_returnflag = 'N' THEN CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE CAST(trunc(l_quantity) AS BIGINT) END ELSE 0 END) AS BIGINT) + l_orderkey % 3 - 1 END AS declared_article_count
        FROM lineitem GROUP BY l_orderkey""",
    "checked_payments_v": f"""SELECT l_orderkey AS receipt_id, l_linenumber AS position, l_shipmode_v AS raw_label, amount_cents FROM (
        SELECT l_orderkey, l_linenumber, 'CB' AS l_shipmode_v, {cents('l_extendedprice')} + CASE WHEN l_linenumber = 1 AND l_orderkey % 6 = 0 THEN 2 ELSE 0 END AS amount_cents FROM lineitem)""",
    "attempts_v": """SELECT event_id AS extraction_id, user_id AS document_id, ts AS ran_at, event_type <> 'error' AS success,
        ts + to_seconds(event_id % 3) AS created_at FROM events""",
    "arrivals_v": f"""SELECT o_orderkey AS receipt_id, o_custkey % 5 AS store_id,
        CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority ELSE '' END AS register_number,
        CAST(o_custkey % 50 AS VARCHAR) AS ticket_number, date_trunc('month', o_orderdate) + to_hours(CAST(o_orderkey % 3 AS INTEGER)) AS purchased_at,
        CAST({cents('o_totalprice')} // 5000000 AS BIGINT) AS total_cents, o_orderdate + to_seconds(o_orderkey) AS created_at FROM orders""",
    "strict_v": """SELECT receipt_id, original_id FROM (SELECT receipt_id, first_value(receipt_id) OVER w AS original_id FROM arrivals_v
        WHERE register_number <> '' WINDOW w AS (PARTITION BY store_id, register_number, ticket_number, purchased_at ORDER BY created_at, receipt_id)) WHERE receipt_id <> original_id""",
    "tree_v": """SELECT category_id, name, depth, path, crumb FROM (
        WITH RECURSIVE walk AS (SELECT category_id, name, 1 AS depth, [category_id] AS path, name AS crumb FROM categories_v WHERE parent_id IS NULL
        UNION ALL SELECT c.category_id, c.name, w.depth + 1, list_append(w.path, c.category_id), w.crumb || ' > ' || c.name
        FROM categories_v c JOIN walk w ON c.parent_id = w.category_id) SELECT * FROM walk)""",
    "texts_v": """SELECT x, o, list_distinct(o) AS s FROM (SELECT x, flatten(list_transform(string_split(x, ' '),
        lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))) AS o FROM (
        SELECT p_name AS x FROM part UNION SELECT replace(replace(p_name, 'e', 'a'), 'll', 'l') FROM part
        UNION SELECT lower(p_type) FROM part UNION SELECT regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g') FROM part))""",
    "scores_v": f"""SELECT a.x AS query, b.x AS name,
        len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))) AS similarity,
        {_extent('a.s', 'b.o')} AS forward, {_extent('b.s', 'a.o')} AS backward, greatest(similarity, forward, backward) AS score
        FROM texts_v a, texts_v b""",
    "attribute_hits_v": """SELECT query, 'product_brand' AS record_type, record_id, b.name, 'normalized_name' AS matched_attribute, 0 AS place, score
        FROM scores_v s JOIN product_brands_v b ON s.name = b.normalized_name WHERE score >= 0.18
        UNION ALL SELECT query, 'product', record_id, p.name, 'normalized_name', 0, score FROM scores_v s JOIN products_v p ON s.name = p.normalized_name WHERE score >= 0.18
        UNION ALL SELECT query, 'product_variant', CAST(record_id AS VARCHAR), v.name, 'normalized_name', 0, score FROM scores_v s JOIN variants_v v ON s.name = v.normalized_name WHERE score >= 0.18
        UNION ALL SELECT query, 'product_variant', CAST(record_id AS VARCHAR), v.name, 'product_name', 1, score FROM scores_v s JOIN variants_v v ON s.name = v.product_normalized_name WHERE score >= 0.18
        UNION ALL SELECT query, 'product_variant', CAST(record_id AS VARCHAR), v.name, 'product_brand_name', 2, score FROM scores_v s JOIN variants_v v ON s.name = v.brand_normalized_name WHERE score >= 0.18""",
    "hits_v": """SELECT query, record_type, record_id, name, arg_max(matched_attribute, (score, -place)) AS matched_attribute, round(max(score) * 100, 2) AS score
        FROM attribute_hits_v WHERE query IN (SELECT p_name FROM part) GROUP BY ALL""",
    "ranked_hits_v": """SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, record_type, name, record_id) AS rank FROM hits_v""",
    "expanded_v": """SELECT h.*, v.record_id AS variant_id, v.name AS variant_name FROM ranked_hits_v h JOIN variants_v v
        ON (h.record_type = 'product_variant' AND h.record_id = CAST(v.record_id AS VARCHAR)) WHERE rank <= 20
        UNION ALL SELECT h.*, v.record_id, v.name FROM ranked_hits_v h JOIN variants_v v ON h.record_type = 'product' AND h.record_id = v.product_id WHERE rank <= 20
        UNION ALL SELECT h.*, v.record_id, v.name FROM ranked_hits_v h JOIN variants_v v ON h.record_type = 'product_brand' AND h.record_id = v.product_brand_id WHERE rank <= 20""",
    "prior_v": """SELECT normalized_label_snapshot AS normalized_label, variant_id, max(decided_at) AS decided_at
        FROM matches_v WHERE status = 'confirmed' GROUP BY ALL""",
    "candidates_v": """SELECT normalized_label, variant_id, 'prior_confirmed_label' AS reason, CAST(1 AS DECIMAL(5,4)) AS confidence,
        0 AS source, 0 AS hit, -epoch_us(decided_at) AS recency, '' AS variant_name FROM prior_v
        UNION ALL SELECT query, variant_id, 'catalogue_search', CAST(least(greatest(CAST(score AS DECIMAL(9,4)) / 100, 0), 1) AS DECIMAL(5,4)),
        1, rank, 0, variant_name FROM expanded_v""",
    "suggestions_v": """SELECT line_id, variant_id, reason, confidence, rank FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY source, hit, recency, variant_name, variant_id) AS rank FROM (
        SELECT e.line_id, c.* FROM eligible_v e JOIN candidates_v c USING (normalized_label)
        LEFT JOIN matches_v m ON m.line_id = e.line_id AND m.variant_id = c.variant_id AND m.status = 'rejected' WHERE m.line_id IS NULL
        QUALIFY row_number() OVER (PARTITION BY e.line_id, c.variant_id ORDER BY c.source, c.hit, c.recency, c.variant_name) = 1)) WHERE rank <= 5""",
}
