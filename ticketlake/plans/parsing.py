"""Text line queries, and round trips: texts rendered from ``orders`` are parsed back.

Each order becomes one receipt text from its own columns (no grouping); the SQL side states
the expected rows straight from the same columns and never parses text.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ticketlake.functions.fixed_values import MONTHS
from ticketlake.operators import formats
from ticketlake.operators import receipt_text as ops
from ticketlake.plans.registry import query

FULL_MONTHS = [next(name for name, n in MONTHS.items() if n == number) for number in range(1, 13)]
MONTH_SQL = "[" + ", ".join(f"'{m}'" for m in FULL_MONTHS) + "]"


def lines_of(t):
    return ops.explode_lines(ops.by_document(t.table("documents").select(F.col("doc_id").alias("document_id"), "text")))


DOC_LINES = """SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY place) AS line_no, line FROM (
    SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS place,
    regexp_replace(raw, '^[\\s]+|[\\s]+$', '', 'g') AS line FROM documents) WHERE line <> ''"""


@query("explode_lines", f"SELECT document_id, CAST(line_no AS INTEGER) AS line_no, line FROM ({DOC_LINES})")
def explode_lines(t):
    return ops.explode_lines(t.table("documents").select(F.col("doc_id").alias("document_id"), "text"))


@query("assign_line_positions", """SELECT receipt_id AS document_id, line_id, row_number() OVER (PARTITION BY receipt_id ORDER BY part_id, line_id) AS position FROM lines_v""")
def assign_line_positions(t):
    indexed = t.lines.selectExpr("receipt_id as document_id", "line_id", "struct(part_id, line_id) as line_index")
    return ops.assign_line_positions(indexed).select("document_id", "line_id", F.col("position").cast("bigint").alias("position"))


@query("body_bounds", f"""WITH l AS ({DOC_LINES}) SELECT document_id, CAST(line_no AS INTEGER) AS line_no FROM (SELECT *, max(contains(line, ',')) OVER w AS started,
    coalesce(max(contains(line, ',') AND line LIKE '%e.') OVER (PARTITION BY document_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS finished
    FROM l WINDOW w AS (PARTITION BY document_id ORDER BY line_no)) WHERE started AND NOT finished""")
def body_bounds(t):
    begins = F.contains("line", F.lit(","))
    df = lines_of(t).withColumns({"begins": begins, "ends": begins & F.col("line").endswith("e.")})
    df = df.withColumns({"started": formats._ever(F.col("begins"), ops.up_to()), "finished": formats._ever(F.col("ends"), ops.before())})
    return df.where("started and not finished").select("document_id", "line_no")


@query("carry_section_label", """SELECT conv_id, turn, nullif(last_value(mark IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), '') AS section FROM (
    SELECT conv_id, turn, CASE WHEN role = 'user' THEN left(text, 12) WHEN role = 'system' THEN '' END AS mark FROM conversations)""")
def carry_section_label(t):
    mark = F.when(F.col("role") == "user", F.left("text", F.lit(12))).when(F.col("role") == "system", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return t.table("conversations").select("conv_id", "turn", F.nullif(formats._carried(mark, order), F.lit("")).alias("section"))


@query("pending_label", """SELECT conv_id, turn, pending FROM (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER w = 'user' THEN lag(length(text)) OVER w END AS pending FROM (
    SELECT * FROM conversations WHERE length(text) % 3 > 0) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant'""")
def pending_label(t):
    kept = F.length("text") % 3 > 0
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    previous = formats._carried(F.when(kept, F.struct("role", F.length("text").cast("bigint").alias("n"))), before)
    df = t.table("conversations").withColumn("previous", previous).where(kept & (F.col("role") == "assistant"))
    return df.select("conv_id", "turn", F.when(F.col("previous.role") == "user", F.col("previous.n")).alias("pending"))


@query("first_match_per_document", f"""WITH l AS ({DOC_LINES}) SELECT d.doc_id AS document_id,
    (SELECT arg_min(line, line_no) FROM l WHERE l.document_id = d.doc_id AND regexp_matches(line, '[0-9]{{4}}')) AS first_number,
    (SELECT arg_min(line, line_no) FROM l WHERE l.document_id = d.doc_id AND regexp_matches(line, '^[A-E]')) AS first_letter
    FROM documents d WHERE d.doc_id IN (SELECT document_id FROM l WHERE regexp_matches(line, '[0-9]{{4}}') OR regexp_matches(line, '^[A-E]'))""")
def first_match_per_document(t):
    return ops.first_matches(lines_of(t), {"number": "[0-9]{4}", "letter": "\\A[A-E]"})


def rendered(t, *parts, case="true"):
    """Order columns the texts are made of, and the text built from ``parts`` (SQL expressions)."""
    base = t.table("orders").selectExpr(
        "o_orderkey as k", "o_custkey as c", "o_orderdate as at", "cast(cast(o_totalprice as decimal(18,2)) * 100 as bigint) as cents",
    ).selectExpr("*", "cast(1 + k % 4 as int) as n").withColumn("unit", F.expr("transform(sequence(1, n), i -> 50 + (cents + 37 * i) % 950)"))
    months = "array(" + ", ".join(f"'{m}'" for m in FULL_MONTHS) + ")"
    base = base.selectExpr(
        "*", "aggregate(transform(unit, (u, i) -> if(i = 1, u * 2, u)), 0L, (a, u) -> a + u) as total",
        f"if(k % 10 = 8, 'brumaire', element_at({months}, month(at))) as month_name", "n + if(n > 1, 1, 0) as articles",
    )
    return base.selectExpr("*", f"concat_ws('\\n', {', '.join(parts)}) as text").withColumn("document_id", F.col("k"))


def money(x, comma=False):
    return f"concat({x} div 100, '{',' if comma else '.'}', lpad(cast({x} % 100 as string), 2, '0'))"


# Per order: n items; item 2 (if any) is bought twice; totals follow. Case by key % 10:
# 3 prints a total off by 2 cents, 4 repeats item 1, 5 has a bare quantity line, 6 an unknown
# VAT code, 7 no total line, 8 an unknown month.
ROUND_V = """SELECT k, c, d, n, i, CASE WHEN i = 2 THEN 2 WHEN i = 1 AND k % 10 = 4 THEN 2 ELSE 1 END AS q,
    50 + (cents + 37 * i) % 950 AS u FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS d, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents, 1 + o_orderkey % 4 AS n,
    unnest(range(1, 2 + CAST(o_orderkey % 4 AS BIGINT))) AS i FROM orders)"""

LEC_ITEM = "concat('ARTICLE ', chr(64 + i + 1), ' ', c % 97"


def leclerc_v1_texts(t):
    return rendered(
        t,
        "concat('Caisse 001-', lpad(cast(c % 10000 as string), 4, '0'), ' ', date_format(at, 'dd'), ' ', month_name, ' ', date_format(at, 'yyyy HH:mm'))",
        "concat(date_format(at, 'dd/MM/yy'), ' 0 T', k)",
        "'>> RAYON'",
        "if(k % 10 = 5, '3 X 1.00€   3.00', '(A) Dont DEEE / DEA : 0.10')",
        f"array_join(transform(unit, (u, i) -> if(i = 1, concat({LEC_ITEM}), '\\n   2 X ', {money('u')}, '€   ', {money('(u * 2)')}), concat({LEC_ITEM}), '   ', {money('u')}))), '\\n')",
        f"if(k % 10 = 4, concat('ARTICLE A ', c % 97, '   ', {money('unit[0]')}), '')",
        f"if(k % 10 = 7, '', concat('Total ', articles + if(k % 10 = 4, 1, 0), ' articles  ', {money('(total + if(k % 10 = 4, unit[0], 0) + if(k % 10 = 3, 2, 0))')}))",
        f"concat('CB   ', {money('(total + if(k % 10 = 4, unit[0], 0))')})",
        "'REMISES'", "if(k % 3 = 0, 'Lot fidele 0.30', 'rien')", "'Total 0.30'", "'-----'",
        f"concat('Bon achat carte  ', {money('(unit[0])')})", "if(k % 2 = 0, 'CUMUL DISPONIBLE', '')",
        "'BONS DE REDUCTION'", "concat('ARTICLE A ', c % 97, ' (X1)  0.40')", "'-----'",
        "concat('Vous avez obtenu : ', 1 + k % 5, ' Vignette(s)')", "'---- VOS VIGNETTES PYREX ----'",
    )


GOOD = "k % 10 NOT IN (5, 7, 8)"


def parsed(t, texts, name, part):
    return getattr(ops.parse_format(texts.select("document_id", "text"), ops.FORMATS[name]), part)


LINE_SHOWN = ["document_id", "position", "label", "quantity", "unit_price_cents", "total_cents", "vat_rate_bp", "section_label", "kind", "tr_eligible", "unit_of_measure"]


def lines_shown(df):
    return df.select(*LINE_SHOWN).withColumn("position", F.col("position").cast("bigint"))


def expected_lines(rows, vat="CAST(NULL AS INTEGER)", section="'RAYON'", price="CASE WHEN i = 2 THEN u WHEN i = 1 AND k % 10 = 4 THEN u END", extra="", tr="false", kind="'item'", good=GOOD):
    return f"""SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY place) AS position, label, CAST(quantity AS DECIMAL(10,3)) AS quantity,
        unit_price_cents, total_cents, vat_rate_bp, section_label, kind, tr_eligible, 'piece' AS unit_of_measure FROM (
        SELECT k AS document_id, i AS place, {rows} AS label, q AS quantity, {price} AS unit_price_cents, q * u AS total_cents, {vat} AS vat_rate_bp, {section} AS section_label, {kind} AS kind, {tr} AS tr_eligible
        FROM ({ROUND_V}) WHERE {good} {extra})"""


ARTICLE = "'ARTICLE ' || chr(CAST(64 + i AS INTEGER)) || ' ' || c % 97"
DETAIL = f"""UNION ALL SELECT k, 1000, 'Lot fidele', 1, NULL, -30, NULL, NULL, 'discount', false FROM ({ROUND_V}) WHERE i = 1 AND k % 3 = 0 AND {GOOD}"""


@query("parse_leclerc_paper_v1", expected_lines(ARTICLE, extra=DETAIL))
def parse_leclerc_paper_v1(t):
    return lines_shown(parsed(t, leclerc_v1_texts(t), "leclerc.paper.v1", "lines"))


@query("leclerc_detail_sections", f"SELECT k AS document_id, 'Lot fidele' AS label, CAST(-30 AS BIGINT) AS total_cents FROM ({ROUND_V}) WHERE i = 1 AND k % 3 = 0 AND {GOOD}")
def leclerc_detail_sections(t):
    return parsed(t, leclerc_v1_texts(t), "leclerc.paper.v1", "lines").where("kind = 'discount'").select("document_id", "label", "total_cents")


@query("append_detail_discounts", f"SELECT k AS document_id, CAST(count(*) + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS line_count, CASE WHEN k % 3 = 0 THEN 'discount' ELSE 'item' END AS last_kind FROM ({ROUND_V}) WHERE {GOOD} GROUP BY k")
def append_detail_discounts(t):
    lines = parsed(t, leclerc_v1_texts(t), "leclerc.paper.v1", "lines")
    return lines.groupBy("document_id").agg(F.count("*").alias("line_count"), F.max_by("kind", "position").alias("last_kind"))


PROMOTED = f"SELECT k, u FROM ({ROUND_V}) WHERE i = 1 AND {GOOD}"


@query("leclerc_promotions", f"""SELECT k AS document_id, 'leclerc_bon_achat_carte' AS program, -u AS delta, 'Bon achat carte' AS label, 'coupon' AS kind, CAST(NULL AS BIGINT) AS linked FROM ({PROMOTED})
    UNION ALL SELECT k, 'leclerc_tickets', -u, 'CUMUL DISPONIBLE', 'coupon', NULL FROM ({PROMOTED}) WHERE k % 2 = 0
    UNION ALL SELECT k, 'leclerc_bon_immediat', -40, 'ARTICLE A ' || c % 97 || ' (X1)', 'immediate_discount', 1 FROM ({ROUND_V}) WHERE i = 1 AND {GOOD}
    UNION ALL SELECT k, 'leclerc_vignettes_pyrex', 1 + k % 5, 'PYREX', 'points_accrual', NULL FROM ({PROMOTED})""")
def leclerc_promotions(t):
    found = parsed(t, leclerc_v1_texts(t), "leclerc.paper.v1", "promotions")
    return found.select("document_id", "program", "delta", "label", "kind", F.col("linked_line_position").cast("bigint").alias("linked"))


@query("nearest_campaign", f"SELECT k AS document_id, 'PYREX' AS campaign, 1 + k % 5 AS delta FROM ({PROMOTED})")
def nearest_campaign(t):
    return parsed(t, leclerc_v1_texts(t), "leclerc.paper.v1", "promotions").where("unit = 'vignette_count'").select("document_id", F.col("label").alias("campaign"), "delta")


@query("link_promotion_to_line", f"SELECT k AS document_id, CAST(1 AS BIGINT) AS linked FROM ({PROMOTED})")
def link_promotion_to_line(t):
    return parsed(t, leclerc_v1_texts(t), "leclerc.paper.v1", "promotions").where("linking_method = 'parser_inferred'").select("document_id", F.col("linked_line_position").cast("bigint").alias("linked"))


@query("extract_header", f"""SELECT k AS document_id, CASE WHEN k % 10 <> 8 THEN d END AS purchased_at, '001-' || lpad(CAST(c % 10000 AS VARCHAR), 4, '0') AS register_number, 'T' || k AS ticket_number,
    CASE WHEN k % 10 <> 7 THEN CAST(sum(q * u) + CASE WHEN k % 10 = 3 THEN 2 ELSE 0 END AS BIGINT) END AS total_cents, CASE WHEN k % 10 <> 7 THEN CAST(sum(q) AS INTEGER) END AS declared_article_count FROM ({ROUND_V}) GROUP BY k, c, d""")
def extract_header(t):
    header = parsed(t, leclerc_v1_texts(t), "leclerc.paper.v1", "header")
    return header.select("document_id", "purchased_at", "register_number", "ticket_number", "total_cents", "declared_article_count")


@query("extract_payments", f"""SELECT k AS document_id, 'CB' AS raw_label, 'bank_card' AS category, CAST(sum(q * u) AS BIGINT) AS amount_cents FROM ({ROUND_V}) WHERE {GOOD} GROUP BY k
    UNION ALL SELECT k, 'Bon achat carte', 'other', u FROM ({PROMOTED})""")
def extract_payments(t):
    return parsed(t, leclerc_v1_texts(t), "leclerc.paper.v1", "payments").drop("position")


@query("extract_promotions", f"SELECT k AS document_id, CAST(3 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS promotion_count, CAST(1 AS BIGINT) AS inferred_count FROM ({PROMOTED})")
def extract_promotions(t):
    found = parsed(t, leclerc_v1_texts(t), "leclerc.paper.v1", "promotions")
    return found.groupBy("document_id").agg(F.count("*").alias("promotion_count"), F.count_if(F.col("linking_method") == "parser_inferred").alias("inferred_count"))


@query("parse_failure_rows", """SELECT o_orderkey AS document_id, 'Parser failed: ' || CASE o_orderkey % 10 WHEN 5 THEN 'quantity line without a label' WHEN 7 THEN 'no receipt total' ELSE 'unreadable purchase date' END AS detail FROM orders WHERE o_orderkey % 10 IN (5, 7, 8)""")
def parse_failure_rows(t):
    receipts = parsed(t, leclerc_v1_texts(t), "leclerc.paper.v1", "receipts")
    return receipts.select("document_id", F.inline("parser_warnings")).where("code = 'parser_exception'").select("document_id", "detail")


def leclerc_v2_texts(t):
    code = "if(k % 10 = 6, 9, 1 + i % 2)"
    return rendered(
        t,
        "concat('Caisse 001-1 ', date_format(at, 'dd'), ' ', month_name, ' ', date_format(at, 'yyyy HH:mm'))", "'TTC   TVA'",
        "if(k % 10 = 5, '3 X 1.00€   3.00 1', '')",
        f"array_join(transform(unit, (u, i) -> if(i = 1, concat({LEC_ITEM}), ' ..\\n   2 X ', {money('u')}, '€   ', {money('(u * 2)')}, ' ', {code}), concat({LEC_ITEM}), '   ', {money('u')}, ' ', {code}))), '\\n')",
        f"if(k % 10 = 4, concat('ARTICLE A ', c % 97, '   ', {money('unit[0]')}, ' 1'), '')",
        f"if(k % 10 = 7, '', concat('Total ', articles, ' articles  ', {money('total')}))", f"concat('CB   ', {money('total')})",
        "'1 9%99 1.00 0.10 1.10'", "'1 5%50 1.00 0.10 1.10'", "'2 20%00 1.00 0.10 1.10'",
    )


V2_VAT = "CASE WHEN k % 10 = 6 THEN CAST(NULL AS INTEGER) WHEN i % 2 = 1 THEN 550 ELSE 2000 END"


@query("parse_leclerc_paper_v2", expected_lines(ARTICLE, vat=V2_VAT, section="CAST(NULL AS VARCHAR)"))
def parse_leclerc_paper_v2(t):
    return lines_shown(parsed(t, leclerc_v2_texts(t), "leclerc.paper.v2", "lines"))


@query("vat_code_lookup", f"SELECT k AS document_id, CAST(count(*) AS BIGINT) AS missing FROM ({ROUND_V}) WHERE k % 10 = 6 GROUP BY k")
def vat_code_lookup(t):
    receipts = parsed(t, leclerc_v2_texts(t), "leclerc.paper.v2", "receipts")
    missing = receipts.select("document_id", F.inline("parser_warnings")).where("code = 'missing_vat_code'")
    return missing.groupBy("document_id").agg(F.count("*").alias("missing"))


WEB_GOOD = "k % 10 NOT IN (7, 8)"


@query("parse_leclerc_web_v1", f"""SELECT k AS document_id, i AS position, {ARTICLE} AS label, CAST(q AS DECIMAL(10,3)) AS quantity, CASE WHEN q > 1 AND i = 1 THEN u END AS unit_price_cents, q * u AS total_cents,
    CAST(NULL AS INTEGER) AS vat_rate_bp, CAST(NULL AS VARCHAR) AS section_label, 'item' AS kind, false AS tr_eligible, 'piece' AS unit_of_measure FROM ({ROUND_V}) WHERE {WEB_GOOD}
    UNION ALL SELECT k, n + 1, 'FRAIS DE LIVRAISON ' || k % 7, CAST(1 AS DECIMAL(10,3)), NULL, 300, 550, NULL, 'fee', false, 'piece' FROM ({ROUND_V}) WHERE i = 1 AND {WEB_GOOD}""")
def parse_leclerc_web_v1(t):
    texts = rendered(
        t, "concat('Caisse Drive 7-79 - ', day(at), ' ', month_name, ' ', year(at))",
        f"array_join(transform(unit, (u, i) -> if(i = 1, concat('2 X ', {LEC_ITEM}), '  ', {money('(u * 2)')}), concat({LEC_ITEM}), '  ', {money('u')}))), '\\n')",
        f"if(k % 10 = 4, concat('ARTICLE A ', c % 97, '  ', {money('unit[0]')}), '')",
        "concat('FRAIS DE LIVRAISON ', k % 7, '   3.00')", "if(k % 10 = 7, 'CB Web Drive', 'Total 2 articles  9.99')", "'APRES   5.00'",
    )
    return lines_shown(parsed(t, texts, "leclerc.web.v1", "lines"))


def auchan_texts(t):
    return rendered(
        t, "concat('Le ', date_format(at, 'dd'), ' ', month_name, ' ', date_format(at, 'yyyy'), ' à ', date_format(at, 'HH:mm:ss'))",
        "concat('Caisse : ', c, ' Ticket : ', k)", "'AVANT 9,99'", "'Hôte(sse) : 77'", "if(k % 2 = 0, '=== Début Selfscan ===', '')",
        f"array_join(transform(unit, (u, i) -> concat(if(i % 2 = 0, '*', ''), {LEC_ITEM}), if(i = 1, concat(' 2*', {money('u', True)}), ''), ' ', {money('if(i = 1, u * 2, u)', True)})), '\\n')",
        "if(k % 2 = 0, 'Fin Selfscan', '')", "'+ ANNULATION 1,00'", "'(note)'", "'Articles avec Remise'", "'REMISE TEST 2*1,00 0,50'", "'LOT -0,25'", "'TOTAL REMISES -0,25'",
        f"if(k % 10 = 7, 'Total', concat('Total ', {money('(total + 175)', True)}, ' €'))", f"concat('Reçu CARTE BANCAIRE ', {money('(total + 175)', True)})",
        "'VOTRE COMPTE WAAOH'", "'ARTICLE A 0,40'", "if(k % 3 = 0, 'Débit du jour : 1,50 €', 'Votre solde : 9,00 €')",
        "if(k % 5 = 0, 'Lecture partielle incorrecte', if(k % 5 = 1, 'Nouveau scan valide', 'Merci'))", "'APRES 0,10'",
    )


AUCHAN_GOOD = "k % 10 NOT IN (7, 8)"
AUCHAN_Q = "CASE WHEN i = 2 THEN 2 ELSE 1 END"


@query("parse_auchan_paper_v1", f"""SELECT k AS document_id, i AS position, {ARTICLE} AS label, CAST({AUCHAN_Q} AS DECIMAL(10,3)) AS quantity, CASE WHEN i = 2 THEN u END AS unit_price_cents, {AUCHAN_Q} * u AS total_cents,
    CAST(NULL AS INTEGER) AS vat_rate_bp, CASE WHEN k % 2 = 0 THEN 'Selfscan' END AS section_label, 'item' AS kind, i % 2 = 1 AS tr_eligible, 'piece' AS unit_of_measure FROM ({ROUND_V}) WHERE {AUCHAN_GOOD}
    UNION ALL SELECT k, n + 1, 'REMISE TEST', CAST(2 AS DECIMAL(10,3)), 100, 200, NULL, 'Articles avec Remise', 'item', false, 'piece' FROM ({ROUND_V}) WHERE i = 1 AND {AUCHAN_GOOD}
    UNION ALL SELECT k, n + 2, 'LOT', CAST(1 AS DECIMAL(10,3)), NULL, -25, NULL, 'Articles avec Remise', 'discount', false, 'piece' FROM ({ROUND_V}) WHERE i = 1 AND {AUCHAN_GOOD}""")
def parse_auchan_paper_v1(t):
    return lines_shown(parsed(t, auchan_texts(t), "auchan.paper.v1", "lines"))


@query("auchan_loyalty", f"""SELECT k AS document_id, 'ARTICLE A' AS label, CAST(40 AS BIGINT) AS delta, 'loyalty_cash_credit' AS kind, 'parser_inferred' AS linking_method FROM ({ROUND_V}) WHERE i = 1 AND {AUCHAN_GOOD}
    UNION ALL SELECT k, 'Débit du jour', -150, 'loyalty_cash_debit', 'unallocated' FROM ({ROUND_V}) WHERE i = 1 AND k % 3 = 0 AND {AUCHAN_GOOD}""")
def auchan_loyalty(t):
    return parsed(t, auchan_texts(t), "auchan.paper.v1", "promotions").select("document_id", "label", "delta", "kind", "linking_method")


@query("auchan_scan_warnings", f"""SELECT k AS document_id, CASE WHEN k % 5 = 0 THEN 'Lecture partielle incorrecte' WHEN k % 5 = 1 THEN 'Nouveau scan valide' END AS warning,
    CASE WHEN k % 5 = 0 THEN 'needs_review' ELSE 'parsed' END AS parser_status FROM ({ROUND_V}) WHERE i = 1 AND {AUCHAN_GOOD}""")
def auchan_scan_warnings(t):
    receipts = parsed(t, auchan_texts(t), "auchan.paper.v1", "receipts").where("total_cents is not null")
    scan = F.get(F.filter("parser_warnings", lambda w: w["code"] == "auchan_selfscan_warning"), 0)
    return receipts.select("document_id", scan["detail"].alias("warning"), "parser_status")


# A weighed article, from the order's own columns.
WEIGHED_GRAMS, WEIGHED_PRICE = "(500 + c % 900)", "(100 + k % 300)"
WEIGHED_CENTS = f"({WEIGHED_GRAMS} * {WEIGHED_PRICE} div 1000)"


def u_v1_texts(t):
    code = "if(k % 10 = 6, 9, 11 + i % 2)"
    return rendered(
        t, "concat(c % 500, '  C', c % 7, '  ', date_format(at, 'dd/MM/yy  HH:mm'), '  ', 1 + c % 9, '  ', k)", "'>>>> RAYON'", "if(k % 10 = 5, '2 x 1,00 €  2,00 €  11', '')",
        f"array_join(transform(unit, (u, i) -> if(i = 1, concat({LEC_ITEM}), 'Z\\n2 x  ', {money('u', True)}, ' €  ', {money('(u * 2)', True)}, ' €  ', {code}), concat({LEC_ITEM}), 'Z  ', {money('u', True)}, ' €  ', {code}))), '\\n')",
        "concat('VRAC ', c % 97, '  11')", f"concat(replace(cast(cast(({WEIGHED_GRAMS}) / 1000 as decimal(6,3)) as string), '.', ','), ' kg x  ', {money(WEIGHED_PRICE, True)}, ' €/kg  ', {money(WEIGHED_CENTS, True)}, ' €')", "'====='",
        f"if(k % 10 = 7, '', concat('TOTAL  ', articles + 1, ' Article(s)  ', {money(f'(total + {WEIGHED_CENTS})', True)}, ' €'))", f"concat('CB SANS CONTACT  EUR  ', {money(f'(total + {WEIGHED_CENTS})', True)}, ' €')",
        "'11 /  5,50  1,00 €  1,00 €  1,00 €'", "'12  20,00  1,00 €  1,00 €  1,00 €'", "concat(1 + k % 5, ' vignette(s) JBL offerte(s)')", "concat('Carte U solde avant ticket  ', 1 + c % 50, ',00 €')",
        "concat('Carte U solde après ticket  ', c % 50 + k % 3, ',00 €')",
    )


U_VAT = "CASE WHEN k % 10 = 6 THEN CAST(NULL AS INTEGER) WHEN i % 2 = 1 THEN 550 ELSE 2000 END"
U_GOOD = "k % 10 NOT IN (5, 7)"
U_Q = "CASE WHEN i = 2 THEN 2 ELSE 1 END"


def u_lines(extra="", tr="false", section="'RAYON'"):
    return f"""SELECT k AS document_id, i AS position, {ARTICLE} || 'Z' AS label, CAST({U_Q} AS DECIMAL(10,3)) AS quantity, {{price}} AS unit_price_cents, {U_Q} * u AS total_cents, {U_VAT} AS vat_rate_bp,
        {section} AS section_label, 'item' AS kind, {tr} AS tr_eligible, 'piece' AS unit_of_measure FROM ({ROUND_V}) WHERE {U_GOOD} {extra}"""


@query("parse_u_paper_v1", u_lines(f"UNION ALL SELECT k, n + 1, 'VRAC ' || c % 97, CAST((500 + c % 900) / 1000.0 AS DECIMAL(10,3)), 100 + k % 300, (500 + c % 900) * (100 + k % 300) // 1000, 550, 'RAYON', 'item', false, 'kg' FROM ({ROUND_V}) WHERE i = 1 AND {U_GOOD}").format(price="CASE WHEN i = 2 THEN u END"))
def parse_u_paper_v1(t):
    return lines_shown(parsed(t, u_v1_texts(t), "u.paper.v1", "lines"))


@query("u_promotions", f"""SELECT k AS document_id, 'u_vignettes_jbl' AS program, 1 + k % 5 AS delta, 'points_accrual' AS kind FROM ({ROUND_V}) WHERE i = 1 AND {U_GOOD}
    UNION ALL SELECT k, 'u_carte_u', (k % 3 - 1) * 100, CASE WHEN k % 3 = 2 THEN 'loyalty_cash_credit' ELSE 'loyalty_cash_debit' END FROM ({ROUND_V}) WHERE i = 1 AND k % 3 <> 1 AND {U_GOOD}""")
def u_promotions(t):
    return parsed(t, u_v1_texts(t), "u.paper.v1", "promotions").select("document_id", "program", "delta", "kind")


@query("parse_u_paper_v2", u_lines(tr="i % 2 = 1").format(price="u"))
def parse_u_paper_v2(t):
    return lines_shown(parsed(t, u_v2_texts(t), "u.paper.v2", "lines"))


def u_v2_texts(t):
    code = "if(k % 10 = 6, 9, 11 + i % 2)"
    return rendered(
        t, "'*** VENTE ***'", "'RAYON'", "if(k % 10 = 5, '2 x 1,00 EUR', 'JAMAIS SUIVI  9,99 €  11')",
        f"array_join(transform(unit, (u, i) -> concat({LEC_ITEM}), 'Z  ', if(i % 2 = 0, '(T)  ', ''), {money('if(i = 1, u * 2, u)', True)}, ' €  ', {code}, '\\n', if(i = 1, 2, 1), ' x  ', {money('u', True)}, ' EUR')), '\\n')",
        "concat('Nombre de lignes d', chr(39), 'article 3')", f"if(k % 10 = 7, '', concat('TOTAL [', articles, '] Articles  ', {money('total', True)}, ' €'))",
        f"concat('CB TRD  ', {money('total', True)}, ' €')", "'11  5,50  1,00 €  1,00 €  1,00 €'", "'12  20,00  1,00 €  1,00 €  1,00 €'",
        "concat(date_format(at, 'dd/MM/yy HH:mm:ss'), ' ', 20000 + c % 999, '  ', 1 + c % 9, '  ', 300 + c % 41, '  ', k)",
    )


# Per layout: texts, format, documents that parse, extra cents and articles, register, ticket, cashier, declared count, payment label and category.
WEIGHED_SQL = "(500 + c % 900) * (100 + k % 300) // 1000"
PRINTED = {
    "leclerc_paper_v2": (leclerc_v2_texts, "leclerc.paper.v2", GOOD, "0", "'001-1'", "NULL", "NULL", "sum(twice)", "CB", "bank_card"),
    "auchan_paper_v1": (auchan_texts, "auchan.paper.v1", AUCHAN_GOOD, "175", "c", "k", "77", "NULL", "CARTE BANCAIRE", "bank_card"),
    "u_paper_v1": (u_v1_texts, "u.paper.v1", U_GOOD, WEIGHED_SQL, "1 + c % 9", "k", "c % 500 || '  C' || c % 7", "sum(twice) + 1", "CB SANS CONTACT", "bank_card"),
    "u_paper_v2": (u_v2_texts, "u.paper.v2", U_GOOD, "0", "1 + c % 9", "k", "300 + c % 41", "sum(twice)", "CB TRD", "tickets_restaurant"),
}
TWICE = f"(SELECT *, CASE WHEN i = 2 THEN 2 ELSE 1 END AS twice FROM ({ROUND_V}))"


def _printed(name, texts, layout, good, extra, register, ticket, cashier, declared, label, category):
    header_sql = f"""SELECT k AS document_id, CAST({register} AS VARCHAR) AS register_number, CAST({ticket} AS VARCHAR) AS ticket_number, CAST({cashier} AS VARCHAR) AS cashier_code,
        CASE WHEN k % 10 <> 7 THEN CAST(sum(twice * u) + {extra} AS BIGINT) END AS total_cents, CASE WHEN k % 10 <> 7 THEN CAST({declared} AS INTEGER) END AS declared_article_count FROM {TWICE} GROUP BY k, c"""

    @query(f"extract_header_{name}", header_sql)
    def header(t):
        fields = ["register_number", "ticket_number", "cashier_code", "total_cents", "declared_article_count"]
        return parsed(t, texts(t), layout, "header").select("document_id", *fields)

    @query(f"extract_payments_{name}", f"SELECT k AS document_id, '{label}' AS raw_label, '{category}' AS category, CAST(sum(twice * u) + {extra} AS BIGINT) AS amount_cents FROM {TWICE} WHERE {good} GROUP BY k, c")
    def payments(t):
        return parsed(t, texts(t), layout, "payments").drop("position")


for _name, _layout in PRINTED.items():
    _printed(_name, *_layout)
