"""Queries that apply one column function to whole tables."""

from pyspark.sql import functions as F

from ticketlake.functions import dates, money, text, warnings
from ticketlake.functions.fixed_values import MONTHS
from ticketlake.plans.inputs import cents
from ticketlake.plans.registry import query
from ticketlake.plans.views import cents as sql_cents
from ticketlake.plans.views import norm, norm_marks


def docs(t):
    return t.table("documents").select("doc_id", "text")


@query("normalize_text", f"SELECT doc_id, {norm('text')} AS normal FROM documents")
def normalize_text(t):
    return docs(t).select("doc_id", text.normalize_text(F.col("text")).alias("normal"))


@query("normalize_detection_text", f"SELECT doc_id, {norm_marks('text')} AS normal FROM documents")
def normalize_detection_text(t):
    return docs(t).select("doc_id", text.normalize_detection_text(F.col("text")).alias("normal"))


@query("normalize_backfill", f"SELECT doc_id, {norm('text')} AS normal FROM documents")
def normalize_backfill(t):
    return docs(t).select("doc_id", text.normalize_backfill(F.col("text")).alias("normal"))


@query("slugify", "SELECT doc_id, regexp_replace(regexp_replace(replace(lower(strip_accents(text)), 'ß', 'ss'), '[^a-z0-9_]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM documents")
def slugify(t):
    return docs(t).select("doc_id", text.slugify(F.col("text")).alias("slug"))


@query("derive_identity", f"SELECT DISTINCT p_brand || ' ' || p_type AS name, {norm(chr(112) + '_brand || chr(32) || p_type')} AS normalized_name, replace(replace(lower(p_brand || ' ' || p_type), '#', '-'), ' ', '-') AS slug FROM part")
def derive_identity(t):
    from ticketlake.operators.catalogue import derive_identity as derive

    return derive(t.table("part").selectExpr("concat(p_brand, ' ', p_type) as name").distinct())


PRINTED = "CASE p_partkey % 4 WHEN 0 THEN '* ' || p_name || ' ..' WHEN 1 THEN p_name || '..' WHEN 2 THEN '  ' || p_name || '  x ' ELSE p_name || ' . .' END"


def printed(t):
    return t.table("part").selectExpr("p_partkey", "p_name", f"{PRINTED} as printed")


@query("clean_label", f"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '* ' || p_name WHEN 1 THEN p_name WHEN 2 THEN p_name || '  x' ELSE p_name || ' . .' END AS label,
    CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN p_name || '  x' ELSE p_name || ' . .' END AS unstarred, p_partkey % 4 < 2 AS truncated FROM part""")
def clean_label(t):
    label = F.col("printed")
    return printed(t).select(
        "p_partkey", text.clean_label(label).alias("label"),
        text.clean_label(text.unstarred_label(label)).alias("unstarred"), text.label_truncated(label).alias("truncated"),
    )


@query("comparable_label", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '* ' || upper(p_name) WHEN 1 THEN upper(p_name) WHEN 2 THEN upper(p_name) || ' X' ELSE upper(p_name) || ' . .' END AS label FROM part")
def comparable_label(t):
    return printed(t).select("p_partkey", text.comparable_label(F.col("printed")).alias("label"))


AMOUNT = f"{sql_cents('c_acctbal')} - 500000"


@query("cents_from", f"SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN {AMOUNT} END AS amount FROM customer")
def cents_from(t):
    signed = t.table("customer").selectExpr("c_custkey", f"{cents('c_acctbal')} - 500000 as v").selectExpr(
        "c_custkey",
        "case when c_custkey % 7 <> 0 then concat(if(v < 0, '-', ''), abs(v) div 100, if(c_custkey % 2 = 0, ',', '.'), lpad(cast(abs(v) % 100 as string), 2, '0')) end as printed",
    )
    return signed.select("c_custkey", money.cents_from(F.col("printed")).alias("amount"))


@query("decimal_from", "SELECT p_partkey, CAST(p_retailprice AS DECIMAL(10,3)) AS quantity FROM part")
def decimal_from(t):
    shown = t.table("part").selectExpr("p_partkey", "replace(cast(cast(p_retailprice as decimal(10,3)) as string), '.', ',') as printed")
    return shown.select("p_partkey", money.decimal_from(F.col("printed")).alias("quantity"))


@query("french_month", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(month(o_orderdate) AS INTEGER) END AS month FROM orders")
def french_month(t):
    by_number = {}
    for name, number in MONTHS.items():
        by_number.setdefault(number, []).append(name)
    spelled = F.array(*[F.lit(by_number[n][0].upper()) for n in range(1, 13)])
    short = F.array(*[F.lit(by_number[n][-1] + ".") for n in range(1, 13)])
    month = F.month("o_orderdate")
    name = F.when(F.col("o_orderkey") % 9 == 0, F.lit("brumaire")).when(F.col("o_orderkey") % 2 == 0, F.element_at(spelled, month)).otherwise(F.element_at(short, month))
    return t.table("orders").select("o_orderkey", dates.french_month(name).alias("month"))


@query("payment_category", """SELECT o_orderkey, ['web', 'tickets_restaurant', 'tickets_restaurant', 'bank_card', 'cash', 'other'][CAST(o_orderkey % 6 + 1 AS INTEGER)] AS category FROM orders""")
def payment_category(t):
    labels = F.array(*[F.lit(x) for x in ("CB Web Drive", "cb (T restau)", "CB TRD SANS", "Carte bancaire", "espèces", "CBX")])
    label = F.concat(F.element_at(labels, (F.col("o_orderkey") % 6 + 1).cast("int")), F.lit(" "), F.col("o_orderpriority"))
    return t.table("orders").select("o_orderkey", money.payment_category(label).alias("category"))


@query("purchase_timestamp", """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN CAST(date_trunc('day', o_orderdate) AS TIMESTAMP)
    ELSE o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) + to_minutes(o_orderkey % 60) END AS at FROM orders""")
def purchase_timestamp(t):
    parts = t.table("orders").selectExpr(
        "o_orderkey", "case when year(o_orderdate) >= 2000 then year(o_orderdate) - 2000 else year(o_orderdate) end as y", "month(o_orderdate) as m",
        "case when o_orderkey % 10 = 0 then 32 else day(o_orderdate) end as d",
        "case when o_orderkey % 10 = 1 then 0 else cast(o_orderkey % 24 as int) end as h",
        "case when o_orderkey % 10 = 1 then 0 else cast(o_orderkey % 60 as int) end as mi", "0 as s",
    )
    return parts.select("o_orderkey", dates.purchase_timestamp(*[F.col(c) for c in ("y", "m", "d", "h", "mi", "s")]).alias("at"))


@query("parse_entered_timestamp", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN NULL WHEN 3 THEN CAST(o_orderdate AS TIMESTAMP)
    ELSE o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) END AS at FROM orders""")
def parse_entered_timestamp(t):
    moment = "cast(o_orderdate as timestamp_ntz) + make_dt_interval(0, cast(o_orderkey % 24 as int))"
    entered = t.table("orders").selectExpr(
        "o_orderkey",
        f"""case o_orderkey % 4 when 0 then date_format({moment}, "yyyy-MM-dd'T'HH:mm") when 1 then date_format({moment}, 'd/M/yyyy H:mm')
            when 2 then '32/1/2024 10:00' else date_format(o_orderdate, 'yyyy-MM-dd') end as entered""",
    )
    return entered.select("o_orderkey", dates.parse_entered_timestamp(F.col("entered")).alias("at"))


@query("pack_unit_price", "SELECT line_id, CAST(round(CAST(total_cents AS DECIMAL(18,0)) / quantity) AS BIGINT) AS price FROM lines_v")
def pack_unit_price(t):
    return t.lines.select("line_id", money.pack_unit_price(F.col("total_cents"), F.col("quantity")).alias("price"))


@query("comparison_unit_price", """SELECT line_id, CASE WHEN comparison_unit_id IS NOT NULL AND quantity_value IS NOT NULL THEN
    CAST(floor(CAST(total_cents AS HUGEINT) * 2 * 1000000 / (2 * CAST(quantity * 1000 AS HUGEINT) * coalesce(package_count, 1) * CAST(quantity_value * 1000 AS HUGEINT)) + 0.5) AS BIGINT) END AS price
    FROM lines_v JOIN variants_v ON part_id = record_id""")
def comparison_unit_price(t):
    joined = t.lines.join(t.variants.drop("name"), F.col("part_id") == F.col("record_id"))
    columns = [F.col(c) for c in ("total_cents", "quantity", "package_count", "quantity_value", "comparison_unit_id")]
    return joined.select("line_id", money.comparison_unit_price(*columns).alias("price"))


@query("discounted_line_total", """SELECT line_id, CASE WHEN kind = 'discount' AND unit_price_cents IS NOT NULL THEN CAST(round(quantity * unit_price_cents) AS BIGINT) ELSE total_cents END AS total FROM lines_v""")
def discounted_line_total(t):
    total = money.discounted_line_total(F.col("quantity"), F.col("unit_price_cents"), F.col("total_cents"), F.col("kind") == "discount")
    return t.lines.select("line_id", total.alias("total"))


@query("build_warning", """SELECT receipt_id, 'totals_sum_mismatch' AS code, 'validate_totals_sum' AS validator,
    'Line totals differ from receipt total by ' || gap || CASE WHEN abs(gap) = 1 THEN ' cent' ELSE ' cents' END AS detail, CAST(gap AS DECIMAL(18,3)) AS value
    FROM (SELECT receipt_id, total_cents % 7 - 3 AS gap FROM receipts_v)""")
def build_warning(t):
    gap = t.receipts.select("receipt_id", (F.col("total_cents") % 7 - 3).alias("gap"))
    return gap.select("receipt_id", F.inline(F.array(warnings.validator_warning("validate_totals_sum", F.col("gap")))))


@query("contains_whole_words", f"""SELECT doc_id, item_id FROM (SELECT doc_id, ' ' || {norm_marks('text')} || ' ' AS body, lang FROM documents)
    JOIN (SELECT item_id, ' ' || {norm_marks("regexp_extract(text, '^[^.,]*')")} || ' ' AS wanted FROM benchmark) ON contains(body, wanted) AND length(trim(wanted)) >= 3""")
def contains_whole_words(t):
    from ticketlake.operators.classify import hint_hits

    phrases = t.table("benchmark").selectExpr("item_id", "regexp_extract(text, '^[^.,]*', 0) as value").select(
        "item_id", text.normalize_detection_text(F.col("value")).alias("normalized_value")
    ).where("length(normalized_value) >= 3")
    bodies = t.table("documents").select(F.col("doc_id").alias("document_id"), "text")
    hits = hint_hits(bodies, phrases).join(phrases, "normalized_value")
    # The gram join finds the pairs; the predicate itself is applied to the joined rows.
    checked = hits.join(bodies, "document_id").where(
        text.contains_whole_words(text.normalize_detection_text(F.col("text")), F.col("normalized_value"))
    )
    return checked.select(F.col("document_id").alias("doc_id"), "item_id")


@query("promotion_delta", f"""SELECT event_id, CASE event_type WHEN 'view' THEN -amount WHEN 'error' THEN -amount ELSE amount END AS delta,
    CASE WHEN amount <> amount % 1000 THEN amount % 1000 - amount END AS moved FROM (SELECT event_id, event_type, {sql_cents('value')} AS amount FROM events)""")
def promotion_delta(t):
    kinds = F.create_map(*[F.lit(x) for x in ("view", "debit", "error", "coupon", "click", "credit", "signup", "accrual", "purchase", "credit")])
    amounts = t.table("events").selectExpr("event_id", "event_type", f"{cents('value')} as amount")
    return amounts.select(
        "event_id", money.promotion_delta(kinds[F.col("event_type")], F.col("amount")).alias("delta"),
        money.balance_delta(F.col("amount"), F.col("amount") % 1000).alias("moved"),
    )


@query("vignette_program", """SELECT p_partkey, ['leclerc_vignettes_smeg', 'leclerc_vignettes_royal_vkb', 'leclerc_vignettes', 'leclerc_vignettes_pyrex'][CAST(p_partkey % 4 + 1 AS INTEGER)] AS program,
    CASE WHEN p_partkey % 4 = 2 THEN 'u_vignettes_jbl' ELSE 'u_vignettes' END AS u_program FROM part""")
def vignette_program(t):
    campaigns = F.array(F.lit("Four Smeg "), F.lit("couteaux vkb "), F.lit("jbl"), F.lit("PYREX "))
    name = F.concat(F.element_at(campaigns, (F.col("p_partkey") % 4 + 1).cast("int")), F.when(F.col("p_partkey") % 4 == 2, F.lit("")).otherwise(F.col("p_name")))
    return t.table("part").select(
        "p_partkey", money.vignette_program(name, money.LECLERC_PROGRAMS, "leclerc_vignettes").alias("program"),
        money.vignette_program(name, money.U_PROGRAMS, "u_vignettes").alias("u_program"),
    )


@query("vat_rate_bp", "SELECT p_partkey, p_size * 100 + CAST(p_partkey % 100 AS INTEGER) AS rate FROM part")
def vat_rate_bp(t):
    shown = t.table("part").selectExpr("p_partkey", "concat(p_size, '%', lpad(cast(p_partkey % 100 as string), 2, '0')) as printed")
    pattern = r"(\d+)%(\d{2})"
    rate = money.vat_rate_bp(F.regexp_extract("printed", pattern, 1), F.regexp_extract("printed", pattern, 2))
    return shown.select("p_partkey", rate.alias("rate"))


@query("recode_enum_values", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'loyalty_cash_credit' ELSE event_type END AS kind FROM events")
def recode_enum_values(t):
    stored = t.table("events").selectExpr("event_id", "if(event_type = 'purchase', 'loyalty_credit', event_type) as kind")
    return stored.select("event_id", money.recode(F.col("kind"), {"loyalty_credit": "loyalty_cash_credit"}).alias("kind"))
