"""Amounts, prices, payment and promotion classes. Cents are integers throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUANTITY = "decimal(10,3)"


def cents_from(amount: Column) -> Column:
    """Signed "euros[,.]cents" text to cents; the sign comes from the text so "-0,50" is negative."""
    euros = F.regexp_extract(amount, "\\A-?(\\d+)", 1).try_cast("bigint")
    cents = F.regexp_extract(amount, "\\A[^,.]*[,.](\\d+)", 1).try_cast("bigint")
    value = F.coalesce(euros, F.lit(0)) * 100 + F.coalesce(cents, F.lit(0))
    return F.when(amount.isNotNull(), F.when(amount.startswith("-"), -value).otherwise(value))


def decimal_from(value: Column) -> Column:
    return F.replace(value, F.lit(","), F.lit(".")).try_cast(QUANTITY)


# Payment label patterns in order of precedence.
PAYMENT_RULES = [
    ("(?iu)\\ACB Web(?![\\p{L}\\p{N}_])", "web"),
    ("(?iu)\\ACB\\s*\\(T\\s*restau\\)", "tickets_restaurant"),
    ("(?iu)\\ACB TRD(?![\\p{L}\\p{N}_])", "tickets_restaurant"),
    ("(?iu)\\A(?:CB|CARTE BANCAIRE)(?![\\p{L}\\p{N}_])", "bank_card"),
    ("(?iu)\\A(?:ESPECES|ESP[EÈ]CES)(?![\\p{L}\\p{N}_])", "cash"),
]

# Loyalty campaign keywords and their program codes.
LECLERC_PROGRAMS = [
    ("SMEG", "leclerc_vignettes_smeg"),
    ("ROYAL|VKB", "leclerc_vignettes_royal_vkb"),
    ("MONBENTO", "leclerc_vignettes_monbento"),
    ("PYREX", "leclerc_vignettes_pyrex"),
]
U_PROGRAMS = [("\\AJBL\\z", "u_vignettes_jbl")]


def first_rule(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    cases = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, value in rules:
        cases = cases.when(text.rlike(pattern), F.lit(value))
    return cases.otherwise(F.lit(default))


def payment_category(raw_label: Column) -> Column:
    return first_rule(raw_label, PAYMENT_RULES, "other")


def vignette_program(campaign: Column, rules: list[tuple[str, str]], default: str) -> Column:
    return first_rule(F.coalesce(campaign, F.lit("")), [("(?iu)" + p, v) for p, v in rules], default)


def vat_rate_bp(whole: Column, hundredths: Column) -> Column:
    return whole.cast("int") * 100 + hundredths.cast("int")


def pack_unit_price(total_cents: Column, quantity: Column) -> Column:
    exact = F.try_divide(total_cents.cast("decimal(18,0)"), quantity.cast(QUANTITY))
    return F.round(exact, 0).cast("bigint")


def comparison_unit_price(total_cents: Column, quantity: Column, package_count: Column, quantity_value: Column, unit_id: Column) -> Column:
    compared = (
        quantity.cast(QUANTITY)
        * F.coalesce(package_count, F.lit(1)).cast("decimal(6,0)")
        * quantity_value.cast(QUANTITY)
    ).cast("decimal(20,6)")
    exact = F.try_divide(total_cents.cast("decimal(16,0)"), compared)
    return F.when(unit_id.isNotNull() & quantity_value.isNotNull(), F.round(exact, 0).cast("bigint"))


def discounted_line_total(quantity: Column, unit_price_cents: Column, total_cents: Column, in_discounts: Column) -> Column:
    recomputed = F.round(quantity.cast(QUANTITY) * unit_price_cents.cast("decimal(12,0)"), 0).cast("bigint")
    return F.when(in_discounts & unit_price_cents.isNotNull(), recomputed).otherwise(total_cents)


def promotion_delta(event: Column, amount: Column) -> Column:
    """Sign by event: debits, consumption and coupons take away, the rest adds."""
    return F.when(event.isin("debit", "consumption", "coupon", "immediate_discount"), -F.abs(amount)).otherwise(amount)


def balance_delta(before: Column, after: Column) -> Column:
    """Card balance movement; null when either side is missing or nothing moved."""
    return F.nullif(after - before, F.lit(0))


def recode(value: Column, renames: dict[str, str]) -> Column:
    cases = F.when(F.lit(False), value)
    for old, new in renames.items():
        cases = cases.when(value == old, F.lit(new))
    return cases.otherwise(value)
