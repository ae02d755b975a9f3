"""Structured review warnings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketlake.functions import fixed_values as fixed

WARNING_TYPE = "struct<code:string,validator:string,detail:string,value:decimal(18,3)>"


def build_warning(code: str, detail: Column, validator: str | None = None, value: Column | None = None) -> Column:
    return F.struct(
        F.lit(code).alias("code"),
        F.lit(validator).cast("string").alias("validator"),
        detail.alias("detail"),
        (F.lit(None) if value is None else value).cast("decimal(18,3)").alias("value"),
    )


def _cents_word(discrepancy: Column) -> Column:
    return F.when(F.abs(discrepancy) == 1, F.lit("cent")).otherwise(F.lit("cents"))


def validator_warning(validator: str, discrepancy: Column) -> Column:
    number = discrepancy.cast("bigint")
    if validator == "validate_article_count":
        detail = F.format_string(fixed.ARTICLES_TEXT, number)
    else:
        text = fixed.TOTALS_TEXT if validator == "validate_totals_sum" else fixed.PAYMENTS_TEXT
        detail = F.format_string(text, number, _cents_word(number))
    return build_warning(fixed.VALIDATOR_WARNINGS[validator], detail, validator, number)


def merge_warnings(existing: Column, current: Column) -> Column:
    """Keep warnings that no validator raised, then append the current validator warnings."""
    return F.concat(
        F.filter(existing, lambda w: w["validator"].isNull() | ~w["validator"].isin(fixed.VALIDATORS)), current
    )


def replace_duplicate_warning(existing: Column, current: Column) -> Column:
    return F.concat(F.filter(existing, lambda w: w["code"] != "suspected_duplicate"), current)
