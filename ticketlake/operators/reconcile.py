"""Reconciliation of receipts with their lines and payments; duplicates; replacement."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlake.functions import text, warnings
from ticketlake.functions import fixed_values as fixed
from ticketlake.operators.ordering import running_max_before

REPEAT_KEY = [
    "raw_text",
    "label",
    "label_truncated",
    "quantity",
    "unit_of_measure",
    "unit_price_cents",
    "vat_rate_bp",
    "tr_eligible",
    "kind",
]


def _mergeable() -> Column:
    allowed = (
        (F.col("kind") == "item")
        & (F.col("unit_of_measure") == "piece")
        & ~text.is_blank(F.col("raw_text"))
        & ~text.is_blank(F.col("label"))
        & F.col("quantity").isNotNull()
        & F.col("total_cents").isNotNull()
    )
    return F.coalesce(allowed, F.lit(False))


def _reconciled() -> Column:
    exact = (F.col("quantity") != 0) & (F.col("unit_price_cents") * F.col("quantity") == F.col("total_cents"))
    return F.coalesce(exact, F.lit(False))


def _inferred_price(count: Column, quantity: Column, total: Column) -> Column:
    """Unit price of a merged line without one, when the total divides evenly."""
    even = (count > 1) & F.col("unit_price_cents").isNull() & (quantity != 0) & (total % quantity == 0)
    return F.when(even, F.try_divide(total.cast("decimal(18,0)"), quantity).cast("bigint"))


def coalesce_repeated_in_place(lines: DataFrame, key: str, order: str) -> DataFrame:
    """The rule of ``coalesce_repeated_lines`` for parsed documents, whose lines are together anyway.

    A group is part of one text, and windows over (document, ...) keep its partitioning.
    """
    columns = lines.columns
    marked = lines.withColumns({"_may": _mergeable(), "_ok": _reconciled()})
    group = Window.partitionBy(key, "_may", *REPEAT_KEY)
    marked = marked.withColumns(
        {
            "_n": F.count("*").over(group),
            "_ok_n": F.count_if("_ok").over(group),
            "_low": F.min("total_cents").over(group),
            "_high": F.max("total_cents").over(group),
        }
    )
    prefer = F.expr("_may and _ok_n > 0 and _ok_n < _n")
    together = F.expr("_may and not (_ok_n > 0 and _ok_n < _n) and _n > 1 and _low = _high")
    marked = marked.withColumns({"_prefer": prefer, "_together": together}).where("not _prefer or _ok")
    merged = Window.partitionBy(key, "_may", *REPEAT_KEY)
    marked = marked.withColumns(
        {
            "_place": F.row_number().over(merged.orderBy(order)),
            "_sum": F.sum("total_cents").over(merged),
            "_count": F.count("*").over(merged),
        }
    ).where("not (_prefer or _together) or _place = 1")
    changed = F.col("_prefer") | F.col("_together")
    quantity = F.when(changed, F.col("quantity") * F.col("_count")).otherwise(F.col("quantity")).cast("decimal(10,3)")
    marked = marked.withColumns(
        {"quantity": quantity, "total_cents": F.when(changed, F.col("_sum")).otherwise(F.col("total_cents"))}
    )
    price = F.when(changed, _inferred_price(F.col("_count"), F.col("quantity"), F.col("total_cents")))
    return marked.withColumn("unit_price_cents", F.coalesce("unit_price_cents", price)).select(*columns)


def coalesce_repeated_lines(lines: DataFrame, key: str, order: str) -> DataFrame:
    """Collapse repeated piece items of a receipt.

    Where only some copies reconcile (unit price times quantity is the total), only those are
    kept and merged; otherwise copies with one common total merge; otherwise all stay.
    Copies are summed by partial aggregation; only groups that stay apart are re-read.
    """
    columns = lines.columns
    mergeable = _mergeable()
    rest = [c for c in columns if c not in (key, "quantity", "total_cents", *REPEAT_KEY)]
    carried = F.struct(*rest)
    marked = lines.where(mergeable).withColumn("_ok", _reconciled())
    ok = F.col("_ok")
    groups = marked.groupBy(key, *REPEAT_KEY).agg(
        F.count("*").alias("_n"),
        F.count_if(ok).alias("_ok_n"),
        F.min("total_cents").alias("_low"),
        F.max("total_cents").alias("_high"),
        F.sum("total_cents").alias("_total"),
        F.sum(F.when(ok, F.col("total_cents"))).alias("_ok_total"),
        F.min_by(carried, F.col(order)).alias("_first"),
        F.min_by(F.when(ok, carried), F.when(ok, F.col(order))).alias("_ok_first"),
    )
    prefer = (F.col("_ok_n") > 0) & (F.col("_ok_n") < F.col("_n"))
    together = F.col("_low") == F.col("_high")
    stays = ~prefer & ~together
    count = F.when(prefer, F.col("_ok_n")).otherwise(F.col("_n"))
    quantity = (F.col("quantity") * count).cast("decimal(10,3)")
    total = F.when(prefer, F.col("_ok_total")).otherwise(F.col("_total"))
    inferred = _inferred_price(count, quantity, total)
    merged = groups.where(~stays).select(
        key,
        *[F.col(c) for c in REPEAT_KEY if c not in ("quantity", "unit_price_cents")],
        quantity.alias("quantity"),
        F.coalesce("unit_price_cents", inferred).cast(lines.schema["unit_price_cents"].dataType).alias("unit_price_cents"),
        total.cast(lines.schema["total_cents"].dataType).alias("total_cents"),
        F.when(prefer, F.col("_ok_first")).otherwise(F.col("_first")).alias("_rest"),
    ).select("*", "_rest.*").drop("_rest")
    apart = groups.where(stays).select(*[F.col(c).alias("_k_" + c) for c in (key, *REPEAT_KEY)])
    same = [F.col(key) == F.col("_k_" + key), *[F.col(c).eqNullSafe(F.col("_k_" + c)) for c in REPEAT_KEY]]
    left_alone = marked.drop("_ok").join(apart, same, "left_semi")
    return (
        lines.where(~mergeable).select(*columns).unionByName(left_alone.select(*columns)).unionByName(merged.select(*columns))
    )


def line_article_count() -> Column:
    counted = F.when(F.col("unit_of_measure") == "piece", F.col("quantity").cast("bigint")).otherwise(F.lit(1))
    return F.when(F.col("kind") == "item", counted).otherwise(F.lit(0))


def receipt_sums(receipts: DataFrame, lines: DataFrame, payments: DataFrame, key: str, kept: Sequence[str] = ()) -> DataFrame:
    """Line total, article count and payment total next to the declared values and ``kept`` columns; missing children are 0."""
    line_sums = lines.groupBy(key).agg(
        F.sum(F.coalesce("total_cents", F.lit(0)).cast("bigint")).alias("line_total"),
        F.sum(line_article_count()).alias("article_count"),
    )
    payment_sums = payments.groupBy(key).agg(F.sum(F.col("amount_cents").cast("bigint")).alias("payment_total"))
    return (
        receipts.select(key, "total_cents", "declared_article_count", *kept)
        .join(line_sums, key, "left")
        .join(payment_sums, key, "left")
        .na.fill(0, ["line_total", "article_count", "payment_total"])
    )


def discrepancies(sums: DataFrame) -> DataFrame:
    """Differences per validator and whether each passes (article count is skipped when undeclared)."""
    return (
        sums.withColumn("totals_gap", F.col("line_total") - F.col("total_cents"))
        .withColumn("article_gap", F.col("article_count") - F.col("declared_article_count"))
        .withColumn("payments_gap", F.col("payment_total") - F.col("total_cents"))
        .withColumn("totals_ok", F.abs("totals_gap") <= fixed.MONETARY_TOLERANCE_CENTS)
        .withColumn("articles_ok", F.coalesce(F.col("article_gap") == 0, F.lit(True)))
        .withColumn("payments_ok", F.abs("payments_gap") <= fixed.MONETARY_TOLERANCE_CENTS)
    )


def validator_results(receipts: DataFrame, lines: DataFrame, payments: DataFrame, key: str, kept: Sequence[str] = ()) -> DataFrame:
    """Per receipt the failed validators in fixed order and their warnings, with its ``kept`` columns."""
    judged = discrepancies(receipt_sums(receipts, lines, payments, key, kept))
    checks = [("totals_ok", "totals_gap"), ("articles_ok", "article_gap"), ("payments_ok", "payments_gap")]
    raised = [
        F.when(~F.col(ok), warnings.validator_warning(name, F.col(gap)))
        for name, (ok, gap) in zip(fixed.VALIDATORS, checks, strict=True)
    ]
    return judged.withColumn("validator_warnings", F.filter(F.array(*raised), lambda w: w.isNotNull())).withColumn(
        "failed_validators", F.transform("validator_warnings", lambda w: w["validator"])
    )


Validator = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


def apply_validators(receipts: DataFrame, lines: DataFrame, payments: DataFrame, extra: list[Validator]) -> DataFrame:
    """Append the warnings of user-supplied validators.

    A validator maps (receipts, lines, payments) to rows (receipt_id, warning) for the
    receipts it fails; each is one join keyed by receipt.
    """
    checked = receipts
    for validator in extra:
        raised = validator(receipts, lines, payments).groupBy("receipt_id").agg(F.collect_list("warning").alias("_raised"))
        empty = F.array().cast(f"array<{warnings.WARNING_TYPE}>")
        checked = (
            checked.join(raised, "receipt_id", "left")
            .withColumn("parser_warnings", F.concat("parser_warnings", F.coalesce("_raised", empty)))
            .drop("_raised")
        )
    return checked


def revalidate_receipts(receipts: DataFrame, lines: DataFrame, payments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validators over coalesced stored lines; receipts without a total go to rejects."""
    complete = receipts.where("total_cents is not null")
    rejects = receipts.where("total_cents is null").select("receipt_id", F.lit("missing_total").alias("reason"))
    merged = coalesce_repeated_lines(lines, "receipt_id", "position")
    judged = validator_results(complete, merged, payments, "receipt_id").select(
        "receipt_id", "validator_warnings", "failed_validators"
    )
    kept = warnings.merge_warnings(F.col("parser_warnings"), F.col("validator_warnings"))
    checked = complete.drop("parser_status").join(judged, "receipt_id").withColumn("parser_warnings", kept)
    status = F.when(F.size("parser_warnings") == 0, F.lit("parsed")).otherwise(F.lit("needs_review"))
    return checked.withColumn("parser_status", status).drop("validator_warnings"), rejects


def finalize_reviews(receipts: DataFrame, lines: DataFrame, payments: DataFrame, promotions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Receipts whose validators pass become reviewed; their promotion links are confirmed."""
    checked, _ = revalidate_receipts(receipts, lines, payments)
    passes = F.size("failed_validators") == 0
    done = checked.withColumn("parser_status", F.when(passes, F.lit("reviewed")).otherwise(F.col("parser_status")))
    reviewed = checked.where(passes).select("receipt_id", F.lit(True).alias("_reviewed"))
    method = F.when(F.col("linked_line_id").isNotNull(), F.lit("user_confirmed")).otherwise(F.lit("unallocated"))
    confirmed = promotions.join(reviewed, "receipt_id", "left").withColumn(
        "linking_method", F.when(F.col("_reviewed"), method).otherwise(F.col("linking_method"))
    )
    return done, confirmed.drop("_reviewed")


STRICT_KEY = ["store_id", "register_number", "ticket_number", "purchased_at"]


def strict_duplicates(receipts: DataFrame) -> DataFrame:
    """(receipt_id, original_id): later arrivals with the same store, register, ticket and time."""
    keyed = receipts.where(
        F.col("store_id").isNotNull()
        & ~text.is_blank(F.col("register_number"))
        & ~text.is_blank(F.col("ticket_number"))
        & F.col("purchased_at").isNotNull()
    ).select("receipt_id", "created_at", *STRICT_KEY)
    first = keyed.groupBy(*STRICT_KEY).agg(F.min_by("receipt_id", F.struct("created_at", "receipt_id")).alias("original_id"))
    return keyed.join(first, STRICT_KEY).where("receipt_id <> original_id").select("receipt_id", "original_id")


def suspected_duplicates(receipts: DataFrame) -> DataFrame:
    """(receipt_id, suspect_id) among receipts that are not strict duplicates.

    The suspect is the most recent purchase among earlier arrivals with the same store, day
    and total. A hot key is spread over ordered chunks.
    """
    survivors = receipts.join(strict_duplicates(receipts).select("receipt_id"), "receipt_id", "left_anti")
    keyed = survivors.where(
        F.col("store_id").isNotNull() & F.col("purchased_at").isNotNull() & F.col("total_cents").isNotNull()
    ).select("receipt_id", "created_at", "purchased_at", "store_id", "total_cents", F.to_date("purchased_at").alias("purchase_day"))
    ranked = running_max_before(
        keyed, ["store_id", "purchase_day", "total_cents"], ["created_at", "receipt_id"],
        F.struct("purchased_at", "receipt_id"), "_suspect",
    )
    return ranked.where("_suspect is not null").select("receipt_id", F.col("_suspect.receipt_id").alias("suspect_id"))


def mark_suspected_duplicates(receipts: DataFrame) -> DataFrame:
    """Receipts that survive the strict check, with a fresh suspected-duplicate warning."""
    survivors = receipts.join(strict_duplicates(receipts).select("receipt_id"), "receipt_id", "left_anti")
    suspects = suspected_duplicates(receipts)
    warning = F.array(
        warnings.build_warning("suspected_duplicate", F.format_string(fixed.DUPLICATE_TEXT, F.col("suspect_id").cast("string")))
    )
    marked = warnings.replace_duplicate_warning(F.col("parser_warnings"), warning)
    return survivors.join(suspects, "receipt_id", "left").withColumn(
        "parser_warnings", F.when(F.col("suspect_id").isNotNull(), marked).otherwise(F.col("parser_warnings"))
    )


def reparse_receipts(receipts: DataFrame, lines: DataFrame, matches: DataFrame, reparsed: DataFrame, reparsed_lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replace the header and lines of re-parsed receipts, keyed by receipt id.

    Receipt id and store stay. A failed re-parse keeps the old header fields but drops the
    lines. Receipts with matched lines, or whose new header collides with another receipt's
    strict key, are refused.
    """
    matched = lines.join(matches.select("line_id").distinct(), "line_id", "left_semi").select("receipt_id").distinct()
    refused = reparsed.join(matched, "receipt_id", "left_semi").select("receipt_id", F.lit("lines_already_matched").alias("reason"))
    allowed = reparsed.join(matched, "receipt_id", "left_anti")
    others = receipts.select(*STRICT_KEY, F.col("receipt_id").alias("_other"))
    stores = receipts.select("receipt_id", "store_id")
    named = allowed.where(~text.is_blank(F.col("register_number")) & ~text.is_blank(F.col("ticket_number")))
    clashes = (
        named.join(stores, "receipt_id").join(others, STRICT_KEY).where("receipt_id <> _other")
        .select("receipt_id", F.lit("duplicate_receipt").alias("reason")).distinct()
    )
    refused = refused.unionByName(clashes)
    allowed = allowed.join(clashes.select("receipt_id"), "receipt_id", "left_anti")
    fields = ["purchased_at", "register_number", "ticket_number", "total_cents", "declared_article_count"]
    fresh = allowed.select("receipt_id", "parser_status", "parser_warnings", "failed", *[F.col(c).alias("_" + c) for c in fields])
    rest = [c for c in receipts.columns if c not in ("receipt_id", "parser_status", "parser_warnings", *fields)]
    updated = receipts.drop("parser_status", "parser_warnings").join(fresh, "receipt_id").select(
        "receipt_id", *rest, "parser_status", "parser_warnings",
        *[F.when(F.col("failed"), F.col(c)).otherwise(F.col("_" + c)).alias(c) for c in fields],
    )
    ids = allowed.select("receipt_id")
    next_receipts = receipts.join(ids, "receipt_id", "left_anti").unionByName(updated.select(*receipts.columns))
    good = allowed.where("not failed").select("receipt_id")
    next_lines = lines.join(ids, "receipt_id", "left_anti").unionByName(
        reparsed_lines.join(good, "receipt_id", "left_semi").select(*lines.columns)
    )
    return next_receipts, next_lines, refused


def apply_review_edits(current: DataFrame, patch: DataFrame, key: str, blank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Apply a patch table: update by id, insert rows marked new, delete rows marked so.

    ``patch`` has the table's columns plus ``provided`` (names of supplied fields), ``is_new``
    and ``destroy``. ``blank`` drops new rows without content.
    """
    columns = current.columns
    changes = patch.where("not is_new")
    fresh = changes.select(key, "destroy", "provided", *[F.col(c).alias("_" + c) for c in columns if c != key])
    merged = current.join(fresh, key, "left").where("destroy is null or not destroy")
    updated = merged.select(
        key,
        *[
            F.when(F.array_contains("provided", c), F.col("_" + c)).otherwise(F.col(c)).alias(c)
            for c in columns
            if c != key
        ],
    )
    inserted = patch.where("is_new and not destroy").select(*columns)
    return updated.select(*columns).unionByName(blank(inserted) if blank else inserted)


def delete_receipts(wanted: DataFrame, tables: dict[str, DataFrame], matches: DataFrame, lines: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Remove receipts with their children; receipts with matched lines are refused."""
    matched = lines.join(matches.select("line_id").distinct(), "line_id", "left_semi").select("receipt_id").distinct()
    refused = wanted.join(matched, "receipt_id", "left_semi")
    gone = wanted.join(matched, "receipt_id", "left_anti").select("receipt_id")
    return {name: table.join(gone, "receipt_id", "left_anti") for name, table in tables.items()}, refused


def resolve_promotion_positions(promotions: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Line ids for promised positions; receipts with an unmatched position are voided."""
    places = lines.select("receipt_id", F.col("position").alias("linked_line_position"), F.col("line_id").alias("linked_line_id"))
    linked = promotions.join(places, ["receipt_id", "linked_line_position"], "left")
    missing = F.col("linked_line_position").isNotNull() & F.col("linked_line_id").isNull()
    voided = linked.where(missing).select("receipt_id").distinct()
    return linked.join(voided, "receipt_id", "left_anti"), voided
