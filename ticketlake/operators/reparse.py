"""Re-parsing stored receipts: which ones may take their new header, and the four tables after it.

Requests run in arrival order, each against the receipts as they stand at its turn: receipts that
are not parsed again and later requests with their old header, earlier requests with the header
they ended up with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlake.functions import fixed_values as fixed
from ticketlake.functions import text, warnings
from ticketlake.operators.ordering import running_max_before, with_rank
from ticketlake.operators.reconcile import STRICT_KEY, resolve_promotion_positions, revalidate_receipts
from ticketlake.session import durable

HEADER = ["purchased_at", "register_number", "ticket_number", "total_cents", "declared_article_count"]


def _strict(prefix: str) -> Column:
    """The strict key as one value; null where a part of it is missing."""
    parts = [F.col(c if c == "store_id" else prefix + c) for c in STRICT_KEY]
    store, register, ticket, time = parts
    whole = store.isNotNull() & time.isNotNull() & ~text.is_blank(register) & ~text.is_blank(ticket)
    return F.when(whole, F.struct(*[p.alias(c) for p, c in zip(parts, STRICT_KEY, strict=True)]))


def _daily(prefix: str) -> Column:
    """Store, day and total as one value; null where one is missing."""
    day, total = F.to_date(prefix + "purchased_at"), F.col(prefix + "total_cents")
    whole = F.col("store_id").isNotNull() & day.isNotNull() & total.isNotNull()
    return F.when(whole, F.struct("store_id", day.alias("day"), total.alias("total_cents")))


def decide_requests(requests: DataFrame, others: DataFrame) -> DataFrame:
    """(receipt_id, accepted) for requests (receipt_id, place, before, after, accepted).

    ``before`` and ``after`` are strict keys, ``place`` the order of the requests, ``accepted``
    is set where the answer is known beforehand. ``others`` has the keys (``before``) of all other
    receipts. A key is free at a request's turn when no other receipt holds it and no later request
    has it as its old one; of earlier requests, refused ones hold their old key and accepted ones the
    new one. Per key the least place of a known holder and of an open request is enough, so
    a key of many requests costs one aggregate. A round decides all requests that no open one
    precedes on their key; rounds number the longest chain of requests that wait for each other.
    """
    taken = others.where("before is not null").select(F.col("before").alias("after"), F.lit(True).alias("_taken")).distinct()
    later = requests.where("before is not null").groupBy(F.col("before").alias("after")).agg(F.max("place").alias("_later"))
    known = requests.join(taken, "after", "left").join(later, "after", "left")
    blocked = F.col("_taken").isNotNull() | F.coalesce(F.col("_later") > F.col("place"), F.lit(False))
    first = F.when(F.col("accepted").isNotNull(), F.col("accepted")).when(F.col("after").isNull(), True).when(blocked, False)
    state = durable(known.select("receipt_id", "place", "before", "after", first.alias("accepted")))
    while not state.where("accepted is null").isEmpty():
        held = F.when(F.col("accepted"), F.array("after")).when(~F.col("accepted"), F.array("before")).otherwise(F.array("before", "after"))
        claims = state.select("place", F.col("accepted").isNotNull().alias("_known"), F.explode(held).alias("after")).where("after is not null")
        least = claims.groupBy("after").agg(
            F.min(F.when(F.col("_known"), F.col("place"))).alias("_holder"), F.min(F.when(~F.col("_known"), F.col("place"))).alias("_open")
        )
        taken_before = F.coalesce(F.col("_holder") < F.col("place"), F.lit(False))
        next_up = F.coalesce(F.col("_open") >= F.col("place"), F.lit(True))
        answer = F.coalesce("accepted", F.when(taken_before, F.lit(False)).when(next_up, F.lit(True)))
        state = durable(state.join(least, "after", "left").select("receipt_id", "place", "before", "after", answer.alias("accepted")))
    return state.select("receipt_id", "accepted")


def suspects_of(moved: DataFrame, still: DataFrame) -> DataFrame:
    """(receipt_id, suspect_id): the latest other purchase of the same store, day and total at a request's turn.

    ``moved``: receipt_id, place, store_id, old header with ``_old_`` before the names, new header.
    ``still``: receipts that keep their header. Earlier requests count with the new header, later ones
    with the old; both are running maxima, so a hot day of a store spans tasks.
    """
    seen = F.struct("purchased_at", "receipt_id")
    asked = moved.select("receipt_id", _daily("").alias("_key"), "place", F.lit(0).alias("_kind"))
    none = F.lit(None).cast(moved.select(seen.alias("v")).schema["v"].dataType)

    def running(prefix: str, sign: int) -> DataFrame:
        shown = F.struct(F.col(prefix + "purchased_at").alias("purchased_at"), F.col("receipt_id"))
        given = moved.select("receipt_id", _daily(prefix).alias("_key"), "place", F.lit(1).alias("_kind"), shown.alias("_shown"))
        rows = asked.withColumn("_shown", none).unionByName(given).where("_key is not null").withColumn("_turn", F.col("place") * sign)
        # A request stands before its own header, which therefore never counts.
        found = running_max_before(rows, ["_key"], ["_turn", "_kind"], F.col("_shown"), "_found")
        return found.where("_kind = 0 and _found is not null").select("receipt_id", "_found")

    fixed_ones = still.select(_daily("").alias("_key"), seen.alias("_found")).where("_key is not null").groupBy("_key").agg(F.max("_found").alias("_found"))
    met = asked.join(fixed_ones, "_key").select("receipt_id", "_found").unionByName(running("", 1)).unionByName(running("_old_", -1))
    return met.groupBy("receipt_id").agg(F.max("_found").alias("_found")).select("receipt_id", F.col("_found.receipt_id").alias("suspect_id"))


def rerun_receipts(tables: dict[str, DataFrame], matches: DataFrame, reparsed: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The four tables after a re-parse, and the requests ``refused``.

    ``tables`` and ``reparsed`` hold receipts, lines, promotions and payments. New receipts have one row
    per receipt id with header, parser_status, parser_warnings and ``failed``; new promotions have a
    ``linked_line_position`` instead of a line. Receipt id and store stay. Accepted receipts lose all children
    and get the new ones; a failed parse keeps the old header and leaves no children. Receipts with
    matched lines, promotions that name a missing line, or a strict key that is taken are refused and stay as they
    are. The warning of a suspected duplicate is made anew, validators run over new children; a receipt without
    a total keeps the status its parser gave. Requests for unknown receipts are ignored.
    """
    receipts, lines = tables["receipts"], tables["lines"]
    fresh = reparsed["receipts"].select("receipt_id", "parser_status", "parser_warnings", F.coalesce("failed", F.lit(False)).alias("failed"), *HEADER)
    old = receipts.select("receipt_id", "store_id", "created_at", *[F.col(c).alias("_old_" + c) for c in HEADER])
    matched = lines.join(matches.select("line_id").distinct(), "line_id", "left_semi").select("receipt_id").distinct()
    linked, unlinked = resolve_promotion_positions(reparsed["promotions"], reparsed["lines"])
    barred = durable(
        matched.select("receipt_id", F.lit("lines_already_matched").alias("reason"))
        .unionByName(unlinked.select("receipt_id", F.lit("missing_promotion_line").alias("reason")))
        .join(fresh.select("receipt_id"), "receipt_id", "left_semi")
        .groupBy("receipt_id").agg(F.min("reason").alias("reason"))
    )
    placed = with_rank(fresh.join(old, "receipt_id"), [F.col("created_at").asc_nulls_last(), F.col("receipt_id")], "place")
    header = [F.when(F.col("failed"), F.col("_old_" + c)).otherwise(F.col(c)).alias(c) for c in HEADER]
    others = [c for c in placed.columns if c not in HEADER]
    placed = durable(placed.select(*others, *header).join(barred, "receipt_id", "left"))
    answer = F.when(F.col("reason").isNotNull(), False).when(F.col("failed"), True)
    requests = placed.select("receipt_id", "place", _strict("_old_").alias("before"), _strict("").alias("after"), answer.alias("accepted"))
    rest = receipts.join(placed.select("receipt_id"), "receipt_id", "left_anti")
    decided = decide_requests(requests, rest.select(_strict("").alias("before")))
    judged = durable(placed.join(decided, "receipt_id"))
    refused = judged.where("not accepted").select("receipt_id", F.coalesce("reason", F.lit("duplicate_receipt")).alias("reason"))

    moved = judged.where("accepted")
    ids = moved.select("receipt_id")
    good = moved.where("not failed").select("receipt_id")
    still = receipts.join(ids, "receipt_id", "left_anti")
    suspected = suspects_of(moved, still)
    note = F.array(warnings.build_warning("suspected_duplicate", F.format_string(fixed.DUPLICATE_TEXT, F.col("suspect_id").cast("string"))))
    marked = F.when(F.col("suspect_id").isNotNull(), warnings.replace_duplicate_warning(F.col("parser_warnings"), note)).otherwise(F.col("parser_warnings"))
    after = moved.join(suspected, "receipt_id", "left").select("receipt_id", "failed", "parser_status", marked.alias("parser_warnings"), *HEADER)
    kept = [c for c in receipts.columns if c not in {"parser_status", "parser_warnings", *HEADER}]
    after = durable(receipts.select(*kept).join(after, "receipt_id"))

    def replaced(name: str, new: DataFrame) -> DataFrame:
        table = tables[name]
        return table.join(ids, "receipt_id", "left_anti").unionByName(new.join(good, "receipt_id", "left_semi").select(*table.columns))

    checkable = after.where("not failed and total_cents is not null")
    checked, _ = revalidate_receipts(checkable, reparsed["lines"], reparsed["payments"])
    unchecked = after.where("failed or total_cents is null")
    columns = receipts.columns
    return {
        "receipts": still.unionByName(checked.select(*columns)).unionByName(unchecked.select(*columns)),
        "lines": replaced("lines", reparsed["lines"]),
        "promotions": replaced("promotions", linked),
        "payments": replaced("payments", reparsed["payments"]),
        "refused": refused,
    }
