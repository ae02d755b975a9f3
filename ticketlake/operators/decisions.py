"""Matching decisions and the price facts that follow from confirmed ones.

Decisions arrive in bulk as request tables. Each operator returns the next snapshot of
the match table (and rejects, where a request is not allowed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlake.functions import money, text
from ticketlake.functions.fixed_values import TERMINAL_STATUSES
from ticketlake.operators.ordering import latest_by, ordered, upsert
from ticketlake.session import durable

MATCH_COLUMNS = [
    "match_id",
    "line_id",
    "variant_id",
    "status",
    "source",
    "confidence",
    "label_snapshot",
    "normalized_label_snapshot",
    "decided_at",
]



def _decide(requests: DataFrame, matches: DataFrame, status: str, priority: Column) -> DataFrame:
    """Rewrite the preferred existing row per request, or add a row.

    ``priority`` ranks existing match rows (null: not reusable); the lowest wins, then the id.
    """
    key = F.coalesce(F.col("variant_id").cast("string"), F.lit(""))
    wanted = requests.select("line_id", F.col("variant_id").alias("_wanted"), "label", "decided_at", key.alias("_key"))
    usable = (
        matches.join(wanted.select("line_id", "_wanted", "_key"), "line_id")
        .withColumn("_priority", priority)
        .where(F.col("_priority").isNotNull())
        .groupBy("line_id", "_key")
        .agg(F.min_by("match_id", F.struct("_priority", "match_id")).alias("match_id"))
    )
    chosen = wanted.join(usable, ["line_id", "_key"], "left").withColumnRenamed("_wanted", "variant_id")
    rewritten = chosen.select(
        F.coalesce("match_id", F.sha2(F.concat_ws("|", F.lit(status), "line_id", F.coalesce(F.col("variant_id").cast("string"), F.lit(""))), 256)).alias("match_id"),
        "line_id",
        F.col("variant_id") if status != "ignored" else F.lit(None).cast(matches.schema["variant_id"].dataType).alias("variant_id"),
        F.lit(status).alias("status"),
        F.lit("user").alias("source"),
        F.lit(None).cast("decimal(5,4)").alias("confidence"),
        F.col("label").alias("label_snapshot"),
        text.normalize_text(F.col("label")).alias("normalized_label_snapshot"),
        "decided_at",
    )
    return upsert(matches.select(*MATCH_COLUMNS), rewritten, ["match_id"])


def _labelled(requests: DataFrame, lines: DataFrame) -> DataFrame:
    return requests.join(lines.select("line_id", "label", "receipt_id"), "line_id")


def confirmable(requests: DataFrame, lines: DataFrame, receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split requests into allowed ones and rejects with a reason."""
    state = receipts.select("receipt_id", "parser_status", "purchased_at")
    known = _labelled(requests, lines).join(state, "receipt_id")
    reason = F.when(F.col("parser_status") != "reviewed", F.lit("receipt_not_reviewed")).when(
        F.col("purchased_at").isNull(), F.lit("purchase_date_missing")
    )
    known = known.withColumn("reason", reason)
    return known.where("reason is null"), known.where("reason is not null")


def latest_requests(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Last request per key when a batch holds several."""
    return latest_by(requests, keys, ["decided_at", "variant_id"] if "variant_id" not in keys else ["decided_at"])


def apply_confirmations(requests: DataFrame, matches: DataFrame, lines: DataFrame, receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(line, variant) confirmed: the terminal row, else that variant's suggestion, else a new row."""
    allowed, refused = confirmable(latest_requests(requests, ["line_id"]), lines, receipts)
    priority = F.when(F.col("status").isin(TERMINAL_STATUSES), 0).when(
        (F.col("status") == "suggested") & (F.col("variant_id") == F.col("_wanted")), 1
    )
    return _decide(allowed, matches, "confirmed", priority), refused


def apply_ignores(requests: DataFrame, matches: DataFrame, lines: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines ignored: terminal row without a variant; their price observations go."""
    none = requests.withColumn("variant_id", F.lit(None).cast(matches.schema["variant_id"].dataType))
    wanted = _labelled(latest_by(none, ["line_id"], ["decided_at"]), lines)
    priority = F.when(F.col("status").isin(TERMINAL_STATUSES), 0)
    kept = observations.join(wanted.select("line_id"), "line_id", "left_anti")
    return _decide(wanted, matches, "ignored", priority), kept


def apply_rejections(requests: DataFrame, matches: DataFrame, lines: DataFrame) -> DataFrame:
    """(line, variant) rejected: the suggestion, else the earlier rejection, else a new row."""
    wanted = _labelled(latest_requests(requests, ["line_id", "variant_id"]), lines)
    mine = F.col("variant_id") == F.col("_wanted")
    priority = F.when((F.col("status") == "suggested") & mine, 0).when((F.col("status") == "rejected") & mine, 1)
    return _decide(wanted, matches, "rejected", priority)


def persist_suggestions(suggestions: DataFrame, matches: DataFrame, lines: DataFrame) -> DataFrame:
    """Upsert (line, variant, suggested) with confidence; existing decision times are kept."""
    stored = (
        matches.where(F.col("status") == "suggested")
        .groupBy("line_id", "variant_id")
        .agg(F.min_by(F.struct("match_id", "decided_at"), "match_id").alias("_old"))
    )
    # Read twice by the upsert.
    incoming = (
        durable(suggestions.select("line_id", "variant_id", "confidence"))
        .join(lines.select("line_id", "label"), "line_id")
        .join(stored, ["line_id", "variant_id"], "left")
    )
    rows = incoming.select(
        F.coalesce("_old.match_id", F.sha2(F.concat_ws("|", F.lit("suggested"), "line_id", F.col("variant_id").cast("string")), 256)).alias("match_id"),
        "line_id",
        "variant_id",
        F.lit("suggested").alias("status"),
        F.lit("heuristic").alias("source"),
        F.col("confidence").cast("decimal(5,4)").alias("confidence"),
        F.col("label").alias("label_snapshot"),
        text.normalize_text(F.col("label")).alias("normalized_label_snapshot"),
        F.col("_old.decided_at").alias("decided_at"),
    )
    return upsert(matches.select(*MATCH_COLUMNS), rows, ["match_id"])


def current_decisions(log: DataFrame) -> DataFrame:
    """Fold an ordered decision log (line_id, variant_id, action, decided_at, seq) into its state.

    Terminal state: the last confirm or ignore per line. Rejections stay per (line, variant).
    A suggestion stays until a later rejection of the pair, or until the line's first
    terminal decision confirms that variant (which turns the suggestion into it).
    """
    at = F.struct("decided_at", "seq")
    terminal_log = log.where(F.col("action").isin("confirm", "ignore"))
    per_line = terminal_log.groupBy("line_id").agg(
        F.max_by(F.struct("variant_id", "action", "decided_at"), at).alias("_last"),
        F.min_by(F.struct("variant_id", "action"), at).alias("_first"),
        F.min(at).alias("_first_at"),
    )
    terminal = per_line.select(
        "line_id",
        F.when(F.col("_last.action") == "confirm", F.col("_last.variant_id")).alias("variant_id"),
        F.when(F.col("_last.action") == "confirm", F.lit("confirmed")).otherwise(F.lit("ignored")).alias("status"),
        F.col("_last.decided_at").alias("decided_at"),
    )
    pairs = log.where(F.col("action").isin("reject", "suggest")).groupBy("line_id", "variant_id").agg(
        F.max(F.when(F.col("action") == "reject", at)).alias("_rejected"),
        F.max(F.when(F.col("action") == "suggest", at)).alias("_suggested"),
    )
    rejected = pairs.where("_rejected is not null").select(
        "line_id", "variant_id", F.lit("rejected").alias("status"), F.col("_rejected.decided_at").alias("decided_at")
    )
    first = per_line.where(F.col("_first.action") == "confirm").select(
        "line_id", F.col("_first.variant_id").alias("variant_id"), "_first_at"
    )
    open_pairs = pairs.where("_suggested is not null and (_rejected is null or _suggested > _rejected)")
    suggested = (
        open_pairs.join(first, ["line_id", "variant_id"], "left")
        .where("_first_at is null or _suggested > _first_at")
        .select("line_id", "variant_id", F.lit("suggested").alias("status"), F.col("_suggested.decided_at").alias("decided_at"))
    )
    return terminal.unionByName(rejected).unionByName(suggested)


def stale_set_guard(expected: DataFrame, eligible: DataFrame) -> DataFrame:
    """Requests (request_id, normalized_label, line_id) whose id set equals the label's current lines.

    Sets are compared by counts over an equi-join, never collected.
    """
    asked = expected.groupBy("request_id", "normalized_label", "line_id").agg(F.count("*").alias("_times"))
    current = eligible.select("normalized_label", "line_id")
    known = current.withColumn("_known", F.lit(1))
    matched = asked.join(known, ["normalized_label", "line_id"], "left")
    per_request = matched.groupBy("request_id", "normalized_label").agg(
        F.sum("_times").alias("expected_count"), F.count("_known").alias("matched_count")
    )
    sizes = current.groupBy("normalized_label").agg(F.count("*").alias("current_count"))
    judged = per_request.join(sizes, "normalized_label", "left").na.fill(0, ["current_count"])
    accepted = (F.col("expected_count") == F.col("current_count")) & (F.col("matched_count") == F.col("current_count"))
    return judged.withColumn("accepted", accepted)


def bulk_decision_lines(expected: DataFrame, eligible: DataFrame) -> DataFrame:
    """Lines of the accepted group requests, ready for confirmation or ignoring."""
    accepted = stale_set_guard(expected, eligible).where("accepted").select("request_id", "normalized_label")
    return eligible.join(accepted, "normalized_label").select("request_id", "normalized_label", "line_id")


def bulk_preview(eligible: DataFrame) -> DataFrame:
    """Per label: first raw label by (label, id) and the number of affected lines."""
    return eligible.groupBy("normalized_label").agg(
        F.min("label").alias("representative_label"), F.count("*").alias("affected_count")
    )


def price_observations(matches: DataFrame, lines: DataFrame, receipts: DataFrame, variants: DataFrame) -> DataFrame:
    """One price fact per confirmed line of a dated receipt."""
    confirmed = matches.where(F.col("status") == "confirmed").select("match_id", "line_id", "variant_id")
    facts = (
        confirmed.join(lines.select("line_id", "receipt_id", "quantity", "unit_of_measure", "total_cents"), "line_id")
        .join(receipts.where(F.col("purchased_at").isNotNull()).select("receipt_id", "store_id", "purchased_at"), "receipt_id")
        .join(variants.select(F.col("record_id").alias("variant_id"), "package_count", "quantity_value", "comparison_unit_id"), "variant_id")
    )
    unit_price = money.comparison_unit_price(
        F.col("total_cents"), F.col("quantity"), F.col("package_count"), F.col("quantity_value"), F.col("comparison_unit_id")
    )
    return facts.select(
        "match_id",
        "line_id",
        "variant_id",
        "store_id",
        F.col("purchased_at").alias("observed_at"),
        F.col("quantity").alias("purchased_quantity"),
        F.col("unit_of_measure").alias("purchased_unit"),
        "total_cents",
        money.pack_unit_price(F.col("total_cents"), F.col("quantity")).alias("pack_unit_price_cents"),
        F.when(F.col("quantity_value").isNotNull(), F.col("comparison_unit_id")).alias("comparison_unit_id"),
        unit_price.alias("comparison_unit_price_cents"),
        F.lit("receipt_line").alias("source"),
    )


def price_history(observations: DataFrame, variant_id=None, store_id=None, day: str | None = None) -> DataFrame:
    """Observations of a variant, a store or a day (half-open range, so partitions prune)."""
    if variant_id is not None:
        observations = observations.where(F.col("variant_id") == variant_id)
    if store_id is not None:
        observations = observations.where(F.col("store_id") == store_id)
    if day is not None:
        start = F.lit(day).cast("timestamp_ntz")
        observations = observations.where((F.col("observed_at") >= start) & (F.col("observed_at") < start + F.expr("interval 1 day")))
    return observations


def history_order() -> list[Column]:
    return [ordered("observed_at", "desc"), ordered("line_id", "desc")]
