"""Source classification: receipt format and store of a document from its text."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlake.functions import text
from ticketlake.functions.fixed_values import CHANNELS, FORMAT_CHANNELS, MINIMUM_HINT_LENGTH
from ticketlake.operators.spread import spread_join
from ticketlake.session import durable


class DetectionRule(NamedTuple):
    format: str
    tier: str
    marker: str
    pattern: str


#: Up to so many different first words of hints are tested in the scan, as a hash set.
MOST_FIRST_WORDS = 10_000

_B = "(?<![\\p{L}\\p{N}_])"
_E = "(?![\\p{L}\\p{N}_])"

# Detection rules in order (format, tier, marker, pattern).
DETECTION_RULES = [
    DetectionRule("leclerc.web.v1", "hard", "leclerc_web_payment", f"(?dimu){_B}CB\\s+Web\\s+(?:Drive|C&C){_E}"),
    DetectionRule("leclerc.paper.v2", "hard", "leclerc_paper_vat_table", f"(?dimu){_B}Code\\s+HT\\s+TVA\\s+TTC{_E}"),
    DetectionRule("u.paper.v2", "hard", "u_omnipos_version", f"(?dimu){_B}OmniPOS\\s+version{_E}"),
    DetectionRule("u.paper.v2", "hard", "u_omnipos_sale_banner", "(?dimu)^\\s*\\*{3}\\s*VENTE\\s*\\*{3}\\s*$"),
    DetectionRule("u.paper.v1", "hard", "u_legacy_hash_footer", "(?dimu)^\\s*Hash:"),
    DetectionRule("u.paper.v1", "fallback", "u_legacy_section_marker", "(?dimu)^\\s*>>>>\\s+"),
    DetectionRule("auchan.paper.v1", "hard", "auchan_waaoh_account", f"(?dimu){_B}WAAOH{_E}"),
    DetectionRule("auchan.paper.v1", "hard", "auchan_selfscan_section", f"(?dimu){_B}Selfscan{_E}"),
    DetectionRule("auchan.paper.v1", "hard", "auchan_tr_totals", f"(?dimu){_B}TOT\\.\\s+ARTICLES\\s+ELIGIBLES\\s+TR{_E}"),
    DetectionRule("leclerc.paper.v1", "fallback", "leclerc_paper_legacy_ticket_line", "(?dimu)^\\s*\\d{2}/\\d{2}/\\d{2}\\s+\\d\\s+\\w{4}\\s+\\d{2}\\w{3}\\s*$"),
]

EVIDENCE_TYPE = (
    "struct<code:string,parser_format:string,parser_formats:array<string>,marker:string,store_id:string,"
    "store_ids:array<string>,source:string,value:string,explicit_parser_format:string,"
    "detected_parser_formats:array<string>,explicit_store_id:string,detected_store_ids:array<string>>"
)
EVIDENCE_FIELDS = [part.split(":")[0] for part in EVIDENCE_TYPE[len("struct<"):-1].split(",")]
_LISTS = {"parser_formats", "store_ids", "detected_parser_formats", "detected_store_ids"}


def evidence(code: str, **fields: Column) -> Column:
    """One evidence entry; fields that are not given are null."""
    parts = [F.lit(code).alias("code")]
    for name in EVIDENCE_FIELDS[1:]:
        kind = "array<string>" if name in _LISTS else "string"
        parts.append(fields.get(name, F.lit(None)).cast(kind).alias(name))
    return F.struct(*parts)


def _empty_evidence() -> Column:
    return F.array().cast(f"array<{EVIDENCE_TYPE}>")


def match_format_rules(body: Column, rules: list[DetectionRule] = DETECTION_RULES) -> Column:
    """All matching rules as array<struct<format, tier, marker>>, evaluated in the scan stage."""
    tried = [
        F.struct(F.lit(r.format).alias("format"), F.lit(r.tier).alias("tier"), F.lit(r.marker).alias("marker"), body.rlike(r.pattern).alias("hit"))
        for r in rules
    ]
    return F.transform(
        F.filter(F.array(*tried), lambda m: m["hit"]),
        lambda m: F.struct(m["format"].alias("format"), m["tier"].alias("tier"), m["marker"].alias("marker")),
    )


def preferred_matches(matches: Column) -> Column:
    """Hard matches shadow fallback ones."""
    hard = F.filter(matches, lambda m: m["tier"] == "hard")
    return F.when(F.size(hard) > 0, hard).otherwise(matches)


def distinct_formats(matches: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["format"])))


def choose_format(df: DataFrame, matches: str = "matches") -> DataFrame:
    """Chosen format (only when unambiguous), its confidence and the evidence."""
    chosen = df.withColumn("_preferred", preferred_matches(F.col(matches))).withColumn("detected_formats", distinct_formats(F.col("_preferred")))
    one = F.size("detected_formats") == 1
    markers = F.transform("_preferred", lambda m: evidence("parser_format_marker", parser_format=m["format"], marker=m["marker"]))
    ambiguous = F.concat(markers, F.array(evidence("parser_format_ambiguous", parser_formats=F.col("detected_formats"))))
    none = F.array(evidence("parser_format_not_detected"))
    return (
        chosen.withColumn("detected_format", F.when(one, F.element_at("detected_formats", 1)))
        .withColumn("format_confidence", F.when(one, F.lit("high")).otherwise(F.lit("none")))
        .withColumn("format_evidence", F.when(one, markers).when(F.size("detected_formats") == 0, none).otherwise(ambiguous))
        .drop("_preferred")
    )


def store_scope_for_format(stores: DataFrame, formats: DataFrame) -> DataFrame:
    """Stores in scope of each different format, by channel; a null or unknown format allows every channel.

    One row per format and store, never per document; documents look their scope up by format.
    """
    channels = F.lit(None).cast("array<string>")
    for name, allowed in FORMAT_CHANNELS.items():
        channels = F.when(F.col("parser_format") == name, F.array(*map(F.lit, allowed))).otherwise(channels)
    every = F.array(*map(F.lit, CHANNELS))
    scopes = formats.select("parser_format").distinct().select("parser_format", F.explode(F.coalesce(channels, every)).alias("channel"))
    return scopes.join(stores, "channel")


def store_hints(stores: DataFrame, brands: DataFrame, nested_hints: DataFrame | None = None) -> DataFrame:
    """One row per store and hint value: (store_id, channel, source, value, position, specific).

    ``stores`` carries normalised identifier columns (arrays). ``position`` keeps the
    evidence order: aliases, location name, header patterns, legal entities, codes, hints.
    """
    base = stores.join(brands.select("retail_brand_id", "aliases"), "retail_brand_id")

    def listed(rank: int, source: str, values: Column) -> DataFrame:
        return base.select("store_id", "channel", F.lit(rank).alias("_rank"), F.lit(source).alias("source"), F.posexplode(values).alias("_at", "value"))

    hints = listed(0, "retail_brand.aliases", F.col("aliases"))
    hints = hints.unionByName(listed(1, "store.location_name", F.array("location_name")))
    ranked = [(2, "receipt_header_patterns"), (3, "legal_entities"), (4, "receipt_store_codes")]
    for rank, key in ranked:
        if key in stores.columns:
            hints = hints.unionByName(listed(rank, f"store.identifiers.{key}", F.col(key)))
    if nested_hints is not None:
        nested = nested_hints.join(stores.select("store_id", "channel"), "store_id").select(
            "store_id", "channel", F.lit(5).alias("_rank"), "source", F.lit(0).alias("_at"), "value"
        )
        hints = hints.unionByName(nested)
    return hints.select(
        "store_id",
        "channel",
        "source",
        "value",
        F.struct("_rank", "_at", "source", "value").alias("position"),
        (F.col("_rank") > 0).alias("specific"),
        text.normalize_detection_text(F.col("value")).alias("normalized_value"),
    ).where(F.length("normalized_value") >= MINIMUM_HINT_LENGTH)


def hint_hits(documents: DataFrame, hints: DataFrame, body: str = "text") -> DataFrame:
    """Distinct (document_id, normalized_value) where a hint occurs as whole words.

    A whole-word hit of an n-word value is one of the text's n-word grams, so texts are cut
    into grams of the lengths that hints have and joined on equality. Neither the texts nor
    the hints are broadcast, and texts are not compared with hints pair by pair. Where hints
    begin with few different words, grams are only cut where one of those words stands.
    """
    values = hints.select("normalized_value").distinct().withColumn("_words", F.size(F.split("normalized_value", " ")))
    # At most one number per hint length reaches the driver.
    lengths = sorted(r[0] for r in values.select("_words").distinct().collect())
    begins = values.select(F.substring_index("normalized_value", " ", 1).alias("word")).distinct()
    known = [r[0] for r in begins.limit(MOST_FIRST_WORDS + 1).collect()]
    words = documents.select("document_id", F.split(text.normalize_detection_text(F.col(body)), " ").alias("_tokens"))
    starts = F.sequence(F.lit(1), F.size("_tokens"))
    if len(known) <= MOST_FIRST_WORDS:
        starts = F.filter(starts, lambda i: F.get("_tokens", i - 1).isin(known))
    words = words.withColumn("_starts", starts)

    def grams(n: int) -> Column:
        room = F.filter("_starts", lambda i: i <= F.size("_tokens") - (n - 1))
        return F.transform(room, lambda i: F.array_join(F.slice("_tokens", i, n), " "))

    cut = F.array_distinct(F.flatten(F.array(*[grams(n) for n in lengths]))) if lengths else F.array().cast("array<string>")
    return words.select("document_id", F.explode(cut).alias("normalized_value")).join(values, "normalized_value").select(
        "document_id", "normalized_value"
    )


def store_evidence(formats: DataFrame, hits: DataFrame, hints: DataFrame, default_formats: DataFrame) -> DataFrame:
    """Evidence rows per document and store in scope.

    ``formats``: (document_id, parser_format chosen for scoping, null when unknown).
    """
    # Documents get their format, and hints their store's default formats, before they meet: rows per document
    # and store are made once, in cells, and only those with a fitting default are compared again.
    scoped = durable(hits.join(formats.select("document_id", "parser_format"), "document_id"))
    found = spread_join(scoped, _with_defaults(hints, default_formats), "normalized_value").where(_in_scope())
    return _entries(found, default_formats)


def _with_defaults(hints: DataFrame, default_formats: DataFrame) -> DataFrame:
    defaults = default_formats.groupBy("store_id").agg(F.collect_set("default_parser_format").alias("default_formats"))
    return hints.join(defaults, "store_id", "left")


def _in_scope() -> Column:
    """Whether a store's channel fits the format; a null or unknown format allows every channel."""
    fits = F.lit(True)
    for name, channels in FORMAT_CHANNELS.items():
        fits = F.when(F.col("parser_format") == name, F.col("channel").isin(*channels)).otherwise(fits)
    return fits


def _entries(found: DataFrame, default_formats: DataFrame) -> DataFrame:
    """Evidence entries of hints found in scope, and of their stores' default formats."""
    metadata = found.select("document_id", "store_id", "parser_format", "source", "value", "position", "specific")
    fitting = found.where(F.array_contains("default_formats", F.col("parser_format")))
    stores = fitting.select("document_id", "store_id", "parser_format").distinct()
    defaults = stores.join(default_formats, "store_id").where(F.col("default_parser_format") == F.col("parser_format")).select(
        "document_id",
        "store_id",
        evidence("store_default_parser_format", store_id=F.col("store_id"), parser_format=F.col("parser_format")).alias("entry"),
        F.struct(F.lit(9).alias("_rank"), F.lit(0).alias("_at"), F.lit("").alias("source"), F.lit("").alias("value")).alias("position"),
        F.lit(False).alias("specific"),
    )
    entries = metadata.select(
        "document_id",
        "store_id",
        evidence("store_metadata_match", store_id=F.col("store_id"), source=F.col("source"), value=F.col("value")).alias("entry"),
        "position",
        "specific",
    )
    return entries.unionByName(defaults)


def hint_signatures(formats: DataFrame, hits: DataFrame) -> DataFrame:
    """(document_id, parser_format, hints, signature): the hints a document names, as one sorted list.

    What a store decision and its evidence depend on is the format and this list, so documents
    that share both share one signature. Documents that name no hint have no row.
    """
    named = hits.groupBy("document_id").agg(F.array_sort(F.collect_set("normalized_value")).alias("hints"))
    parts = F.concat_ws("|", F.coalesce("parser_format", F.lit("")), "hints")
    return formats.select("document_id", "parser_format").join(named, "document_id").withColumn("signature", F.sha2(parts, 256))


def shared_signatures(formats: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(document_id, signature), and per signature its formats and hits, each named as ``store_evidence`` takes them.

    Stores of a document follow from its formats and the hints it names, so evidence for choosing stores is put
    together once per signature. Documents without a format row or a hit have no signature.
    """
    named = hits.groupBy("document_id").agg(F.array_sort(F.collect_set("normalized_value")).alias("_hints"))
    scopes = formats.groupBy("document_id").agg(F.array_sort(F.collect_set(F.struct("parser_format"))).alias("_formats"))
    signature = F.sha2(F.to_json(F.struct("_formats", "_hints")), 256)
    known = durable(scopes.join(named, "document_id").withColumn("signature", signature))
    each = known.groupBy("signature").agg(F.any_value("_formats").alias("_formats"), F.any_value("_hints").alias("_hints")).withColumnRenamed("signature", "document_id")
    return known.select("document_id", "signature"), each.select("document_id", F.inline("_formats")), each.select("document_id", F.explode("_hints").alias("normalized_value"))


def decide_stores(signatures: DataFrame, hints: DataFrame) -> DataFrame:
    """(signature, detected_store, many, specific): one store or several, without listing any.

    Stores are reduced to their least and greatest id per hint value, channel and kind before they
    meet a signature; a signature has one store exactly when least and greatest are equal over all
    its hints. Specific hints shadow aliases. Signatures without a store in scope have no row.
    """
    own = F.when(F.col("specific"), F.col("store_id"))
    bounds = hints.groupBy("normalized_value", "channel").agg(
        F.min("store_id").alias("_low"), F.max("store_id").alias("_high"), F.min(own).alias("_own_low"), F.max(own).alias("_own_high")
    )
    asked = signatures.select("signature", "parser_format", "hints").distinct().select("signature", "parser_format", F.explode("hints").alias("normalized_value"))
    met = asked.join(bounds, "normalized_value").where(_in_scope()).groupBy("signature").agg(
        F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.min("_own_low").alias("_own_low"), F.max("_own_high").alias("_own_high")
    )
    low, high = F.coalesce("_own_low", "_low"), F.coalesce("_own_high", "_high")
    return met.select(
        "signature", F.when(low == high, low).alias("detected_store"), (low != high).alias("many"), F.col("_own_low").isNotNull().alias("specific")
    )


def signature_evidence(signatures: DataFrame, hints: DataFrame, default_formats: DataFrame) -> DataFrame:
    """Store, confidence and full evidence per signature, as ``choose_store`` gives them per document.

    Aliases are spread over the stores of a brand only for signatures without a specific hint;
    beside specific ones they are looked up for the stores those name.
    """
    known = durable(signatures.select(F.col("signature").alias("document_id"), "parser_format", "hints").distinct())
    asked = known.select("document_id", "parser_format", F.explode("hints").alias("normalized_value"))
    hints = _with_defaults(hints, default_formats)
    specific, aliases = hints.where("specific"), hints.where("not specific")
    named = durable(asked.join(specific, "normalized_value").where(_in_scope()))
    stores = named.select("document_id", "store_id").distinct()
    columns = named.columns
    beside = asked.join(stores, "document_id").join(aliases, ["normalized_value", "store_id"])
    alone = asked.join(stores.select("document_id").distinct(), "document_id", "left_anti").join(aliases, "normalized_value").where(_in_scope())
    found = named.unionByName(beside.select(*columns)).unionByName(alone.select(*columns))
    return choose_store(_entries(durable(found), default_formats)).withColumnRenamed("document_id", "signature")


def choose_store(entries: DataFrame) -> DataFrame:
    """Store per document: specific evidence shadows alias-only stores; one store wins, several are ambiguous.

    A document's candidate list is bounded by the store dimension.
    """
    per_store = entries.groupBy("document_id", "store_id").agg(
        F.max("specific").alias("_specific"), F.array_sort(F.collect_list(F.struct("position", "entry"))).alias("_entries")
    )
    level = per_store.groupBy("document_id").agg(F.max("_specific").alias("_any"))
    kept = per_store.join(level, "document_id").where("_specific = _any")
    per_document = kept.groupBy("document_id").agg(
        F.count("*").alias("store_count"),
        F.min("store_id").alias("_store"),
        F.array_sort(F.collect_list(F.struct("store_id", "_entries"))).alias("_stores"),
    )
    entries_of = F.flatten(F.transform("_stores", lambda s: F.transform(s["_entries"], lambda e: e["entry"])))
    ids = F.array_sort(F.transform("_stores", lambda s: s["store_id"].cast("string")))
    ambiguous = F.concat(entries_of, F.array(evidence("store_ambiguous", store_ids=ids)))
    one = F.col("store_count") == 1
    return per_document.select(
        "document_id",
        F.when(one, F.col("_store")).alias("detected_store"),
        F.when(one, F.lit("high")).otherwise(F.lit("none")).alias("store_confidence"),
        ids.alias("detected_stores"),
        F.when(one, entries_of).otherwise(ambiguous).alias("store_evidence"),
    )


def apply_explicit_format(df: DataFrame) -> DataFrame:
    """An explicit format hint wins with confidence manual; detector evidence and conflicts are kept."""
    hint = F.col("hint_format")
    conflict = (F.size("detected_formats") > 0) & ((F.size("detected_formats") > 1) | (F.element_at("detected_formats", 1) != hint))
    kept = F.filter("format_evidence", lambda e: e["code"] != "parser_format_not_detected")
    clash = F.array(evidence("explicit_parser_format_conflict", explicit_parser_format=hint, detected_parser_formats=F.col("detected_formats")))
    manual = F.concat(
        F.array(evidence("explicit_parser_format", parser_format=hint)), kept, F.when(conflict, clash).otherwise(_empty_evidence())
    )
    return (
        df.withColumn("format_evidence", F.when(hint.isNotNull(), manual).otherwise(F.col("format_evidence")))
        .withColumn("parser_format", F.coalesce(hint, "detected_format"))
        .withColumn("parser_confidence", F.when(hint.isNotNull(), F.lit("manual")).otherwise(F.col("format_confidence")))
    )


def apply_explicit_store(df: DataFrame) -> DataFrame:
    hint = F.col("hint_store")
    found = F.coalesce(F.col("detected_stores"), F.array().cast("array<string>"))
    conflict = (F.size(found) > 0) & ((F.size(found) > 1) | (F.element_at(found, 1) != hint.cast("string")))
    none = F.array(evidence("store_not_detected"))
    detected = F.coalesce(F.col("store_evidence"), none)
    kept = F.filter(detected, lambda e: e["code"] != "store_not_detected")
    clash = F.array(evidence("explicit_store_conflict", explicit_store_id=hint, detected_store_ids=found))
    manual = F.concat(F.array(evidence("explicit_store", store_id=hint)), kept, F.when(conflict, clash).otherwise(_empty_evidence()))
    return (
        df.withColumn("store_evidence", F.when(hint.isNotNull(), manual).otherwise(detected))
        .withColumn("store_id", F.coalesce(hint, "detected_store"))
        .withColumn("store_confidence", F.when(hint.isNotNull(), F.lit("manual")).otherwise(F.coalesce(F.col("store_confidence"), F.lit("none"))))
    )


def classify_documents(extractions: DataFrame, hints: DataFrame, default_formats: DataFrame, rules: list[DetectionRule] = DETECTION_RULES) -> DataFrame:
    """One detection row per extraction: format, store, confidences, status, evidence.

    ``extractions``: document_id, text, hint_format, hint_store. Texts are read twice (rules
    and grams), and only ids and short keys are shuffled. Store evidence is put together once per
    signature (format and hints named), so no row per document and store is ever made.
    """
    formats, signatures, stores = _decided(extractions, hints, default_formats, rules)
    found = signatures.select("document_id", "signature").join(stores, "signature").drop("signature")
    joined = apply_explicit_store(formats.join(found, "document_id", "left"))
    return joined.select(*_detection(), F.concat("format_evidence", "store_evidence").alias("evidence"))


def classify_by_evidence(extractions: DataFrame, hints: DataFrame, default_formats: DataFrame, rules: list[DetectionRule] = DETECTION_RULES) -> tuple[DataFrame, DataFrame]:
    """The rows of ``classify_documents`` with ``evidence_id`` for their evidence, and (evidence_id, evidence).

    Evidence may name every store of a brand. It follows from the signature, the format evidence and the explicit store, so it is
    put together once for each of these and never travels with a document.
    """
    formats, signatures, stores = _decided(extractions, hints, default_formats, rules)
    found = signatures.select("document_id", "signature").join(stores.select("signature", "detected_store", "store_confidence"), "signature")
    unlisted = {"detected_stores": F.lit(None).cast("array<string>"), "store_evidence": F.lit(None).cast(f"array<{EVIDENCE_TYPE}>")}
    joined = formats.join(found, "document_id", "left")
    given = ["format_evidence", "hint_store", "signature"]
    joined = joined.withColumns({"evidence_id": F.sha2(F.to_json(F.struct(*given)), 256), **unlisted})
    detections = apply_explicit_store(joined).select(*_detection(), "evidence_id")
    named = joined.groupBy("evidence_id").agg(*[F.any_value(name).alias(name) for name in given])
    listed = apply_explicit_store(named.join(stores, "signature", "left"))
    return detections, listed.select("evidence_id", F.concat("format_evidence", "store_evidence").alias("evidence"))


def _decided(extractions: DataFrame, hints: DataFrame, default_formats: DataFrame, rules: list[DetectionRule]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Formats per extraction, the signatures of those that name hints, and stores per signature."""
    hints = durable(hints)
    ruled = extractions.select("document_id", "hint_format", "hint_store", match_format_rules(F.col("text"), rules).alias("matches"))
    formats = durable(apply_explicit_format(choose_format(ruled)).drop("matches"))
    signatures = durable(hint_signatures(formats, hint_hits(extractions, hints)))
    return formats, signatures, signature_evidence(signatures, hints, default_formats)


def _detection() -> list[Column]:
    classified = F.col("parser_format").isNotNull() & F.col("store_id").isNotNull()
    return [
        F.col("document_id"),
        F.when(classified, F.lit("classified")).otherwise(F.lit("needs_classification")).alias("status"),
        *map(F.col, ("parser_format", "parser_confidence", "store_id", "store_confidence")),
    ]


def manual_classification(requests: DataFrame, latest_extractions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """User classifications as manual detections; documents without a successful text are refused."""
    found = requests.join(latest_extractions.select("document_id", "extraction_id"), "document_id", "left")
    entry = F.array(evidence("manual_classification", store_id=F.col("store_id"), parser_format=F.col("parser_format")))
    detections = found.where("extraction_id is not null").select(
        "document_id", "extraction_id", F.lit("classified").alias("status"), "parser_format",
        F.lit("manual").alias("parser_confidence"), "store_id", F.lit("manual").alias("store_confidence"), entry.alias("evidence"),
    )
    refused = found.where("extraction_id is null").select("document_id", F.lit("missing_successful_text_extraction").alias("reason"))
    return detections, refused


def backfill_detections(documents: DataFrame, latest_extractions: DataFrame) -> DataFrame:
    """Manual detections for historic documents; documents without a successful text vanish."""
    entry = F.array(evidence("manual_backfill"))
    return documents.join(latest_extractions.select("document_id", "extraction_id"), "document_id").select(
        "document_id", "extraction_id", F.lit("classified").alias("status"), "parser_format",
        F.lit("manual").alias("parser_confidence"), "store_id", F.lit("manual").alias("store_confidence"), entry.alias("evidence"),
    )


def resolve_evidence_stores(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Store ids of evidence lists to display labels, unknown ids kept, order kept.

    ``entries``: key, store_ids (bounded by the store dimension). ``labels``: store_id, label.
    """
    exploded = entries.select("key", F.posexplode("store_ids").alias("_at", "store_id"))
    named = exploded.join(labels, "store_id", "left").select("key", "_at", F.coalesce("label", F.col("store_id")).alias("_label"))
    return named.groupBy("key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_label"))), lambda x: x["_label"]), ", ").alias("stores")
    )
