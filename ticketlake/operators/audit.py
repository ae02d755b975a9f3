"""Integrity audits: each returns the offending rows, none enforces anything."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlake.functions import fixed_values as fixed


def one_of(column: str, values: list[str]) -> str:
    return f"{column} in ({', '.join(repr(v) for v in values)})"

# Unique keys per table; the condition limits partial keys.
UNIQUE_KEYS = [
    ("retail_brands", ["slug"], None),
    ("stores", ["retail_brand_id", "location_name", "channel"], None),
    ("source_documents", ["content_hash"], None),
    ("receipts", ["store_id", "register_number", "ticket_number", "purchased_at"], "store_id is not null and register_number is not null and ticket_number is not null and purchased_at is not null"),
    ("receipt_lines", ["receipt_id", "position"], None),
    ("receipt_payments", ["receipt_id", "position"], None),
    ("receipt_line_matches", ["line_id"], "status in ('confirmed', 'ignored')"),
    ("price_observations", ["line_id"], None),
    ("price_observations", ["match_id"], None),
    ("categories", ["normalized_name"], None),
    ("categories", ["slug"], None),
    ("comparison_units", ["normalized_name"], None),
    ("comparison_units", ["slug"], None),
    ("comparison_units", ["symbol"], None),
    ("manufacturers", ["normalized_name"], None),
    ("manufacturers", ["slug"], None),
    ("product_brands", ["normalized_name"], None),
    ("product_brands", ["slug"], None),
    ("products", ["product_brand_id", "category_id", "normalized_name"], None),
    ("products", ["product_brand_id", "category_id", "slug"], None),
    ("product_variants", ["product_id", "normalized_name"], None),
    ("product_variants", ["product_id", "slug"], None),
    ("product_variants", ["barcode"], "barcode is not null"),
    ("product_alternative_groups", ["category_id", "name"], None),
    ("product_alternative_group_memberships", ["group_id", "variant_id"], None),
]


class ForeignKey(NamedTuple):
    table: str
    column: str
    parent: str
    parent_key: str


# References between tables (child table, column, parent table, parent key).
FOREIGN_KEYS = [
    ForeignKey("stores", "retail_brand_id", "retail_brands", "retail_brand_id"),
    ForeignKey("source_documents", "store_id", "stores", "store_id"),
    ForeignKey("text_extractions", "document_id", "source_documents", "document_id"),
    ForeignKey("source_document_detections", "document_id", "source_documents", "document_id"),
    ForeignKey("source_document_detections", "extraction_id", "text_extractions", "extraction_id"),
    ForeignKey("source_document_detections", "store_id", "stores", "store_id"),
    ForeignKey("receipts", "store_id", "stores", "store_id"),
    ForeignKey("receipts", "document_id", "source_documents", "document_id"),
    ForeignKey("receipts", "extraction_id", "text_extractions", "extraction_id"),
    ForeignKey("receipt_lines", "receipt_id", "receipts", "receipt_id"),
    ForeignKey("receipt_payments", "receipt_id", "receipts", "receipt_id"),
    ForeignKey("receipt_promotions", "receipt_id", "receipts", "receipt_id"),
    ForeignKey("receipt_promotions", "linked_line_id", "receipt_lines", "line_id"),
    ForeignKey("categories", "parent_id", "categories", "category_id"),
    ForeignKey("product_brands", "retail_brand_id", "retail_brands", "retail_brand_id"),
    ForeignKey("products", "product_brand_id", "product_brands", "product_brand_id"),
    ForeignKey("products", "category_id", "categories", "category_id"),
    ForeignKey("products", "manufacturer_id", "manufacturers", "manufacturer_id"),
    ForeignKey("product_variants", "product_id", "products", "product_id"),
    ForeignKey("product_variants", "comparison_unit_id", "comparison_units", "comparison_unit_id"),
    ForeignKey("product_alternative_groups", "category_id", "categories", "category_id"),
    ForeignKey("product_alternative_group_memberships", "group_id", "product_alternative_groups", "group_id"),
    ForeignKey("product_alternative_group_memberships", "variant_id", "product_variants", "variant_id"),
    ForeignKey("receipt_line_matches", "line_id", "receipt_lines", "line_id"),
    ForeignKey("receipt_line_matches", "variant_id", "product_variants", "variant_id"),
    ForeignKey("price_observations", "line_id", "receipt_lines", "line_id"),
    ForeignKey("price_observations", "match_id", "receipt_line_matches", "match_id"),
    ForeignKey("price_observations", "variant_id", "product_variants", "variant_id"),
    ForeignKey("price_observations", "store_id", "stores", "store_id"),
    ForeignKey("price_observations", "comparison_unit_id", "comparison_units", "comparison_unit_id"),
]

# Evidence columns that may not change once stored.
IMMUTABLE_COLUMNS = {
    "source_documents": ["content_hash", "mime_type", "ingested_at"],
    "text_extractions": ["document_id", "engine", "text", "ran_at", "success", "error_message"],
    "source_document_detections": ["document_id", "extraction_id", "status", "parser_format", "parser_confidence", "store_id", "store_confidence", "evidence"],
}

# Row rules per table (name, condition that must hold or be unknown).
ROW_RULES = {
    "receipt_payments": [("amount_positive", "amount_cents > 0"), ("category_domain", one_of("category", fixed.PAYMENT_CATEGORIES))],
    "stores": [("channel_domain", one_of("channel", fixed.CHANNELS))],
    "product_alternative_group_memberships": [("equivalence_domain", one_of("equivalence", fixed.EQUIVALENCES))],
    "receipt_line_matches": [
        ("confidence_probability", "confidence is null or confidence between 0 and 1"),
        ("variant_presence", "(status = 'ignored') = (variant_id is null)"),
        ("status_domain", one_of("status", fixed.MATCH_STATUSES)),
        ("source_domain", one_of("source", fixed.MATCH_SOURCES)),
    ],
    "price_observations": [
        ("quantity_positive", "purchased_quantity > 0"),
        ("total_non_negative", "total_cents >= 0"),
        ("pack_price_non_negative", "pack_unit_price_cents >= 0"),
        ("unit_price_non_negative", "comparison_unit_price_cents is null or comparison_unit_price_cents >= 0"),
        ("source_domain", one_of("source", fixed.OBSERVATION_SOURCES)),
        ("unit_pairing", "(comparison_unit_id is null) = (comparison_unit_price_cents is null)"),
    ],
    "product_variants": [
        ("package_count_positive", "package_count is null or package_count > 0"),
        ("quantity_value_positive", "quantity_value is null or quantity_value > 0"),
    ],
    "categories": [("parent_not_self", "parent_id is null or parent_id <> category_id")],
    "source_documents": [
        ("hash_shape", "content_hash rlike '^[0-9a-f]{64}$'"),
        ("classified_source_present", "source_detection_status <> 'classified' or (store_id is not null and parser_format is not null)"),
        ("status_domain", one_of("source_detection_status", fixed.DETECTION_STATUSES)),
        ("mime_domain", one_of("mime_type", sorted(set(fixed.MIME_TYPES.values())))),
    ],
    "source_document_detections": [
        ("classified_source_present", "status <> 'classified' or (store_id is not null and parser_format is not null)"),
        ("status_domain", one_of("status", fixed.DETECTION_STATUSES)),
        ("parser_confidence_domain", one_of("parser_confidence", fixed.DETECTION_CONFIDENCES)),
        ("store_confidence_domain", one_of("store_confidence", fixed.DETECTION_CONFIDENCES)),
        ("parser_confidence_consistent", "(parser_format is null) = (parser_confidence = 'none')"),
        ("store_confidence_consistent", "(store_id is null) = (store_confidence = 'none')"),
    ],
    "receipt_promotions": [
        ("kind_domain", one_of("kind", fixed.PROMOTION_KINDS)),
        ("unit_domain", one_of("unit", fixed.PROMOTION_UNITS)),
        ("linking_domain", one_of("linking_method", fixed.LINKING_METHODS)),
        ("link_method_consistent", "(linked_line_id is null) = (linking_method = 'unallocated')"),
    ],
    "receipts": [("status_domain", one_of("parser_status", fixed.PARSER_STATUSES))],
    "receipt_lines": [("kind_domain", one_of("kind", fixed.LINE_KINDS)), ("unit_domain", one_of("unit_of_measure", fixed.UNITS_OF_MEASURE))],
}


def audit_unique(table: DataFrame, keys: list[str], condition: str | None = None) -> DataFrame:
    """Key values stored more than once; nulls never collide."""
    rows = table.where(condition) if condition else table
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def audit_foreign_key(child: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose reference has no parent; the parent side is one column."""
    keys = parent.select(F.col(parent_key).alias(column)).distinct()
    return child.where(F.col(column).isNotNull()).join(keys, column, "left_anti")


def audit_foreign_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per reference: its orphans, or null and ``not_checked`` where its tables or columns aren't given."""
    spark, parts, missing = next(iter(tables.values())).sparkSession, [], []
    for key in FOREIGN_KEYS:
        name = f"{key.table}.{key.column}"
        child, parent = tables.get(key.table), tables.get(key.parent)
        if child is None or parent is None or key.column not in child.columns or key.parent_key not in parent.columns:
            missing.append((name, None, "not_checked"))
            continue
        orphans = audit_foreign_key(child, key.column, parent, key.parent_key)
        parts.append(orphans.agg(F.count("*").alias("orphans")).select(F.lit(name).alias("reference"), "orphans", F.lit("checked").alias("state")))
    parts.append(spark.createDataFrame(missing, "reference string, orphans bigint, state string"))
    return reduce(DataFrame.unionByName, parts)


def audit_immutability(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Evidence rows that vanished or changed between two snapshots, null-safe."""
    old = before.select(key, F.struct(*columns).alias("_old"))
    new = after.select(key, F.struct(*columns).alias("_new"), F.lit(True).alias("_there"))
    joined = old.join(new, key, "left")
    finding = F.when(F.col("_there").isNull(), F.lit("vanished")).when(~F.col("_old").eqNullSafe(F.col("_new")), F.lit("changed"))
    return joined.select(key, finding.alias("finding")).where("finding is not null")


def audit_checks(table: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Rows that break a rule, with the names of the broken rules."""
    broken = F.filter(F.array(*[F.when(~F.expr(rule), F.lit(name)) for name, rule in rules]), lambda x: x.isNotNull())
    return table.withColumn("broken_rules", broken).where(F.size("broken_rules") > 0)


def warning_problem(document: Column) -> Column:
    """Why a JSON warning is malformed, or null: exactly four keys, of the right types."""
    fields = F.try_parse_json(document)
    kind = lambda path: F.regexp_extract(F.schema_of_variant(F.try_variant_get(fields, f"$.{path}", "variant")), "^[A-Z]+", 0)
    keys = F.array_sort(F.json_object_keys(document))
    numbers = ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"]
    return (
        F.when(keys.isNull(), F.lit("not an object"))
        .when(keys != F.array(*[F.lit(k) for k in ("code", "detail", "validator", "value")]), F.lit("keys"))
        .when(kind("code") != "STRING", F.lit("code"))
        .when(~kind("validator").isin("STRING", "VOID"), F.lit("validator"))
        .when(kind("detail") != "STRING", F.lit("detail"))
        .when(~kind("value").isin(*numbers, "VOID"), F.lit("value"))
    )


def audit_observation_consistency(observations: DataFrame, matches: DataFrame) -> DataFrame:
    """Observations whose decision is not confirmed or names another line or variant."""
    decided = matches.select("match_id", F.col("line_id").alias("_line"), F.col("variant_id").alias("_variant"), "status")
    joined = observations.join(decided, "match_id")
    finding = F.when(F.col("status") != "confirmed", F.lit("not_confirmed")).when(
        ~(F.col("line_id").eqNullSafe(F.col("_line")) & F.col("variant_id").eqNullSafe(F.col("_variant"))), F.lit("mismatch")
    )
    return joined.select("match_id", finding.alias("finding")).where("finding is not null")


def audit_detection_extraction(detections: DataFrame, extractions: DataFrame) -> DataFrame:
    """Detections whose extraction belongs to another document."""
    owner = extractions.select("extraction_id", F.col("document_id").alias("_owner"))
    return detections.join(owner, "extraction_id").where(F.col("document_id") != F.col("_owner")).drop("_owner")


def restricted_deletes(parent: str, wanted: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Requested deletions (key) that still have dependents, with what depends on them.

    Every table that refers to the parent must be given: a deletion is not safe unless all were asked.
    """
    references = [key for key in FOREIGN_KEYS if key.parent == parent]
    absent = [f"{k.table}.{k.column}" for k in references if k.table not in tables or k.column not in tables[k.table].columns]
    if absent or not references:
        raise ValueError(f"references to {parent} that can't be checked: {', '.join(absent) or 'none known'}")
    held = None
    for key in references:
        used = tables[key.table].select(F.col(key.column).alias(key.parent_key)).distinct()
        part = wanted.select(key.parent_key).join(used, key.parent_key, "left_semi").withColumn("held_by", F.lit(key.table))
        held = part if held is None else held.unionByName(part)
    return held


def surrogate_key(table: str, key: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(table), key.cast("string")), 256)


def rekey_tables(tables: dict[str, tuple[DataFrame, str]], references: list[ForeignKey], polymorphic: dict[str, tuple[str, str, dict[str, str]]] | None = None) -> dict[str, DataFrame]:
    """New surrogate keys for every table and rewritten references.

    Keys are hashes of (table, old key), so a reference is rewritten in place without a
    join. ``polymorphic``: table -> (type column, id column, type name -> table).
    """
    rewritten = {}
    for name, (table, key) in tables.items():
        columns = {key: surrogate_key(name, F.col(key))}
        for reference in references:
            if reference.table == name and reference.column in table.columns:
                columns[reference.column] = F.when(F.col(reference.column).isNotNull(), surrogate_key(reference.parent, F.col(reference.column)))
        if polymorphic and name in polymorphic:
            kind, target, owners = polymorphic[name]
            cases = F.when(F.lit(False), F.lit(None).cast("string"))
            for type_name, owner in owners.items():
                cases = cases.when(F.col(kind) == type_name, surrogate_key(owner, F.col(target)))
            columns[target] = cases
        rewritten[name] = table.withColumns(columns)
    return rewritten
