"""Document and text-extraction sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.functions import text
from ticketlake.functions.fixed_values import MIME_TYPES
from ticketlake.operators.ordering import earliest_by


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files under a folder: path, bytes and modification time."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "content", F.col("modificationTime").cast("timestamp_ntz").alias("ingested_at"))
    )


def mime_type(path: Column) -> Column:
    types = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.element_at(types, F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)\\z", 1)))


def register_documents(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Admitted uploads as pending source documents, and rejects of other types.

    The bytes are hashed in the scan and dropped before anything is shuffled.
    """
    typed = uploads.withColumn("mime_type", mime_type(F.col("path")))
    hints = [c for c in ("store_id", "parser_format") if c in uploads.columns]
    admitted = typed.where("mime_type is not null").select(
        F.sha2(F.col("path"), 256).alias("document_id"),
        F.sha2("content", 256).alias("content_hash"),
        "mime_type",
        "ingested_at",
        *[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in hints],
        F.lit("pending").alias("source_detection_status"),
    )
    rejects = typed.where("mime_type is null").select("path", F.lit("unsupported_mime_type").alias("reason"))
    return admitted, rejects


def dedup_documents_by_hash(registered: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(upload_id, document_id, duplicate): the first registration of a hash wins.

    The first document per hash comes from a partial aggregate; joining it back leaves a
    hot hash on the probe side of a one-row-per-key join, which AQE splits.
    """
    first = earliest_by(registered.select("content_hash", "ingested_at", "document_id"), ["content_hash"], ["ingested_at", "document_id"])
    first = first.select("content_hash", F.col("document_id").alias("_first"))
    if existing is not None:
        known = existing.select("content_hash", F.col("document_id").alias("_known"))
        first = first.join(known, "content_hash", "left").select(
            "content_hash", F.coalesce("_known", "_first").alias("_first")
        )
    owner = registered.select("content_hash", F.col("document_id").alias("upload_id")).join(first, "content_hash")
    return owner.select(
        "upload_id", F.col("_first").alias("document_id"), (F.col("upload_id") != F.col("_first")).alias("duplicate")
    )


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Already extracted texts, one file per document."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("ran_at"),
    )


def load_extractions(attempts: DataFrame) -> DataFrame:
    """One extraction row per attempt; blank text is a failure with empty text and a message."""
    failed = text.is_blank(F.col("text")) | F.coalesce(F.col("error_message") != "", F.lit(False))
    message = F.coalesce(F.nullif(F.col("error_message"), F.lit("")), F.concat(F.col("engine"), F.lit(" returned empty text")))
    return attempts.select(
        "extraction_id",
        "document_id",
        "engine",
        F.when(failed, F.lit("")).otherwise(F.col("text")).alias("text"),
        "ran_at",
        (~failed).alias("success"),
        F.when(failed, message).alias("error_message"),
    )


def parseable_extractions(extractions: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Successful extractions of fully classified documents, and refusals for the rest."""
    state = documents.select("document_id", "source_detection_status", "store_id", "parser_format")
    successful = extractions.where("success").join(state, "document_id")
    ready = (
        (F.col("source_detection_status") == "classified")
        & F.col("store_id").isNotNull()
        & F.col("parser_format").isNotNull()
    )
    ready = F.coalesce(ready, F.lit(False))
    return successful.where(ready), successful.where(~ready).select(
        "extraction_id", "document_id", F.lit("unclassified_source_document").alias("reason")
    )


# Tie-break columns of each "latest" lookup.
LATEST_ORDERS = {
    "reparse": ["ran_at", "extraction_id"],
    "manual": ["ran_at", "created_at"],
    "status": ["ran_at", "created_at"],
    "detection": ["created_at", "detection_id"],
    "receipt": ["created_at"],
}


def latest_per_document(rows: DataFrame, purpose: str, key: str = "document_id") -> DataFrame:
    """Newest row per document for a purpose; partial aggregation instead of a sort."""
    if purpose in ("reparse", "manual"):
        rows = rows.where("success")
    order = [c for c in LATEST_ORDERS[purpose] if c in rows.columns]
    rest = [c for c in rows.columns if c != key]
    tie = [c for c in ("extraction_id", "detection_id", "receipt_id") if c in rows.columns and c not in order]
    return (
        rows.groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.struct(*order, *tie)).alias("_row"))
        .select(key, "_row.*")
    )


def processing_state(documents: DataFrame, latest_extraction: DataFrame, receipts: DataFrame) -> DataFrame:
    """Extraction and parsing state per document."""
    tried = latest_extraction.select("document_id", F.col("success").alias("_success"))
    parsed = receipts.select(F.col("document_id")).distinct().withColumn("_receipt", F.lit(True))
    joined = documents.join(tried, "document_id", "left").join(parsed, "document_id", "left")
    success = F.coalesce(F.col("_success"), F.lit(False))
    extraction = F.when(success, "complete").when(F.col("_success").isNotNull(), "failed").otherwise("queued")
    parsing = (
        F.when(F.col("_receipt").isNotNull(), "complete")
        .when(success & (F.col("source_detection_status") == "classified"), "queued")
        .when(success & (F.col("source_detection_status") == "needs_classification"), "needs_classification")
        .when(F.col("_success").isNotNull(), "blocked")
        .otherwise("waiting")
    )
    return joined.select("document_id", extraction.alias("extraction_state"), parsing.alias("parsing_state"))


def extraction_accuracy(extractions: DataFrame, expectations: DataFrame) -> DataFrame:
    """Per document and variant: matched patterns, total, percentage, missed labels in order.

    ``expectations`` (document_id, position, label, pattern) is joined per document; the
    text travels once per expected field.
    """
    scored = extractions.select("document_id", "variant", "text").join(expectations, "document_id").select(
        "document_id", "variant", "position", "label", F.expr("text rlike pattern").alias("hit")
    )
    missed = F.array_sort(F.collect_list(F.when(~F.col("hit"), F.struct("position", "label"))))
    counted = scored.groupBy("document_id", "variant").agg(
        F.count_if("hit").alias("matched"), F.count("*").alias("total"), missed.alias("_missed")
    )
    share = F.round(F.col("matched").cast("decimal(12,0)") * 100 / F.col("total"), 1).cast("decimal(5,1)")
    labels = F.array_join(F.transform("_missed", lambda m: m["label"]), ", ")
    return counted.select(
        "document_id", "variant", "matched", "total", share.alias("accuracy"),
        F.when(F.size("_missed") == 0, F.lit("-")).otherwise(labels).alias("missed"),
    )
