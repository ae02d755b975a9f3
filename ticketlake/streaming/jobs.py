"""Incremental versions of the batch operators.

Each job is a ``foreachBatch`` function over Parquet tables in a shared folder. A micro
batch writes its own ``batch_id`` partition with overwrite, so a batch that is retried
after a failure replaces its own rows, and it reads only earlier batches as history.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.operators import classify, decisions, reconcile
from ticketlake.operators.ordering import latest_by
from ticketlake.operators.receipt_text import FORMATS, by_document, parse_corpus, parse_parts
from ticketlake.sources import documents

Job = Callable[[DataFrame, int], None]

#: What is parsed from a classified document.
PARTS = ("receipts", "lines", "promotions", "payments")


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder for a run, under the shared folder the cluster names."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="ticketlake-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def history(like: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Rows of earlier batches, shaped like ``like``."""
    if batch_id == 0:
        return like.limit(0)
    return like.sparkSession.read.schema(f"{_ddl(like)}, batch_id bigint").parquet(path).where(F.col("batch_id") < batch_id).drop("batch_id")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def run_available(stream: DataFrame, job: Job, folder: str) -> None:
    """Process everything that has arrived, then stop."""
    query = (
        stream.writeStream.foreachBatch(job)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def register_job(path: str) -> Job:
    """Register documents (document_id, content_hash, ingested_at): earlier registrations win.

    ``{path}`` holds the registered documents; ``{path}_answers`` tells for every upload which
    document it is: itself, or the first one with its content.
    """

    def job(batch: DataFrame, batch_id: int) -> None:
        known = history(batch, path, batch_id).select("content_hash")
        fresh = batch.join(known, "content_hash", "left_anti")
        first = fresh.groupBy("content_hash").agg(F.min_by(F.struct("document_id", "ingested_at"), F.struct("ingested_at", "document_id")).alias("_row"))
        write_batch(first.select("content_hash", "_row.*").select(*batch.columns), path, batch_id)
        stored = history(batch, path, batch_id + 1).select("content_hash", F.col("document_id").alias("registered_id"))
        answers = batch.select("document_id", "content_hash").join(stored, "content_hash")
        write_batch(answers.select("document_id", "registered_id"), f"{path}_answers", batch_id)

    return job


def classify_and_parse_job(path: str, hints: DataFrame, default_formats: DataFrame) -> Job:
    """Classify successful extractions; parse the classified ones; the rest wait for a manual decision.

    ``{path}/detections`` names evidence by ``evidence_id``; ``{path}/evidence`` holds it once per batch (see ``detections``).
    What all parts are parsed from is kept in ``{path}/work`` until the batch is done.
    """

    def job(batch: DataFrame, batch_id: int) -> None:
        found, evidence = classify.classify_by_evidence(batch, hints, default_formats)
        write_batch(found, f"{path}/detections", batch_id)
        write_batch(evidence, f"{path}/evidence", batch_id)
        stored = batch.sparkSession.read.parquet(f"{path}/detections/batch_id={batch_id}").where("status = 'classified'")
        # Texts are shuffled once, by document; what is known of a document comes to them.
        known = stored.select("document_id", "parser_format").hint("shuffle_hash")
        ready = by_document(batch.select("document_id", "text")).join(known, "document_id").select("document_id", "parser_format", "text")
        # At most one name per known format reaches the driver.
        present = sorted(r[0] for r in stored.select("parser_format").distinct().collect())
        work = f"{path}/work/batch_id={batch_id}"

        def keep(rows: DataFrame, name: str) -> DataFrame:
            by = ["parser_format"] if name == "whole" else []
            rows.write.mode("overwrite").partitionBy(*by).parquet(f"{work}/{name}")
            return rows.sparkSession.read.schema(rows.schema).parquet(f"{work}/{name}")

        if present:
            known_formats = [name for name in present if name in FORMATS] or list(FORMATS)
            parse_parts(ready, PARTS, known_formats, keep, lambda rows, part: write_batch(rows, f"{path}/{part}", batch_id))
            discard(batch.sparkSession, work)

    return job


def discard(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def detections(spark: SparkSession, path: str) -> DataFrame:
    """Detections of all batches with their evidence, as ``classify_documents`` gives them."""
    found, evidence = (spark.read.parquet(f"{path}/{name}") for name in ("detections", "evidence"))
    return found.join(evidence, ["batch_id", "evidence_id"]).drop("batch_id", "evidence_id")


def duplicates_job(path: str) -> Job:
    """Strict and suspected duplicates of arriving receipts, against history and the batch itself.

    What is stored came first, whatever its ``created_at`` says: a late arrival is the duplicate.
    History is joined by the strict key and by store, day and total, without the rejected receipts.
    """

    def job(batch: DataFrame, batch_id: int) -> None:
        outcomes = batch.select("receipt_id", F.lit("").alias("outcome"), F.col("receipt_id").alias("other"))
        rejected = history(outcomes, f"{path}/outcomes", batch_id).where("outcome = 'rejected'").select("receipt_id")
        earlier = history(batch, f"{path}/receipts", batch_id).join(rejected, "receipt_id", "left_anti")
        day = F.to_date("purchased_at").alias("_day")
        strict_keys = batch.select(*reconcile.STRICT_KEY).distinct()
        loose_keys = batch.select("store_id", day, "total_cents").distinct()
        same = earlier.join(strict_keys, reconcile.STRICT_KEY, "left_semi")
        alike = earlier.select("*", day).join(loose_keys, ["store_id", "_day", "total_cents"], "left_semi").select(*batch.columns)
        touched = same.select(*batch.columns).unionByName(alike).dropDuplicates(["receipt_id"])
        order = lambda turn: F.struct(F.lit(turn).alias("turn"), F.col("created_at").alias("at"))
        everything = touched.withColumn("created_at", order(0)).unionByName(batch.withColumn("created_at", order(1)))
        mine = batch.select("receipt_id")
        strict = reconcile.strict_duplicates(everything).join(mine, "receipt_id", "left_semi")
        suspected = reconcile.suspected_duplicates(everything).join(mine, "receipt_id", "left_semi")
        outcome = strict.select("receipt_id", F.lit("rejected").alias("outcome"), F.col("original_id").alias("other")).unionByName(
            suspected.select("receipt_id", F.lit("suspected").alias("outcome"), F.col("suspect_id").alias("other"))
        )
        write_batch(outcome, f"{path}/outcomes", batch_id)
        write_batch(batch, f"{path}/receipts", batch_id)

    return job


def latest_status(events: DataFrame) -> DataFrame:
    """Latest state per document as a streaming aggregation (document_id, state, at, seq)."""
    return events.groupBy("document_id").agg(F.max_by("state", F.struct("at", "seq")).alias("state"), F.max(F.struct("at", "seq")).alias("version"))


def status_job(path: str) -> Job:
    """Store changed states; readers take the highest version per document."""

    def job(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id)

    return job


def current_status(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return latest_by(rows.select("document_id", "state", "version"), ["document_id"], ["version"]).select("document_id", "state")


def compact_decisions(log: DataFrame) -> DataFrame:
    """The log entries that the folded state depends on; folding them gives the same state."""
    at = F.struct("decided_at", "seq")
    row = F.struct(*log.columns)
    terminal = log.where(F.col("action").isin("confirm", "ignore")).groupBy("line_id").agg(
        F.array_distinct(F.array(F.min_by(row, at), F.max_by(row, at))).alias("_rows")
    )
    pairs = log.where(F.col("action").isin("reject", "suggest")).groupBy("line_id", "variant_id", "action").agg(
        F.array(F.max_by(row, at)).alias("_rows")
    )
    return terminal.select("_rows").unionByName(pairs.select("_rows")).select(F.inline("_rows"))


def decisions_job(path: str) -> Job:
    """Maintain the compacted decision log; each batch writes the next full snapshot."""

    def job(batch: DataFrame, batch_id: int) -> None:
        previous = history(batch, path, batch_id)
        if batch_id > 0:
            previous = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/batch_id={batch_id - 1}")
        write_batch(compact_decisions(previous.unionByName(batch)), path, batch_id)

    return job


def current_decisions(spark: SparkSession, path: str) -> DataFrame:
    snapshots = spark.read.parquet(path)
    newest = snapshots.agg(F.max("batch_id")).scalar()
    return decisions.current_decisions(snapshots.where(F.col("batch_id") == newest).drop("batch_id"))


def resume_job(path: str, extractions: DataFrame) -> Job:
    """Manual classifications re-queue the latest successful extraction for parsing."""
    latest = documents.latest_per_document(extractions, "manual")

    def job(batch: DataFrame, batch_id: int) -> None:
        found, refused = classify.manual_classification(batch, latest.select("document_id", "extraction_id"))
        write_batch(found, f"{path}/detections", batch_id)
        write_batch(refused, f"{path}/refused", batch_id)
        ready = found.join(latest.select("document_id", "text"), "document_id").select("document_id", "parser_format", "text")
        write_batch(parse_corpus(ready, "lines"), f"{path}/lines", batch_id)

    return job
