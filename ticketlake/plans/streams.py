"""Streaming jobs over the benchmark tables, run until all available data is processed."""

from pyspark.sql import functions as F

from ticketlake.plans.decision import CURRENT
from ticketlake.plans.classification import hints, texts
from ticketlake.plans.parsing import GOOD, ROUND_V, leclerc_v1_texts
from ticketlake.plans.reconciliation import SUSPECTED
from ticketlake.plans.registry import STATEMENTS, query
from ticketlake.streaming import jobs


def stream(t, name):
    """A table as a stream, whether it is stored as one file or as a folder of files.

    Streams don't take the path of a file, but a pattern that only this table fits.
    """
    schema = t.table(name).schema
    return t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/{name}.parque[t]")


@query("stream_register", "SELECT sha256(text) AS content_hash, arg_min(doc_id, (doc_id % 50, doc_id)) AS document_id FROM documents GROUP BY 1")
def stream_register(t):
    folder = jobs.workspace(t.spark, "register")
    arriving = stream(t, "documents").selectExpr("doc_id as document_id", "sha2(text, 256) as content_hash", "doc_id % 50 as ingested_at")
    jobs.run_available(arriving, jobs.register_job(f"{folder}/documents"), folder)
    return t.spark.read.parquet(f"{folder}/documents").select("content_hash", "document_id")


@query("stream_classify_parse", STATEMENTS["classify_documents"])
def stream_classify_parse(t):
    folder = jobs.workspace(t.spark, "classify")

    class Arriving:
        spark, sf_dir = t.spark, t.sf_dir
        table = staticmethod(lambda name: stream(t, name))

    arriving = texts(Arriving).selectExpr("*", "if(document_id % 7 = 0, 'leclerc.web.v1', null) as hint_format", "cast(if(document_id % 11 = 0, 5, null) as bigint) as hint_store")
    defaults = t.stores.selectExpr("store_id", "'none' as default_parser_format")
    jobs.run_available(arriving, jobs.classify_and_parse_job(folder, hints(t), defaults), folder)
    return t.spark.read.parquet(f"{folder}/detections").select("document_id", "parser_format", "store_id", "status")


@query("stream_duplicates", f"SELECT receipt_id, 'rejected' AS outcome, original_id AS other FROM strict_v UNION ALL SELECT receipt_id, 'suspected', suspect_id FROM ({SUSPECTED})")
def stream_duplicates(t):
    folder = jobs.workspace(t.spark, "duplicates")

    from ticketlake.plans.inputs import Inputs

    class Arriving(Inputs):
        def table(self, name):
            return stream(t, name)

    jobs.run_available(Arriving(t.spark, t.sf_dir).arrivals, jobs.duplicates_job(folder), folder)
    return t.spark.read.parquet(f"{folder}/outcomes").select("receipt_id", "outcome", "other")


@query("stream_status", "SELECT user_id AS document_id, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY 1")
def stream_status(t):
    folder = jobs.workspace(t.spark, "status")
    events = stream(t, "events").selectExpr("user_id as document_id", "event_type as state", "ts as at", "event_id as seq")
    writer = jobs.latest_status(events).writeStream.outputMode("update").foreachBatch(jobs.status_job(f"{folder}/states"))
    writer.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return jobs.current_status(t.spark, f"{folder}/states")


@query("stream_decisions", CURRENT)
def stream_decisions(t):
    folder = jobs.workspace(t.spark, "decisions")
    log = stream(t, "events").where("event_type <> 'purchase'").selectExpr(
        "user_id as line_id", "cast(get_json_object(props, '$.k') as bigint) % 4 as variant_id",
        "case event_type when 'click' then 'confirm' when 'view' then 'ignore' when 'error' then 'reject' when 'signup' then 'suggest' end as action",
        "cast(ts as timestamp_ntz) as decided_at", "event_id as seq",
    )
    jobs.run_available(log, jobs.decisions_job(f"{folder}/log"), folder)
    return jobs.current_decisions(t.spark, f"{folder}/log")


@query("resume_after_manual", f"SELECT document_id, CAST(count(*) AS BIGINT) AS line_count FROM (SELECT k AS document_id FROM ({ROUND_V}) WHERE {GOOD} UNION ALL SELECT k FROM ({ROUND_V}) WHERE i = 1 AND k % 3 = 0 AND {GOOD}) GROUP BY 1")
def resume_after_manual(t):
    folder = jobs.workspace(t.spark, "resume")
    extractions = leclerc_v1_texts(t).selectExpr("document_id", "document_id as extraction_id", "text", "true as success", "at as ran_at", "at as created_at")
    requests = stream(t, "orders").selectExpr("o_orderkey as document_id", "o_custkey as store_id", "'leclerc.paper.v1' as parser_format")
    jobs.run_available(requests, jobs.resume_job(folder, extractions), folder)
    return t.spark.read.parquet(f"{folder}/lines").groupBy("document_id").agg(F.count("*").alias("line_count"))
