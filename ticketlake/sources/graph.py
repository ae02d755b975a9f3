"""Writing parsed receipts with their children, all or nothing per receipt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.operators.reconcile import resolve_promotion_positions


def receipt_graph(parsed: dict[str, DataFrame], documents: DataFrame) -> dict[str, DataFrame]:
    """Tables ready to write, plus ``rejects``.

    ``parsed``: receipts, lines, promotions, payments keyed by receipt_id, receipts with
    document_id. Store and format always come from the document. A receipt with a child that
    cannot be stored (unmatched promotion position, payment not above zero) is left out with
    all its children.
    """
    lines = parsed["lines"].withColumn("line_id", F.sha2(F.concat_ws("|", F.lit("line"), "receipt_id", "position"), 256))
    linked, voided = resolve_promotion_positions(parsed["promotions"], lines)
    rejects = voided.withColumn("reason", F.lit("missing_promotion_linked_line")).unionByName(
        parsed["payments"].where("amount_cents <= 0").select("receipt_id", F.lit("payment_not_positive").alias("reason")).distinct()
    )
    bad = rejects.select("receipt_id").distinct()
    source = documents.select("document_id", "store_id", "parser_format")
    receipts = parsed["receipts"].drop("store_id", "parser_format").join(source, "document_id")

    def kept(table: DataFrame) -> DataFrame:
        return table.join(bad, "receipt_id", "left_anti")

    return {
        "receipts": kept(receipts).withColumn("purchase_month", F.date_format("purchased_at", "yyyy-MM")),
        "receipt_lines": kept(lines),
        "receipt_promotions": kept(linked),
        "receipt_payments": kept(parsed["payments"]),
        "rejects": rejects,
    }


def write_receipt_graph(graph: dict[str, DataFrame], path: str, batch: str) -> None:
    """Write the tables of one batch as Parquet; receipts are partitioned by purchase month.

    A batch has a folder of its own in each table and replaces it, so a retry leaves no row twice.
    """
    for name, table in graph.items():
        writer = table.write.mode("overwrite")
        if name == "receipts":
            writer = writer.partitionBy("purchase_month")
        writer.parquet(f"{path}/{name}/batch={batch}")


def read_receipt_graph(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of all batches."""
    return spark.read.parquet(f"{path}/{name}")
