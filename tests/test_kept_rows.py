"""Rows that must not get lost: unknown formats, late arrivals, re-uploads, unchecked references."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ticketlake.operators import audit, catalogue, classify, formats  # noqa: F401
from ticketlake.operators.receipt_text import parse_corpus
from ticketlake.streaming import jobs


def test_null_and_unknown_formats_allow_every_store(spark):
    stores = spark.createDataFrame([(1, "physical"), (2, "drive"), (3, "click_collect")], "store_id int, channel string")
    wanted = spark.createDataFrame([("a", None), ("b", "other.v1"), ("c", "u.paper.v1"), ("d", "u.paper.v1")], "document_id string, parser_format string")
    scope = {}
    for r in classify.store_scope_for_format(stores, wanted).collect():
        scope.setdefault(r.parser_format, []).append(r.store_id)
    assert {k: sorted(v) for k, v in scope.items()} == {None: [1, 2, 3], "other.v1": [1, 2, 3], "u.paper.v1": [1]}


def test_documents_without_a_parser_keep_a_receipt(spark):
    docs = spark.createDataFrame([("a", None, "x"), ("b", "other.v1", "x")], "document_id string, parser_format string, text string")
    found = {r.document_id: r for r in parse_corpus(docs, "receipts", ["u.paper.v1"]).collect()}
    assert {k: r.parser_warnings[0].detail for k, r in found.items()} == {
        "a": "Parser failed: no receipt format",
        "b": "Parser failed: unknown receipt format other.v1",
    }
    assert all(r.parser_status == "needs_review" and r.total_cents is None for r in found.values())
    assert parse_corpus(docs, "lines", ["u.paper.v1"]).count() == 0


RECEIPT = "receipt_id int, store_id int, register_number string, ticket_number string, purchased_at timestamp_ntz, total_cents int, created_at timestamp_ntz"


def in_batches(spark, folder, schema, *batches):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{n}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/in")


def test_late_arrivals_are_the_duplicates(spark, tmp_path):
    bought, late, early = dt.datetime(2024, 1, 5, 10), dt.datetime(2024, 2, 2), dt.datetime(2024, 1, 6)
    stored = [(1, 7, "r", "t", bought, 500, late), (2, 7, "r", "u", bought + dt.timedelta(hours=1), 800, late)]
    # The same ticket as 1, and a suspect of 2; both claim to be older than what is stored.
    arriving = [(3, 7, "r", "t", bought, 500, early), (4, 7, "s", "v", bought, 800, early)]
    stream = in_batches(spark, tmp_path, RECEIPT, stored, arriving)
    jobs.run_available(stream, jobs.duplicates_job(str(tmp_path)), str(tmp_path))
    found = {(r.receipt_id, r.outcome, r.other) for r in spark.read.parquet(f"{tmp_path}/outcomes").collect()}
    assert found == {(3, "rejected", 1), (4, "suspected", 2)}


def test_uploads_are_answered_with_the_first_id(spark, tmp_path):
    stream = in_batches(spark, tmp_path, "document_id int, content_hash string, ingested_at int", [(1, "a", 5), (2, "b", 5)], [(3, "a", 1), (4, "c", 2), (5, "c", 1)])
    jobs.run_available(stream, jobs.register_job(f"{tmp_path}/documents"), str(tmp_path))
    answers = {r.document_id: r.registered_id for r in spark.read.parquet(f"{tmp_path}/documents_answers").collect()}
    assert answers == {1: 1, 2: 2, 3: 1, 4: 5, 5: 5}


def test_references_that_cannot_be_checked_are_named(spark):
    stores = spark.createDataFrame([(1, 9)], "store_id int, retail_brand_id int")
    brands = spark.createDataFrame([(8,)], "retail_brand_id int")
    found = {r.reference: (r.orphans, r.state) for r in audit.audit_foreign_keys({"stores": stores, "retail_brands": brands}).collect()}
    assert len(found) == len(audit.FOREIGN_KEYS)
    assert found.pop("stores.retail_brand_id") == (1, "checked")
    assert set(found.values()) == {(None, "not_checked")}
    with pytest.raises(ValueError, match="product_brands.retail_brand_id"):
        audit.restricted_deletes("retail_brands", brands, {"stores": stores})


def test_moves_and_parents_by_path(spark):
    tree = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, None, "d")], "category_id int, parent_id int, name string")
    paths = catalogue.category_paths(tree).persist()
    moves = spark.createDataFrame([(1, 3), (1, 4), (2, 2), (9, 9), (3, 1)], "category_id int, new_parent_id int")
    assert {tuple(r) for r in catalogue.invalid_moves(moves, paths).collect()} == {(1, 3), (2, 2), (9, 9)}
    allowed = {(r.category_id, r.parent_id, r.breadcrumb) for r in catalogue.valid_parents([2, 4], paths).collect()}
    assert allowed == {(2, 1, "a"), (2, 4, "d"), (4, 1, "a"), (4, 2, "a > b"), (4, 3, "a > b > c")}


def test_first_addition_in_order_counts(spark):
    schema = "group_id int, variant_id int, equivalence string"
    additions = spark.createDataFrame([(1, 1, "equivalent"), (1, 1, "different_size")], schema)
    none = spark.createDataFrame([], schema)
    assert [r.equivalence for r in catalogue.membership_changes(none, additions, none).collect()] == ["different_size"]
    assert catalogue.membership_changes(additions.where(F.col("equivalence") == "equivalent"), additions, none).count() == 1
