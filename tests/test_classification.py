"""Store decisions by signature against evidence listed per document and store."""

import random

from ticketlake.operators import classify

STORES = "store_id bigint, retail_brand_id bigint, location_name string, channel string, legal_entities array<string>"


def fixture(spark):
    """Brands of several stores that share an alias, legal entities of several stores, and one alias that is also a place."""
    channels = ["physical", "drive", "click_collect"]
    rows = [(i, i % 3, f"place number {i}" if i else "brand one", channels[i % 3], ["entity even"] if i % 2 == 0 else []) for i in range(12)]
    brands = spark.createDataFrame([(b, [f"brand {n}"]) for b, n in enumerate(["zero", "one", "two"])], "retail_brand_id bigint, aliases array<string>")
    stores = spark.createDataFrame(rows, STORES)
    chance = random.Random(5)
    words = ["brand zero", "brand one", "brand two", "entity even", "CB Web Drive", "*** VENTE ***", "Selfscan", "nothing", ""]
    words += [f"place number {i}" for i in range(12)]
    docs = [(i, "\n".join(chance.choices(words, k=chance.randint(0, 4))), chance.choice([None, None, "u.paper.v1"]), chance.choice([None, None, 4])) for i in range(150)]
    docs += [(900, None, None, None), (901, "", None, None), (902, "brand one\n" * 3000, None, None), (903, "brand one", None, None)]
    defaults = spark.createDataFrame([(i, "u.paper.v2") for i in range(0, 12, 2)], "store_id bigint, default_parser_format string")
    documents = spark.createDataFrame(docs, "document_id bigint, text string, hint_format string, hint_store bigint")
    return documents, classify.store_hints(stores, brands), defaults


def by_document(documents, hints, defaults):
    """Store decisions with one row per document and store."""
    formats = classify.apply_explicit_format(classify.choose_format(documents.withColumn("matches", classify.match_format_rules(documents.text))))
    entries = classify.store_evidence(formats.select("document_id", "parser_format"), classify.hint_hits(documents, hints), hints, defaults)
    return formats, classify.choose_store(entries)


def test_evidence_by_signature_equals_evidence_by_document(spark):
    documents, hints, defaults = fixture(spark)
    formats, stores = by_document(documents, hints, defaults)
    whole = classify.apply_explicit_store(formats.join(stores, "document_id", "left"))
    wanted = {r.document_id: (r.parser_format, r.store_id, r.store_confidence, list(r.format_evidence) + list(r.store_evidence)) for r in whole.collect()}
    found = {r.document_id: (r.parser_format, r.store_id, r.store_confidence, list(r.evidence)) for r in classify.classify_documents(documents, hints, defaults).collect()}
    assert found == wanted and len(found) == 154
    codes = {e.code for row in found.values() for e in row[3]}
    assert {"store_ambiguous", "store_default_parser_format", "store_not_detected", "explicit_store_conflict"} <= codes


def test_bounds_decide_like_lists(spark):
    documents, hints, defaults = fixture(spark)
    formats, stores = by_document(documents, hints, defaults)
    signatures = classify.hint_signatures(formats, classify.hint_hits(documents, hints))
    decided = signatures.join(classify.decide_stores(signatures, hints), "signature").collect()
    listed = {r.document_id: (r.detected_store, len(r.detected_stores) > 1) for r in stores.collect()}
    assert {r.document_id: (r.detected_store, r.many) for r in decided} == listed


def test_texts_are_scanned_twice_and_no_row_is_made_per_document_and_store(spark, tmp_path, monkeypatch):
    documents, hints, defaults = fixture(spark)
    documents.write.parquet(str(tmp_path / "texts"))
    plans, sizes = [], []
    keep = classify.durable

    def recorded(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        kept = keep(frame)
        sizes.append((kept.columns, kept.count()))
        return kept

    monkeypatch.setattr(classify, "durable", recorded)
    stored = spark.read.parquet(str(tmp_path / "texts"))
    many = stored.unionByName(stored.withColumn("document_id", stored.document_id + 10_000)).unionByName(stored.withColumn("document_id", stored.document_id + 20_000))
    result = classify.classify_documents(stored, hints, defaults)
    plans.append(result._jdf.queryExecution().executedPlan().toString())
    scans = [line for plan in plans for line in plan.splitlines() if "FileScan parquet" in line and "text" in line.split("Batched")[0]]
    assert len(scans) == 2
    with_stores = [n for columns, n in sizes if "store_id" in columns and "document_id" in columns]
    sizes.clear()
    classify.classify_documents(many, hints, defaults)
    # Three times the documents, and as many rows with stores: they belong to signatures.
    assert [n for columns, n in sizes if "store_id" in columns and "document_id" in columns] == with_stores


def test_tables_without_documents_or_hints(spark):
    documents, hints, defaults = fixture(spark)
    assert classify.classify_documents(documents.limit(0), hints, defaults).count() == 0
    rows = classify.classify_documents(documents, hints.limit(0), defaults).collect()
    assert len(rows) == 154 and all(r.evidence[-1].code in {"store_not_detected", "explicit_store"} for r in rows)
