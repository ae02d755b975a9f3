"""Queries that take their whole table and do all their work."""

import datetime

from ticketlake.operators import classify, receipt_text
from ticketlake.plans import QUERIES
from ticketlake.plans.classification import hints, texts
from ticketlake.plans.inputs import Inputs
from ticketlake.streaming import jobs

DAY = datetime.datetime(2024, 5, 1)


def test_pairs_are_made_for_every_item_line(spark, tmp_path):
    parts = [(n, "red bolt", "Brand#1", "LARGE", 1, 900.0) for n in range(2)] + [(2, "hot ring", "Brand#1", "LARGE", 1, 900.0)]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    # One line for each tax step: 5 confirms a variant of its label, 7 rejects its own.
    lines = [(order, 0, 1, 1, 2.0, 3.0, 0.0, order / 100, flag, "O", DAY) for flag, first in (("N", 0), ("R", 100)) for order in range(first, first + 9)]
    lines += [(200, 1, 1, 1, 2.0, 3.0, 0.0, 0.05, "N", "O", DAY), (300, 2, 1, 1, 2.0, 3.0, 0.0, 0.0, "N", "O", DAY)]
    schema = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(lines, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = sorted((int(r.line_id.split("-")[0]), r.variant_id) for r in QUERIES["exclude_rejected_pairs"](spark, str(tmp_path)).collect())
    assert found == sorted((order, variant) for order in [*range(9), 200] for variant in (0, 1) if (order, variant) != (7, 0))


def test_the_stream_parses_every_part_and_stores_evidence_once(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "stored")
    monkeypatch.setattr(jobs, "workspace", lambda *_: folder)
    web = "Caisse Drive 7-79 - 3 mars 2024\n2 X ARTICLE B 1  4.00\nTotal 2 articles  4.00"
    paper = "Caisse 001-1 03 mars 2024 10:11\nTTC   TVA\nARTICLE B 1   2.00 1\nTotal 1 articles  2.00\nCB   2.00\n1 5%50 1.00 0.10 1.10"
    rows = [(0, web), (8, web), (16, web + "\nrien"), (33, paper), (33, "ARTICLE C 1   1.00 1"), (6, web), (9, paper), (80, web), (128, web), (None, web), (7, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    # Twenty stores share each name, so evidence is longer than the documents.
    stores = [(n, f"Supplier#{n % 10:09d}", n % 5, 0.0) for n in range(200)]
    spark.createDataFrame(stores, "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(n, f"NATION_{n}") for n in range(5)], "n_nationkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    QUERIES["stream_classify_parse"](spark, str(tmp_path)).collect()

    t = Inputs(spark, str(tmp_path))
    hinted = texts(t).selectExpr("*", "if(document_id % 7 = 0, 'leclerc.web.v1', null) as hint_format", "cast(if(document_id % 11 = 0, 5, null) as bigint) as hint_store")
    defaults = t.stores.selectExpr("store_id", "'none' as default_parser_format")
    expected = classify.classify_documents(hinted, hints(t), defaults)
    found = jobs.detections(spark, folder)
    assert sorted(map(str, found.select(*expected.columns).collect())) == sorted(map(str, expected.collect()))
    evidence = spark.read.parquet(f"{folder}/evidence")
    assert evidence.count() < expected.where("document_id is not null").count() and expected.where("size(evidence) > 10").count() > 1
    assert "evidence" not in spark.read.parquet(f"{folder}/detections").columns

    ready = hinted.join(expected.where("status = 'classified'").select("document_id", "parser_format"), "document_id")
    formats = sorted(r[0] for r in ready.select("parser_format").distinct().collect())
    assert formats == ["leclerc.paper.v2", "leclerc.web.v1"]
    for part in ("receipts", "lines"):
        whole = receipt_text.parse_corpus(ready.select("document_id", "parser_format", "text"), part, formats)
        stored = spark.read.parquet(f"{folder}/{part}").drop("batch_id")
        assert sorted(map(str, stored.select(*whole.columns).collect())) == sorted(map(str, whole.collect())), part
    paid = spark.read.parquet(f"{folder}/payments").select("document_id", "amount_cents").collect()
    assert (33, 200) in map(tuple, paid) and (tmp_path / "stored" / "promotions").exists()
    assert not list((tmp_path / "stored" / "work").glob("*"))


def test_receipts_read_texts_once(spark):
    texts = spark.createDataFrame([(1, "Le 03 mars 2024 à 10:11:12\nCaisse : 1 Ticket : 2\nNouveau scan valide"), (None, "x"), (2, None)], "document_id bigint, text string")
    receipts = receipt_text.parse_format(texts, receipt_text.FORMATS["auchan.paper.v1"]).receipts
    # Header, warnings, lines and payments start from one copy of the marked texts.
    assert "RepartitionByExpression" not in receipts._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.document_id or 0, r.parser_status) for r in receipts.collect()) == [(1, "needs_review"), (2, "needs_review")]
