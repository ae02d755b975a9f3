"""Bodies found in a document's letters, without a row for every line."""

import pytest
from pyspark.sql import functions as F

from ticketlake.operators import formats  # noqa: F401  (registers the shipped formats)
from ticketlake.operators.receipt_text import FORMATS, lines_where, parse_format, whole_documents

RECEIPT = "Caisse 1 01 mai 2025 10:00\nCAFE 9.00 \n\n (A) Dont DEEE / DEA : 0.10\n>> FRAIS\nLAIT\n(A) Dont DEEE / DEA : 0.10\n2 X 1.00€ 2.00\nTotal 2 articles 11.00\nCB 11.00\nTHE 1.00"


def shown(plan):
    return plan._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", sorted(FORMATS))
def test_lines_stay_in_the_row_of_their_document(spark, name):
    texts = spark.createDataFrame([(1, "a"), (2, "b")], "document_id bigint, text string").repartition(2)
    parsed = parse_format(texts, FORMATS[name])
    # Headers and failures need no window and no join, so neither do payments.
    for part in (parsed.header, parsed.payments):
        assert "Window" not in shown(part) and "Join" not in shown(part)
    lines = shown(parsed.lines)
    assert "Join" not in lines and "line_no" not in "".join(line for line in lines.splitlines() if "Window [" in line)


def test_pending_labels_pass_over_asides(spark):
    parsed = parse_format(spark.createDataFrame([(1, RECEIPT)], "document_id bigint, text string"), FORMATS["leclerc.paper.v1"])
    rows = sorted(parsed.lines.collect(), key=lambda r: r.position)
    assert [(r.label, r.total_cents, r.section_label, r.raw_text) for r in rows] == [
        ("CAFE", 900, None, "CAFE 9.00"), ("LAIT", 200, "FRAIS", "LAIT\n2 X 1.00€ 2.00"),
    ]
    assert [(r.position, r.amount_cents) for r in parsed.payments.collect()] == [(9, 1100)]


def test_texts_that_share_an_id_are_one_document(spark):
    texts = spark.createDataFrame([(1, "a \n\n b\n\x00c"), (1, "a\nb"), (2, None), (None, "x"), (3, " \n y\t")], "document_id bigint, text string")
    whole = whole_documents(texts)
    found = {r.document_id: (r.copies, r.lines, r.numbers) for r in whole.collect()}
    assert found == {1: (2, ["a", "a", "b", "b", "c"], [1, 1, 2, 2, 3]), 2: (1, [], None), None: (1, ["x"], None), 3: (1, ["y"], None)}
    kept = lines_where(whole, lambda line, place: line != "a", F.col("document_id") > 0)
    assert sorted(tuple(r) for r in kept.collect()) == [(1, 2, "b"), (1, 2, "b"), (1, 3, "c"), (3, 1, "y")]
