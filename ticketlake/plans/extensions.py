"""User-supplied formats, detection rules and validators on the benchmark tables."""

from pyspark.sql import functions as F

from ticketlake.functions import warnings
from ticketlake.operators import classify, reconcile
from ticketlake.operators import receipt_text as parsing
from ticketlake.plans.parsing import rendered
from ticketlake.plans.registry import query

ITEM = r"(?d)\A(.+?) ; (\d+\.\d{2})\z"


def stall_marks(documents):
    """I item, L any other line; the body is the whole text."""
    return parsing.bounded(documents, parsing.letters("L", ("I", parsing.matching(ITEM))), "1", "0")


def stall_body(documents):
    row = parsing.captured_row(
        line_index=F.col("line_no"), raw_text=F.col("line"), printed_label=F.regexp_extract("line", ITEM, 1),
        printed_total=F.regexp_extract("line", ITEM, 2), kind=F.lit("item"),
    )
    return parsing.captured_rows(parsing.at_places(documents, parsing.body_places("I")), row)


STALL = parsing.FormatSpec(
    name="stall.paper.v1",
    headers={"when": r"\ADate (\d{4})-(\d{2})-(\d{2})\z", "sum": r"\ASomme (\d+\.\d{2})\z"},
    fields={"total": ("sum", 1)},
    date=parsing.DateRule("when", year=1, month=2, day=3),
    mark=stall_marks,
    body=stall_body,
    payment=r"\A(ESPECES) (\d+\.\d{2})\z",
)


@query("register_format", """SELECT o_orderkey AS document_id, date_trunc('day', o_orderdate)::TIMESTAMP AS purchased_at, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS total_cents,
    CASE WHEN o_orderkey % 4 = 0 THEN 'needs_review' ELSE 'parsed' END AS parser_status FROM orders""")
def register_format(t):
    parsing.register_format(STALL)
    paid = "if(k % 4 = 0, cents + 2, cents)"
    texts = rendered(
        t, "concat('Date ', date_format(at, 'yyyy-MM-dd'))", "concat('POMMES ; ', cents div 100, '.', lpad(cast(cents % 100 as string), 2, '0'))",
        "concat('Somme ', cents div 100, '.', lpad(cast(cents % 100 as string), 2, '0'))", f"concat('ESPECES ', {paid} div 100, '.', lpad(cast({paid} % 100 as string), 2, '0'))",
    ).selectExpr("document_id", "'stall.paper.v1' as parser_format", "text")
    return parsing.parse_corpus(texts, "receipts", ["stall.paper.v1"]).select("document_id", "purchased_at", "total_cents", "parser_status")


@query("register_detection_rule", "SELECT doc_id AS document_id, 'stall.paper.v1:stall_number' AS found FROM documents WHERE regexp_matches(text, '[0-9]{16}')")
def register_detection_rule(t):
    rules = [*classify.DETECTION_RULES, classify.DetectionRule("stall.paper.v1", "hard", "stall_number", "[0-9]{16}")]
    found = t.table("documents").select(F.col("doc_id").alias("document_id"), F.inline(classify.match_format_rules(F.col("text"), rules)))
    return found.where("format = 'stall.paper.v1'").select("document_id", F.concat_ws(":", "format", "marker").alias("found"))


def dear_lines(receipts, lines, payments):
    """A validator: no single line above 1,000 euros."""
    highest = lines.groupBy("receipt_id").agg(F.max("total_cents").alias("_top")).where("_top > 10000000")
    return highest.select("receipt_id", warnings.build_warning("line_too_dear", F.lit("Line above limit"), "validate_line_limit", F.col("_top")).alias("warning"))


@query("register_validator", "SELECT receipt_id, CASE WHEN max(total_cents) > 10000000 THEN 'line_too_dear' ELSE '' END AS codes FROM lines_v GROUP BY 1")
def register_validator(t):
    receipts = t.checked_receipts.withColumn("parser_warnings", F.array().cast(f"array<{warnings.WARNING_TYPE}>"))
    checked = reconcile.apply_validators(receipts, t.lines, t.checked_payments, [dear_lines])
    return checked.select("receipt_id", F.array_join(F.transform("parser_warnings", lambda w: w["code"]), ",").alias("codes"))
