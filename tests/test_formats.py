"""Golden parses of hand-written receipts, one group per format."""

import datetime as dt
from decimal import Decimal

import pytest

from ticketlake.operators import formats  # noqa: F401  (registers the shipped formats)
from ticketlake.operators.receipt_text import FORMATS, parse_corpus, parse_format

LECLERC_V1 = """
        HYPER DU TEST
 Caisse 012-0304 07 août 2025 18:05
 07/08/25 0 4B2C 11A22

 >> FRAIS
 YAOURT NATURE X8
      2 X 1.50€            3.00
* POMMES BIO ..            2.40
 (A) Dont DEEE / DEA : 0.10
 FROMAGE RAPE              4.00
   Remise carte           -1.00
 >> BOULANGERIE
 PAIN COMPLET              1.10
                      --------
 Total 5 articles          9.50

 Bon achat carte           2.00
 CB                        7.50
 CUMUL DISPONIBLE
 Cumul points fidélité Amazones/Jeannerie
 Vous avez obtenu : 12 points
 ----------
 Vous avez obtenu : 5 points
 Vous venez d'obtenir 2 Vignette(s) Royal VKB
"""
LECLERC_DETAILS = """
Caisse 012-0304 01 janv 2025 09:00
CAFE MOULU 250G            5.00
Remise immediate          -0.50
Total 1 article            4.50
CB                         4.50
REMISES
Lot cafe                   0.50
Total                      0.50
-------
BONS DE REDUCTION
CAFE MOULU (X1)            0.40
Total Bon immediat         0.40
-------
---- VOS VIGNETTES PYREX ----
Vous venez d'utiliser : 7 Vignette(s)
"""
LECLERC_V2 = """
Caisse 031-0777 23 novembre 2024 17:41
TTC   TVA
>> JARDIN
TERREAU ..
4 X 2.25€                  9.00 2
BOUGIE                     3.40 2
>> BUREAU
CARTE POSTALE              0.60 7
Total 6 articles          13.00
CB                        13.00
2 20%00 10.33 2.07 12.40
"""
WEB = """
 Caisse Drive 412-31 - 7 sept. 2024
 JUS DE RAISIN             1.80
 FRAIS DE LIVRAISON 5.5%   2.50
 3 X COMPOTE               4.20
 Total 4 articles          8.50
 CB Web Retrait            8.50
 SUITE                     1.00
"""
AUCHAN = """
Le 02 février 2024 à 17:20:31
Caisse : 58 Ticket : 70012
Hôte(sse) : 208
== Début Selfscan ==
THE VERT 3,30
*OEUFS FRAIS.. 2,60
> Livraison offerte
Fin Selfscan
PILES 4,00
Articles avec Remise
SAVON.. 2*1,20 1,90
BON FIDELE -0,50
TOTAL REMISES -0,50
Total 11,80 €
Reçu CARTE BANCAIRE 6,80
Reçu ESPECES 5,00
Lecture partielle incorrecte
5 Articles
VOTRE COMPTE WAAOH
Crédit du jour : 0,25 €
SAVON DOUX 0,25
Nouveau solde : 6,10 €
"""
U_V1 = """
58  QT   29/11/24   20:14   3   771204
>>>> EPICERIE
SEL FIN                   0,95 €   12
>>>> VRAC
AMANDES    12
0,340 kg x    15,00 €/kg    5,10 €
>>>> FRAIS
NOIX DE COCO
3 x    1,10 €    3,30 €    14
=====
TOTAL    5 Article(s)    9,35 €
ESPÈCES    9,35 €
12 / 20,00    5,04 €    1,01 €    6,05 €
Carte U solde avant ticket   7,20 €
Carte U solde après ticket   6,00 €
4 vignette(s) VERRES offerte(s)
"""
U_V2 = """
*** VENTE ***
BAZAR
BOUGIES                      2,50 €      21
2 x        1,25 EUR
ARTICLE SANS SUITE           3,33 €      29
FROMAGERIE
COMTE                 (T)    6,40 €      22
1 x        6,40 EUR
TOTAL [3] Articles           8,90 €
Nombre de lignes d'article 2
CB SANS CONTACT              2,50 €
CB TRD                       6,40 €
21 20,00         0,42 €      2,08 €      2,50 €
22  5,50         0,33 €      6,07 €      6,40 €
29/11/24 20:31:05 61044   007         319    20077
"""


def parse(spark, name, body):
    docs = spark.createDataFrame([("d", name, body)], "document_id string, parser_format string, text string")
    out = parse_format(docs, FORMATS[name])
    receipt = out.receipts.collect()[0]
    lines = [r for r in out.lines.orderBy("position").collect()]
    promotions = [r for r in out.promotions.orderBy("rule_order", "line_no").collect()]
    payments = [r for r in out.payments.orderBy("position").collect()]
    return receipt, lines, promotions, payments


def test_leclerc_paper_v1(spark):
    receipt, lines, promotions, payments = parse(spark, "leclerc.paper.v1", LECLERC_V1)
    assert receipt.purchased_at == dt.datetime(2025, 8, 7, 18, 5)
    assert (receipt.register_number, receipt.ticket_number) == ("012-0304", "4B2C 11A22")
    assert (receipt.total_cents, receipt.declared_article_count, receipt.parser_status) == (950, 5, "parsed")
    assert [(x.label, x.total_cents, x.kind, x.section_label) for x in lines] == [
        ("YAOURT NATURE X8", 300, "item", "FRAIS"),
        ("POMMES BIO", 240, "item", "FRAIS"),
        ("FROMAGE RAPE", 400, "item", "FRAIS"),
        ("Remise carte", -100, "discount", "FRAIS"),
        ("PAIN COMPLET", 110, "item", "BOULANGERIE"),
    ]
    assert lines[0].quantity == Decimal("2.000") and lines[0].unit_price_cents == 150
    assert lines[1].label_truncated and lines[1].raw_text == "* POMMES BIO ..            2.40"
    assert [(p.category, p.amount_cents) for p in payments] == [("other", 200), ("bank_card", 750)]
    assert [(p.program, p.delta, p.label, p.kind) for p in promotions] == [
        ("leclerc_bon_achat_carte", -200, "Bon achat carte", "coupon"),
        ("leclerc_tickets", -200, "CUMUL DISPONIBLE", "coupon"),
        ("leclerc_points_amazones_jeannerie", 12, "Amazones/Jeannerie", "points_accrual"),
        ("leclerc_vignettes_royal_vkb", 2, "Royal VKB", "points_accrual"),
    ]


def test_leclerc_detail_sections_replace_inline_discounts(spark):
    receipt, lines, promotions, _ = parse(spark, "leclerc.paper.v1", LECLERC_DETAILS)
    assert [(x.label, x.total_cents, x.kind) for x in lines] == [("CAFE MOULU 250G", 500, "item"), ("Lot cafe", -50, "discount")]
    assert receipt.parser_status == "parsed"
    assert [(p.program, p.delta, p.linked_line_position, p.linking_method) for p in promotions] == [
        ("leclerc_bon_immediat", -40, 1, "parser_inferred"),
        ("leclerc_vignettes_pyrex", -7, None, "unallocated"),
    ]


def test_leclerc_paper_v2_vat_table(spark):
    receipt, lines, _, _ = parse(spark, "leclerc.paper.v2", LECLERC_V2)
    assert receipt.purchased_at == dt.datetime(2024, 11, 23, 17, 41)
    assert [(x.label, x.quantity, x.total_cents, x.vat_rate_bp, x.section_label) for x in lines] == [
        ("TERREAU", 4, 900, 2000, "JARDIN"),
        ("BOUGIE", 1, 340, 2000, "JARDIN"),
        ("CARTE POSTALE", 1, 60, None, "BUREAU"),
    ]
    assert receipt.parser_status == "needs_review"
    assert [(w.code, w.detail) for w in receipt.parser_warnings] == [("missing_vat_code", "No VAT table row found for code 7")]


def test_leclerc_web(spark):
    receipt, lines, promotions, payments = parse(spark, "leclerc.web.v1", WEB)
    assert receipt.purchased_at == dt.datetime(2024, 9, 7)
    assert [(x.label, x.quantity, x.kind, x.vat_rate_bp) for x in lines] == [
        ("JUS DE RAISIN", 1, "item", None),
        ("FRAIS DE LIVRAISON 5.5%", 1, "fee", 550),
        ("COMPOTE", 3, "item", None),
    ]
    assert receipt.parser_status == "parsed" and promotions == []
    assert [(p.category, p.position) for p in payments] == [("web", 6)]


def test_auchan_paper(spark):
    receipt, lines, promotions, payments = parse(spark, "auchan.paper.v1", AUCHAN)
    assert (receipt.register_number, receipt.ticket_number, receipt.cashier_code) == ("58", "70012", "208")
    assert [(x.label, x.total_cents, x.kind, x.section_label, x.tr_eligible) for x in lines] == [
        ("THE VERT", 330, "item", "Selfscan", False),
        ("OEUFS FRAIS", 260, "item", "Selfscan", True),
        ("PILES", 400, "item", None, False),
        ("SAVON", 240, "item", "Articles avec Remise", False),
        ("BON FIDELE", -50, "discount", "Articles avec Remise", False),
    ]
    assert receipt.parser_status == "needs_review"
    assert [w.code for w in receipt.parser_warnings] == ["auchan_selfscan_warning"]
    assert [(p.label, p.delta, p.linked_line_position) for p in promotions] == [("Crédit du jour", 25, None), ("SAVON DOUX", 25, 4)]
    assert [p.category for p in payments] == ["bank_card", "cash"]


def test_u_paper_v1(spark):
    receipt, lines, promotions, payments = parse(spark, "u.paper.v1", U_V1)
    assert receipt.purchased_at == dt.datetime(2024, 11, 29, 20, 14)
    assert receipt.cashier_code == "58  QT"
    assert [(x.label, x.quantity, x.unit_of_measure, x.total_cents, x.vat_rate_bp, x.section_label) for x in lines] == [
        ("SEL FIN", 1, "piece", 95, 2000, "EPICERIE"),
        ("AMANDES", Decimal("0.340"), "kg", 510, 2000, "VRAC"),
        ("NOIX DE COCO", 3, "piece", 330, None, "FRAIS"),
    ]
    assert lines[1].raw_text == "AMANDES 12\n0,340 kg x    15,00 €/kg    5,10 €"
    assert [(p.program, p.delta) for p in promotions] == [("u_carte_u", -120), ("u_vignettes", 4)]
    assert [w.detail for w in receipt.parser_warnings] == ["No VAT table row found for code 14"]
    assert [p.category for p in payments] == ["cash"]


def test_u_paper_v2(spark):
    receipt, lines, _, payments = parse(spark, "u.paper.v2", U_V2)
    assert receipt.purchased_at == dt.datetime(2024, 11, 29, 20, 31, 5)
    assert (receipt.register_number, receipt.cashier_code, receipt.ticket_number) == ("007", "319", "20077")
    assert [(x.label, x.total_cents, x.section_label, x.tr_eligible, x.vat_rate_bp) for x in lines] == [
        ("BOUGIES", 250, "BAZAR", False, 2000),
        ("COMTE", 640, "FROMAGERIE", True, 550),
    ]
    assert [p.category for p in payments] == ["bank_card", "tickets_restaurant"]


@pytest.mark.parametrize(
    ("name", "body", "reason"),
    [
        ("leclerc.paper.v1", "Caisse 1 01 mai 2025 10:00\n>> RAYON\n2 X 1.00€ 2.00\nTotal 2 articles 2.00", "quantity line without a label"),
        ("leclerc.paper.v1", "Caisse 1 01 brumaire 2025 10:00\nA 1.00\nTotal 1 article 1.00", "unreadable purchase date"),
        ("u.paper.v2", "*** VENTE ***\n1 x 1,00 EUR\nTOTAL [1] Articles 1,00 €", "quantity line without a label"),
        ("auchan.paper.v1", "Hôte(sse) : 1\nA 1,00", "no receipt total"),
        ("leclerc.web.v1", "   \n", "no receipt total"),
    ],
)
def test_failures_keep_a_bare_receipt(spark, name, body, reason):
    receipt, lines, promotions, payments = parse(spark, name, body)
    assert (lines, promotions, payments) == ([], [], [])
    assert receipt.parser_status == "needs_review" and receipt.purchased_at is None
    assert [(w.code, w.detail) for w in receipt.parser_warnings] == [("parser_exception", f"Parser failed: {reason}")]


def test_corpus_routes_by_format_with_one_text_shuffle(spark):
    docs = spark.createDataFrame(
        [("a", "leclerc.paper.v1", LECLERC_V1), ("b", "u.paper.v1", U_V1), ("c", "auchan.paper.v1", AUCHAN)],
        "document_id string, parser_format string, text string",
    )
    counts = parse_corpus(docs, "lines").groupBy("document_id").count().collect()
    assert {r.document_id: r["count"] for r in counts} == {"a": 5, "b": 3, "c": 5}
    single = parse_format(docs.where("parser_format = 'u.paper.v1'"), FORMATS["u.paper.v1"]).lines
    plan = single._jdf.queryExecution().executedPlan().toString()
    exchanges = {line.split("hashpartitioning(")[1].split(",")[0].split("#")[0] for line in plan.splitlines() if "hashpartitioning(" in line}
    assert exchanges == {"document_id"}
