"""Cheap signs and single passes in front of the patterns of receipt lines."""

import pytest
from pyspark.sql import functions as F

from ticketlake.operators import formats  # noqa: F401  (registers the shipped formats)
from ticketlake.operators.receipt_text import FORMATS, SIGNS, groups, matching, parse_format

LINES = """Caisse 012-0304 07 août 2025 18:05
07/08/25 0 4B2C 11A22|Ticket 07/08/25 0 4B|>> FRAIS|>>>> RAYON|Total 5 articles 9.50|Total 1 article 4.50|-----|-|BONS DE REDUCTION
(A) Dont DEEE / DEA : 0.10|(b) prix hors contributions :|bon ACHAT carte 2.00|Bon achat carte 2.00|cb 7.50|CB (T restau) 7.50|CYCLEEN 1.00
cumul disponible|Cumul points FIDÉLITÉ Amazones/Jeannerie|vous avez obtenu : 12 points|Vous venez d'utiliser 3 Vignette(s) X|--- Vos vignettes PYREX|opération vignette Y
CAFE -1.00|CAFE 1.00|2 X 1.50€ 3.00|TTC TVA|CAFE 3.40 2|4 X 2.25€ 9.00 2|2 20%00 10.33 2.07 12.40|Caisse Drive 4-1 - 7 sept. 2024|CB Web Retrait 8.50
*OEUFS 2,60|SAVON.. 2*1,20 1,90|Le 02 février 2024 à 17:20:31|Caisse : 58 Ticket : 70012|Hôte(sse) : 208|Total 11,80 €|5 Articles|Reçu CARTE 6,80
== Début Selfscan ==|Fin Selfscan|Articles avec Remise|Total|x lecture PARTIELLE|NOUVEAU SCAN|Nouveau ſcan|+ ANNULATION 1,00|votre compte WAAOH|CAGNOTTE x waaoh
carte u solde avant ticket 7,20 €|Carte U solde après ticket 6,00 €|4 VIGNETTE(S) JBL offerte(s)|58  QT   29/11/24   20:14   3   771204|SEL 0,95 €   12
3 x 1,10 € 3,30 € 14|0,340 KG x 15,00 €/kg 5,10 €|TOTAL 5 Article(s) 9,35 €|=====|ESPÈCES 9,35 €|CB X EUR 9,35 €|12 / 20,00 5,04 € 1,01 € 6,05 €|*** VENTE ***
2 x 1,25 EUR|COMTE (T) 6,40 € 22|TOTAL [3] Articles 8,90 €|Nombre de lignes d'article 2|CB TRD 6,40 €|21 20,00 0,42 € 2,08 € 2,50 €|29/11/24 20:31:05 61044 007 319 20077""".replace("\n", "|").split("|")


def test_signs_lose_no_match(spark):
    lines = spark.createDataFrame([(line,) for line in LINES], "line string")
    shown = [matching(pattern)(F.col("line")).alias(f"s{n}") for n, pattern in enumerate(SIGNS)]
    asked = [F.col("line").rlike(pattern).alias(f"r{n}") for n, pattern in enumerate(SIGNS)]
    for row in lines.select("line", *shown, *asked).collect():
        for n, pattern in enumerate(SIGNS):
            assert row[f"s{n}"] == row[f"r{n}"], (row.line, pattern)
    # Each pattern was met by a line that it matches.
    counts = lines.select(*[F.count_if(F.col("line").rlike(p)).alias(f"c{n}") for n, p in enumerate(SIGNS)]).first()
    assert all(counts[f"c{n}"] for n in range(len(SIGNS))), [p for n, p in enumerate(SIGNS) if not counts[f"c{n}"]]


def test_groups_come_from_one_pass(spark):
    one = spark.createDataFrame([("ab 12 tail",), (None,)], "line string")
    found = one.select(groups("line", r"\A(x)?(\w+) (\d+)", 3).alias("g")).collect()
    assert [r.g and r.g[1:4] for r in found] == [["", "ab", "12"], None]


@pytest.mark.parametrize("name", ["leclerc.paper.v1", "auchan.paper.v1"])
def test_promotions_meet_lines_once(spark, name):
    texts = spark.createDataFrame([(1, "a"), (2, "b")], "document_id bigint, text string").repartition(2)
    plan = parse_format(texts, FORMATS[name]).promotions._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("RepartitionByExpression") == 2


def test_receipts_are_judged_once(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b")], "document_id bigint, text string").repartition(2)
    plan = parse_format(texts, FORMATS["leclerc.paper.v1"]).receipts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 3
