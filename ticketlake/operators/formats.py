"""The six shipped receipt formats.

Patterns are fixed values (they decide which texts match). Each body marks a document's lines with
letters; where items start and finish, the section label and the pending label of a line are found
in that string. Promotion rules are windows over the few lines they mention.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlake.functions import money, text, warnings
from ticketlake.operators.receipt_text import (
    SIGNS,
    DateRule,
    FormatSpec,
    after,
    at_places,
    before,
    body_places,
    bounded,
    captured_row,
    captured_rows,
    cents_after,
    first_of,
    group_of,
    groups,
    has,
    last_place,
    letter_at,
    letters,
    letters_to,
    line_at,
    lines_where,
    matching,
    promotion,
    promotion_rows,
    register_format,
    starts,
    up_to,
    whole,
)

# Leclerc paper patterns.
LECLERC = {
    "header": r"(?d)\ACaisse (\S+) (\d{2}) (\p{L}+) (\d{4}) (\d{2}):(\d{2})\z",
    "ticket": r"(?d)\A(?:Ticket )?\d{2}/\d{2}/\d{2}\s+\d+\s+(.+)\z",
    "section": r"(?d)\A>>\s+(.+)\z",
    "total": r"(?d)\ATotal (\d+) articles?\s+(\d+\.\d{2})\z",
    "separator": r"\A-+\z",
    "remises": r"\AREMISES\z",
    "bons": r"\ABONS DE REDUCTION\z",
    "detail_total": r"\ATotal(?![\p{L}\p{N}_])",
    "contribution": r"(?diu)\A\([A-Z]\)\s+(?:Dont\s+DEEE\s*/\s*DEA|Prix\s+hors\s+contributions)\s*:",
    "payment": r"(?diu)\A(CB(?:\s+\(T\s*restau\))?|Bon achat carte|Bon immediat|CYCLEEN)\s+(\d+\.\d{2})\z",
    "bon_achat": r"(?d)\ABon achat carte\s+(\d+\.\d{2})\z",
    "cumul": r"(?iu)\ACUMUL DISPONIBLE\z",
    "points_section": r"(?diu)\ACumul points fidélité (Amazones/Jeannerie)\z",
    "points_accrual": r"(?diu)\A(?:Vous venez d'obtenir|Vous avez obtenu)\s*:?\s*(\d+)\s+points?\z",
    "points_consumption": r"(?diu)\A(?:Vous venez d'utiliser|Vous avez utilisé)\s*:?\s*(\d+)\s+points?\z",
    "vignette_accrual": r"(?diu)\A(?:Vous venez d'obtenir|Vous avez obtenu)\s*:?\s*(\d+)\s+Vignette\(s\)(?:\s+(.+))?\z",
    "vignette_consumption": r"(?diu)\A(?:Vous venez d'utiliser|Vous avez utilisé)\s*:?\s*(\d+)\s+Vignette\(s\)(?:\s+(.+))?\z",
    "vignette_section": r"(?diu)\A(?:-+\s*)?VOS VIGNETTES\s+(.+)\z",
    "vignette_operation": r"(?diu)\AOP[ÉE]RATION VIGNETTES?\s+(.+)\z",
    "detail": r"(?d)\A(.+?)\s+(\d+\.\d{2})\z",
}
# What differs between the two Leclerc paper layouts.
LECLERC_V1 = {
    "item": r"(?d)\A(.+?)\s+(\d+\.\d{2})\z",
    "discount": r"(?d)\A(.+?)\s+(-\d+\.\d{2})\z",
    "quantity": r"(?d)\A(\d+(?:[,.]\d+)?)\s+X\s+(\d+\.\d{2})€\s+(\d+\.\d{2})\z",
}
LECLERC_V2 = {
    "body_header": r"\ATTC\s+TVA\z",
    "item": r"(?d)\A(.+?)\s+(\d+\.\d{2})\s+(\d+)\z",
    "quantity": r"(?d)\A(\d+(?:[,.]\d+)?)\s+X\s+(\d+\.\d{2})€\s+(\d+\.\d{2})\s+(\d+)\z",
    "vat_row": r"(?d)\A(\d+)\s+(\d+)%\s*(\d{2})\s+[-\d.]+\s+[-\d.]+\s+[-\d.]+\z",
}
# Leclerc web patterns.
WEB = {
    "date": r"(?d)\ACaisse(?: Drive)? \S+ - (\d{1,2}) (\p{L}+\.?) (\d{4})\z",
    "line": r"(?d)\A(.+?)\s+(\d+\.\d{2})\z",
    "total": r"(?d)\ATotal (\d+) articles?\s+(\d+\.\d{2})\z",
    "payment": r"(?d)\A(CB Web .+?)\s+(\d+\.\d{2})\z",
    "counted": r"(?d)\A(\d+) X (.+)\z",
    "fee": "FRAIS DE LIVRAISON",
}
# Auchan paper patterns.
AUCHAN = {
    "item": r"(?d)\A(\*)?(.+?)\s+(?:(\d+(?:[,.]\d+)?)\*(\d+,\d{2})\s+)?(-?\d+,\d{2})\z",
    "date": r"(?d)\ALe (\d{2}) (\p{L}+) (\d{4}) à (\d{2}):(\d{2}):(\d{2})\z",
    "register": r"(?d)\ACaisse\s*:\s*(\d+)\s+Ticket\s*:\s*(\d+)\z",
    "cashier": r"\AHôte\(sse\)\s*:\s*(\S+)",
    "total": r"\ATotal (\d+,\d{2}) €\z",
    "count": r"\A(\d+) Articles\z",
    "payment": r"(?d)\AReçu (.+?)\s+(\d+,\d{2})\z",
    "selfscan_start": "Début Selfscan",
    "selfscan_end": "Fin Selfscan",
    "discounts": r"\AArticles avec Remise\z",
    "end": r"\ATotal(?![\p{L}\p{N}_])",
    "host": r"Hôte\(sse\)\s*:",
    "scan_warning": r"(?iu)Lecture partielle|Nouveau scan",
    "severe": r"(?iu)incorrect",
    "correction": r"(?d)\A[+-]\s*\S.*\s+\d+,\d{2}\z",
    "noise": r"\A(?:TOTAL REMISES|TVAS|Brut|Montant total des remises|Reçu |TOT\. |VOTRE COMPTE|\(|>)",
    "account": r"(?diu)\A(?:VOTRE COMPTE|CAGNOTTE).+WAAOH",
    "account_end": r"\A(?:(?:Reçu|Merci|TVAS|Brut|\d+ Articles|Total)(?![\p{L}\p{N}_])|TOT\.(?=[\p{L}\p{N}_\s]))",
    "information": r"(?iu)\A(?:Votre solde|Nouveau solde|Jusqu'au)(?![\p{L}\p{N}_])",
    "day_event": r"(?diu)\A(Crédit du jour|Débit du jour)\s*:\s*(\d+,\d{2})\s*(?:€)?\z",
    "credit": r"(?d)\A(.+?)\s+(\d+,\d{2})\s*(?:€)?\z",
}
SELFSCAN_SECTION = "Selfscan"
DISCOUNT_SECTION = "Articles avec Remise"
# Magasins U patterns common to both layouts.
U = {
    "before": r"(?diu)\ACarte U\s+solde\s+avant(?![\p{L}\p{N}_]).*?(\d+,\d{2})\s€?\z",
    "after": r"(?diu)\ACarte U\s+solde\s+apr[eè]s(?![\p{L}\p{N}_]).*?(\d+,\d{2})\s€?\z",
    "vignettes": r"(?diu)\A(\d+)\s+vignette\(s\)\s+(.+?)\s+offertes?(?:\(s\))?\z",
}
U_V1 = {
    "header": r"(?d)\A(\d+\s+\S+)\s+(\d{2})/(\d{2})/(\d{2})\s+(\d{2}):(\d{2})\s+(\d+)\s+(\d+)\z",
    "section": r"(?d)\A>>>>\s+(.+)\z",
    "item": r"(?d)\A(.+?)\s+(\d+,\d{2})\s€\s+(\d+)\z",
    "coded_label": r"(?d)\A(.+?)\s+(\d+)\z",
    "quantity": r"(?diu)\A(\d+(?:[,.]\d+)?)\s+x\s+(\d+,\d{2})\s€\s+(\d+,\d{2})\s€\s+(\d+)\z",
    "weighted": r"(?diu)\A(\d+(?:[,.]\d+)?)\s+(kg|g|l|ml)\s+x\s+(\d+,\d{2})\s€/(kg|g|l|ml)\s+(\d+,\d{2})\s€\z",
    "total": r"(?d)\ATOTAL\s+(\d+)\s+Article\(s\)\s+(\d+,\d{2})\s€\z",
    "end": r"\A=+\z",
    "payment": r"(?d)\A(CB .+?|ESP[EÈ]CES)\s+(?:EUR\s+)?(\d+,\d{2})\s€\z",
    "vat_row": r"(?d)\A(\d+)\s+(?:/\s+)?(\d+,\d{2})\s+[-\d,]+\s€\s+[-\d,]+\s€\s+[-\d,]+\s€\z",
}
U_V2 = {
    "sale": r"\A\*\*\* VENTE \*\*\*\z",
    "item": r"(?d)\A(.+?)\s+(?:(\(T\))\s+)?(\d+,\d{2})\s€\s+(\d+)\z",
    "quantity": r"(?diu)\A(\d+(?:[,.]\d+)?)\s+x\s+(\d+,\d{2})\s+EUR\z",
    "total": r"(?d)\ATOTAL \[(\d+)\] Articles\s+(\d+,\d{2})\s€\z",
    "end": r"\ANombre de lignes d'article(?![\p{L}\p{N}_])",
    "payment": r"(?d)\A(CB .+?)\s+(\d+,\d{2})\s€\z",
    "vat_row": r"(?d)\A(\d+)\s+(\d+,\d{2})\s+[-\d,]+\s€\s+[-\d,]+\s€\s+[-\d,]+\s€\z",
    "footer": r"(?d)\A(\d{2})/(\d{2})/(\d{2})\s+(\d{2}):(\d{2}):(\d{2})\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\z",
}
NO_LABEL = "quantity line without a label"
LECLERC_REMISES = "REMISES"
DIGITS = "0123456789"
SIGNS |= {
    LECLERC["header"]: starts("Caisse "),
    LECLERC["ticket"]: first_of("T" + DIGITS),
    LECLERC["section"]: starts(">>"),
    LECLERC["total"]: starts("Total "),
    LECLERC["separator"]: starts("-"),
    LECLERC["bons"]: starts("BONS"),
    LECLERC["contribution"]: starts("("),
    LECLERC["payment"]: first_of("BbCc"),
    LECLERC["bon_achat"]: starts("Bon achat carte"),
    LECLERC["detail"]: cents_after("."),  # v1 items and web lines have this pattern too
    LECLERC_V1["discount"]: lambda line: has("-")(line) & cents_after(".")(line),
    LECLERC_V1["quantity"]: first_of(DIGITS),
    LECLERC_V2["body_header"]: starts("TTC"),
    LECLERC_V2["item"]: has("."),
    LECLERC_V2["quantity"]: first_of(DIGITS),
    LECLERC_V2["vat_row"]: has("%"),
    WEB["date"]: starts("Caisse"),
    WEB["payment"]: starts("CB Web "),
    AUCHAN["item"]: cents_after(","),
    AUCHAN["date"]: starts("Le "),
    AUCHAN["register"]: starts("Caisse"),
    AUCHAN["cashier"]: starts("Hôte(sse)"),
    AUCHAN["total"]: starts("Total "),
    AUCHAN["count"]: first_of(DIGITS),
    AUCHAN["payment"]: starts("Reçu "),
    AUCHAN["selfscan_start"]: has(AUCHAN["selfscan_start"]),
    AUCHAN["selfscan_end"]: has(AUCHAN["selfscan_end"]),
    AUCHAN["discounts"]: starts(DISCOUNT_SECTION),
    AUCHAN["end"]: starts("Total"),
    AUCHAN["host"]: has("Hôte(sse)"),
    AUCHAN["scan_warning"]: lambda line: has("lecture part")(F.lower(line)) | has("nouveau ")(F.lower(line)),
    AUCHAN["correction"]: first_of("+-"),
    AUCHAN["account"]: first_of("VvCc"),
    U["before"]: first_of("Cc"),
    U["after"]: first_of("Cc"),
    U["vignettes"]: first_of(DIGITS),
    U_V1["header"]: first_of(DIGITS),
    U_V1["section"]: starts(">>>>"),
    U_V1["item"]: has("€"),
    U_V1["quantity"]: first_of(DIGITS),
    U_V1["weighted"]: first_of(DIGITS),
    U_V1["total"]: starts("TOTAL"),
    U_V1["end"]: starts("="),
    U_V1["payment"]: first_of("CE"),
    U_V1["vat_row"]: first_of(DIGITS),
    U_V2["sale"]: starts("***"),
    U_V2["item"]: has("€"),
    U_V2["quantity"]: first_of(DIGITS),
    U_V2["total"]: starts("TOTAL ["),
    U_V2["end"]: starts("Nombre"),
    U_V2["payment"]: starts("CB "),
    U_V2["vat_row"]: first_of(DIGITS),
    U_V2["footer"]: first_of(DIGITS),
}
# Every pattern a promotion rule asks, coupons' amounts apart.
LECLERC_PROMOTING = "|".join(
    f"(?:{LECLERC[name]})"
    for name in [
        "separator", "bons", "bon_achat", "cumul", "points_section", "points_accrual", "points_consumption",
        "vignette_accrual", "vignette_consumption", "vignette_section", "vignette_operation",
    ]
)
# These begin with a dash, "Bon", "Cumul", "Operation" or "Vous", some in letters of either case.
SIGNS[LECLERC_PROMOTING] = first_of("-BCcOoVv")


def _is(pattern: str) -> Column:
    return matching(pattern)(F.col("line"))


def _part(pattern: str, group: int) -> Column:
    return F.regexp_extract("line", pattern, group)


def _ever(flag: Column, frame) -> Column:
    return F.coalesce(F.max(flag).over(frame), F.lit(False))


def _carried(value: Column, frame) -> Column:
    return F.last(value, ignorenulls=True).over(frame)


# --- Leclerc paper -----------------------------------------------------------------------


def detail_section(lines: DataFrame, heading: str, flag: str) -> DataFrame:
    """Flag amount rows between the first heading and the next dashed separator, totals left out."""
    opened = _ever(_is(LECLERC[heading]), before())
    inside = lines.withColumn("_open", opened)
    closed = _ever(F.col("_open") & _is(LECLERC["separator"]), up_to())
    row = (
        F.col("_open")
        & ~F.col("_closed")
        & ~_is(LECLERC[heading])
        & _is(LECLERC["detail"])
        & ~_part(LECLERC["detail"], 1).rlike(LECLERC["detail_total"])
    )
    return inside.withColumn("_closed", closed).withColumn(flag, row).drop("_open", "_closed")


def leclerc_details(documents: DataFrame) -> DataFrame:
    """Places of the rows ``detail_section`` flags under REMISES, in ``details``."""

    def letter(line: Column) -> Column:
        counted = matching(LECLERC["detail"])(line) & ~F.regexp_extract(line, LECLERC["detail"], 1).rlike(LECLERC["detail_total"])
        return F.when(matching(LECLERC["separator"])(line), "-").when(counted, "d").otherwise("x")

    df = documents.withColumn("remises", F.array_position("lines", F.lit(LECLERC_REMISES)).cast("int"))
    # Up to the first separator after the heading.
    below = F.array_join(F.transform(F.slice("lines", F.col("remises") + 1, F.size("lines")), letter), "")
    flagged = F.transform(F.split(F.substring_index(below, "-", 1), ""), lambda c, at: F.when(c == "d", F.col("remises") + at + 1))
    details = F.when(F.col("remises") > 0, F.filter(flagged, lambda place: place.isNotNull()))
    return df.withColumn("details", F.coalesce(details, F.array().cast("array<int>")))


def leclerc_marks(patterns: dict[str, str]):
    coded = "body_header" in patterns

    def mark(documents: DataFrame) -> DataFrame:
        """S section, M column heads, A aside, T total, Q quantity, D discount, I item, L any other line."""
        rules = [("S", matching(LECLERC["section"])), ("A", matching(LECLERC["contribution"]))]
        rules += [("M", matching(patterns["body_header"]))] if coded else []
        rules += [("T", matching(LECLERC["total"])), ("Q", matching(patterns["quantity"]))]
        rules += [("D", matching(patterns["discount"]))] if "discount" in patterns else []
        marks = letters("L", *rules, ("I", matching(patterns["item"])))
        # Without column heads an item or total begins the body too; a quantity line makes the line before it begin.
        begins = "[SM]|[ITLQ](?=Q)" if coded else "[SIQT]|[LD](?=Q)"
        return bounded(
            documents, marks, f"regexp_instr(letters, '{begins}')", "if(start > 0, locate('T', letters, start), 0)",
            f"if(start > 0 and translate(substr(letters, start, finish - start), 'SMA', '') rlike '(^|[^L])Q', '{NO_LABEL}', null)",
        )

    return mark


def leclerc_body(patterns: dict[str, str]):
    coded = "body_header" in patterns

    def body(documents: DataFrame) -> DataFrame:
        # Detail discounts replace discounts of the body and follow it: their places are negative.
        df = leclerc_details(documents)
        sold = F.when(F.size("details") > 0, body_places("QI")).otherwise(body_places("QID"))
        places = F.concat(F.coalesce(sold, F.array().cast("array<int>")), F.transform("details", lambda place: -place))
        df = at_places(df, places).withColumns({"letter": letter_at(F.abs("place")), "before": last_place("SMA", F.col("place") - 1)})
        held = (F.col("before") >= F.col("start")) & (letter_at(F.col("before")) == "L")
        df = df.withColumn("pending", F.when(held, text.unstarred_label(line_at(F.col("before")))))
        df = df.withColumn("section_at", last_place("MATQDIL", F.col("place")))
        section = F.regexp_extract(line_at(F.col("section_at")), LECLERC["section"], 1)

        is_detail, is_d = F.col("place") < 0, F.col("letter") == "D"
        counted = (F.col("letter") == "Q") & ~is_detail
        # Quantity, price, total and code of a quantity line; label, amount and code of any other.
        printed = F.when(is_detail, groups("line", LECLERC["detail"], 2)).when(counted, groups("line", patterns["quantity"], 4 if coded else 3))
        if "discount" in patterns:
            printed = printed.when(is_d, groups("line", patterns["discount"], 2))
        df = df.withColumn("printed", printed.otherwise(groups("line", patterns["item"], 3 if coded else 2)))
        row = captured_row(
            line_index=F.col("line_no") + F.when(is_detail, F.lit(1_000_000_000)).otherwise(F.lit(0)),
            raw_text=F.when(counted, F.concat_ws("\n", "pending", "line")).otherwise(F.col("line")),
            printed_label=F.when(counted, F.col("pending")).otherwise(text.unstarred_label(group_of("printed", 1))),
            printed_quantity=F.when(counted, group_of("printed", 1)),
            printed_price=F.when(counted, group_of("printed", 2)),
            printed_total=F.when(counted, group_of("printed", 3)).otherwise(group_of("printed", 2)),
            negated=is_detail,
            vat_code=F.when(counted, group_of("printed", 4)).when(~is_detail, group_of("printed", 3)) if coded else F.lit(None),
            vat_lookup=~is_detail & coded,
            section_label=F.when(~is_detail & (F.col("section_at") > 0), section),
            kind=F.when(is_detail | is_d, F.lit("discount")).otherwise(F.lit("item")),
        )
        return captured_rows(df, row)

    return body


def leclerc_promoting(line: Column, place: Column) -> Column:
    """Lines some rule mentions; amounts only below the coupons' heading."""
    priced = matching(LECLERC["detail"])(line)
    return matching(LECLERC_PROMOTING)(line) | ((F.col("opened") > 0) & (place > F.col("opened")) & priced)


def leclerc_promotions(lines: DataFrame) -> DataFrame:
    """All promotion rules in one pass: each line yields at most one promotion per rule."""
    heading = F.when(_is(LECLERC["points_section"]), text.clean_label(_part(LECLERC["points_section"], 1))).when(
        _is(LECLERC["separator"]), F.lit("")
    )
    title = F.when(_is(LECLERC["vignette_section"]), _part(LECLERC["vignette_section"], 1)).when(
        _is(LECLERC["vignette_operation"]), _part(LECLERC["vignette_operation"], 1)
    )
    df = detail_section(lines, "bons", "is_bon").withColumns(
        {
            "is_coupon": _is(LECLERC["bon_achat"]),
            "heading": heading,
            "title": text.clean_label(F.regexp_replace(title, r"\s*[-*]+\z", "")),
        }
    )
    df = df.withColumns(
        {
            "has_cumul": F.max(_is(LECLERC["cumul"])).over(whole()),
            "points_campaign": F.nullif(_carried(F.col("heading"), before()), F.lit("")),
            "above": _carried(F.col("title"), before()),
            "below": F.first("title", ignorenulls=True).over(after()),
        }
    )
    amount = money.cents_from(_part(LECLERC["bon_achat"], 1))
    named = text.clean_label(_part(LECLERC["detail"], 1))
    rows = [
        F.when(F.col("is_coupon"), promotion(0, "leclerc_bon_achat_carte", "euro_cents", -amount, "Bon achat carte", "coupon")),
        F.when(F.expr("is_coupon and has_cumul"), promotion(1, "leclerc_tickets", "euro_cents", -amount, "CUMUL DISPONIBLE", "coupon")),
        F.when(
            F.col("is_bon"),
            promotion(
                2, "leclerc_bon_immediat", "euro_cents", -money.cents_from(_part(LECLERC["detail"], 2)), named,
                "immediate_discount", F.regexp_replace(named, r"(?iu)\s+\(X\d+\)\z", ""),
            ),
        ),
    ]
    signs = [("accrual", "points_accrual", 1), ("consumption", "points_consumption", -1)]
    for order, (event, kind, sign) in enumerate(signs, 3):
        pattern = LECLERC[f"points_{event}"]
        count = _part(pattern, 1).try_cast("bigint") * sign
        row = promotion(order, "leclerc_points_amazones_jeannerie", "point_count", count, F.col("points_campaign"), kind)
        rows.append(F.when(_is(pattern) & F.col("points_campaign").isNotNull(), row))
    for order, (event, kind, sign) in enumerate(signs, 5):
        pattern = LECLERC[f"vignette_{event}"]
        campaign = F.coalesce(F.nullif(_part(pattern, 2), F.lit("")), "above", "below")
        row = promotion(
            order, money.vignette_program(campaign, money.LECLERC_PROGRAMS, "leclerc_vignettes"), "vignette_count",
            _part(pattern, 1).try_cast("bigint") * sign, F.coalesce(F.nullif(campaign, F.lit("")), F.lit("Vignette(s)")), kind,
        )
        rows.append(F.when(_is(pattern), row))
    return promotion_rows(df, *rows)


def _leclerc(name: str, patterns: dict[str, str], vat_row=None) -> FormatSpec:
    return FormatSpec(
        name=name,
        headers={k: LECLERC[k] for k in ("header", "ticket", "total")},
        fields={"register_number": ("header", 1), "ticket_number": ("ticket", 1), "total": ("total", 2), "count": ("total", 1)},
        date=DateRule("header", year=4, month=3, day=2, hour=5, minute=6, month_is_name=True),
        mark=leclerc_marks(patterns),
        body=leclerc_body(patterns),
        payment=LECLERC["payment"],
        vat_row=vat_row,
        promotions=leclerc_promotions,
        promoting=leclerc_promoting,
        opens=LECLERC["bons"],
    )


LECLERC_PAPER_V1 = register_format(_leclerc("leclerc.paper.v1", LECLERC_V1))
LECLERC_PAPER_V2 = register_format(
    _leclerc(
        "leclerc.paper.v2",
        LECLERC_V2,
        (
            LECLERC_V2["vat_row"],
            1,
            lambda line: money.vat_rate_bp(
                F.regexp_extract(line, LECLERC_V2["vat_row"], 2), F.regexp_extract(line, LECLERC_V2["vat_row"], 3)
            ),
        ),
    )
)

# --- Leclerc web -------------------------------------------------------------------------


def web_marks(documents: DataFrame) -> DataFrame:
    """T total, I line with an amount, L any other; the body starts with the text."""
    return bounded(documents, letters("L", ("T", matching(WEB["total"])), ("I", matching(WEB["line"]))), "1", "locate('T', letters)")


def web_body(documents: DataFrame) -> DataFrame:
    df = at_places(documents, body_places("I"))
    df = df.withColumn("printed", text.strip(_part(WEB["line"], 1)))
    counted = F.col("printed").rlike(WEB["counted"])
    df = df.withColumns(
        {
            "label": F.when(counted, F.regexp_extract("printed", WEB["counted"], 2)).otherwise(F.col("printed")),
            "times": F.when(counted, F.regexp_extract("printed", WEB["counted"], 1)),
        }
    )
    fee = F.col("label").startswith(WEB["fee"])
    row = captured_row(
        line_index=F.col("line_no"),
        raw_text=F.col("line"),
        printed_label=F.col("label"),
        printed_quantity=F.col("times"),
        printed_total=_part(WEB["line"], 2),
        vat_fixed_bp=F.when(fee, F.lit(550)),
        kind=F.when(fee, F.lit("fee")).otherwise(F.lit("item")),
    )
    return captured_rows(df, row)


LECLERC_WEB_V1 = register_format(
    FormatSpec(
        name="leclerc.web.v1",
        headers={k: WEB[k] for k in ("date", "total")},
        fields={"total": ("total", 2), "count": ("total", 1)},
        date=DateRule("date", year=3, month=2, day=1, month_is_name=True),
        mark=web_marks,
        body=web_body,
        payment=WEB["payment"],
    )
)

# --- Auchan paper ------------------------------------------------------------------------


def auchan_marks(documents: DataFrame) -> DataFrame:
    """b and e: self-scan begins and ends, d discounts, t total, H and h: host line that is an item line or not, I item, L any other."""
    p = AUCHAN["item"]

    def sells(line: Column) -> Column:
        aside = matching(AUCHAN["scan_warning"])(line) | matching(AUCHAN["correction"])(line) | line.rlike(AUCHAN["noise"])
        label, total = text.strip(F.regexp_extract(line, p, 2)), F.regexp_extract(line, p, 5)
        # A negative "TOTAL REMISES" repeats the discounts above it.
        repeated = has("TOTAL REMISES")(line) & (text.clean_label(label) == "TOTAL REMISES") & total.startswith("-")
        return matching(p)(line) & ~aside & ~repeated

    marks = letters(
        "L",
        ("b", matching(AUCHAN["selfscan_start"])),
        ("e", matching(AUCHAN["selfscan_end"])),
        ("d", matching(AUCHAN["discounts"])),
        ("t", matching(AUCHAN["end"])),
        ("H", lambda line: matching(AUCHAN["host"])(line) & sells(line)),
        ("h", matching(AUCHAN["host"])),
        ("I", sells),
    )
    # With self-scan the host line begins nothing.
    start = "regexp_instr(letters, if(contains(letters, 'b'), '[bd]', '[bdhH]'))"
    return bounded(documents, marks, start, "locate('t', letters)")


def auchan_body(documents: DataFrame) -> DataFrame:
    df = at_places(documents, body_places("IH"))
    df = df.withColumn("section", letter_at(last_place("HhIL", F.col("place"))))
    df = df.withColumn("printed", groups("line", AUCHAN["item"], 5))
    row = captured_row(
        line_index=F.col("line_no"),
        raw_text=F.col("line"),
        printed_label=text.strip(group_of("printed", 2)),
        printed_quantity=group_of("printed", 3),
        printed_price=group_of("printed", 4),
        printed_total=group_of("printed", 5),
        recomputed=F.contains(letters_to(F.col("place")), F.lit("d")),
        tr_eligible=group_of("printed", 1) == "*",
        section_label=F.when(F.col("section") == "b", F.lit(SELFSCAN_SECTION)).when(F.col("section") == "d", F.lit(DISCOUNT_SECTION)),
    )
    return captured_rows(df, row)


def auchan_promoting(line: Column, place: Column) -> Column:
    """Lines from the first account heading on."""
    return (F.col("opened") > 0) & (place >= F.col("opened"))


def auchan_loyalty(lines: DataFrame) -> DataFrame:
    opens = _is(AUCHAN["account"])
    state = F.when(opens, F.lit(True)).when(_is(AUCHAN["scan_warning"]) | _is(AUCHAN["account_end"]), F.lit(False))
    inside = lines.withColumn("inside", _carried(state, up_to())).where(
        F.col("inside") & ~opens & ~_is(AUCHAN["correction"]) & ~_is(AUCHAN["information"])
    )
    day, credit = AUCHAN["day_event"], AUCHAN["credit"]
    debit = F.lower(_part(day, 1)) == "débit du jour"
    moved = money.cents_from(_part(day, 2))
    event = promotion(
        0, "auchan_waaoh", "euro_cents", F.when(debit, -moved).otherwise(moved), _part(day, 1),
        F.when(debit, F.lit("loyalty_cash_debit")).otherwise(F.lit("loyalty_cash_credit")),
    )
    named = text.strip(_part(credit, 1))
    credited = promotion(
        0, "auchan_waaoh", "euro_cents", money.cents_from(_part(credit, 2)), named, "loyalty_cash_credit", named
    )
    return promotion_rows(inside, F.when(_is(day), event).when(_is(credit), credited))


def auchan_scan_warnings(documents: DataFrame) -> DataFrame:
    return lines_where(documents, lambda line, _: matching(AUCHAN["scan_warning"])(line)).select(
        "document_id", "line_no", warnings.build_warning("auchan_selfscan_warning", F.col("line")).alias("warning")
    )


AUCHAN_PAPER_V1 = register_format(
    FormatSpec(
        name="auchan.paper.v1",
        headers={k: AUCHAN[k] for k in ("date", "register", "cashier", "total", "count")},
        fields={
            "register_number": ("register", 1),
            "ticket_number": ("register", 2),
            "cashier_code": ("cashier", 1),
            "total": ("total", 1),
            "count": ("count", 1),
        },
        date=DateRule("date", year=3, month=2, day=1, hour=4, minute=5, second=6, month_is_name=True),
        mark=auchan_marks,
        body=auchan_body,
        payment=AUCHAN["payment"],
        promotions=auchan_loyalty,
        promoting=auchan_promoting,
        opens=AUCHAN["account"],
        line_warnings=auchan_scan_warnings,
        mild=lambda w: (w["code"] == "auchan_selfscan_warning") & ~w["detail"].rlike(AUCHAN["severe"]),
    )
)

# --- Magasins U paper --------------------------------------------------------------------


def u_v1_marks(documents: DataFrame) -> DataFrame:
    """S section, E end of the body, Q quantity, G weighed, I item, L any other."""
    marks = letters(
        "L",
        ("S", matching(U_V1["section"])),
        ("E", lambda line: matching(U_V1["end"])(line) | matching(U_V1["total"])(line)),
        ("Q", matching(U_V1["quantity"])),
        ("G", matching(U_V1["weighted"])),
        ("I", matching(U_V1["item"])),
    )
    return bounded(
        documents, marks, "locate('S', letters)", "if(start > 0, locate('E', letters, start), 0)",
        f"if(start > 0 and substr(letters, start, finish - start) rlike '[^L][QG]', '{NO_LABEL}', null)",
    )


def u_v1_body(documents: DataFrame) -> DataFrame:
    df = at_places(documents, body_places("QGI")).withColumn("letter", letter_at(F.col("place")))
    # Inside the body only sections are no rows, so the label of a quantity stands right above it.
    df = df.withColumn("above", F.when(letter_at(F.col("place") - 1) == "L", line_at(F.col("place") - 1)))
    coded = F.col("above").rlike(U_V1["coded_label"])
    label = F.when(coded, F.regexp_extract("above", U_V1["coded_label"], 1)).otherwise(F.col("above"))
    df = df.withColumn("pending", text.strip(label)).withColumn("pending_code", F.when(coded, F.regexp_extract("above", U_V1["coded_label"], 2)))
    is_q, is_g = F.col("letter") == "Q", F.col("letter") == "G"
    continued = is_q | is_g
    counted, weighed, priced = groups("line", U_V1["quantity"], 4), groups("line", U_V1["weighted"], 5), groups("line", U_V1["item"], 3)
    df = df.withColumn("printed", F.when(is_q, counted).when(is_g, weighed).otherwise(priced))
    row = captured_row(
        line_index=F.col("line_no"),
        raw_text=F.when(is_q, F.concat_ws("\n", "pending", "line"))
        .when(is_g, F.concat_ws("\n", F.concat_ws(" ", "pending", "pending_code"), "line"))
        .otherwise(F.col("line")),
        printed_label=F.when(continued, F.col("pending")).otherwise(text.strip(group_of("printed", 1))),
        printed_quantity=F.when(continued, group_of("printed", 1)),
        printed_price=F.when(is_q, group_of("printed", 2)).when(is_g, group_of("printed", 3)),
        printed_total=F.when(is_q, group_of("printed", 3)).when(is_g, group_of("printed", 5)).otherwise(group_of("printed", 2)),
        unit_of_measure=F.when(is_g, F.lower(group_of("printed", 2))).otherwise(F.lit("piece")),
        vat_code=F.when(is_q, group_of("printed", 4)).when(is_g, F.col("pending_code")).otherwise(group_of("printed", 3)),
        vat_lookup=F.lit(True),
        section_label=F.regexp_extract(line_at(last_place("EQGIL", F.col("place"))), U_V1["section"], 1),
        kind=F.lit("item"),
    )
    return captured_rows(df, row)


def u_v2_marks(documents: DataFrame) -> DataFrame:
    """S sale, E end of the body, Q quantity, I item, L any other."""
    marks = letters(
        "L",
        ("S", matching(U_V2["sale"])),
        ("E", lambda line: matching(U_V2["end"])(line) | matching(U_V2["total"])(line)),
        ("Q", matching(U_V2["quantity"])),
        ("I", matching(U_V2["item"])),
    )
    return bounded(
        documents, marks, "locate('S', letters)", "if(start > 0, locate('E', letters, start), 0)",
        f"if(start > 0 and translate(substr(letters, start, finish - start), 'SL', '') rlike '(^|Q)Q', '{NO_LABEL}', null)",
    )


def u_v2_body(documents: DataFrame) -> DataFrame:
    df = at_places(documents, body_places("QI")).withColumn("is_quantity", letter_at(F.col("place")) == "Q")
    # The last item or quantity line before decides: an item is pending, a quantity line is not.
    df = df.withColumn("sold_at", last_place("SL", F.col("place") - 1)).withColumn("label_at", last_place("SQI", F.col("sold_at")))
    held = F.col("is_quantity") & (F.col("sold_at") > F.col("start")) & (letter_at(F.col("sold_at")) == "I")
    df = df.withColumn("pending", F.when(held, line_at(F.col("sold_at"))))
    is_q = F.col("is_quantity")
    # A quantity line is printed with the item line that it follows.
    df = df.withColumns(
        {"sold": groups(F.when(is_q, F.col("pending")).otherwise(F.col("line")), U_V2["item"], 4), "counted": F.when(is_q, groups("line", U_V2["quantity"], 2))}
    )
    row = captured_row(
        line_index=F.col("line_no"),
        raw_text=F.when(is_q, F.concat_ws("\n", "pending", "line")).otherwise(F.col("line")),
        printed_label=F.when(is_q, text.strip(group_of("sold", 1))).otherwise(F.lit("")),
        printed_quantity=group_of("counted", 1),
        printed_price=group_of("counted", 2),
        printed_total=F.when(is_q, group_of("sold", 3)),
        vat_code=group_of("sold", 4),
        vat_lookup=F.lit(True),
        # A missing code is reported once, by the item line itself: it looks its code up, also if no quantity line follows.
        reports_vat=~is_q,
        tr_eligible=is_q & (group_of("sold", 2) == "(T)"),
        section_label=F.when(is_q & (F.col("label_at") > F.col("start")), line_at(F.col("label_at"))),
        kind=F.lit("item"),
        emitted=is_q,
    )
    return captured_rows(df, row)


def u_promoting(line: Column, place: Column) -> Column:
    stated = [matching(pattern)(line) for pattern in U.values()]
    return (place <= F.greatest("copies", F.lit(1))) | stated[0] | stated[1] | stated[2]


def u_promotions(lines: DataFrame) -> DataFrame:
    """The card balance movement (first balance lines of the document) and vignette accruals."""

    def first(name: str) -> Column:
        hit = _is(U[name])
        return F.min_by(F.when(hit, _part(U[name], 1)), F.when(hit, F.col("line_no"))).over(whole())

    df = lines.withColumns({"_before": first("before"), "_after": first("after")})
    df = df.withColumns({"_before": money.cents_from(F.col("_before")), "_after": money.cents_from(F.col("_after"))})
    df = df.withColumn("moved", money.balance_delta(F.col("_before"), F.col("_after")))
    kind = F.when(F.col("moved") > 0, F.lit("loyalty_cash_credit")).otherwise(F.lit("loyalty_cash_debit"))
    # Stated once per document, on its first line.
    balance = promotion(0, "u_carte_u", "euro_cents", F.col("moved"), "Carte U solde", kind, line_no=F.lit(0))
    campaign = text.clean_label(_part(U["vignettes"], 2))
    accrual = promotion(
        1, money.vignette_program(campaign, money.U_PROGRAMS, "u_vignettes"), "vignette_count",
        _part(U["vignettes"], 1).try_cast("bigint"), campaign, "points_accrual",
    )
    stated = F.expr("line_no = 1 and moved is not null")
    return promotion_rows(df, F.when(stated, balance), F.when(_is(U["vignettes"]), accrual))


def _u_vat(pattern: str):
    return (pattern, 1, lambda line: (money.decimal_from(F.regexp_extract(line, pattern, 2)) * 100).cast("int"))


U_PAPER_V1 = register_format(
    FormatSpec(
        name="u.paper.v1",
        headers={k: U_V1[k] for k in ("header", "total")},
        fields={
            "register_number": ("header", 7),
            "ticket_number": ("header", 8),
            "cashier_code": ("header", 1),
            "total": ("total", 2),
            "count": ("total", 1),
        },
        date=DateRule("header", year=4, month=3, day=2, hour=5, minute=6),
        mark=u_v1_marks,
        body=u_v1_body,
        payment=U_V1["payment"],
        vat_row=_u_vat(U_V1["vat_row"]),
        promotions=u_promotions,
        promoting=u_promoting,
    )
)
U_PAPER_V2 = register_format(
    FormatSpec(
        name="u.paper.v2",
        headers={k: U_V2[k] for k in ("footer", "total")},
        fields={
            "register_number": ("footer", 8),
            "ticket_number": ("footer", 10),
            "cashier_code": ("footer", 9),
            "total": ("total", 2),
            "count": ("total", 1),
        },
        date=DateRule("footer", year=3, month=2, day=1, hour=4, minute=5, second=6),
        mark=u_v2_marks,
        body=u_v2_body,
        payment=U_V2["payment"],
        vat_row=_u_vat(U_V2["vat_row"]),
        promotions=u_promotions,
        promoting=u_promoting,
    )
)
