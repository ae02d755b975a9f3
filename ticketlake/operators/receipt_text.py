"""Receipt parsing over a corpus of texts.

Every stage is keyed by document. Texts are hash-partitioned by document once, before
they are cut into lines; all later windows, aggregates and joins use that partitioning.
Lines stay in the row of their document: each is marked with one letter, so where a body begins,
ends or fails is a search in the document's letters. Only lines that state something become rows.
A format is a ``FormatSpec``: patterns plus functions that turn marked documents into rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property, reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlake.functions import dates, money, text, warnings
from ticketlake.functions import fixed_values as fixed
from ticketlake.operators.reconcile import coalesce_repeated_in_place, validator_results
from ticketlake.session import stored_copy


def by_line():
    return Window.partitionBy("document_id").orderBy("line_no")


def up_to():
    return by_line().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before():
    return by_line().rowsBetween(Window.unboundedPreceding, -1)


def after():
    return by_line().rowsBetween(1, Window.unboundedFollowing)


def whole():
    return Window.partitionBy("document_id")


HEADER_COLUMNS = [
    "parser_format",
    "purchased_at",
    "register_number",
    "ticket_number",
    "cashier_code",
    "total_cents",
    "declared_article_count",
]
LINE_COLUMNS = [
    "raw_text",
    "label",
    "label_truncated",
    "quantity",
    "unit_of_measure",
    "unit_price_cents",
    "total_cents",
    "vat_rate_bp",
    "tr_eligible",
    "section_label",
    "kind",
]


class DateRule(NamedTuple):
    """Where the purchase time stands: header pattern and capture groups (0: absent)."""

    pattern: str
    year: int
    month: int
    day: int
    hour: int = 0
    minute: int = 0
    second: int = 0
    month_is_name: bool = False


class FormatSpec(NamedTuple):
    """Declaration of one receipt format.

    ``headers``: named patterns; the first matching line of each is kept per document.
    ``fields``: header field -> (header name, group). ``mark``: documents with ``letters``, ``start``,
    ``finish`` and ``failure`` of the body. ``body``: marked documents -> item rows.
    ``vat_row``: (pattern, code group, rate from the matching line). ``promotions``: lines ->
    promotion rows; ``promoting``: which lines (line, place) these rules read; ``opens``: pattern whose first
    line is at ``opened`` for it (0: none).
    ``line_warnings``: lines -> warning rows. ``mild``: warning codes that do not force review by themselves.
    """

    name: str
    headers: dict[str, str]
    fields: dict[str, tuple[str, int]]
    date: DateRule
    mark: Callable[[DataFrame], DataFrame]
    body: Callable[[DataFrame], DataFrame]
    payment: str
    vat_row: tuple[str, int, Callable[[Column], Column]] | None = None
    promotions: Callable[[DataFrame], DataFrame] | None = None
    promoting: Callable[[Column, Column], Column] | None = None
    opens: str = "(?!)"
    line_warnings: Callable[[DataFrame], DataFrame] | None = None
    mild: Callable[[Column], Column] | None = None


def cut_lines(whole_text: Column) -> Column:
    """Non-blank trimmed lines."""
    return F.filter(F.transform(F.split(whole_text, "\n"), text.strip), lambda line: ~text.is_blank(line))


def explode_lines(documents: DataFrame) -> DataFrame:
    """Non-blank trimmed lines, numbered from 1 inside the row that holds the text."""
    return documents.select("document_id", F.posexplode(cut_lines(F.col("text"))).alias("_at", "line")).select(
        "document_id", (F.col("_at") + 1).alias("line_no"), "line"
    )


def whole_documents(documents: DataFrame, *beside: str) -> DataFrame:
    """One row per id (and values of ``beside``) with its ``lines``; ``copies`` counts the rows it had.

    Texts that share an id are one document, its lines in order of their numbers in each text: only
    then ``numbers`` holds these, else a line's number is its place.
    """
    texts = documents.groupBy("document_id", *beside).agg(F.count("*").cast("int").alias("copies"), F.collect_list("text").alias("_texts"))
    numbered = F.transform(
        "_texts", lambda t: F.transform(cut_lines(t), lambda line, at: F.struct((at + 1).alias("line_no"), line.alias("line")))
    )
    several = F.size("_texts") > 1
    merged = texts.withColumn("_merged", F.when(several, F.array_sort(F.flatten(numbered))))
    return merged.select(
        "document_id",
        *beside,
        "copies",
        F.when(several, F.col("_merged.line")).otherwise(F.coalesce(cut_lines(F.get("_texts", F.lit(0))), F.array().cast("array<string>"))).alias("lines"),
        F.col("_merged.line_no").alias("numbers"),
    )


def number_of(place: Column) -> Column:
    return F.coalesce(F.get("numbers", place - 1), place)


def lines_where(documents: DataFrame, wanted: Callable[[Column, Column], Column], of: Column | None = None) -> DataFrame:
    """Lines for which ``wanted`` (line, place) holds, as rows; of documents for which ``of`` holds."""
    found = F.transform("lines", lambda line, at: F.when(wanted(line, at + 1), F.struct((at + 1).alias("place"), line.alias("line"))))
    kept = F.filter(found, lambda one: one.isNotNull())
    rows = documents.select("document_id", "numbers", F.inline(kept if of is None else F.when(of, kept)))
    return rows.select("document_id", number_of(F.col("place")).alias("line_no"), "line")


def letters(otherwise: str, *rules: tuple[str, Callable[[Column], Column]]) -> Column:
    """One letter per line: that of the first rule that holds."""

    def letter(line: Column) -> Column:
        cases = F.when(F.lit(False), F.lit(""))
        for name, holds in rules:
            cases = cases.when(holds(line), F.lit(name))
        return cases.otherwise(F.lit(otherwise))

    return F.array_join(F.transform("lines", letter), "")


def starts(plain: str) -> Callable[[Column], Column]:
    return lambda line: line.startswith(plain)


def has(plain: str) -> Callable[[Column], Column]:
    return lambda line: F.contains(line, F.lit(plain))


def first_of(characters: str) -> Callable[[Column], Column]:
    return lambda line: F.contains(F.lit(characters), F.substring(line, 1, 1))


def cents_after(mark: str) -> Callable[[Column], Column]:
    return lambda line: F.substring(line, -3, 1) == mark


#: Pattern -> what every line that it matches shows. Cheaper to see, so only lines that show it are asked for the pattern.
SIGNS: dict[str, Callable[[Column], Column]] = {}


def matching(pattern: str) -> Callable[[Column], Column]:
    shows = SIGNS.get(pattern)
    return lambda line: line.rlike(pattern) if shows is None else shows(line) & line.rlike(pattern)


def groups(line: Column | str, pattern: str, count: int) -> Column:
    """Groups 1 to ``count`` of a line that matches, each at its number, from one pass of the pattern. A line holds no line feed."""
    return F.split(F.regexp_replace(line, pattern, "\n" + "".join(f"${n}\n" for n in range(1, count + 1))), "\n")


def group_of(found: str, number: int) -> Column:
    return F.get(found, F.lit(number))


def letter_at(place: Column) -> Column:
    return F.substr("letters", place, F.lit(1))


def letters_to(place: Column) -> Column:
    return F.substr("letters", F.lit(1), place)


def line_at(place: Column) -> Column:
    return F.get("lines", place - 1)


def last_place(passed: str, place: Column) -> Column:
    """The last place up to ``place`` whose letter is none of ``passed``; 0 if there is none."""
    return F.length(F.rtrim(letters_to(place), F.lit(passed)))


def body_places(wanted: str) -> Column:
    """Places of the body (``start`` to before ``finish``) with one of the ``wanted`` letters."""
    within = F.when(F.expr("start > 0 and start < finish"), F.sequence(F.col("start"), F.col("finish") - 1))
    return F.filter(within, lambda place: F.lit(wanted).contains(letter_at(place)))


def at_places(documents: DataFrame, places: Column) -> DataFrame:
    """A row per place of sound documents, with its line; a negative place keeps its sign."""
    placed = documents.select("*", F.explode(F.when(F.col("sound"), places)).alias("place"))
    return placed.withColumns({"line": line_at(F.abs("place")), "line_no": number_of(F.abs("place"))})


def bounded(documents: DataFrame, marks: Column, start: str, finish: str, failure: str | None = None) -> DataFrame:
    """``letters`` of the lines and, from SQL over them, where the body starts (0: nowhere), finishes and how it fails."""
    df = documents.withColumn("letters", marks).withColumn("start", F.expr(start))
    df = df.withColumn("finish", F.expr(f"coalesce(nullif({finish}, 0), length(letters) + 1)"))
    return df.withColumn("failure", F.expr(failure or "cast(null as string)"))


def first_matches(lines: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Per document the first line matching each named pattern: one aggregation for all patterns."""
    hits = {f"_hit_{name}": F.col("line").rlike(pattern) for name, pattern in patterns.items()}
    matching = lines.withColumns(hits).where(reduce(Column.__or__, [F.col(h) for h in hits]))
    firsts = [
        F.min_by(F.when(F.col(f"_hit_{name}"), F.col("line")), F.when(F.col(f"_hit_{name}"), F.col("line_no"))).alias(f"first_{name}")
        for name in patterns
    ]
    return matching.groupBy("document_id").agg(*firsts)


def extract_header(documents: DataFrame, spec: FormatSpec) -> DataFrame:
    """Register, ticket, cashier, time, total and declared count of each document, beside its columns."""
    firsts = {f"first_{name}": F.get(F.filter("lines", matching(pattern)), F.lit(0)) for name, pattern in spec.headers.items()}
    found = documents.withColumns({name: F.when(F.col("document_id").isNotNull(), first) for name, first in firsts.items()})
    dated = [getattr(spec.date, part) for part in ("year", "month", "day", "hour", "minute", "second")]
    asked = [*spec.fields.values(), *((spec.date.pattern, index) for index in dated)]
    last = {name: max((index for of, index in asked if of == name), default=0) for name in spec.headers}
    found = found.withColumns({f"_of_{name}": groups(f"first_{name}", pattern, last[name]) for name, pattern in spec.headers.items()})

    def group(name: str, index: int) -> Column:
        return F.nullif(group_of(f"_of_{name}", index) if index else F.regexp_extract(f"first_{name}", spec.headers[name], 0), F.lit(""))

    def field(name: str) -> Column:
        return group(*spec.fields[name]) if name in spec.fields else F.lit(None).cast("string")

    rule = spec.date
    printed = {
        part: group(rule.pattern, getattr(rule, part)) if getattr(rule, part) else F.lit("0")
        for part in ("year", "month", "day", "hour", "minute", "second")
    }
    captured = found.select(
        *documents.columns,
        F.col(f"first_{rule.pattern}").isNotNull().alias("_dated"),
        *[text_part.alias("_" + part) for part, text_part in printed.items()],
        *[field(f).alias(f) for f in ("register_number", "ticket_number", "cashier_code", "total", "count")],
    )
    month = dates.french_month(F.col("_month")) if rule.month_is_name else F.col("_month").try_cast("int")
    numbers = captured.withColumns(
        {"_month": month, **{"_" + part: F.col("_" + part).try_cast("int") for part in printed if part != "month"}}
    )
    purchased = dates.purchase_timestamp(*[F.col("_" + part) for part in ("year", "month", "day", "hour", "minute", "second")])
    return numbers.select(
        *documents.columns,
        F.lit(spec.name).alias("parser_format"),
        purchased.alias("purchased_at"),
        "register_number",
        "ticket_number",
        "cashier_code",
        money.cents_from(F.col("total")).alias("total_cents"),
        F.col("count").try_cast("int").alias("declared_article_count"),
        (F.col("_dated") & purchased.isNull()).alias("bad_date"),
    )


def extract_payments(documents: DataFrame, spec: FormatSpec) -> DataFrame:
    """Payments of sound documents at their line number; the pattern captures (raw label, amount)."""
    hits = lines_where(documents, lambda line, _: matching(spec.payment)(line), F.col("sound"))
    paid = hits.withColumn("_paid", groups("line", spec.payment, 2))
    paid = paid.withColumns({"raw_label": group_of("_paid", 1), "_amount": group_of("_paid", 2)})
    return paid.select(
        "document_id",
        F.col("line_no").alias("position"),
        "raw_label",
        money.payment_category(F.col("raw_label")).alias("category"),
        money.cents_from(F.col("_amount")).alias("amount_cents"),
    )


def vat_table(spec: FormatSpec) -> Column:
    """VAT rows of a document, last row of a code first."""
    if spec.vat_row is None:
        return F.lit(None)
    pattern, code, rate = spec.vat_row
    rows = F.transform(
        F.filter("lines", matching(pattern)),
        lambda line: F.struct(F.regexp_extract(line, pattern, code).alias("code"), rate(line).alias("rate")),
    )
    return F.reverse(rows)


def vat_code_lookup(rows: DataFrame, spec: FormatSpec) -> DataFrame:
    """VAT rate per row from its document's table; ``vat_missing`` marks looked-up codes without a row."""
    if spec.vat_row is None:
        return rows.withColumn("vat_rate_bp", F.col("vat_fixed_bp")).withColumn("vat_missing", F.lit(False)).drop("vat_rows")
    hit = F.get(F.filter("vat_rows", lambda v: v["code"] == F.col("vat_code")), 0)
    return (
        rows.withColumn("_hit", hit)
        .withColumn("vat_rate_bp", F.when(F.col("vat_lookup"), F.col("_hit.rate")).otherwise(F.col("vat_fixed_bp")))
        .withColumn("vat_missing", F.col("vat_lookup") & F.col("reports_vat") & F.col("_hit").isNull())
        .drop("_hit", "vat_rows")
    )


# What a body function states per row, with the usual value; amounts and labels as printed.
CAPTURES = {
    "line_index": ("int", "null"),
    "raw_text": ("string", "null"),
    "printed_label": ("string", "null"),
    "printed_quantity": ("string", "null"),
    "printed_price": ("string", "null"),
    "printed_total": ("string", "null"),
    "negated": ("boolean", "false"),
    "recomputed": ("boolean", "false"),
    "unit_of_measure": ("string", "'piece'"),
    "vat_code": ("string", "null"),
    "vat_lookup": ("boolean", "false"),
    "vat_fixed_bp": ("int", "null"),
    "tr_eligible": ("boolean", "false"),
    "section_label": ("string", "null"),
    "kind": ("string", "null"),
    "emitted": ("boolean", "true"),
    "reports_vat": ("boolean", "true"),
    "failure": ("string", "null"),
}


def captured_row(**stated: Column) -> Column:
    """One row of a body function as a struct; everything not stated has its usual value."""
    return F.struct(
        *[
            stated[name].cast(kind).alias(name) if name in stated else F.expr(f"cast({usual} as {kind}) as {name}")
            for name, (kind, usual) in CAPTURES.items()
        ]
    )


def captured_rows(df: DataFrame, row: Column) -> DataFrame:
    """The struct of each place as a row."""
    return df.select("document_id", "vat_rows", F.inline(F.array(row)))


def converted_rows(rows: DataFrame) -> DataFrame:
    """Printed amounts and labels to cents, decimals and clean labels. No kind stated: by sign."""
    numbers = rows.select(
        "*",
        F.coalesce(money.decimal_from(F.nullif("printed_quantity", F.lit(""))), F.lit(1).cast(money.QUANTITY)).alias("quantity"),
        money.cents_from(F.nullif("printed_price", F.lit(""))).alias("unit_price_cents"),
        money.cents_from(F.col("printed_total")).alias("_stated"),
    )
    total = money.discounted_line_total(F.col("quantity"), F.col("unit_price_cents"), F.col("_stated"), F.col("recomputed"))
    by_sign = F.when(F.col("_stated") < 0, F.lit("discount")).otherwise(F.lit("item"))
    return numbers.withColumns(
        {
            "label": text.clean_label(F.col("printed_label")),
            "label_truncated": text.label_truncated(F.col("printed_label")),
            "total_cents": F.when(F.col("negated"), -F.abs("_stated")).otherwise(total),
            "kind": F.coalesce("kind", by_sign),
        }
    ).drop("_stated", "printed_label", "printed_quantity", "printed_price", "printed_total", "negated", "recomputed")


def assign_line_positions(lines: DataFrame) -> DataFrame:
    place = Window.partitionBy("document_id").orderBy("line_index")
    return lines.withColumn("position", F.row_number().over(place))


def link_promotion_to_line(promotions: DataFrame, lines: DataFrame, key: str = "document_id") -> DataFrame:
    """First line by position whose label is a prefix of the promotion's link label, or the reverse.

    A receipt's labels are one row that meets its promotions once. Promotions of one rule and line number share their link.
    """
    offered = lines.select(key, "position", text.comparable_label(F.col("label")).alias("_offered")).where("_offered <> ''")
    offers = offered.groupBy(key).agg(F.collect_list(F.struct("position", "_offered")).alias("_offers"))
    asked = promotions.withColumn("_asked", F.nullif(text.comparable_label(F.col("link_label")), F.lit(""))).join(offers, key, "left")
    asks = F.col("_asked")
    either = F.filter("_offers", lambda one: asks.startswith(one["_offered"]) | one["_offered"].startswith(asks))
    first = F.when(asks.isNotNull(), F.array_min(F.transform(either, lambda one: one["position"])))
    place = Window.partitionBy(key, "rule_order", "line_no")
    linked = asked.withColumn("_first", first).withColumn("linked_line_position", F.min("_first").over(place))
    return linked.select(
        *promotions.columns,
        "linked_line_position",
        F.when(F.col("linked_line_position").isNotNull(), F.lit("parser_inferred")).otherwise(F.lit("unallocated")).alias("linking_method"),
    )


PROMOTION_TYPE = (
    "struct<rule_order:int,line_no:int,program:string,unit:string,delta:bigint,label:string,kind:string,link_label:string>"
)


def promotion(order: int, program: Column | str, unit: str, delta: Column, label: Column | str, kind: Column | str, link_label: Column | None = None, line_no: Column | None = None) -> Column:
    """One promotion as a struct; string arguments are literals."""
    as_column = lambda value: value if isinstance(value, Column) else F.lit(value)
    return F.struct(
        F.lit(order).alias("rule_order"),
        (F.col("line_no") if line_no is None else line_no).cast("int").alias("line_no"),
        as_column(program).alias("program"),
        F.lit(unit).alias("unit"),
        delta.cast("bigint").alias("delta"),
        text.clean_label(as_column(label)).alias("label"),
        as_column(kind).alias("kind"),
        (F.lit(None) if link_label is None else link_label).cast("string").alias("link_label"),
    )


def promotion_rows(df: DataFrame, *promotions: Column) -> DataFrame:
    """The non-null promotions of each line as rows."""
    return df.select("document_id", F.inline(F.filter(F.array(*promotions), lambda p: p.isNotNull())))


def by_document(documents: DataFrame) -> DataFrame:
    """Hash-partition by document into the configured number of tasks.

    The number is explicit because parsing is bound by CPU, not bytes: adaptive coalescing
    by size would leave too few tasks.
    """
    return documents.repartition(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), "document_id")


class ParsedReceipts:
    """Receipts and children parsed from documents (document_id, text) of one format.

    Plans are built on first use, so a caller that only wants lines plans only lines. A
    document whose parsing fails keeps a receipt with a ``parser_exception`` warning, no
    header values and no children.
    """

    #: Whether ``_headed`` is read from a copy.
    kept = False

    def __init__(self, documents: DataFrame, spec: FormatSpec):
        self.spec = spec
        self.placed = by_document(documents.select("document_id", "text"))

    @cached_property
    def whole(self) -> DataFrame:
        return whole_documents(self.placed)

    @classmethod
    def of_whole(cls, whole: DataFrame, spec: FormatSpec, keep: Callable[[DataFrame, str], DataFrame]) -> ParsedReceipts:
        """Receipts of ``whole_documents``; what all parts start from is made once and kept."""
        parsed = cls.__new__(cls)
        parsed.spec, parsed.whole = spec, whole
        parsed._headed, parsed.kept = keep(parsed._headed, f"headed/{spec.name}"), True
        return parsed

    @cached_property
    def _headed(self) -> DataFrame:
        """Documents with their lines, header values and the reason a document fails, if it does."""
        headed = extract_header(self.spec.mark(self.whole), self.spec)
        reason = F.coalesce(
            F.col("failure"),
            F.when(F.col("bad_date"), F.lit("unreadable purchase date")),
            F.when(F.col("total_cents").isNull(), F.lit("no receipt total")),
        )
        return headed.withColumn("failure", reason).withColumn("sound", F.col("failure").isNull())

    def _of_rows(self, *columns: str) -> DataFrame:
        """Values of a document, once for each row it had."""
        rows = self._headed.select("document_id", *columns, F.explode(F.sequence(F.lit(1), "copies")))
        return rows.select("document_id", *columns)

    @cached_property
    def _rows(self) -> DataFrame:
        """What the bodies of sound documents state."""
        stated = self.spec.body(self._headed.withColumn("vat_rows", vat_table(self.spec)))
        return vat_code_lookup(converted_rows(stated), self.spec)

    @cached_property
    def header(self) -> DataFrame:
        return self._of_rows(*HEADER_COLUMNS, "bad_date")

    @cached_property
    def judged(self) -> DataFrame:
        """Header values, VAT warnings and the reason a document fails, if it does."""
        header = self._of_rows(*HEADER_COLUMNS, "failure", "copies")
        if self.spec.vat_row is None:
            return header.withColumn("_vat", F.lit(None).cast(f"array<struct<line_index:int,warning:{warnings.WARNING_TYPE}>>"))
        vat_warning = warnings.build_warning("missing_vat_code", F.format_string(fixed.VAT_TEXT, F.coalesce("vat_code", F.lit(""))))
        missing = self._rows.where("vat_missing").groupBy("document_id").agg(
            F.array_sort(F.collect_list(F.struct("line_index", vat_warning.alias("warning")))).alias("_vat")
        )
        return header.join(missing, "document_id", "left")

    @cached_property
    def lines(self) -> DataFrame:
        """Lines of sound documents."""
        emitted = self._rows.where("emitted and document_id is not null").select("document_id", "line_index", *LINE_COLUMNS)
        merged = coalesce_repeated_in_place(emitted, "document_id", "line_index")
        return assign_line_positions(merged).select("document_id", "position", *LINE_COLUMNS)

    @cached_property
    def payments(self) -> DataFrame:
        return extract_payments(self._headed, self.spec)

    @cached_property
    def promotions(self) -> DataFrame:
        rules = self.spec.promotions
        promoting = self.spec.promoting or (lambda line, place: F.lit(False))
        opened = F.array_position(F.transform("lines", matching(self.spec.opens)), F.lit(True))
        lines = lines_where(self._headed.withColumn("opened", opened), promoting, F.col("sound"))
        stated = rules(lines) if rules else promotion_rows(lines, F.lit(None).cast(PROMOTION_TYPE))
        return link_promotion_to_line(stated, self.lines).drop("link_label")

    @cached_property
    def receipts(self) -> DataFrame:
        # Header, warnings, lines and payments all start from the marked texts, which take most of the time.
        if not self.kept:
            self._headed, self.kept = stored_copy(self._headed), True
        judged = self.judged
        found = F.transform("_vat", lambda n: n["warning"])
        none = F.array().cast(f"array<{warnings.WARNING_TYPE}>")
        if self.spec.line_warnings is not None:
            noted = self.spec.line_warnings(self._headed).groupBy("document_id").agg(
                F.array_sort(F.collect_list(F.struct("line_no", "warning"))).alias("_noted")
            )
            judged = judged.join(noted, "document_id", "left")
            found = F.concat(F.coalesce(found, none), F.coalesce(F.transform("_noted", lambda n: n["warning"]), none))
        judged = judged.withColumn("_found", F.coalesce(found, none))
        kept = [c for c in judged.columns if c not in ("document_id", "total_cents", "declared_article_count")]
        checked = validator_results(judged.where("document_id is not null"), self.lines, self.payments, "document_id", kept)
        # Every row of a document meets all its rows.
        checked = checked.select("*", F.explode(F.sequence(F.lit(1), "copies")))
        mild = self.spec.mild
        blocking = F.col("_found") if mild is None else F.filter("_found", lambda w: ~mild(w))
        exception = F.array(warnings.build_warning("parser_exception", F.format_string(fixed.FAILURE_TEXT, "failure")))
        failed = F.col("failure").isNotNull()
        passed = ~failed & (F.size("validator_warnings") == 0) & (F.size(blocking) == 0)
        fields = ["purchased_at", "register_number", "ticket_number", "cashier_code", "total_cents", "declared_article_count"]
        return checked.select(
            "document_id",
            "parser_format",
            *[F.when(~failed, F.col(c)).alias(c) for c in fields],
            F.when(passed, F.lit("parsed")).otherwise(F.lit("needs_review")).alias("parser_status"),
            F.when(failed, exception).otherwise(F.concat("_found", "validator_warnings")).alias("parser_warnings"),
        )


def parse_format(documents: DataFrame, spec: FormatSpec) -> ParsedReceipts:
    return ParsedReceipts(documents, spec)


FORMATS: dict[str, FormatSpec] = {}


def register_format(spec: FormatSpec) -> FormatSpec:
    """Make a format available to ``parse_corpus``; a name can be registered once."""
    if FORMATS.get(spec.name, spec) is not spec:
        raise ValueError(f"format {spec.name} is already registered")
    FORMATS[spec.name] = spec
    return spec


def parse_corpus(documents: DataFrame, part: str, formats: list[str] | None = None) -> DataFrame:
    """One part ("receipts", "lines", "promotions", "payments") of a mixed corpus.

    ``documents``: document_id, parser_format, text. Each format reads only its own documents.
    Documents whose format is null or not registered have no children, and keep a receipt
    with a ``parser_exception`` warning.
    """
    parsed = [
        getattr(parse_format(documents.where(F.col("parser_format") == name), FORMATS[name]), part)
        for name in formats or list(FORMATS)
    ]
    if part == "receipts":
        parsed.append(unparsed_receipts(documents, parsed[0]))
    return reduce(DataFrame.unionByName, parsed)


def parse_parts(documents: DataFrame, parts: Sequence[str], formats: list[str], keep: Callable[[DataFrame, str], DataFrame], write: Callable[[DataFrame, str], None]) -> None:
    """Writes several parts, as ``parse_corpus`` gives them, cutting and marking every text once.

    ``documents``: as for ``parse_corpus``, already hash-partitioned by document. ``keep`` stores rows under a name and returns
    the copy, "whole" by ``parser_format``; ``write`` stores a part.
    """
    whole = keep(whole_documents(documents, "parser_format"), "whole")
    parsed = [ParsedReceipts.of_whole(whole.where(F.col("parser_format") == name).drop("parser_format"), FORMATS[name], keep) for name in formats]
    for part in parts:
        found = [getattr(one, part) for one in parsed]
        if part == "receipts":
            found.append(unparsed_receipts(documents, found[0]))
        write(reduce(DataFrame.unionByName, found), part)


def unparsed_receipts(documents: DataFrame, like: DataFrame) -> DataFrame:
    """Bare receipts of documents that no registered format can parse, shaped like ``like``."""
    unknown = documents.where(~F.coalesce(F.col("parser_format").isin(list(FORMATS)), F.lit(False)))
    reason = F.when(F.col("parser_format").isNull(), F.lit("no receipt format")).otherwise(F.format_string("unknown receipt format %s", "parser_format"))
    warning = F.array(warnings.build_warning("parser_exception", F.format_string(fixed.FAILURE_TEXT, reason)))
    given = {"document_id": F.col("document_id"), "parser_format": F.col("parser_format"), "parser_status": F.lit("needs_review"), "parser_warnings": warning}
    return unknown.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields])
