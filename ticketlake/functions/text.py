"""Label and text normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketlake.functions import folding


def _spell_out(text: Column, table: dict[str, str]) -> Column:
    """Multi-letter spellings: Latin letters by plain replacement, rare symbols by lookup.

    Both branches are guarded, so text without such characters passes through unchanged.
    """
    latin = {c: r for c, r in table.items() if c in folding.LATIN_EXPANSIONS}
    rare = {c: r for c, r in table.items() if c not in latin}
    spelled = text
    for char, letters in latin.items():
        spelled = F.replace(spelled, F.lit(char), F.lit(letters))
    if latin:
        spelled = F.when(text.rlike("[" + "".join(latin) + "]"), spelled).otherwise(text)
    if not rare:
        return spelled
    lookup = F.create_map(*[F.lit(x) for pair in rare.items() for x in pair])
    looked_up = F.array_join(F.transform(F.split(spelled, ""), lambda c: F.coalesce(F.element_at(lookup, c), c)), "")
    # Two ranges that cover every rare symbol: a class of hundreds of letters is slow to test.
    return F.when(text.rlike("[\\u00BC-\\u00BE\\u0100-\\x{10FFFF}]"), looked_up).otherwise(spelled)


def _fold(text: Column, table: dict[str, str]) -> Column:
    """Replace characters by table, single letters in one pass."""
    single = {c: r for c, r in table.items() if len(r) == 1}
    multiple = {c: r for c, r in table.items() if len(r) > 1}
    translated = F.translate(text, "".join(single), "".join(single.values()))
    # Bound once: the guarded branches mention it several times.
    return F.get(F.transform(F.array(translated), lambda t: _spell_out(t, multiple)), 0)


def _separate(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def normalize_text(text: Column) -> Column:
    """Catalogue identity text: compatibility form, ASCII spelling, lower case, single blanks."""
    composed = text
    for mark, letters in folding.composable().items():
        composed = F.regexp_replace(composed, f"([{letters}]){mark}(?!\\p{{Mn}})", "$1")
    composed = F.when(text.rlike("\\p{Mn}"), composed).otherwise(text)
    return F.coalesce(_separate(_fold(composed, folding.transliteration())), F.lit(""))


def normalize_detection_text(text: Column) -> Column:
    """Evidence text: marks dropped, nothing spelled out."""
    bare = F.regexp_replace(_fold(text, folding.mark_removal()), "\\p{Mn}+", "")
    return F.coalesce(_separate(bare), F.lit(""))


def normalize_backfill(text: Column) -> Column:
    """Bulk variant used for stored label snapshots; null stays null."""
    return _separate(_fold(F.regexp_replace(text, "\\p{Mn}+", ""), folding.unaccent()))


def slugify(text: Column) -> Column:
    ascii_text = F.lower(_fold(text, {c: r.lower() for c, r in folding.latin_letters().items()}))
    hyphened = F.regexp_replace(ascii_text, "[^a-z0-9_-]+", "-")
    return F.regexp_replace(F.regexp_replace(hyphened, "-{2,}", "-"), "^-|-$", "")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r\0"))


def clean_label(label: Column) -> Column:
    return strip(F.when(label_truncated(label), F.regexp_replace(label, "\\s*\\.\\.\\z", "")).otherwise(label))


def label_truncated(label: Column) -> Column:
    return label.endswith("..")


def unstarred_label(label: Column) -> Column:
    return strip(F.when(label.startswith("*"), F.substr(label, F.lit(2))).otherwise(label))


def comparable_label(label: Column) -> Column:
    return strip(F.regexp_replace(F.upper(clean_label(label)), "\\s+", " "))


def contains_whole_words(normalized_text: Column, normalized_value: Column, minimum: int = 3) -> Column:
    padded = F.concat(F.lit(" "), normalized_text, F.lit(" "))
    wanted = F.concat(F.lit(" "), normalized_value, F.lit(" "))
    return (F.length(normalized_value) >= minimum) & F.contains(padded, wanted)


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike("[^\\s\\p{Z}\\x{85}]")


def capture(text: Column, pattern: str, group: int) -> Column:
    """Capture group, or null when the pattern or the group does not take part."""
    return F.when(text.rlike(pattern), F.nullif(F.regexp_extract(text, pattern, group), F.lit("")))
