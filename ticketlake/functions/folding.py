"""Character folding tables, built by rule from the Unicode database."""

from __future__ import annotations

import unicodedata
from functools import cache

# Latin letters that fold to ASCII without a canonical decomposition.
LATIN_EXPANSIONS = {
    "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "ß": "ss",
    "Ð": "D", "ð": "d", "Đ": "D", "đ": "d", "Ø": "O", "ø": "o",
    "Þ": "Th", "þ": "th", "Ħ": "H", "ħ": "h", "ı": "i", "Ĳ": "IJ", "ĳ": "ij",
    "ĸ": "k", "Ŀ": "L", "ŀ": "l", "Ł": "L", "ł": "l", "ŉ": "'n", "Ŋ": "NG", "ŋ": "ng",
    "Ŧ": "T", "ŧ": "t", "×": "x",
}
COMBINING = [chr(c) for c in range(0x300, 0x370)]
CODE_POINTS = [*range(0x80, 0xD800), *range(0xE000, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F1AD)]


def _base(char: str, form: str) -> str:
    return "".join(c for c in unicodedata.normalize(form, char) if unicodedata.category(c) != "Mn")


@cache
def latin_letters() -> dict[str, str]:
    """Letters of the Latin-1 and Latin Extended-A blocks that have an ASCII spelling."""
    table = {}
    for code in range(0xC0, 0x180):
        char = chr(code)
        folded = LATIN_EXPANSIONS.get(char) or _base(char, "NFD")
        if folded.isascii():
            table[char] = folded
    return table | {"×": "x"}


@cache
def transliteration() -> dict[str, str]:
    """Compatibility form, then the ASCII spelling; characters without one are left out."""
    table = {}
    for code in CODE_POINTS:
        char = chr(code)
        folded = "".join(latin_letters().get(c, c if c.isascii() else " ") for c in unicodedata.normalize("NFKC", char))
        if any(c.isalnum() for c in folded):
            table[char] = folded.lower()
    return table


@cache
def composable() -> dict[str, str]:
    """Combining mark -> ASCII letters that carry it in the Latin letter table."""
    pairs: dict[str, str] = {}
    for char in latin_letters():
        parts = unicodedata.normalize("NFD", char)
        if len(parts) == 2 and parts[0].isascii() and parts[1] in COMBINING:
            pairs[parts[1]] = pairs.get(parts[1], "") + parts[0]
    return pairs


@cache
def mark_removal() -> dict[str, str]:
    """Canonical decomposition without marks, where that leaves ASCII."""
    table = {}
    for code in CODE_POINTS:
        folded = _base(chr(code), "NFD")
        if folded and folded.isascii():
            table[chr(code)] = folded.lower()
    return table


@cache
def unaccent() -> dict[str, str]:
    """Compatibility decomposition without marks, plus the Latin expansions."""
    table = {}
    for code in CODE_POINTS:
        char = chr(code)
        folded = LATIN_EXPANSIONS.get(char) or _base(char, "NFKD")
        if folded and folded.isascii() and any(c.isalnum() for c in folded):
            table[char] = folded.lower()
    return table
