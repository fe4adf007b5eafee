"""Glyph names, what they stand for, and the codes that simple fonts give them."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the accents, and of the characters that aren't a letter with or without one.
ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "dieresis": "̈", "ring": "̊", "cedilla": "̧", "caron": "̌"}
DIGITS = "zero one two three four five six seven eight nine"
ASCII_SIGNS = (
    "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash "
    "colon semicolon less equal greater question at bracketleft backslash bracketright asciicircum underscore grave braceleft bar braceright asciitilde"
)
OTHERS = {
    "exclamdown": "¡", "cent": "¢", "sterling": "£", "currency": "¤", "yen": "¥", "brokenbar": "¦", "section": "§", "dieresis": "¨", "copyright": "©", "ordfeminine": "ª",
    "guillemotleft": "«", "logicalnot": "¬", "registered": "®", "macron": "¯", "degree": "°", "plusminus": "±", "twosuperior": "²", "threesuperior": "³", "acute": "´", "mu": "µ",
    "paragraph": "¶", "periodcentered": "·", "cedilla": "¸", "onesuperior": "¹", "ordmasculine": "º", "guillemotright": "»", "onequarter": "¼", "onehalf": "½", "threequarters": "¾",
    "questiondown": "¿", "AE": "Æ", "Eth": "Ð", "multiply": "×", "Oslash": "Ø", "Thorn": "Þ", "germandbls": "ß", "ae": "æ", "eth": "ð", "divide": "÷", "oslash": "ø", "thorn": "þ",
    "dotlessi": "ı", "Lslash": "Ł", "lslash": "ł", "OE": "Œ", "oe": "œ", "florin": "ƒ", "circumflex": "ˆ", "caron": "ˇ", "breve": "˘", "dotaccent": "˙", "ring": "˚", "ogonek": "˛",
    "tilde": "˜", "hungarumlaut": "˝", "endash": "–", "emdash": "—", "quoteleft": "‘", "quoteright": "’", "quotesinglbase": "‚", "quotedblleft": "“", "quotedblright": "”",
    "quotedblbase": "„", "dagger": "†", "daggerdbl": "‡", "bullet": "•", "ellipsis": "…", "perthousand": "‰", "guilsinglleft": "‹", "guilsinglright": "›", "fraction": "⁄",
    "Euro": "€", "trademark": "™", "minus": "−", "fi": "ﬁ", "fl": "ﬂ",
}
# Codes of the standard encoding above ASCII.
STANDARD_HIGH = {
    0xA1: "exclamdown cent sterling fraction yen florin section currency quotesingle quotedblleft guillemotleft guilsinglleft guilsinglright fi fl", 0xB1: "endash dagger daggerdbl periodcentered",
    0xB6: "paragraph bullet quotesinglbase quotedblbase quotedblright guillemotright ellipsis perthousand", 0xBF: "questiondown", 0xC1: "grave acute circumflex tilde macron breve dotaccent dieresis",
    0xCA: "ring cedilla", 0xCD: "hungarumlaut ogonek caron emdash", 0xE1: "AE", 0xE3: "ordfeminine", 0xE8: "Lslash Oslash OE ordmasculine", 0xF1: "ae", 0xF5: "dotlessi", 0xF8: "lslash oslash oe germandbls",
}
CODECS = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman"}


@lru_cache(maxsize=1)
def _named() -> dict[str, str]:
    signs = [c for c in map(chr, range(32, 127)) if not c.isalnum()]
    out = dict(zip(ASCII_SIGNS.split(), signs, strict=True)) | dict(zip(DIGITS.split(), "0123456789", strict=True))
    return out | OTHERS


def character(name: str) -> int | None:
    """The code point a glyph name stands for: named, a letter, a letter with an accent, uniXXXX or uXXXX; None otherwise."""
    if name in _named():
        return ord(_named()[name])
    if len(name) == 1 and name.isascii() and name.isalpha():
        return ord(name)
    if (accent := ACCENTS.get(name[1:])) and name[0].isascii() and name[0].isalpha():
        whole = unicodedata.normalize("NFC", name[0] + accent)
        return ord(whole) if len(whole) == 1 else None
    if m := re.fullmatch(r"uni([0-9A-F]{4})|u([0-9A-F]{4,6})", name):
        value = int(m[1] or m[2], 16)
        return value if value <= 0x10FFFF and not 0xD800 <= value <= 0xDFFF else None
    return None


@lru_cache(maxsize=1)
def _names() -> dict[str, str]:
    letters = {c: c for c in map(chr, range(65, 123)) if c.isalpha()}
    marked = {unicodedata.normalize("NFC", c + a): c + n for c in letters for n, a in ACCENTS.items()}
    return {c: n for c, n in marked.items() if len(c) == 1} | letters | {c: n for n, c in _named().items()}


def name_of(char: str) -> str | None:
    return _names().get(char)


@lru_cache(maxsize=4)
def encoding(name: str) -> dict[int, str]:
    """Glyph names by code of a predefined encoding; KeyError for others."""
    if name == "StandardEncoding":
        out = {c: n for c in range(32, 127) if (n := name_of(chr(c)))} | {0x27: "quoteright", 0x60: "quoteleft"}
        for first, names in STANDARD_HIGH.items():
            out |= {first + i: n for i, n in enumerate(names.split())}
        return out
    out = {}
    for code in range(32, 256):
        try:
            glyph = name_of(bytes([code]).decode(CODECS[name]))
        except UnicodeDecodeError:
            glyph = None
        if name == "WinAnsiEncoding":
            glyph = {0xA0: "space", 0xAD: "hyphen"}.get(code, glyph or ("bullet" if code > 126 else None))
        if glyph:
            out[code] = glyph
    return out


def glyph_name(code: int, differences: dict[int, str], base: str | None, symbolic: bool) -> str | None:
    """What a code selects: a difference, else the base encoding's, else the standard one's if the font isn't symbolic."""
    if code in differences:
        return differences[code]
    if base in (*CODECS, "StandardEncoding"):
        return encoding(base).get(code)
    return None if symbolic else encoding("StandardEncoding").get(code)


def used_codes(strings: Column) -> Column:
    """The distinct bytes of an array of byte strings, in order."""
    each = F.transform(strings, lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(s), F.lit(1))), lambda i: F.conv(F.hex(F.substring(s, i, F.lit(1))), 16, 10).cast("int")))
    return F.array_sort(F.array_distinct(F.filter(F.flatten(each), lambda c: c.isNotNull())))


def glyph_order(names: list[str], codes: dict[int, str]) -> list[str]:
    """.notdef, then encoded glyphs by their lowest code, then the others as they were."""
    lowest: dict[str, int] = {}
    for code in sorted(codes):
        lowest.setdefault(codes[code], code)
    rest = [n for n in names if n != ".notdef"]
    return [".notdef", *sorted((n for n in rest if n in lowest), key=lowest.__getitem__), *(n for n in rest if n not in lowest)]
