"""Numbers, names and labels as text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size units, and the parts of the standard fonts' names.
UNITS = ("B", "KiB", "MiB", "GiB")
FAMILIES = (
    ("helvetica", "Helvetica"), ("arial", "Helvetica"), ("couriernew", "Courier"), ("courier", "Courier"),
    ("timesnewroman", "Times"), ("times", "Times"), ("zapfdingbats", "ZapfDingbats"), ("symbol", "Symbol"),
)
STYLE_WORDS = "bold|italic|oblique|psmt|mt|ps|regular|roman"
STANDARD_ENCODINGS = ("WinAnsiEncoding", "MacRomanEncoding", "StandardEncoding")


def canonical_number(token: Column) -> Column:
    """A plain number without a plus, idle zeros, an idle point or a sign of zero; null for anything else."""
    whole = F.regexp_extract(token, r"^[+-]?0*([0-9]*)", 1)
    part = F.regexp_extract(token, r"\.([0-9]*?)0*$", 1)
    sign = F.when(token.startswith("-"), "-").otherwise("")
    plain = token.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]*)$")
    digits = F.concat(whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise(""))
    return F.when(plain, F.when(digits == "", "0").otherwise(F.concat(sign, digits)))


def human(size: Column) -> Column:
    """A number of bytes with a unit, one decimal from KiB on."""
    out = F.format_string("%d B", size.cast("bigint"))
    for power, unit in enumerate(UNITS[1:], 1):
        out = F.when(size >= 1024**power, F.format_string(f"%.1f {unit}", size / float(1024**power))).otherwise(out)
    return out


def percent(before: Column, after: Column) -> Column:
    """Signed change with one decimal; a dash if there was nothing."""
    return F.when(before == 0, "-").otherwise(F.format_string("%+.1f%%", (after - before) / F.when(before == 0, F.lit(None)).otherwise(before) * 100.0))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, "-").otherwise(F.format_string("%.0f%%", part * 100.0 / F.when(whole == 0, F.lit(None)).otherwise(whole)))


def truncated_left(text: Column, width: int) -> Column:
    """The end of a text that is too long, after three dots."""
    return F.when(F.char_length(text) <= width, text).otherwise(F.concat(F.lit("..."), F.substring(text, 3 - width, width - 3)))


def size_cell(size: Column, whole: Column) -> Column:
    """A size and its share of the whole; a dash if there is none."""
    return F.when(size.isNull(), "-").otherwise(F.concat(size.cast("bigint").cast("string"), F.lit(" ("), ratio(size, whole), F.lit(")")))


def score_cell(score: Column) -> Column:
    return F.when(score.isNull(), "-").otherwise(F.format_string("%.3f", score))


def without_tag(name: Column) -> Column:
    """A font name without the six letters and plus of a subset."""
    return F.regexp_replace(name, r"^[A-Z]{6}\+", "")


def with_tag(name: Column, tag: Column) -> Column:
    return F.when(name.rlike(r"^[A-Z]{6}\+"), name).otherwise(F.concat(tag, F.lit("+"), name))


def standard_font(name: Column) -> Column:
    """The standard font a name stands for under the usual spellings; null if none."""
    folded = F.lower(F.regexp_replace(without_tag(name), "[ ,_-]", ""))
    family, rest = F.lit(None).cast("string"), F.lit(None).cast("string")
    for prefix, known in reversed(FAMILIES):
        hit = folded == prefix if known == "Symbol" else folded.startswith(prefix)
        family, rest = F.when(hit, known).otherwise(family), F.when(hit, F.substring(folded, len(prefix) + 1, 1000)).otherwise(rest)
    known = rest.rlike(f"^(?:{STYLE_WORDS})*$")
    bold, slant = rest.contains("bold"), rest.rlike("italic|oblique")
    lean = F.when(family == "Times", "Italic").otherwise("Oblique")
    style = F.concat(F.when(bold, "Bold").otherwise(""), F.when(slant, lean).otherwise(""))
    plain = F.when(family == "Times", "Times-Roman").otherwise(family)
    single = family.isin("Symbol", "ZapfDingbats")
    return F.when(known & ~(single & (style != "")), F.when(style == "", plain).otherwise(F.concat_ws("-", family, style)))


def can_unembed(name: Column, encoding: Column, differences_known: Column, symbolic: Column) -> Column:
    """The standard font whose program can go: symbols without an encoding; else a standard one, or none and not symbolic."""
    font = standard_font(name)
    symbol = font.isin("Symbol", "ZapfDingbats")
    fits = F.when(symbol, encoding.isNull()).when(encoding.isNull(), ~F.coalesce(symbolic, F.lit(False))).otherwise(encoding.isin(*STANDARD_ENCODINGS) & F.coalesce(differences_known, F.lit(True)))
    return F.when(fits, font)


def safe_name(name: Column) -> Column:
    """At most 127 characters of printable ASCII without delimiters; Untitled if nothing is left."""
    out = F.substring(F.regexp_replace(name, r"[^\x21-\x7e]|[\[\](){}<>/%]", "_"), 1, 127)
    return F.when(F.coalesce(name, F.lit("")) == "", "Untitled").otherwise(out)


def safe_name_of(name: str) -> str:
    """safe_name() of one text."""
    return re.sub(r"[^\x21-\x7e]|[\[\](){}<>/%]", "_", name)[:127] or "Untitled"


def standard_font_of(name: str) -> str | None:
    """standard_font() of one text."""
    folded = re.sub("[ ,_-]", "", re.sub(r"^[A-Z]{6}\+", "", name)).lower()
    for prefix, family in FAMILIES:
        if folded == prefix if family == "Symbol" else folded.startswith(prefix):
            rest = folded[len(prefix) :]
            break
    else:
        return None
    bold, slant = "bold" in rest, bool(re.search("italic|oblique", rest))
    if not re.fullmatch(f"(?:{STYLE_WORDS})*", rest) or family in ("Symbol", "ZapfDingbats") and (bold or slant):
        return None
    style = "Bold" * bold + ("Italic" if family == "Times" else "Oblique") * slant
    return f"{family}-{style}" if style else "Times-Roman" if family == "Times" else family


# What to look for, in this order, and the category.
PROBLEM_KINDS = (("does not parse", "parse"), ("page count", "page_count"), ("content stream", "content_stream"), ("(ImageDecode)", "image"))


def problem_category(problem: Column) -> Column:
    """The first kind of problem whose words the text has."""
    out = F.lit("stream")
    for words, kind in reversed(PROBLEM_KINDS):
        out = F.when(problem.contains(words), kind).otherwise(out)
    return out


def category_of(problem: str) -> str:
    return next((kind for words, kind in PROBLEM_KINDS if words in problem), "stream")


def non_ascii_hex(h: Column) -> Column:
    """Whether hex digits hold a byte outside 0x20 to 0x7e."""
    return h.rlike(r"^(?:..)*(?:[01][0-9A-F]|7F|[89A-F][0-9A-F])")


def output_name(path: Column, folder: Column) -> Column:
    """Where a compressed copy goes: <folder or own folder>/<stem>-compressed.pdf."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    own = F.regexp_replace(path, r"/?[^/]*$", "")
    return F.concat(F.coalesce(folder, own), F.lit("/"), stem, F.lit("-compressed.pdf"))
