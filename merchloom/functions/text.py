"""Names, codes, prices and labels as Column expressions; everything stays in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: JavaScript-like white space: Java's \s has neither the no-break space nor the Unicode spaces.
SPACE = r"[\s   -     　﻿]"


def _folding() -> tuple[str, str]:
    """Characters whose canonical decomposition is one character and marks, and those characters: all scripts of the basic plane.
    Hangul syllables, which decompose into several letters, stay whole, and so do unified ideographs, which do not decompose."""
    source, target = [], []
    for block in ((0xC0, 0x3400), (0xF900, 0x10000)):
        for c in map(chr, range(*block)):
            base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.category(x).startswith("M"))
            if base != c and len(base) == 1:
                source.append(c)
                target.append(base)
    return "".join(source), "".join(target)


_MARKED, _PLAIN = _folding()


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    """White space runs become one space; trimmed."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def name_key(name: Column) -> Column:
    """Lower case without marks; everything but letters and digits becomes one space."""
    plain = F.regexp_replace(F.translate(F.lower(name), _MARKED, _PLAIN), r"\p{M}+", "")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty strings are equal, one empty string is like nothing."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def half_up(c: Column, places: int) -> Column:
    """Rounded as Math.round does: halves go up."""
    return F.floor(c * 10**places + F.lit(0.5)) / F.lit(float(10**places))


def ranked_value(c: Column, order: list[str], default: int = 999) -> Column:
    """Position of a value in ``order``."""
    rank = F.lit(default)
    for i, value in reversed(list(enumerate(order))):
        rank = F.when(c == value, i).otherwise(rank)
    return rank


def base_code(sku: Column, sources: list[str]) -> Column:
    """The code before ``__source__`` in a composite stock code, or the whole code; upper case without spaces."""
    trimmed = js_trim(sku)
    head = F.regexp_extract(trimmed, rf"(?s)^(.+?)__(?:{'|'.join(sources)})__", 1)
    code = F.upper(F.regexp_replace(F.when(head != "", head).otherwise(trimmed), f"{SPACE}+", ""))
    return F.when(code != "", code)


def safe_id(c: Column) -> Column:
    """Characters other than letters, digits, _ and - become -, runs of - one -."""
    return F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9_-]", "-"), "-+", "-")


def product_slug(source: Column, external_id: Column) -> Column:
    return F.substring(F.regexp_replace(F.concat_ws("-", source, safe_id(external_id)), "^-|-$", ""), 1, 200)


def product_sku(code: Column, source: Column, external_id: Column) -> Column:
    """code__source__id of at most 120 characters; null without a code."""
    trimmed = js_trim(code)
    whole = F.substring(F.regexp_replace(F.concat_ws("__", trimmed, source, safe_id(external_id)), "^-|-$", ""), 1, 120)
    return F.when(trimmed != "", F.when(whole != "", whole))


def spec_number(value: Column) -> Column:
    """A value that is one plain number below 1e12, as DECIMAL(18,6); else null."""
    text = F.regexp_replace(F.regexp_extract(js_trim(value), r"^([0-9]+(?:[.,][0-9]+)?)$", 1), ",", ".")
    number = text.try_cast("double")
    return F.when((text != "") & (number < 1e12), text.try_cast("decimal(18,6)"))


def price(text: Column) -> Column:
    """The whole number before the currency word; a decimal part is not read (only its digits next to
    the word are), as the catalogue's own rule has it."""
    digits = F.regexp_extract(collapse(text), r"(?iu)([0-9\s]+)\s*грн", 1)
    return F.regexp_replace(digits, r"\s", "").try_cast("int")


def filterable(label: Column) -> Column:
    return label.rlike("(?iu)м²|м2|вт|w")


#: Ukrainian letters in Latin. Fixed values.
_LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "h", "ґ": "g", "д": "d", "е": "e", "є": "ye", "ж": "zh", "з": "z", "и": "y", "і": "i", "ї": "yi", "й": "y", "к": "k",
    "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch",
    "ы": "y", "э": "e", "ю": "yu", "я": "ya", "ё": "yo", "ъ": "", "ь": "", "²": "2", "³": "3",
}


def slug(label: Column, limit: int, default: str) -> Column:
    """Transliterated, lower-cased, words joined by -, at most ``limit`` characters."""
    text = F.translate(F.lower(label), *map("".join, zip(*[(k, v) for k, v in _LATIN.items() if len(v) == 1])))
    for k, v in _LATIN.items():
        if len(v) != 1:
            text = F.replace(text, F.lit(k), F.lit(v))
    text = F.regexp_replace(F.translate(text, _MARKED, _PLAIN), r"[^a-z0-9\s-]", "")
    text = F.regexp_replace(F.regexp_replace(text, r"[\s-]+", "-"), "^-|-$", "")
    short = F.substring(text, 1, limit)
    return F.when(short != "", short).otherwise(default)


def spec_display(text: Column, number: Column, unit: Column) -> Column:
    """The text, else the number with its unit, else a dash."""
    plain = F.regexp_replace(number.cast("string"), r"(\.[0-9]*?)0+$", "$1")
    shown = F.when(number.isNotNull(), F.concat_ws(" ", F.regexp_replace(plain, r"\.$", ""), F.nullif(unit, F.lit(""))))
    return F.coalesce(F.nullif(text, F.lit("")), shown, F.lit("—"))


def price_label(value: Column, visible: Column, otherwise: str = "on request") -> Column:
    amount = F.concat(F.replace(F.format_number(value, 0), F.lit(","), F.lit(" ")), F.lit(" ₴"))
    return F.when(visible & value.isNotNull(), amount).otherwise(otherwise)


def escaped_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br/>\n")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def shortened(text: Column, limit: int = 320) -> Column:
    """Texts above ``limit`` characters are cut three below it and end in an ellipsis."""
    cut = F.concat(js_trim(F.substring(text, 1, limit - 3)), F.lit("…"))
    return F.when(F.length(text) > limit, cut).otherwise(F.nullif(text, F.lit("")))
