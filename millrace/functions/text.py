"""Column functions on text: white space, accents, slugs, titles, ids, entities, similarity.

A null or blank input gives null wherever a text is returned. White space and word limits follow the
browsers' regular expressions (no-break spaces are white space; letters beyond ASCII are not word
characters), whatever the JVM's defaults are."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
LETTER = "[A-Za-z0-9_]"

#: Institutions whose ids have a short prefix.
SHORT_NAMES = {
    "massachusetts institute of technology": "mit",
    "stanford university": "stanford",
    "harvard university": "harvard",
    "university of california, berkeley": "berkeley",
    "carnegie mellon university": "cmu",
    "georgia institute of technology": "georgia-tech",
    "university of oxford": "oxford",
    "university of cambridge": "cambridge",
    "imperial college london": "imperial",
    "project management institute": "pmi",
    "banco interamericano de desarrollo": "iadb",
}


def pattern(text: str) -> str:
    r"""A JVM pattern, in any case, for one in which \b, \s and \w are meant as browsers mean them; \b stands
    before a letter or a group of words, or else after one."""
    text = re.sub(r"\\b(?=[A-Za-z(])", f"(?<!{LETTER})", text).replace(r"\b", f"(?!{LETTER})")
    flags = "(?i)" if text.isascii() else "(?iu)"
    return flags + text.replace(r"\w", LETTER).replace(r"\s", SPACE)


def says(c: Column, *texts: str) -> Column:
    r"""Whether one of the patterns is in c. What all of them start with, \b, is looked for once."""
    if len(texts) > 1 and all(x.startswith(r"\b") for x in texts):
        text = r"\b(?:" + "|".join(x.removeprefix(r"\b") for x in texts) + ")"
    else:
        text = "|".join(f"(?:{x})" for x in texts) if len(texts) > 1 else texts[0]
    return F.coalesce(c.rlike(pattern(text)), F.lit(False))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, which is evaluated once however often f uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean(c: Column) -> Column:
    """White space collapsed and trimmed; null if nothing is left."""
    return blank_to_null(F.trim(F.regexp_replace(c, f"{SPACE}+", " ")))


def _accented() -> tuple[str, str]:
    """Characters whose decomposition without combining marks is one ASCII character, and that character."""
    pairs = []
    for point in [*range(0x80, 0xD800), *range(0xE000, 0x10000)]:
        plain = "".join(x for x in unicodedata.normalize("NFD", chr(point)) if not "\u0300" <= x <= "\u036f")
        if len(plain) == 1 and ord(plain) < 128:
            pairs.append((chr(point), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accented()


def strip_accents(c: Column) -> Column:
    """ASCII text is left as it is, which is far cheaper than to look its characters up."""
    ascii_ = F.octet_length(c) == F.length(c)
    return F.when(ascii_, c).otherwise(F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"[\u0300-\u036f]", ""))


def slug(c: Column, most: int = 80) -> Column:
    """Lower-case words of a-z and 0-9 joined by hyphens, at most so many characters."""
    dashed = F.regexp_replace(F.lower(strip_accents(clean(c))), "[^a-z0-9]+", "-")
    return blank_to_null(F.regexp_replace(F.left(dashed, F.lit(most)), "^-+|-+$", ""))


def norm_title(c: Column) -> Column:
    """A title for comparison: no accents, lower case, only a-z, 0-9 and single spaces."""
    words = F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", " ")
    return blank_to_null(F.trim(words))


def make_id(institution: Column, code: Column, title: Column) -> Column:
    """Institution's short name or slug, then the code's slug or else the title's; null without the latter."""
    table = F.create_map(*[F.lit(x) for pair in SHORT_NAMES.items() for x in pair])
    prefix = F.coalesce(F.try_element_at(table, F.lower(clean(institution))), slug(institution))
    suffix = F.coalesce(slug(code), slug(title))
    return F.when(suffix.isNotNull(), F.concat_ws("-", prefix, suffix))


def similarity(a: Column, b: Column) -> Column:
    """1 - edits / longer length of two normalised titles; 0 if one is null."""
    left, right = norm_title(a), norm_title(b)
    return F.coalesce(1 - F.levenshtein(left, right) / F.greatest(F.length(left), F.length(right)), F.lit(0.0))


def _code_points(c: Column, found: str, radix: int) -> Column:
    hexed = lambda x: F.lpad(x if radix == 16 else F.hex(x.cast("long")), 8, "0")
    mark = "&#x" if radix == 16 else "&#"

    def one(text: Column, code: Column) -> Column:
        value = F.decode(F.unhex(hexed(code)), "UTF-32")
        text = F.replace(text, F.concat(F.lit(mark), code, F.lit(";")), value)
        return F.replace(text, F.concat(F.lit("&#X"), code, F.lit(";")), value) if radix == 16 else text

    codes = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(found), 1))
    return once(c, lambda x: F.when(x.rlike(found), F.aggregate(codes(x), x, one)).otherwise(x))


def decode_entities(c: Column) -> Column:
    """The references lt, gt, quot, decimal and hexadecimal, nbsp and, last, amp."""
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        c = F.replace(c, F.lit(name), F.lit(value))
    return once(c, lambda x: F.when(F.contains(x, F.lit("&")), _numbered(x)).otherwise(x))


def _numbered(c: Column) -> Column:
    c = _code_points(c, r"&#(0*[0-9]{1,6}|0*10[0-9]{5}|0*110[0-9]{4}|0*111[0-3][0-9]{3});", 10)
    c = _code_points(c, r"(?i)&#x([0-9a-f]{1,5}|0*10[0-9a-f]{4});", 16)
    return F.replace(F.replace(c, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))


def decoded(c: Column) -> Column:
    """References decoded, then cleaned."""
    return clean(decode_entities(c))
