"""Text normalisation, fingerprints and predicates, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def _plain(c: str) -> str:
    """What is left of a character after compatibility decomposition without combining marks."""
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


#: Characters of the scripts with letters that are, in lower case, one other character without their marks; then the marks themselves, which have no counterpart, so ``translate`` takes them out.
_FOLDED = {c: p for c in map(chr, [*range(0xC0, 0x2000), *range(0xFF01, 0xFF5F)]) if c == c.lower() and len(p := _plain(c)) == 1 and p != c and p == p.lower() and p.isalnum()}
MARKED = "".join(_FOLDED) + "".join(map(chr, range(0x300, 0x370)))
PLAIN = "".join(_FOLDED.values())


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def collapsed(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


def folded(x: Column) -> Column:
    """Lower case without marks, in all scripts with letters."""
    return F.translate(F.lower(x), MARKED, PLAIN)


def fingerprint(x: Column, limit: int = 1400) -> Column:
    """Folded words of letters and digits, without URLs and numbers of four digits or more."""
    out = folded(F.coalesce(x, F.lit("")))
    for pattern in (r"https?://\S+", r"\b[0-9]{4,}\b", r"[^a-z0-9]+"):
        out = F.regexp_replace(out, pattern, " ")
    return F.substring(F.trim(out), 1, limit)


def redacted(x: Column, limit: int = 1000) -> Column:
    """Emails, URLs and phone numbers replaced by placeholders; white space collapsed."""
    out = collapsed(x)
    out = F.regexp_replace(out, r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[redacted-email]")
    out = F.regexp_replace(out, r"https?://\S+", "[redacted-url]")
    out = F.regexp_replace(out, r"(?<!\w)(?:\+?\d[\d\s().-]{7,}\d)(?!\w)", "[redacted-phone]")
    return F.trim(F.substring(out, 1, limit))


def cut_at_word(x: Column, limit: int) -> Column:
    whole = collapsed(x)
    cut = F.substring(whole, 1, limit)
    return F.when(F.length(whole) <= limit, whole).when(F.instr(cut, " ") > 0, F.trim(F.regexp_replace(cut, r" [^ ]*$", ""))).otherwise(cut)


def occurrences(text: Column, term: Column) -> Column:
    """How often ``term`` occurs in ``text``, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.greatest(F.length(term), F.lit(1))).cast("long")


def terms(query: str, stop: tuple[str, ...] = ("de", "la", "el", "y", "o", "a", "en", "por", "para", "con", "un", "una", "los", "las")) -> list[str]:
    """A query's words of two characters and more that aren't stop words, in order."""
    import re

    return [t for t in re.findall(r"[\w.-]+", query.lower()) if len(t) > 1 and t not in stop]


def specificity(location: Column, generic: tuple[str, ...] = ("japan", "japon", "south korea", "corea del sur")) -> Column:
    parts = F.size(F.filter(F.split(F.coalesce(location, F.lit("")), r"[,/|-]"), lambda p: F.trim(p) != ""))
    plain = fingerprint(location, 220)
    return F.when(plain == "", 0).when(plain.isin(*generic), 1).otherwise(F.least(F.lit(20), parts + 2))


def halved(title: Column) -> Column:
    """A title that is written twice, once."""
    return F.regexp_replace(collapsed(title), r"(?i)^(.+?)\s+\1$", "$1")


def slug(x: Column) -> Column:
    return F.trim(F.regexp_replace(folded(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))


def first_matching(text: Column, rules: tuple[tuple[str, tuple[str, ...]], ...], default: str) -> Column:
    """The name of the first rule of which a word is contained in the text."""
    out = F.lit(default)
    for name, words in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out
