"""Dates and ages written in words, against a reference instant that is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for now and today, and units with their milliseconds.
NOW = ("just now", "moments ago", "a few seconds ago", "ahora mismo", "hace un momento", "hace unos segundos", "recién", "recien")
UNITS = ((r"([0-9]+)\s*(?:seconds?|segundos?)", 1000), (r"([0-9]+)\s*(?:minutes?|mins?|minutos?)", 60_000), (r"([0-9]+)\s*(?:hours?|hrs?|horas?)", 3_600_000), (r"([0-9]+)\s*(?:days?|d[ií]as?)", 86_400_000))
DAY_MS = 86_400_000
#: Spanish months in order.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
#: English months in order.
ENGLISH_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def age_ms(text: Column, now_ms: int) -> Column:
    """How long before ``now_ms`` a text like '3 days ago' or 'hace 4 horas' is; null if it doesn't say."""
    t = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))
    now = F.lit(False)
    for word in NOW:
        now = now | F.contains(t, F.lit(word))
    out = F.when(now, F.lit(0)).when(t.isin("today", "hoy") | F.contains(t, F.lit("today")) | F.contains(t, F.lit("publicado hoy")), F.lit(now_ms % DAY_MS))
    for pattern, ms in UNITS:
        n = F.regexp_extract(t, pattern, 1)
        out = out.when(n != "", n.cast("long") * ms)
    return out.cast("long")


def within_a_day(text: Column, now_ms: int) -> Column:
    return F.coalesce(age_ms(text, now_ms) <= DAY_MS, F.lit(False))


def spanish_date(text: Column, year: int) -> Column:
    """The first date of a text: 2024-05-01, 1/5/2024, or '1 de mayo (de 2024)'; null if invalid or none."""
    t = F.lower(F.coalesce(text, F.lit("")))
    names = "|".join(MONTHS)
    words = rf"([0-9]{{1,2}}) de ({names})(?: de ([0-9]{{4}}))?"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(t, words, 2))
    y = F.coalesce(F.nullif(F.regexp_extract(t, words, 3), F.lit("")), F.lit(str(year)))
    parts = lambda a, b, c: F.try_to_date(F.concat_ws("-", a, F.lpad(b, 2, "0"), F.lpad(c, 2, "0")), "yyyy-MM-dd")
    iso, slash = r"([0-9]{4})-([0-9]{2})-([0-9]{2})", r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})"
    g = F.regexp_extract
    return F.coalesce(
        F.when(t.rlike(iso), parts(g(t, iso, 1), g(t, iso, 2), g(t, iso, 3))), F.when(t.rlike(slash), parts(g(t, slash, 3), g(t, slash, 2), g(t, slash, 1))), F.when(month > 0, parts(y, month.cast("string"), g(t, words, 1)))
    )
