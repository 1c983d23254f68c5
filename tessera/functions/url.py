"""URL parts, canonical forms and predicates, as column expressions; malformed URLs give empty parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "trk", "refid", "trackingid")


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def query(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))


def without_parameters(url: Column, dropped: tuple[str, ...] = TRACKING) -> Column:
    """https, host, path without a last slash, and the query without the dropped parameters."""
    kept = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(*dropped))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(F.lit("https://"), host(url), F.regexp_replace(path(url), "/+$", ""), tail)


def node_key(url: Column) -> Column:
    """Host without www, path and query: what identifies a page."""
    q = query(url)
    return F.concat(bare_host(url), path(url), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def allowed(url: Column, blocked: tuple[str, ...], only: tuple[str, ...]) -> Column:
    """Not of a blocked domain and, if any are named, of an allowed one; subdomains belong to domains."""
    h = bare_host(url)

    def of(domains: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for d in domains:
            out = out | (h == d) | F.endswith(h, F.lit(f".{d}"))
        return out

    return (h != "") & ~of(blocked) & (of(only) if only else F.lit(True))


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def is_article(url: Column) -> Column:
    """Two path segments or more, the last one of five characters or more."""
    own = segments(url)
    return (F.size(own) >= 2) & (F.length(F.try_element_at(own, F.lit(-1))) >= 5)


def dated(url: Column) -> Column:
    return F.lower(url).rlike(r"[/\-][0-9]{4}[/\-][0-9]{2}[/\-][0-9]{2}") | F.lower(url).rlike(r"20[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])")


def last_number(url: Column) -> Column:
    """The number that ends the path, or null."""
    return F.nullif(F.regexp_extract(path(url), r"([0-9]+)/?$", 1), F.lit(""))


def plain_host(url: Column) -> Column:
    """As ``bare_host``, also of URLs with characters that no URL may hold."""
    return F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), r"^www\.", "")


def plain_path(url: Column) -> Column:
    """As ``path``, also of URLs with characters that no URL may hold."""
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
