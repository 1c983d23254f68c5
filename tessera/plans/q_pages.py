"""Queries over the elements of all pages: their node table, named links, navigation, listed items with counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import pages as P
from tessera.plans.registry import query
from tessera.sources.html import Mark, node_table

_LINKS = r"""WITH found AS (SELECT page_id, url AS base, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">[^<]*</a></li>', 1)) AS href,
  unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1)) AS raw, generate_subscripts(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>'), 1) AS i FROM pages),
links AS (SELECT *, replace(href, '&amp;', '&') AS target, trim(regexp_replace(replace(raw, '&amp;', '&'), '\s+', ' ', 'g')) AS name, regexp_extract(base, '^[a-z]+://[^/?#]*') AS root FROM found)
"""
_SLUG = "trim(regexp_replace(translate(lower({0}), 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy'), '[^a-z0-9]+', '-', 'g'), '-')"
_BANNED = " OR ".join(f"contains(translate(lower(name), 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy') || ' ' || translate(lower(path), 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy'), '{t}')" for t in P.BANNED)
MARKS = {"card": Mark("li"), "item": Mark("li"), "excluded": Mark("footer"), "article": Mark("article"), "nav": Mark("nav")}


def elements(spark, sf_dir, **more):
    return node_table(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html", MARKS, **more)


def bases(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("page"), F.col("url").alias("base"))


@query("S17_page_elements", r"""SELECT page_id, len(regexp_extract_all(html, '<p>')) AS n_p, len(regexp_extract_all(html, '<a ')) AS n_a, len(regexp_extract_all(html, '<b>')) AS n_b,
trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS title, len(regexp_extract_all(html, '<li>')) AS n_in_nav FROM pages""")
def s17_elements(spark, sf_dir):
    n = elements(spark, sf_dir)
    count = lambda tag: F.count_if(F.col("tag") == tag)
    in_nav = F.count_if((F.col("tag") == "li") & F.element_at("marks", F.lit("nav")).isNotNull())
    return n.groupBy(F.col("page").alias("page_id")).agg(count("p").alias("n_p"), count("a").alias("n_a"), count("b").alias("n_b"), F.max(F.when(F.col("tag") == "title", F.col("text"))).alias("title"), in_nav.alias("n_in_nav"))


@query("S19_named_links", f"""{_LINKS} SELECT page_id, root || target AS url, arg_min(name, i) AS name FROM links WHERE name <> '' AND target LIKE '/%' GROUP BY 1, 2""")
def s19(spark, sf_dir):
    href = F.element_at("attributes", F.lit("href"))
    selectors = [href.startswith("/"), F.element_at("marks", F.lit("article")).isNotNull()]
    found = P.named_anchors(elements(spark, sf_dir), bases(spark, sf_dir), selectors, F.col("url") != "")
    return found.select(F.col("page").alias("page_id"), "url", "name")


@query("D21_navigation", f"""{_LINKS}, own AS (SELECT *, regexp_extract(target, '^[^?#]*') AS path FROM links WHERE name <> '' AND length(name) <= 80 AND NOT regexp_matches(lower(name), '[<>]|href=|https?://|&lt;|&gt;|javascript:|mailto:|tel:')),
kept AS (SELECT *, row_number() OVER (PARTITION BY page_id, {_SLUG.format('name')}, {_SLUG.format('path')} ORDER BY i) AS r FROM own
  WHERE path NOT IN ('', '/') AND NOT ({_BANNED}) AND NOT regexp_matches(lower(base || path), '[/-][0-9]{{4}}[/-][0-9]{{2}}[/-][0-9]{{2}}') AND NOT regexp_matches(root || path, '20[0-9]{{2}}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])')
  AND NOT (len(list_filter(string_split(path, '/'), lambda s: s <> '')) >= 2 AND length(list_filter(string_split(path, '/'), lambda s: s <> '')[-1]) >= 5))
SELECT page_id, regexp_replace(root || path, '/+$', '') AS url, name AS title, CAST(7 + CASE WHEN len(string_split(name, ' ')) <= 4 THEN 1 ELSE 0 END AS INT) AS area_score FROM kept WHERE r = 1""")
def d21(spark, sf_dir):
    return P.navigation(elements(spark, sf_dir), bases(spark, sf_dir)).select(F.col("page").alias("page_id"), "url", "title", "area_score")


def _cards(spark, sf_dir):
    tag = lambda t: F.col("tag") == t
    fields = {"title": ("job-title",), "company": ("job-company",)}
    return P.cards(elements(spark, sf_dir), bases(spark, sf_dir), r"^/([^/?#]+)$", r"^urn:li:jobPosting:(\d+)$", fields, {"n_li": tag("li"), "n_a": tag("a"), "n_article": tag("article")})


@query("S17_listed_items", f"""{_LINKS} SELECT page_id, substring(target, 2) AS job_id, arg_min(name, i) AS title, 'card,job_href,list_item' AS sources FROM links WHERE regexp_matches(target, '^/[^/?#]+$') GROUP BY 1, 2""")
def s17_items(spark, sf_dir):
    return _cards(spark, sf_dir)[0].select(F.col("page").alias("page_id"), "job_id", F.coalesce("title", F.lit("")).alias("title"), "sources")


@query("S17_diagnostics", f"""{_LINKS}, items AS (SELECT page_id, count(*) AS n, count(DISTINCT target) AS d FROM links WHERE regexp_matches(target, '^/[^/?#]+$') GROUP BY 1)
SELECT p.page_id, len(regexp_extract_all(html, '<li>')) AS n_li, len(regexp_extract_all(html, '<a ')) AS n_a, len(regexp_extract_all(html, '<article>')) AS n_article, coalesce(n, 0) AS n_card, coalesce(n, 0) AS n_job_href, CAST(0 AS BIGINT) AS n_urn, coalesce(n, 0) AS n_list_item,
coalesce(3 * n, 0) AS n_signals, coalesce(d, 0) AS n_items, CAST(0 AS BIGINT) AS n_excluded, coalesce(d, 0) AS n_incomplete, coalesce(3 * n - d, 0) AS n_duplicates, coalesce(d, 0) = 0 AS missing_identity FROM pages p LEFT JOIN items i ON i.page_id = p.page_id""")
def s17_diagnostics(spark, sf_dir):
    return _cards(spark, sf_dir)[1].withColumnRenamed("page", "page_id")
