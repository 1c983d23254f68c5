"""Queries of the listings: hits, numbered items, sources, dates, reasons, ranked files, property documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import listings as L
from tessera.operators import rules
from tessera.plans.q_records import _HOST, docs, pages, vacancies
from tessera.plans.q_rules import table
from tessera.plans.registry import query
from tessera.plans.views import with_views

_P, _V = with_views("crawl_pages"), with_views("vacancies")
_STRIP = r"regexp_replace({0}, '^[ \t\r\f]+|[ \t\r\f]+$', '', 'g')"
_HIT = r"^[ \t\r\f]*[0-9]+\. (?:\[(article|hub)\][ \t\r\f]*)?\[(.+?)\]\((https?://[^)]+)\)"
_ITEM = r"^[ \t\r\f]*[0-9]+\.[ \t\r\f]+[^ \t\r\f]"


def _grouped(text: str, key: str, source: str, header: str) -> str:
    """Lines of a text with the number of their header, as common table expressions."""
    return rf"""l AS (SELECT {key}, unnest(x) AS line, generate_subscripts(x, 1) AS p FROM (SELECT {key}, string_split(replace({text}, chr(13) || chr(10), chr(10)), chr(10)) AS x FROM {source})),
g AS (SELECT *, regexp_matches(line, '{header}') AS h, sum(CASE WHEN regexp_matches(line, '{header}') THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY p) AS item FROM l)"""


_LISTING = """'before' || chr(10) || '1. [article] [' || source || '](https://n.example/' || (doc_id % 7) || ')' || chr(10) || coalesce(text, '') || chr(10) || ' - kept' || chr(10) || '- left' || chr(10) || '  2. [' || lang || '](https://n.example/' || doc_id || ')' || chr(10) || 'Sources: x' || chr(10) || '3. [again](https://n.example/' || (doc_id % 7) || ')' || chr(10) || 'late'"""


@query("S21_search_hits", rf"""WITH {_grouped(_LISTING, 'doc_id', 'documents', _HIT)},
b AS (SELECT doc_id, item, min(line) FILTER (h) AS head, coalesce(string_agg({_STRIP.format('line')}, ' ' ORDER BY p) FILTER (NOT h AND {_STRIP.format('line')} <> '' AND NOT regexp_matches(line, '^(Sources:|-|Call web_fetch|Next step)')), '') AS snippet FROM g WHERE item > 0 GROUP BY 1, 2),
e AS (SELECT doc_id, item, regexp_extract(head, '{_HIT}', 1) AS hit_type, regexp_extract(head, '{_HIT}', 2) AS title, regexp_extract(head, '{_HIT}', 3) AS url, md5(snippet) AS snippet FROM b)
SELECT doc_id, CAST(item AS INTEGER) AS item, hit_type, title, url, snippet FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, url ORDER BY item) AS r FROM e) WHERE r = 1""")
def s21(spark, sf_dir):
    k = F.col("doc_id")
    link = lambda x: F.concat(F.lit("](https://n.example/"), x.cast("string"), F.lit(")\n"))
    text = F.concat(F.lit("before\n1. [article] ["), "source", link(k % 7), F.coalesce("text", F.lit("")), F.lit("\n - kept\n- left\n  2. ["), "lang", link(k), F.lit("Sources: x\n3. [again"), link(k % 7), F.lit("late"))
    rows = docs(spark, sf_dir).select("doc_id", F.inline(L.search_hits(text)))
    return rows.withColumn("snippet", F.md5("snippet"))


_TASKS = """'TAREAS' || chr(10) || ' 1. ' || o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN ' ⚠ VENCIDA' ELSE '' END || chr(10) || '  Curso : ' || o_custkey || chr(10) || 'Fecha: ' || strftime(o_orderdate, '%Y-%m-%d') || chr(10) || '2. Second ' || o_orderstatus || chr(10) || 'URL: https://c.example/' || o_orderkey || chr(10) || 'Curso a' || chr(10) || 'Curso b:'"""


def _field(label: str) -> str:
    return f"coalesce(trim(substring(arg_max({_STRIP.format('line')}, p) FILTER (starts_with({_STRIP.format('line')}, '{label}')), {len(label) + 1}), ' :'), '')"


@query("S22_numbered_items", rf"""WITH {_grouped(_TASKS, 'o_orderkey', 'orders', _ITEM)},
b AS (SELECT o_orderkey, item, min(line) FILTER (h) AS head, {_field('Curso')} AS course, {_field('Fecha')} AS due, {_field('URL')} AS url FROM g WHERE item > 0 GROUP BY 1, 2)
SELECT o_orderkey, CAST(item AS INTEGER) AS item, regexp_extract(head, '^[ \t\r\f]*[0-9]+\.[ \t\r\f]+(.+?)(?:[ \t\r\f]+⚠[ \t\r\f]+VENCIDA)?[ \t\r\f]*$', 1) AS title, CASE WHEN contains(head, 'VENCIDA') THEN 'overdue' ELSE 'unknown' END AS status, course, due, url FROM b""")
def s22(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("TAREAS\n 1. "), "o_orderpriority", F.when(k % 2 == 0, " ⚠ VENCIDA").otherwise(""), F.lit("\n  Curso : "), F.col("o_custkey").cast("string"), F.lit("\nFecha: "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("\n2. Second "), "o_orderstatus", F.lit("\nURL: https://c.example/"), k.cast("string"), F.lit("\nCurso a\nCurso b:"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.inline(L.numbered_items(text, {"course": "Curso", "due": "Fecha", "url": "URL"})))
    return rows.select("o_orderkey", "item", "title", rules.assignment_status(F.when(F.col("overdue"), L.OVERDUE)).alias("status"), "course", "due", "url")


@query("D19_press_sources", f"""{_P}, l AS (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS place FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS h FROM crawl_pages)),
u AS (SELECT page_id, place, 'https://www.s' || (place % 5) || '.example' || href AS url, CASE place % 3 WHEN 0 THEN ' Link ' WHEN 1 THEN NULL ELSE 'News ' || place END AS title FROM l WHERE starts_with(href, '/')),
h AS (SELECT *, regexp_replace({_HOST}, '^www\\.', '') AS domain FROM u WHERE NOT contains(url, 's4.example')),
f AS (SELECT page_id, url, domain, trim(coalesce(title, '')) AS title, row_number() OVER (PARTITION BY page_id, url ORDER BY place) AS r FROM h WHERE domain <> '')
SELECT page_id, url, CASE WHEN title = '' OR lower(title) IN ('enlace', 'link', 'source', 'fuente') THEN domain ELSE title END AS title, domain FROM f WHERE r = 1""")
def d19(spark, sf_dir):
    found = pages(spark, sf_dir).select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]*)"'), 1)).alias("place", "href")).where(F.startswith("href", F.lit("/")))
    p = F.col("place")
    links = found.select("page_id", "place", F.concat(F.lit("https://www.s"), (p % 5).cast("string"), F.lit(".example"), "href").alias("url"), F.when(p % 3 == 0, " Link ").when(p % 3 == 2, F.concat(F.lit("News "), p.cast("string"))).alias("title"))
    return L.press_sources(links, "page_id", "place", "url", "title", "s4.example")


_SAID = "CASE doc_id % 5 WHEN 0 THEN coalesce(text, '') || ' http://x' WHEN 1 THEN 'see JOBS.example ' || lang WHEN 2 THEN '<b>' || lang WHEN 3 THEN '  ' ELSE text END"


@query("G03_safe_queries", rf"""SELECT doc_id, CASE WHEN contains(t, '://') OR contains(lower(t), 'jobs.example') OR (contains(t, '<') AND contains(t, '>')) THEN 'redacted' ELSE coalesce(nullif(substring(t, 1, 180), ''), 'unknown') END AS safe
  FROM (SELECT doc_id, trim(regexp_replace(coalesce({_SAID}, ''), '[ \t\n\r\f]+', ' ', 'g')) AS t FROM documents)""")
def g03(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", L.safe_query(F.expr(_SAID), "jobs.example").alias("safe"))


_POSTED = "CASE o_orderkey % 7 WHEN 0 THEN 'Publicado  hace ' || o_custkey || ' días !' WHEN 1 THEN o_custkey || ' Hours ago today' WHEN 2 THEN 'TODAY at ' || o_custkey WHEN 3 THEN o_custkey || ' 시간 전' WHEN 4 THEN '投稿 ' || o_custkey || '日前' WHEN 5 THEN 'hace un  momento' ELSE ' on   ' || o_orderstatus END"


@query("X12_relative_dates", rf"""SELECT o_orderkey, coalesce(nullif(regexp_extract(t, '(?i)\bhace\s+(?:unos?\s+segundos?|un\s+momento|\d+\s+(?:minutos?|horas?|d[ií]as?))\b'), ''), nullif(regexp_extract(t, '(?i)\b(?:just now|moments ago|a few seconds ago|\d+\s+(?:minutes?|hours?|days?)\s+ago)\b'), ''),
  nullif(regexp_extract(t, '(?i)\b(?:hoy|today)\b'), ''), nullif(regexp_extract(t, '\d+\s*(?:시간|분|일)\s*전'), ''), nullif(regexp_extract(t, '\d+\s*(?:時間|分|日)前'), ''), t) AS posted FROM (SELECT o_orderkey, trim(regexp_replace({_POSTED}, '[ \t\n\r\f]+', ' ', 'g')) AS t FROM orders)""")
def x12(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", L.relative_date(F.expr(_POSTED)).alias("posted"))


@query("F22_rejections", rf"""{_V} SELECT pos, CASE WHEN trim(regexp_replace(coalesce(description, ''), '[ \t\n\r\f]+', ' ', 'g')) = '' THEN 'missing_description' WHEN length(description) < 160 THEN 'incomplete_description' WHEN job_id IS NULL THEN 'missing_date' WHEN NOT has_full THEN 'outside_24_hours' ELSE '' END AS reason FROM vacancies""")
def f22(spark, sf_dir):
    reason = L.detail_rejection(F.col("description"), F.length("description") < 160, F.col("job_id"), F.col("has_full"))
    return vacancies(spark, sf_dir).select("pos", reason.alias("reason"))


_WORDS = ("web", "en", "1", "license")


@query("O17_ranked_files", f"""WITH f AS (SELECT lower(source || '/' || lang || '/' || doc_id || '.md') AS path, CAST(doc_id AS VARCHAR) AS stem, lower(coalesce(text, '')) AS t FROM documents),
s AS (SELECT path, t, {' + '.join(f"4 * contains(path, '{w}')::INT + 5 * contains(stem, '{w}')::INT" for w in _WORDS)} AS named FROM f)
SELECT path, named + {' + '.join(f"contains(t, '{w}')::INT" for w in _WORDS)} AS score FROM s WHERE named > 0 ORDER BY score DESC, length(path), path LIMIT 5""")
def o17(spark, sf_dir):
    files = docs(spark, sf_dir).select(F.lower(F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), "text")
    return L.ranked_files(files, "path", "text", _WORDS).select("path", "score")


_KINDS = {"name": "title", "note": "rich_text", "due": "date", "status": "select", "link": "url"}


@query("K14_property_documents", """SELECT o_orderkey, o_orderpriority || ' "q"' AS name, 'note ' || o_custkey AS note, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS due, o_orderstatus AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'https://t.example/' || o_orderkey ELSE '' END AS link FROM orders""")
def k14(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat("o_orderpriority", F.lit(' "q"')).alias("name"), F.concat(F.lit("note "), F.col("o_custkey").cast("string")).alias("note"), F.when(k % 3 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("due"), F.col("o_orderstatus").alias("status"), F.when(k % 2 == 0, F.concat(F.lit("https://t.example/"), k.cast("string"))).alias("link"))
    return rows.select("o_orderkey", L.property_document(_KINDS).alias("doc")).select("o_orderkey", *L.flattened_properties(F.col("doc"), _KINDS))
