"""Queries of choices for a key."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import choices as C
from tessera.plans.q_records import _FOLD, docs, pages
from tessera.plans.registry import query
from tessera.plans.views import view, with_views

_A, _P, _T, _TA = with_views("audit"), with_views("crawl_pages"), with_views("tasks"), with_views("tasks", "audit")
_STOP = ("with", "that", "this", "para")
_PROMOTED = {"purchase": "prefer_search", "signup": "free"}
_TERMS = {"en": ["news", "report", "", "fourth"], "es": ["noticias", "hoy"], "de": ["nachrichten"]}


@query("ST02_current_scores", f"""{_A} SELECT session_id, turn AS last_turn, CASE WHEN 100 - turn > 3 THEN 0.0::DOUBLE ELSE coalesce(score, 0)::DOUBLE END AS current
FROM (SELECT session_id, k AS turn, scrape_score AS score, row_number() OVER (PARTITION BY session_id ORDER BY k DESC, scrape_score DESC NULLS LAST) AS r FROM audit) WHERE r = 1""")
def st02(spark, sf_dir):
    rows = view(spark, sf_dir, "audit").select("session_id", F.col("k").alias("turn"), F.col("scrape_score").alias("score"))
    return C.current_scores(rows, "session_id", 100)


@query("ST04_decision_context", f"""{_A} SELECT request_id, CASE WHEN p <= -2 THEN 'unreliable' WHEN p < 0 THEN 'low_content' ELSE 'ok' END AS prior_reliability,
  CAST(CASE WHEN abs(p) < 0.5 THEN 0.2 WHEN p <= -2 THEN 0.05 ELSE 0.1 END AS DOUBLE) AS exploration_rate, rec AS recommended, CASE WHEN rec IS NOT NULL THEN strategy IS NOT DISTINCT FROM rec END AS prediction_match
FROM (SELECT request_id, strategy, coalesce(prior_score, 0) AS p, CASE category WHEN 'purchase' THEN 'prefer_search' WHEN 'signup' THEN 'free' END AS rec FROM audit)""")
def st04(spark, sf_dir):
    return view(spark, sf_dir, "audit").select("request_id", *C.decision_context(F.col("prior_score"), F.col("strategy"), F.col("category"), _PROMOTED))


_TERM_ROWS = ", ".join(f"('{name}', {i}, '{term}')" for name, own in _TERMS.items() for i, term in enumerate(own, 1))


@query("J12_capped_queries", f"""WITH t(language, i, term) AS (VALUES {_TERM_ROWS}), l AS (SELECT doc_id, source, unnest([lang, 'en', 'es']) AS language, generate_subscripts([lang, 'en', 'es'], 1) AS p FROM documents),
c AS (SELECT doc_id, l.language, trim('site:' || source || '.example ' || term) AS query, row_number() OVER (PARTITION BY doc_id ORDER BY p, i) AS r FROM l JOIN t ON l.language = t.language WHERE p <= 2 AND i <= 3),
d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, query ORDER BY r) AS s FROM c WHERE r <= 6)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY r) AS place, language, query FROM d WHERE s = 1""")
def j12(spark, sf_dir):
    found = C.capped_queries(F.concat("source", F.lit(".example")), F.array("lang", F.lit("en"), F.lit("es")), _TERMS)
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(found).alias("p", "q"))
    return rows.select("doc_id", (F.col("p") + 1).cast("long").alias("place"), "q.language", "q.query")


@query("D08_distinct_lines", rf"""WITH l AS (SELECT doc_id, place, regexp_replace(trim(regexp_replace(coalesce(line, ''), '[ \t\r\f]+', ' ', 'g')), '^[-•] +', '') AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM documents)),
s AS (SELECT *, array_to_string(list_filter(regexp_extract_all({_FOLD.format("line")}, '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 3 AND w NOT IN {_STOP})[1:10], ' ') AS sig FROM l WHERE line <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, CASE WHEN sig <> '' THEN 's' || sig ELSE 'l' || lower(line) END ORDER BY place) AS r FROM s)
SELECT doc_id, place, md5(line) AS line FROM r WHERE r = 1""")
def d08(spark, sf_dir):
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return C.distinct_lines(lines, "doc_id", "place", "line", _STOP).select("doc_id", F.col("place").cast("long").alias("place"), F.md5("line").alias("line"))


@query("O14_top_sections", f"""{_P}, l AS (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS place FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS h FROM crawl_pages)),
s AS (SELECT page_id, place, lower(href) AS path, (place * 7 + page_id) % 11 - 3 AS score, place % 3 AS area FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id, path ORDER BY place) AS r FROM s WHERE score > 0),
b AS (SELECT page_id, place, path, row_number() OVER (PARTITION BY page_id ORDER BY score + area DESC, area DESC, length(path), place) AS rank FROM f WHERE r = 1)
SELECT page_id, rank, place, path FROM b WHERE rank <= 4""")
def o14(spark, sf_dir):
    p = F.col("place")
    links = pages(spark, sf_dir).select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]*)"'), 1)).alias("place", "href"))
    best = C.top_sections(links, "page_id", "place", F.lower("href"), (p * 7 + F.col("page_id")) % 11 - 3, p % 3)
    return best.select("page_id", F.col("rank").cast("long").alias("rank"), p.cast("long").alias("place"), F.lower("href").alias("path"))


@query("ST12_updated_registry", f"""{_TA}, u AS (SELECT session_id * 4 AS task_id, outcome AS status, ts_ms AS at_ms, CASE WHEN k % 3 = 0 THEN category END AS metadata, request_id FROM audit),
l AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY at_ms DESC, request_id DESC) AS r FROM u), m AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY at_ms DESC, request_id DESC) AS r FROM u WHERE metadata IS NOT NULL)
SELECT t.task_id, coalesce(l.status, t.status) AS status, coalesce(l.at_ms, t.updated_at_ms) AS updated_at, coalesce(m.metadata, 'none') AS metadata, t.created_at_ms
FROM tasks t LEFT JOIN (SELECT * FROM l WHERE r = 1) l ON t.task_id = l.task_id LEFT JOIN (SELECT * FROM m WHERE r = 1) m ON t.task_id = m.task_id""")
def st12(spark, sf_dir):
    workers = view(spark, sf_dir, "tasks").select("task_id", "status", F.col("updated_at_ms").alias("updated_at"), F.lit("none").alias("metadata"), "created_at_ms")
    updates = view(spark, sf_dir, "audit").select((F.col("session_id") * 4).alias("task_id"), F.col("outcome").alias("status"), F.col("ts_ms").alias("at"), F.expr("CASE WHEN k % 3 = 0 THEN category END").alias("metadata"), "request_id")
    return C.updated_registry(workers, updates, "task_id", ["at", "request_id"])
