"""Queries of the rules: filters, ordering and limits, texts, links, permissions, states and JSON readers."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import url as U
from tessera.operators import records as R
from tessera.operators import rules as L
from tessera.plans.q_records import _HOST, _PATH, _QUERY, docs, pages, vacancies
from tessera.operators.records import shared_folder
from tessera.plans.registry import query
from tessera.plans.views import view, with_views
from tessera.sources import readers

_V, _P, _A, _M, _T = (with_views(n) for n in ("vacancies", "crawl_pages", "audit", "messages", "tasks"))
_MA = with_views("messages", "audit")
_TA = with_views("tasks", "audit")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("F02_negative_inputs", f"{_MA} SELECT m.id, a.scrape_score FROM messages m JOIN audit a ON m.request_id = a.request_id WHERE m.role = 'human' AND a.scrape_score < 0")
def f02(spark, sf_dir):
    return view(spark, sf_dir, "messages").join(view(spark, sf_dir, "audit").select("request_id", "scrape_score"), "request_id").where("role = 'human' AND scrape_score < 0").select("id", "scrape_score")


@query("F04_scraped", f"{_A} SELECT request_id, source_type FROM audit WHERE node = 'web_scraping_node' AND source_type IS NOT NULL")
def f04(spark, sf_dir):
    return view(spark, sf_dir, "audit").where("node = 'web_scraping_node' AND source_type IS NOT NULL").select("request_id", "source_type")


@query("F20_blocked_patterns", f"""{_M}, h AS (SELECT id, lower(coalesce(content, '')) AS t, lower(coalesce(string_agg(coalesce(content, ''), chr(10)) OVER (PARTITION BY session_id ORDER BY ts, id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), '')) AS h FROM messages)
SELECT id, coalesce(CASE WHEN contains(t, 'the of') THEN 'the of' WHEN contains(t, 'is and') THEN 'is and' END,
  CASE WHEN contains(t, 'that') THEN CASE WHEN contains(h, 'the of') THEN 'the of' WHEN contains(h, 'is and') THEN 'is and' END END) AS pattern FROM h""")
def f20(spark, sf_dir):
    return L.guarded(view(spark, sf_dir, "messages"), ("the of", "is and"), ("that",), "session_id", ["ts", "id"], "content").select("id", "pattern")


@query("F25_permissions", f"""{_T}, r AS (SELECT task_id, CASE task_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS risk, CASE task_id % 5 WHEN 0 THEN 'allow_all' WHEN 1 THEN 'confirm_high_risk' WHEN 2 THEN 'deny_high_risk' WHEN 3 THEN 'deny_all' ELSE 'odd' END AS m FROM tasks),
n AS (SELECT task_id, coalesce(risk = 'high', false) AS high, CASE WHEN m = 'odd' THEN 'confirm_high_risk' ELSE m END AS mode FROM r),
d AS (SELECT task_id, mode, CASE WHEN mode = 'deny_all' THEN mode WHEN mode IN ('deny_high_risk', 'confirm_high_risk') AND high THEN mode ELSE 'allow' END AS reason FROM n)
SELECT task_id, mode, reason, reason NOT LIKE 'deny%' AS allowed, reason = 'confirm_high_risk' AS confirmed FROM d""")
def f25(spark, sf_dir):
    k = F.col("task_id")
    mode = F.when(k % 5 == 0, "allow_all").when(k % 5 == 1, "confirm_high_risk").when(k % 5 == 2, "deny_high_risk").when(k % 5 == 3, "deny_all").otherwise("odd")
    return view(spark, sf_dir, "tasks").select("task_id", L.permission(F.when(k % 3 == 0, "high").when(k % 3 == 1, "low"), mode).alias("p")).select("task_id", "p.*")


@query("O01_ordered", f"{_A} SELECT request_id, row_number() OVER (PARTITION BY category ORDER BY strategy ASC NULLS LAST, estimated_cost_usd DESC NULLS LAST, request_id) AS place FROM audit")
def o01(spark, sf_dir):
    w = Window.partitionBy("category").orderBy(F.asc_nulls_last("strategy"), F.desc_nulls_last("estimated_cost_usd"), "request_id")
    return view(spark, sf_dir, "audit").select("request_id", F.row_number().over(w).cast("long").alias("place"))


@query("O07_prioritised", f"""{_V}, l AS (SELECT pos, company, CASE pos % 6 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 0 WHEN 3 THEN 9 WHEN 4 THEN 1 ELSE 3 END AS detail_rank FROM vacancies)
SELECT pos, detail_rank, row_number() OVER (PARTITION BY company ORDER BY detail_rank, pos) AS place FROM l""")
def o07(spark, sf_dir):
    names = F.array(*(F.lit(x) for x in ("incomplete_metadata", "strong_metadata_missing_date", "verified_card_date", "none", "verified_date", "title_missing_date")))
    rows = vacancies(spark, sf_dir).select("pos", "company", L.detail_rank(F.element_at(names, (F.col("pos") % 6 + 1).cast("int"))).alias("detail_rank"))
    return rows.select("pos", "detail_rank", F.row_number().over(Window.partitionBy("company").orderBy("detail_rank", "pos")).cast("long").alias("place"))


_ASSIGNED = "SELECT o_orderkey, o_custkey, lower(o_orderpriority) AS title, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS due, o_orderstatus = 'F' AND o_orderkey % 5 <> 0 AS valid FROM orders"


def assigned(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.lower("o_orderpriority").alias("title"), F.when(k % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("due"), ((F.col("o_orderstatus") == "F") & (k % 5 != 0)).alias("valid"))


@query("O08_sorted_assignments", f"WITH a AS ({_ASSIGNED}) SELECT o_orderkey, valid, row_number() OVER (PARTITION BY o_custkey, valid ORDER BY coalesce(due, '9999-99-99'), title, o_orderkey) AS place FROM a")
def o08(spark, sf_dir):
    w = Window.partitionBy("o_custkey", "valid").orderBy(F.coalesce("due", F.lit("9999-99-99")), "title", "o_orderkey")
    return assigned(spark, sf_dir).select("o_orderkey", "valid", F.row_number().over(w).cast("long").alias("place"))


@query("A25_artifact_counts", f"WITH a AS ({_ASSIGNED}) SELECT o_custkey, count(*) FILTER (valid) AS n_valid, count(*) FILTER (NOT valid) AS n_invalid, count(*) FILTER (due IS NULL) AS n_issues, bool_or(valid) AS any_valid, bool_or(due IS NULL) AS any_issue FROM a GROUP BY 1")
def a25(spark, sf_dir):
    return assigned(spark, sf_dir).groupBy("o_custkey").agg(F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_invalid"), F.count_if(F.col("due").isNull()).alias("n_issues"), F.bool_or("valid").alias("any_valid"), F.bool_or(F.col("due").isNull()).alias("any_issue"))


@query("O09_limit_last", f"""{_V}, t AS (SELECT *, row_number() OVER (ORDER BY n, location) AS turn FROM (SELECT pos, location, canonical_url, row_number() OVER (PARTITION BY location ORDER BY pos) AS n FROM vacancies)),
k AS (SELECT *, row_number() OVER (PARTITION BY canonical_url ORDER BY turn) AS r FROM t) SELECT pos, turn FROM k WHERE r = 1 ORDER BY turn LIMIT 30""")
def o09(spark, sf_dir):
    return L.interleaved_page(vacancies(spark, sf_dir), "location", "pos", F.col("canonical_url"), 30).select("pos", "turn")


_RANKED = f"{_V}, c AS (SELECT pos, company || '-' || location AS event, length(description) % 1000 AS score FROM vacancies WHERE len(string_split(description, ' ')) >= 6)"


def ranked(spark, sf_dir):
    v = vacancies(spark, sf_dir).where(F.size(F.split("description", " ")) >= 6)
    return v.select("pos", F.concat_ws("-", "company", "location").alias("event"), (F.length("description") % 1000).cast("long").alias("score"))


@query("O15_dedupe_then_limit", f"{_RANKED} SELECT pos, score FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY score DESC, pos) AS r FROM c) WHERE r = 1 ORDER BY score DESC, pos LIMIT 8")
def o15(spark, sf_dir):
    return L.deduped_then_limited(ranked(spark, sf_dir), F.col("event"), [-F.col("score")], "pos", 8).select("pos", "score")


@query("O16_limit_then_dedupe", f"{_RANKED} SELECT pos, score FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY score DESC, pos) AS r FROM (SELECT * FROM c ORDER BY score DESC, pos LIMIT 8)) WHERE r = 1")
def o16(spark, sf_dir):
    return L.limited_then_deduped(ranked(spark, sf_dir), F.col("event"), [-F.col("score")], "pos", 8).select("pos", "score")


@query("A24_session_documents", f"""{_TA}, a AS (SELECT session_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, count(*) AS n_calls, max(request_id) AS last_request FROM audit GROUP BY 1),
t AS (SELECT session_id, string_agg(DISTINCT status, ',' ORDER BY status) AS statuses, count(*) AS n_tasks FROM tasks GROUP BY 1)
SELECT coalesce(a.session_id, t.session_id) AS session_id, coalesce(categories, '') AS categories, coalesce(n_calls, 0) AS n_calls, last_request, coalesce(statuses, '') AS statuses, coalesce(n_tasks, 0) AS n_tasks FROM a FULL JOIN t ON a.session_id = t.session_id""")
def a24(spark, sf_dir):
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    a = view(spark, sf_dir, "audit").groupBy("session_id").agg(names("category").alias("categories"), F.count("*").alias("n_calls"), F.max("request_id").alias("last_request"))
    t = view(spark, sf_dir, "tasks").groupBy("session_id").agg(names("status").alias("statuses"), F.count("*").alias("n_tasks"))
    return a.join(t, "session_id", "full").select("session_id", F.coalesce("categories", F.lit("")).alias("categories"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"), "last_request", F.coalesce("statuses", F.lit("")).alias("statuses"), F.coalesce("n_tasks", F.lit(0)).alias("n_tasks"))


@query("A26_new_and_duplicate", f"{_V} SELECT company, count(DISTINCT canonical_url) AS n_unique, count(DISTINCT job_id) AS n_new, greatest(0, count(DISTINCT canonical_url) - count(DISTINCT job_id)) AS n_duplicate FROM vacancies GROUP BY 1")
def a26(spark, sf_dir):
    n = vacancies(spark, sf_dir).groupBy("company").agg(F.count_distinct("canonical_url").alias("n_unique"), F.count_distinct("job_id").alias("n_new"))
    return n.withColumn("n_duplicate", F.greatest(F.lit(0), F.col("n_unique") - F.col("n_new")))


@query("M06_recency_bonus", f"{_T} SELECT task_id, greatest(0, CAST(trunc(50 - (created_at_ms % 1728000000) / 8.64e7 * 5) AS INTEGER)) AS bonus FROM tasks")
def m06(spark, sf_dir):
    return view(spark, sf_dir, "tasks").select("task_id", L.recency_bonus(F.col("created_at_ms") % 1_728_000_000).alias("bonus"))


@query("M11_minute_windows", f"{_A} SELECT request_id, CASE WHEN k > 5 THEN 'r' || CAST((k - 5) * 60 AS VARCHAR) END AS part FROM audit")
def m11(spark, sf_dir):
    return view(spark, sf_dir, "audit").select("request_id", L.minute_window(F.col("k") - 5).alias("part"))


@query("M13_arguments", f"""{_A}, r AS (SELECT request_id, unnest(string_split('limit=' || k || ' rate=' || k || '.5 deep=' || CASE WHEN k % 2 = 0 THEN 'True' ELSE 'no' END || ' site=' || CASE WHEN k % 3 = 0 THEN 'None' ELSE category END, ' ')) AS p FROM audit)
SELECT request_id, split_part(p, '=', 1) AS key, split_part(p, '=', 2) AS value, CASE WHEN lower(split_part(p, '=', 2)) IN ('true', 'false') THEN 'bool' WHEN lower(split_part(p, '=', 2)) IN ('null', 'none') THEN 'null'
  WHEN regexp_matches(split_part(p, '=', 2), '^[+-]?[0-9]*\\.[0-9]+$') THEN 'float' WHEN regexp_matches(split_part(p, '=', 2), '^[+-]?[0-9]+$') THEN 'int' ELSE 'text' END AS kind FROM r""")
def m13(spark, sf_dir):
    k = F.col("k").cast("string")
    raw = F.concat(F.lit("limit="), k, F.lit(" rate="), k, F.lit(".5 deep="), F.when(F.col("k") % 2 == 0, "True").otherwise("no"), F.lit(" site="), F.when(F.col("k") % 3 == 0, "None").otherwise(F.col("category")))
    return view(spark, sf_dir, "audit").select("request_id", F.explode(L.argument_kinds(raw)).alias("a")).select("request_id", "a.*")


@query("M16_languages", """WITH l AS (SELECT n_nationkey, ['es', CASE WHEN n_regionkey = 1 THEN 'en' ELSE 'es' END, CASE WHEN n_nationkey % 2 = 0 THEN 'fr' ELSE 'en' END] AS l FROM nation),
u AS (SELECT n_nationkey, unnest(l) AS x, generate_subscripts(l, 1) AS p FROM l) SELECT n_nationkey, string_agg(x, ',' ORDER BY p) AS languages FROM (SELECT n_nationkey, x, min(p) AS p FROM u GROUP BY 1, 2) GROUP BY 1""")
def m16(spark, sf_dir):
    own, group, last = F.array(F.lit("es")), F.array(F.when(F.col("n_regionkey") == 1, "en").otherwise("es")), F.array(F.when(F.col("n_nationkey") % 2 == 0, "fr").otherwise("en"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.array_distinct(F.concat(own, group, last)), ",").alias("languages"))


@query("M17_local_days", "SELECT event_id, CAST(ts - INTERVAL 3 HOUR AS DATE) AS day FROM events")
def m17(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/Argentina/Buenos_Aires")).alias("day"))


@query("M18_incomplete", f"{_V} SELECT pos, job_id IS NULL OR length(description) < 160 OR NOT has_full AS needs_detail, job_id IS NOT NULL AND title <> '' AND company <> '' AND location <> '' AS complete FROM vacancies")
def m18(spark, sf_dir):
    filled = F.col("job_id").isNotNull() & (F.col("title") != "") & (F.col("company") != "") & (F.col("location") != "")
    return vacancies(spark, sf_dir).select("pos", (F.col("job_id").isNull() | (F.length("description") < 160) | ~F.col("has_full")).alias("needs_detail"), filled.alias("complete"))


@query("M20_lookups", "SELECT n_name, CASE r_name WHEN 'AMERICA' THEN 'en' WHEN 'EUROPE' THEN 'de' WHEN 'AFRICA' THEN 'fr' ELSE 'es' END AS language FROM nation JOIN region ON n_regionkey = r_regionkey")
def m20(spark, sf_dir):
    known = F.create_map(*(F.lit(x) for x in ("AMERICA", "en", "EUROPE", "de", "AFRICA", "fr")))
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_name", F.coalesce(F.try_element_at(known, F.col("r_name")), F.lit("es")).alias("language"))


@query("J13_section_paths", """SELECT n_name, coalesce(string_agg('/' || lower(s_name), ',' ORDER BY s_suppkey) FILTER (r <= 4), '/news') AS paths FROM nation LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier) ON s_nationkey = n_nationkey GROUP BY 1""")
def j13(spark, sf_dir):
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    first = table(spark, sf_dir, "supplier").withColumn("r", F.row_number().over(w)).where("r <= 4")
    lists = first.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", F.concat(F.lit("/"), F.lower("s_name")).alias("p")))).alias("l"))
    return table(spark, sf_dir, "nation").join(lists, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("n_name", F.coalesce(F.array_join("l.p", ","), F.lit("/news")).alias("paths"))


@query("J14_enriched", f"{_T} SELECT task_id, CASE WHEN task_id % 5 = 0 THEN 'graded' ELSE status END AS status FROM tasks")
def j14(spark, sf_dir):
    t = view(spark, sf_dir, "tasks").select("task_id", "status")
    new = t.where("task_id % 5 < 2").select("task_id", F.when(F.col("task_id") % 5 == 0, "graded").otherwise("").alias("status"))
    return L.with_updates(t, new, "task_id", "status")


@query("J19_first_link", f"""{_P}, l AS (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS place FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS h FROM crawl_pages)),
k AS (SELECT *, regexp_replace(href, '[?#].*$', '') AS link_key FROM l), u AS (SELECT page_id, min(link_key) AS link_key FROM k GROUP BY 1)
SELECT k.page_id, k.place, CASE WHEN row_number() OVER (PARTITION BY k.page_id, k.link_key ORDER BY k.place) = 1 AND u.page_id IS NOT NULL THEN k.link_key || '/moved' END AS final_url FROM k LEFT JOIN u ON k.page_id = u.page_id AND k.link_key = u.link_key""")
def j19(spark, sf_dir):
    found = pages(spark, sf_dir).select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]*)"'), 1)).alias("place", "href"))
    links = found.select("page_id", F.col("place").cast("long").alias("place"), F.regexp_replace("href", r"[?#].*$", "").alias("link_key"))
    updates = links.groupBy("page_id").agg(F.min("link_key").alias("link_key")).withColumn("final_url", F.concat("link_key", F.lit("/moved")))
    return L.first_link_resolved(links, updates, "page_id", "link_key", "place").select("page_id", "place", "final_url")


@query("J20_overrides", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'new ' || o_orderstatus END AS priority,
  CASE WHEN o_orderkey % 4 = 0 THEN '2030-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS posted, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'old' END AS posted_text FROM orders""")
def j20(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    old = o.select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("posted"), F.lit("old").alias("posted_text"))
    new = o.select("o_orderkey", F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("new "), "o_orderstatus")).alias("priority"), F.when(k % 4 == 0, "2030-01-01").alias("posted"), F.lit(None).cast("string").alias("posted_text"))
    return L.overridden(old, new, "o_orderkey", ["priority"], ["posted", "posted_text"])


_ORDERED = "SELECT {key}, coalesce(string_agg(x, '{sep}' ORDER BY p), '') AS joined, count(x) AS n FROM (SELECT {key}, x, min(p) AS p FROM (SELECT {key}, unnest(l) AS x, generate_subscripts(l, 1) AS p FROM l) WHERE {test} GROUP BY 1, 2) GROUP BY 1"


@query("D11_unique_sources", f"""{_P}, l AS (SELECT page_id, list_transform(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1), lambda u: trim(rtrim(split_part(u || '|domain=x>>>', '|', 1), '>'))) AS l FROM crawl_pages)
SELECT page_id, md5(joined) AS sources, n FROM ({_ORDERED.format(key='page_id', sep=',', test="x <> ''")})""")
def d11(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]*)"'), 1)
    own = F.array_distinct(F.filter(F.transform(found, lambda u: L.cleaned_url(F.concat(u, F.lit("|domain=x>>>")))), lambda u: u != ""))
    return pages(spark, sf_dir).select("page_id", own.alias("l")).where(F.size("l") > 0).select("page_id", F.md5(F.array_join("l", ",")).alias("sources"), F.size("l").cast("long").alias("n"))


@query("D15_ordered_distinct", f"WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS l FROM documents) SELECT doc_id, md5(joined) AS words, n FROM ({_ORDERED.format(key='doc_id', sep=' ', test='true')})")
def d15(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_distinct(F.split(F.coalesce("text", F.lit("")), " ")).alias("l")).select("doc_id", F.md5(F.array_join("l", " ")).alias("words"), F.size("l").cast("long").alias("n"))


_SCORES = "coalesce(text, '') || chr(10) || 'River 2 - 1 Boca end' || chr(10) || 'River   2 - 1 Boca end' || chr(10) || source || ' 3-0 final'"


@query("D17_score_lines", rf"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split({_SCORES}, chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: regexp_matches(x, '\b.+?\b[0-9]+\s*-\s*[0-9]+\b.+')) AS l FROM documents)
SELECT doc_id, md5(joined) AS scores, n FROM ({_ORDERED.format(key='doc_id', sep='|', test='true')})""")
def d17(spark, sf_dir):
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\nRiver 2 - 1 Boca end\nRiver   2 - 1 Boca end\n"), "source", F.lit(" 3-0 final"))
    return docs(spark, sf_dir).select("doc_id", L.score_lines(text).alias("l")).select("doc_id", F.md5(F.array_join("l", "|")).alias("scores"), F.size("l").cast("long").alias("n"))


@query("X19_query_terms", rf"""{_M}, l AS (SELECT id, list_filter(regexp_extract_all(lower(coalesce(content, '')), '([a-z0-9_áéíóúñ.\-]+)', 1), lambda w: length(w) > 1 AND w NOT IN ({', '.join(repr(w) for w in L.STOP_WORDS)})) AS l FROM messages),
d AS (SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY p) AS r FROM (SELECT id, x, min(p) AS p FROM (SELECT id, unnest(l) AS x, generate_subscripts(l, 1) AS p FROM l) GROUP BY 1, 2))
SELECT m.id, coalesce(string_agg(x, ' ' ORDER BY r) FILTER (r <= 10), '') AS terms FROM messages m LEFT JOIN d ON m.id = d.id GROUP BY 1""")
def x19(spark, sf_dir):
    return view(spark, sf_dir, "messages").select("id", F.array_join(L.query_terms(F.col("content")), " ").alias("terms"))


@query("X05_clean_chunks", "SELECT doc_id, md5(array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\n|  '), lambda x: trim(x)), lambda x: x <> ''), chr(10))) AS cleaned FROM documents")
def x05(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(L.clean_chunks(F.col("text"))).alias("cleaned"))


@query("X11_halved_titles", r"""WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source || ' ' || lang || '  ' || upper(source) || ' ' || lang WHEN 1 THEN source || ' with verification ' ELSE lang || ' ' || source END AS t FROM documents),
p AS (SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(t, '[ \t\n\r\f]+', ' ', 'g')), '(?i) +with verification$', ''), ' ') AS w FROM t)
SELECT doc_id, CASE WHEN len(w) % 2 = 0 AND list_transform(w[1:len(w) // 2], lambda x: lower(x)) = list_transform(w[len(w) // 2 + 1:], lambda x: lower(x)) THEN array_to_string(w[1:len(w) // 2], ' ') ELSE array_to_string(w, ' ') END AS title FROM p""")
def x11(spark, sf_dir):
    twice = F.concat_ws(" ", "source", "lang", F.lit(""), F.upper("source"), "lang")
    title = F.when(F.col("doc_id") % 3 == 0, twice).when(F.col("doc_id") % 3 == 1, F.concat("source", F.lit(" with verification "))).otherwise(F.concat_ws(" ", "lang", "source"))
    return docs(spark, sf_dir).select("doc_id", L.halved(title).alias("title"))


@query("X13_final_numbers", "SELECT o_orderkey, CASE WHEN m = '' THEN '' ELSE coalesce(nullif(ltrim(m, '0'), ''), '0') END AS job_id FROM (SELECT o_orderkey, regexp_extract(trim(CASE o_orderkey % 3 WHEN 0 THEN 'urn:job:000' || (o_orderkey % 2) WHEN 1 THEN 'view-' || o_orderkey || ' ' ELSE 'none' END), '([0-9]+)$', 1) AS m FROM orders)")
def x13(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("urn:job:000"), (k % 2).cast("string"))).when(k % 3 == 1, F.concat(F.lit("view-"), k.cast("string"), F.lit(" "))).otherwise("none")
    return table(spark, sf_dir, "orders").select("o_orderkey", L.final_number(raw).alias("job_id"))


@query("X34_statuses", f"""{_T}, r AS (SELECT task_id, lower(trim(CASE task_id % 5 WHEN 0 THEN ' Vencida ' WHEN 1 THEN 'Enviado para calificar' WHEN 2 THEN 'No entregado' WHEN 3 THEN 'pendiente' ELSE status END)) AS s FROM tasks)
SELECT task_id, CASE WHEN regexp_matches(s, 'vencida|vencido|overdue') THEN 'overdue' WHEN regexp_matches(s, 'entregado|enviado|submitted|calificado|graded') THEN 'submitted' WHEN regexp_matches(s, 'pendiente|por entregar|no entregado|abierta|abierto') THEN 'pending' ELSE 'unknown' END AS normal FROM r""")
def x34(spark, sf_dir):
    k = F.col("task_id")
    raw = F.when(k % 5 == 0, " Vencida ").when(k % 5 == 1, "Enviado para calificar").when(k % 5 == 2, "No entregado").when(k % 5 == 3, "pendiente").otherwise(F.col("status"))
    return view(spark, sf_dir, "tasks").select("task_id", L.assignment_status(raw).alias("normal"))


@query("X40_compatible_texts", """SELECT p_partkey, a = '' OR b = '' OR a = b OR (length(a) >= 6 AND length(b) >= 6 AND (contains(a, b) OR contains(b, a))) AS compatible
  FROM (SELECT p_partkey, lower(trim(p_brand)) AS a, lower(trim(CASE p_partkey % 4 WHEN 0 THEN p_name || ' ' || p_brand WHEN 1 THEN '' WHEN 2 THEN p_brand ELSE p_type END)) AS b FROM part)""")
def x40(spark, sf_dir):
    k = F.col("p_partkey")
    seen = F.when(k % 4 == 0, F.concat_ws(" ", "p_name", "p_brand")).when(k % 4 == 1, "").when(k % 4 == 2, F.col("p_brand")).otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", L.compatible(F.col("p_brand"), seen).alias("compatible"))


@query("X43_body_and_sources", """WITH t AS (SELECT doc_id, list_transform(string_split(coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN chr(10) || ' Sources: ' || chr(10) || source || chr(10) || chr(10) || lang ELSE '' END, chr(10)), lambda x: trim(x)) AS l FROM documents),
p AS (SELECT doc_id, l, list_position(l, 'Sources:') AS mark FROM t)
SELECT doc_id, md5(array_to_string(list_filter(CASE WHEN mark > 0 THEN l[1:mark - 1] ELSE l END, lambda x: x <> ''), chr(10))) AS body, array_to_string(list_filter(CASE WHEN mark > 0 THEN l[mark + 1:] ELSE [] END, lambda x: x <> '' AND x <> 'Sources:'), ',') AS sources FROM p""")
def x43(spark, sf_dir):
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\n Sources: \n"), "source", F.lit("\n\n"), "lang")).otherwise(""))
    body, sources = L.body_and_sources(text)
    return docs(spark, sf_dir).select("doc_id", F.md5(F.array_join(body, "\n")).alias("body"), F.array_join(sources, ",").alias("sources"))


@query("U02_crawl_canonical", f"""{_P}, u AS (SELECT page_id, split_part(url, '#', 1) || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'lang=es&id=' || page_id || '#top' AS url FROM crawl_pages),
q AS (SELECT page_id, url, list_filter(string_split({_QUERY}, '&'), lambda p: p <> '' AND (regexp_replace({_HOST}, '^www\\.', '') <> 'site1.example' OR lower(split_part(p, '=', 1)) <> 'lang')) AS k FROM u)
SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) || '://' || {_HOST} || CASE WHEN regexp_replace({_PATH}, '/+$', '') = '' THEN '/' ELSE regexp_replace({_PATH}, '/+$', '') END || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END AS canonical FROM q""")
def u02(spark, sf_dir):
    url = F.concat(F.split_part("url", F.lit("#"), F.lit(1)), F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("lang=es&id="), F.col("page_id").cast("string"), F.lit("#top"))
    return pages(spark, sf_dir).select("page_id", L.crawl_canonical(url, "site1.example").alias("canonical"))


@query("U03_node_keys", f"{_P} SELECT page_id, regexp_replace({_HOST}, '^www\\.', '') || {_PATH} || CASE WHEN {_QUERY} <> '' THEN '?' || {_QUERY} ELSE '' END AS node_key FROM crawl_pages")
def u03(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.node_key(F.col("url")).alias("node_key"))


@query("U04_article_urls", f"""{_P}, s AS (SELECT page_id, url, list_filter(string_split({_PATH}, '/'), lambda s: s <> '') AS s FROM crawl_pages)
SELECT page_id, len(s) >= 2 AND length(s[-1]) >= 5 AS article, regexp_matches(lower(url), '[/\\-][0-9]{{4}}[/\\-][0-9]{{2}}[/\\-][0-9]{{2}}') OR regexp_matches(lower(url), '20[0-9]{{2}}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])') AS dated FROM s""")
def u04(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.is_article(F.col("url")).alias("article"), U.dated(F.col("url")).alias("dated"))


@query("U05_hosts", f"{_P} SELECT page_id, {_HOST} AS host, '' AS malformed FROM crawl_pages")
def u05(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.host(F.col("url")).alias("host"), U.host(F.concat(F.lit("http://[bad "), "url")).alias("malformed"))


@query("U06_source_titles", f"""{_P} SELECT page_id, CASE WHEN title <> '' THEN title WHEN h <> '' THEN h ELSE url END AS title FROM (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN '' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title, regexp_replace({_HOST}, '^www\\.', '') AS h FROM crawl_pages)""")
def u06(spark, sf_dir):
    url = L.cleaned_url(F.concat("url", F.lit("|domain=x>>>")))
    title = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return pages(spark, sf_dir).select("page_id", F.coalesce(F.nullif(title, F.lit("")), F.nullif(U.bare_host(url), F.lit("")), url).alias("title"))


@query("U07_resource_ids", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'p' || o_orderkey ELSE '' END AS slides, CASE o_orderkey % 3 WHEN 1 THEN 'f' || o_orderkey ELSE '' END AS file FROM orders""")
def u07(spark, sf_dir):
    k = F.col("o_orderkey")
    url = F.when(k % 3 == 0, F.concat(F.lit("https://d.example/Presentation/d/p"), k.cast("string"), F.lit("/edit"))).when(k % 3 == 1, F.concat(F.lit("https://d.example/file/d/f"), k.cast("string"))).otherwise("https://d.example/")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.regexp_extract(url, r"(?i)/presentation/d/([^/]+)", 1).alias("slides"), F.regexp_extract(url, r"(?i)/file/d/([^/]+)", 1).alias("file"))


@query("ST09_transitions", f"""{_T}, l AS (SELECT task_id, 'queued' AS status, created_at_ms AS moment, 0 AS step FROM tasks UNION ALL SELECT task_id, 'running', created_at_ms + 1, 1 FROM tasks WHERE status <> 'queued' UNION ALL SELECT task_id, status, updated_at_ms + 2, 2 FROM tasks WHERE status NOT IN ('queued', 'running'))
SELECT coalesce(before, 'none') || '>' || status AS transition, count(*) AS n FROM (SELECT status, lag(status) OVER (PARTITION BY task_id ORDER BY moment, step) AS before FROM l) GROUP BY 1""")
def st09(spark, sf_dir):
    row = lambda status, at, step: F.struct(status.alias("status"), at.alias("at"), F.lit(step).alias("step"))
    s = F.col("status")
    log = F.array_compact(F.array(row(F.lit("queued"), F.col("created_at_ms"), 0), F.when(s != "queued", row(F.lit("running"), F.col("created_at_ms") + 1, 1)), F.when(~s.isin("queued", "running"), row(s, F.col("updated_at_ms") + 2, 2))))
    rows = view(spark, sf_dir, "tasks").select("task_id", F.explode(log).alias("r")).select("task_id", "r.*")
    return L.transitions(rows, "task_id", ["at", "step"], "status").groupBy(F.concat(F.coalesce("before", F.lit("none")), F.lit(">"), "status").alias("transition")).agg(F.count("*").alias("n"))


@query("ST12_worker_registry", f"{_T} SELECT c_custkey AS worker_id, coalesce(s, 'idle') AS status FROM customer LEFT JOIN (SELECT session_id, arg_max(status, (updated_at_ms, task_id)) AS s FROM tasks GROUP BY 1) ON session_id = c_custkey")
def st12(spark, sf_dir):
    registry = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("worker_id"), F.lit("idle").alias("status"))
    new = view(spark, sf_dir, "tasks").groupBy(F.col("session_id").alias("worker_id")).agg(F.max_by("status", F.struct("updated_at_ms", "task_id")).alias("status"))
    known = new.join(registry, "worker_id", "left_semi")
    return registry.join(known, "worker_id", "left_anti").unionByName(known)


@query("H04_first_titles", "SELECT o_custkey, coalesce(arg_min(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'P'), arg_min(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'O'), 'untitled') AS title FROM orders GROUP BY 1")
def h04(spark, sf_dir):
    tier = lambda s: F.min_by(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")), F.when(F.col("o_orderstatus") == s, F.col("o_orderkey")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.coalesce(tier("P"), tier("O"), F.lit("untitled")).alias("title"))


_HOP = "SELECT DISTINCT c.target AS node FROM c JOIN {level} ON c.source = {level}.node WHERE c.target NOT IN (SELECT node FROM {seen})"


@query("H05_frontier", f"""WITH k AS (SELECT l_suppkey AS source, CAST(l_partkey % 97 AS BIGINT) AS target, min(l_orderkey) AS place FROM lineitem GROUP BY 1, 2),
c AS (SELECT source, target FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY place, target) AS n FROM k) WHERE n <= 3),
l0 AS (SELECT CAST(1 AS BIGINT) AS node), l1 AS ({_HOP.format(level='l0', seen='l0')}), s1 AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1), l2 AS ({_HOP.format(level='l1', seen='s1')})
SELECT node, 0 AS depth FROM l0 UNION ALL SELECT node, 1 FROM l1 UNION ALL SELECT node, 2 FROM l2""")
def h05(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 97).alias("target"), F.col("l_orderkey").alias("place"))
    return L.frontier(links, spark.range(1, 2).withColumnRenamed("id", "node"), 2, 3)


def lines(spark, sf_dir):
    """The audit log as JSON lines in the shared folder, with blank, malformed and other lines between."""
    a = view(spark, sf_dir, "audit").withColumn("event_type", F.when(F.col("k") % 4 == 0, "country_news_resolution").otherwise("turn"))
    row = F.to_json(F.struct(F.col("event_type"), F.col("request_id").cast("string").alias("request_id"), "outcome", "duration_ms", "category", "strategy", "quality_target", "ts_ms"))
    odd = F.when(F.col("k") % 10 == 0, F.lit("")).when(F.col("k") % 10 == 1, F.lit('{"request_id": ')).when(F.col("k") % 10 == 2, F.lit('[{"request_id": "0"}]')).otherwise(F.lit("17"))
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    a.select(F.explode(F.array(row, odd)).alias("value")).write.text(path)
    return path


@query("S01_scrape_records", f"{_A} SELECT CAST(request_id AS VARCHAR) AS request_id, strategy, quality_target FROM audit WHERE strategy IS NOT NULL")
def s01(spark, sf_dir):
    return readers.scrape_records(spark, lines(spark, sf_dir)).select("request_id", "strategy", "quality_target")


@query("S02_node_outcomes", f"{_A} SELECT CAST(request_id AS VARCHAR) AS request_id, outcome, duration_ms FROM audit WHERE outcome IS NOT NULL AND duration_ms IS NOT NULL")
def s02(spark, sf_dir):
    return readers.node_outcomes(spark, lines(spark, sf_dir)).select("request_id", "outcome", "duration_ms")


@query("S03_resolution_events", f"{_A} SELECT CAST(request_id AS VARCHAR) AS request_id, ts_ms FROM audit WHERE k % 4 = 0")
def s03(spark, sf_dir):
    return readers.json_objects(spark, lines(spark, sf_dir)).where("event_type = 'country_news_resolution'").select("request_id", "ts_ms")


@query("S04_json_objects", f"{_A} SELECT CAST(request_id AS VARCHAR) AS request_id, category FROM audit")
def s04(spark, sf_dir):
    return readers.json_objects(spark, lines(spark, sf_dir)).select("request_id", "category")


@query("S16_S25_unified_hits", "SELECT doc_id, source AS title, CASE WHEN doc_id % 2 = 0 THEN 'https://x.example/' || doc_id ELSE 'https://y.example/' || doc_id END AS url, lang AS content FROM documents")
def s25(spark, sf_dir):
    k, none = F.col("doc_id"), F.lit(None).cast("string")
    link = lambda host: F.concat(F.lit(f"https://{host}.example/"), k.cast("string"))
    hits = docs(spark, sf_dir).select("doc_id", F.when(k % 2 == 0, F.col("source")).alias("title"), F.when(k % 2 == 1, F.col("source")).alias("name"), F.when(k % 2 == 0, link("x")).alias("url"), F.when(k % 2 == 1, link("y")).alias("link"), F.when(k % 2 == 0, F.col("lang")).alias("content"), F.when(k % 2 == 1, F.col("lang")).otherwise(none).alias("snippet"))
    return readers.unified_hits(hits, ("doc_id",))
