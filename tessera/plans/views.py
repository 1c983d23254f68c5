"""Domain views over the synthetic tables: the same mapping for Spark and, as text, for DuckDB.

The reference's inputs (an audit log, a message store, vacancy and page records, a task log) don't
exist here, so each is a deterministic projection of a table that does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

K = {"spark": "CAST(get_json_object(props, '$.k') AS INT)", "duckdb": "CAST(json_extract_string(props, '$.k') AS INT)"}
MILLIS = {"spark": "unix_millis(CAST({0} AS TIMESTAMP))", "duckdb": "(epoch_us({0}) // 1000)"}

AUDIT = """
SELECT event_id AS request_id, user_id AS session_id, {ts} AS ts_ms, event_type AS category, k,
  CASE event_id % 4 WHEN 0 THEN 'chat_node' WHEN 1 THEN 'price_node' ELSE 'web_scraping_node' END AS node,
  CASE event_id % 3 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini' ELSE 'local-model' END AS model,
  CASE WHEN user_id % 5 = 4 THEN NULL WHEN user_id % 4 = 0 THEN 'api_price' WHEN user_id % 4 = 1 THEN 'force_search'
       WHEN user_id % 4 = 2 THEN 'prefer_search' ELSE 'free' END AS strategy,
  CASE WHEN (user_id + k) % 4 = 0 THEN 'api_price' WHEN (user_id + k) % 4 = 1 THEN 'force_search' ELSE 'free' END AS ml_recommended,
  value * 100 AS duration_ms,
  CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(k AS DOUBLE) / 100000 END AS estimated_cost_usd,
  3 * k AS raw_words,
  CASE WHEN 3 * k < 20 THEN 'unreliable' WHEN 3 * k < 50 THEN 'low_content' WHEN 3 * k < 120 THEN 'ok_weak' ELSE 'ok_strong' END AS scrape_reliability,
  CASE WHEN 3 * k >= 120 THEN 1 ELSE 0 END AS quality_target,
  CASE WHEN k % 9 = 0 THEN NULL ELSE CAST(k - 40 AS DOUBLE) / 32 END AS scrape_score,
  CAST(k % 11 - 5 AS DOUBLE) / 4 AS prior_score,
  CASE WHEN k % 6 = 0 THEN k % 4 END AS recovery_turns,
  CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(k % 13 AS DOUBLE) / 8 END AS regret_estimate,
  CASE WHEN k < 60 THEN 'success' WHEN k < 75 THEN 'error' WHEN k < 85 THEN 'low_confidence' WHEN k < 95 THEN 'blocked' END AS outcome,
  CASE user_id % 3 WHEN 0 THEN 'structured' WHEN 1 THEN 'unstructured' END AS source_type,
  CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS prediction_match,
  k % 2 = 0 AS ml_would_succeed, k % 4 <> 0 AS tokens_available,
  10 * k AS prompt_tokens, 3 * k AS completion_tokens, 13 * k AS total_tokens,
  k % 8 = 0 AS followup_likely, k % 9 = 0 AS exploring, CAST(k % 4 AS DOUBLE) / 20 AS exp_rate
FROM (SELECT *, {k} AS k FROM events) e
"""
MESSAGES = """
SELECT conv_id * 1000 + turn AS id, conv_id AS session_id,
  CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' ELSE role END AS role,
  text AS content, turn AS ts, conv_id * 8 + turn AS request_id
FROM conversations
"""
TASKS = """
SELECT o_orderkey AS task_id, o_custkey AS session_id, {ts} AS created_at_ms,
  {ts} + 1000 * (o_orderkey % 50) AS updated_at_ms,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'queued' ELSE 'running' END
    ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'cancelled' END END AS status,
  CASE WHEN o_orderkey % 4 = 0 AND o_orderkey > 8 THEN o_orderkey - 4 END AS parent_task_id
FROM orders
"""
RESOLUTIONS = """
SELECT event_id, {ts} AS ts_ms, CASE WHEN k % 10 = 0 THEN NULL ELSE n_name END AS geography,
  CASE WHEN k < 40 THEN 'curated' WHEN k < 70 THEN 'dynamic' WHEN k < 90 THEN 'generic' ELSE 'none' END AS resolution_path, k % 6 AS domains_found
FROM (SELECT *, {k} AS k FROM events) e JOIN nation ON n_nationkey = user_id % 25
"""
VACANCIES = """
SELECT doc_id AS pos, CASE WHEN doc_id % 10 = 3 THEN NULL ELSE CAST(doc_id % 700 AS VARCHAR(20)) END AS job_id,
  'https://jobs.example.com/view/' || CAST(doc_id % 650 AS VARCHAR(20)) AS canonical_url,
  source AS company, lang AS location, text AS description,
  substring(text, 1, 24) AS title, doc_id % 3 = 0 AS has_full
FROM documents
"""
SITE_NODES = """
SELECT page_id AS node_id, CASE WHEN page_id > 0 THEN CAST(floor((page_id - 1) / 12) AS BIGINT) END AS parent_id,
  CASE page_id % 7 WHEN 0 THEN 'section' WHEN 1 THEN 'document' WHEN 2 THEN 'google_drive' WHEN 3 THEN 'link' WHEN 4 THEN 'document' WHEN 5 THEN 'external_redirect' ELSE 'image' END AS kind,
  CASE WHEN page_id % 11 = 7 THEN 'Perfil' ELSE substring(html, 60 + CAST(page_id % 5 AS INT), 12) END AS title,
  CASE WHEN page_id % 4 <> 2 THEN 'https://www.site.example/v/' || CAST(page_id * 5 % 17 AS VARCHAR(20)) END AS url,
  CASE WHEN page_id % 3 = 1 THEN 'https://site.example/r/' || CAST(page_id * 7 % 13 AS VARCHAR(20)) WHEN page_id % 9 = 2 THEN 'http://www.site.example/r/1' END AS canonical_url,
  CASE WHEN page_id % 4 = 1 THEN 'http://site.example/r/' || CAST(page_id * 11 % 23 AS VARCHAR(20)) END AS redirect_url,
  CASE WHEN page_id % 5 = 2 THEN 'https://site.example/v/' || CAST(page_id * 3 % 29 AS VARCHAR(20)) ELSE '' END AS download_url,
  CASE WHEN page_id % 6 = 3 THEN 'https://site.example/v/' || CAST(page_id % 17 AS VARCHAR(20)) END AS preview_url,
  CASE WHEN page_id % 2 = 0 THEN url END AS description, CASE WHEN page_id % 3 = 0 THEN 'text/html' END AS mime_type, CAST(NULL AS VARCHAR(20)) AS subtitle,
  page_id % 12 AS n_meta, CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'new' ELSE 'new,old' END AS badge_list
FROM pages
"""
NAME_QUERIES = """
SELECT p_partkey AS query_id, p_brand AS g,
  CASE p_partkey % 7 WHEN 0 THEN upper(p_name) WHEN 1 THEN '' WHEN 2 THEN CAST(p_partkey % 120 AS VARCHAR(20)) WHEN 3 THEN substring(p_name, 2, 6)
    WHEN 4 THEN '  ' || split_part(p_name, ' ', 2) || '  ' || split_part(p_name, ' ', 1) || ' ' WHEN 5 THEN substring(p_name, 1, 3) || ' ' || substring(split_part(p_name, ' ', 2), 2, 3) ELSE p_name || ' x' END AS query
FROM part
"""
BOXES = """
SELECT l_orderkey AS page, l_orderkey * 10000000000 + CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey AS box, l_suppkey % 4 * 25 AS x, l_partkey % 110 AS y,
  CASE WHEN l_linenumber % 7 = 5 THEN CAST(90 AS BIGINT) ELSE 130 + CAST(l_quantity AS BIGINT) * 4 END AS width, 40 + l_linenumber * 12 AS height, l_partkey % 9 AS identity
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey) l
"""
ADHOC = """
SELECT o_orderkey AS input, CASE o_orderkey % 6
  WHEN 0 THEN '[' || CAST(o_custkey AS VARCHAR(20)) || ', ' || CAST(o_custkey % 7 AS VARCHAR(20)) || ', -2.5]'
  WHEN 1 THEN '[' || chr(123) || '"a": ' || CAST(o_custkey AS VARCHAR(20)) || ', "b": "x' || CAST(o_custkey % 3 AS VARCHAR(20)) || '"' || chr(125) || ', ' || chr(123) || '"a": 7, "b": "y"' || chr(125) || ', ' || chr(123) || '"a": null, "c": 1' || chr(125) || ', 5]'
  WHEN 2 THEN 'k,v' || chr(10) || CAST(o_custkey AS VARCHAR(20)) || ',' || o_orderstatus || chr(10) || chr(10) || '5,"q, ""r"" x"' || chr(10)
  WHEN 3 THEN o_orderpriority WHEN 4 THEN '[1, ' || CAST(o_custkey AS VARCHAR(20)) ELSE '[' || CAST(o_custkey AS VARCHAR(20)) || ']' END AS data
FROM orders
"""
PAGES = "SELECT page_id, url, html FROM pages"
TEXTS = {"audit": AUDIT, "messages": MESSAGES, "tasks": TASKS, "resolutions": RESOLUTIONS, "vacancies": VACANCIES, "crawl_pages": PAGES, "site_nodes": SITE_NODES, "name_queries": NAME_QUERIES, "boxes": BOXES, "adhoc": ADHOC}
BASES = {"audit": ("events",), "messages": ("conversations",), "tasks": ("orders",), "resolutions": ("events", "nation"), "vacancies": ("documents",), "crawl_pages": ("pages",), "site_nodes": ("pages",), "name_queries": ("part",), "boxes": ("lineitem",), "adhoc": ("orders",)}


def _text(name: str, engine: str) -> str:
    moment = "o_orderdate" if name == "tasks" else "ts"
    return TEXTS[name].format(k=K[engine], ts=MILLIS[engine].format(moment)) if "{" in TEXTS[name] else TEXTS[name]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view as a DataFrame; its base tables are arguments of the query, so no view is registered."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASES[name]}
    text = _text(name, "spark").replace("VARCHAR(20)", "STRING")
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(text, **tables)


def with_views(*names: str) -> str:
    """``WITH`` clause that defines the views for DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({_text(n, 'duckdb')})" for n in names) + "\n"
