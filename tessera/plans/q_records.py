"""Record, text, URL and crawl queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import time as M
from tessera.functions import url as U
from tessera.operators import records as R
from tessera.plans.registry import query
from tessera.plans.views import view, with_views

_V, _P, _A = with_views("vacancies"), with_views("crawl_pages"), with_views("audit")
_FOLD = f"translate(lower(coalesce({{0}}, '')), '{X.MARKED}', '{X.PLAIN}')"


def _fp(c: str, limit: int = 1400) -> str:
    out = _FOLD.format(c)
    for p in (r"https?://\S+", r"\b[0-9]{4,}\b", r"[^a-z0-9]+"):
        out = f"regexp_replace({out}, '{p}', ' ', 'g')"
    return f"substring(trim({out}), 1, {limit})"


def vacancies(spark, sf_dir):
    return view(spark, sf_dir, "vacancies")


def pages(spark, sf_dir):
    return view(spark, sf_dir, "crawl_pages")


def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("D01_first_wins", f"""{_V} SELECT pos FROM (SELECT pos, row_number() OVER (PARTITION BY coalesce(job_id, canonical_url) ORDER BY pos) AS r FROM vacancies) WHERE r = 1""")
def d01(spark, sf_dir):
    return R.first_wins(vacancies(spark, sf_dir), F.coalesce("job_id", "canonical_url"), "pos").select("pos")


@query("X02_fingerprints", f"SELECT doc_id, md5({_fp('text')}) AS fingerprint FROM documents")
def x02(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(X.fingerprint(F.col("text"))).alias("fingerprint"))


@query("D02_semantic_collapse", f"""{_V}, k AS (SELECT *, {_fp('title', 160)} AS t, {_fp('company', 160)} AS c, {_fp('description')} AS b FROM vacancies),
s AS (SELECT *, t || '|' || c || '|' || b AS key FROM k WHERE length(b) >= 160 AND t <> '' AND c <> '')
SELECT min(pos) AS pos, count(*) AS members, arg_max(job_id, (has_full, length(description), -pos)) AS job_id FROM (SELECT key, pos, coalesce(job_id, '-') AS job_id, has_full, description FROM s) GROUP BY key""")
def d02(spark, sf_dir):
    v = vacancies(spark, sf_dir).withColumn("job_id", F.coalesce("job_id", F.lit("-")))
    key = R.semantic_key("title", "company", "description")
    return R.best_wins(v.where(key.isNotNull()), key, [F.col("has_full"), F.length("description").alias("size")], "pos").select("pos", "members", "job_id")


@query("D04_ranked_replacement", f"""{_V} SELECT canonical_url, max(struct_pack(f := has_full, p := -pos)).p * -1 AS pos FROM vacancies GROUP BY 1""")
def d04(spark, sf_dir):
    return vacancies(spark, sf_dir).groupBy("canonical_url").agg(F.max_by("pos", F.struct("has_full", -F.col("pos"))).alias("pos"))


@query("D05_J16_merged", f"""{_V} SELECT canonical_url, arg_min(job_id, pos) FILTER (job_id IS NOT NULL) AS job_id, arg_min(title, pos) AS title, array_to_string(list_sort(list(DISTINCT company)), ',') AS company FROM vacancies GROUP BY 1""")
def d05(spark, sf_dir):
    return R.merged(vacancies(spark, sf_dir), "canonical_url", "pos", ["job_id", "title"], "company")


@query("W09_interleaved", f"""{_V} SELECT pos, row_number() OVER (ORDER BY n, location) AS turn FROM (SELECT pos, location, row_number() OVER (PARTITION BY location ORDER BY pos) AS n FROM vacancies)""")
def w09(spark, sf_dir):
    return R.interleaved(vacancies(spark, sf_dir).select("pos", "location"), "location", "pos").select("pos", "turn")


@query("W10_source_order", f"{_V} SELECT pos, min(pos) OVER (PARTITION BY company) AS source_first FROM vacancies")
def w10(spark, sf_dir):
    return R.source_order(vacancies(spark, sf_dir), "company", "pos").select("pos", "source_first")




@query("D03_greedy")
def d03(spark, sf_dir):
    v = vacancies(spark, sf_dir).withColumn("tokens", F.array_distinct(F.filter(F.split(X.fingerprint(F.col("description"), 900), " "), lambda t: F.length(t) >= 4)))
    v = v.withColumn("block", F.struct("company", "location"))
    return R.greedy(v, "block", "pos", "tokens", 0.62, 8).select("pos")


@query("A22_country_groups", f"{_V} SELECT CASE location WHEN 'en' THEN 'english' WHEN 'es' THEN 'spanish' ELSE 'other' END AS grp, count(*) AS n, count(*) FILTER (job_id IS NULL) AS without_id FROM vacancies GROUP BY 1")
def a22(spark, sf_dir):
    g = F.when(F.col("location") == "en", "english").when(F.col("location") == "es", "spanish").otherwise("other")
    return vacancies(spark, sf_dir).groupBy(g.alias("grp")).agg(F.count("*").alias("n"), F.count_if(F.col("job_id").isNull()).alias("without_id"))


@query("A18_A19_warning_types", f"""{_A} SELECT coalesce(nullif(lower(trim(split_part(coalesce(outcome, ''), '_', 1))), ''), 'unknown') AS warning, count(*) AS n FROM audit GROUP BY 1""")
def a18(spark, sf_dir):
    kind = F.coalesce(X.blank_to_null(F.lower(F.split_part(F.coalesce("outcome", F.lit("")), F.lit("_"), F.lit(1)))), F.lit("unknown"))
    return view(spark, sf_dir, "audit").groupBy(kind.alias("warning")).agg(F.count("*").alias("n"))


@query("A23_session_status", f"""{_A} SELECT session_id, CASE WHEN bool_and(coalesce(outcome = 'success', false)) THEN 'complete' WHEN bool_or(coalesce(outcome = 'success', false)) THEN 'partial' ELSE 'failed' END AS status FROM audit GROUP BY 1""")
def a23(spark, sf_dir):
    ok = F.coalesce(F.col("outcome") == "success", F.lit(False))
    return view(spark, sf_dir, "audit").groupBy("session_id").agg(F.when(F.bool_and(ok), "complete").when(F.bool_or(ok), "partial").otherwise("failed").alias("status"))


@query("A27_zero_filled_status", f"""{_A} SELECT s.status, count(outcome) AS n FROM (VALUES ('success'), ('error'), ('blocked'), ('timeout')) s(status) LEFT JOIN audit ON outcome = s.status GROUP BY 1""")
def a27(spark, sf_dir):
    names = spark.createDataFrame([("success",), ("error",), ("blocked",), ("timeout",)], "status string")
    counts = view(spark, sf_dir, "audit").groupBy(F.col("outcome").alias("status")).agg(F.count("*").alias("n"))
    return names.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query("X03_redacted", r"""SELECT doc_id, md5(trim(substring(regexp_replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', '[redacted-email]', 'g'), 'https?://\S+', '[redacted-url]', 'g'), 1, 1000))) AS clean
  FROM documents WHERE NOT regexp_matches(text, '[0-9][0-9 ().-]{7,}')""")
def x03(spark, sf_dir):
    return docs(spark, sf_dir).where(~F.col("text").rlike("[0-9][0-9 ().-]{7,}")).select("doc_id", F.md5(X.redacted(F.col("text"))).alias("clean"))


@query("X03_redacted_whole")
def x03_whole(spark, sf_dir):
    """All documents, those with phone numbers too: DuckDB's patterns have no look-behind, so there is no SQL."""
    return docs(spark, sf_dir).select("doc_id", F.md5(X.redacted(F.col("text"))).alias("clean"))


@query("X04_truncated", r"""SELECT doc_id, CASE WHEN length(w) <= 100 THEN w WHEN contains(substring(w, 1, 100), ' ') THEN trim(regexp_replace(substring(w, 1, 100), ' [^ ]*$', '')) ELSE substring(w, 1, 100) END AS cut
  FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS w FROM documents)""")
def x04(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.cut_at_word(F.col("text"), 100).alias("cut"))


@query("X01_folded", f"SELECT doc_id, md5({_FOLD.format('text')}) AS folded FROM documents")
def x01(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(X.folded(F.col("text"))).alias("folded"))


@query("X33_slugs", f"SELECT doc_id, trim(regexp_replace({_FOLD.format('substring(text, 1, 60)')}, '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents")
def x33(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.slug(F.substring("text", 1, 60)).alias("slug"))


@query("X32_hashes", "SELECT doc_id, 'v' || substring(sha256(text), 1, 12) AS version FROM documents")
def x32(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.concat(F.lit("v"), F.substring(F.sha2("text", 256), 1, 12)).alias("version"))


@query("X16_X23_categories", "SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'legal' WHEN contains(lower(text), 'password') OR contains(lower(text), 'token') THEN 'secret' ELSE 'general' END AS category FROM documents")
def x16(spark, sf_dir):
    rules = (("legal", ("license",)), ("secret", ("password", "token")))
    return docs(spark, sf_dir).select("doc_id", X.first_matching(F.lower("text"), rules, "general").alias("category"))


@query("X15_keyword_counts", r"SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) > 4))) AS n FROM documents")
def x15(spark, sf_dir):
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0), lambda w: F.length(w) > 4))
    return docs(spark, sf_dir).select("doc_id", F.size(words).cast("long").alias("n"))


@query("X35_X36_scores", """SELECT doc_id, CASE WHEN n < 200 THEN 'short' WHEN n < 2000 THEN 'medium' ELSE 'long' END AS bucket,
  CASE WHEN contains(text, 'http') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(text, '[0-9]') THEN 2 ELSE 0 END - CASE WHEN n < 100 THEN 4 ELSE 0 END AS score FROM (SELECT doc_id, text, length(text) AS n FROM documents)""")
def x35(spark, sf_dir):
    n = F.length("text")
    part = lambda test, points: F.when(test, points).otherwise(0)
    return docs(spark, sf_dir).select("doc_id", F.when(n < 200, "short").when(n < 2000, "medium").otherwise("long").alias("bucket"), (part(F.contains("text", F.lit("http")), 3) + part(F.col("text").rlike("[0-9]"), 2) - part(n < 100, 4)).alias("score"))


@query("D18_distinct_lines", f"""SELECT count(*) AS n, count(DISTINCT k) AS distinct_lines FROM (SELECT {_FOLD.format("regexp_replace(trim(line), '^[0-9]+[.)] *', '')")} AS k FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE k <> ''""")
def d18(spark, sf_dir):
    lines = docs(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("line"))
    key = X.folded(F.regexp_replace(F.trim("line"), r"^[0-9]+[.)] *", ""))
    return lines.select(key.alias("k")).where("k != ''").groupBy("k").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.count("*").alias("distinct_lines"))


@query("D16_stories", r"""SELECT min(doc_id) AS doc_id, count(*) AS n FROM (SELECT doc_id, lower(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')[1:3], ' ')) AS s FROM documents) GROUP BY s""")
def d16(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(R.story_signature("text").alias("s")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select("doc_id", "n")


@query("F08_routed", f"""{_V} SELECT pos, CASE WHEN job_id IS NULL THEN 'missing_id' WHEN length(description) < 200 THEN 'short_body' WHEN NOT has_full THEN 'excerpt_only' END AS reject_reason FROM vacancies
  WHERE job_id IS NULL OR length(description) < 200 OR NOT has_full""")
def f08(spark, sf_dir):
    reason = F.when(F.col("job_id").isNull(), "missing_id").when(F.length("description") < 200, "short_body").when(~F.col("has_full"), "excerpt_only")
    return R.routed(vacancies(spark, sf_dir), reason)[1].select("pos", "reject_reason")


@query("M19_missing_fields", f"{_V} SELECT pos, 'job_id' AS field FROM vacancies WHERE coalesce(trim(job_id), '') = '' UNION ALL SELECT pos, 'title' FROM vacancies WHERE coalesce(trim(title), '') = ''")
def m19(spark, sf_dir):
    return R.missing_fields(vacancies(spark, sf_dir), "pos", ["job_id", "title"])


@query("M12_specificity", "SELECT n_name, CASE WHEN n_name = '' THEN 0 WHEN lower(n_name) IN ('japan') THEN 1 ELSE 3 END AS score FROM nation")
def m12(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", X.specificity(F.col("n_name")).alias("score"))


@query("M01_relative_ages", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 50) * 60000 WHEN 1 THEN (event_id % 50) * 3600000 WHEN 2 THEN (event_id % 50) * 86400000 ELSE 0 END AS age_ms,
  CASE event_id % 4 WHEN 1 THEN event_id % 50 <= 24 WHEN 2 THEN event_id % 50 <= 1 ELSE true END AS within FROM events""")
def m01(spark, sf_dir):
    n = (F.col("event_id") % 50).cast("string")
    said = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Posted  "), n, F.lit(" minutes ago"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("hace "), n, F.lit(" horas"))).when(F.col("event_id") % 4 == 2, F.concat(n, F.lit(" días"))).otherwise("hace unos segundos")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", M.age_ms(said, 0).alias("age_ms"), M.within_a_day(said, 0).alias("within"))


@query("M02_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def m02(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    months = F.array(*map(F.lit, M.MONTHS))
    words = F.concat(F.dayofmonth("o_orderdate").cast("string"), F.lit(" de "), F.element_at(months, F.month("o_orderdate")), F.lit(" de "), F.year("o_orderdate").cast("string"))
    slash = F.date_format("o_orderdate", "d/M/yyyy")
    said = F.when(F.col("o_orderkey") % 3 == 0, words).when(F.col("o_orderkey") % 3 == 1, slash).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", M.spanish_date(F.concat(F.lit("Vence: "), said), 2024).alias("day"))


_HOST = r"lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1))"
_PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"
_QUERY = r"regexp_extract(url, '\?([^#]*)', 1)"
_KEPT = f"list_filter(string_split({_QUERY}, '&'), lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN ({', '.join(repr(t) for t in U.TRACKING)}))"


@query("U01_U08_page_keys", f"""{_P} SELECT page_id, regexp_replace({_HOST}, '^www\\.', '') AS host, {_PATH} AS path,
  'https://' || {_HOST} || regexp_replace({_PATH}, '/+$', '') || CASE WHEN len({_KEPT}) > 0 THEN '?' || array_to_string({_KEPT}, '&') ELSE '' END AS canonical,
  regexp_replace({_HOST}, '^www\\.', '') || {_PATH} || CASE WHEN {_QUERY} <> '' THEN '?' || {_QUERY} ELSE '' END AS node_key,
  len(list_filter(string_split({_PATH}, '/'), lambda s: s <> '')) >= 2 AND length(list_filter(string_split({_PATH}, '/'), lambda s: s <> '')[-1]) >= 5 AS article,
  regexp_matches(lower(url), '[/\\-][0-9]{{4}}[/\\-][0-9]{{2}}[/\\-][0-9]{{2}}') OR regexp_matches(lower(url), '20[0-9]{{2}}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])') AS dated FROM crawl_pages""")
def u01(spark, sf_dir):
    return R.page_keys(pages(spark, sf_dir))


@query("F07_allowed_domains", f"{_P} SELECT page_id FROM crawl_pages WHERE {_HOST} <> '' AND NOT ({_HOST} = 'site1.example' OR {_HOST} LIKE '%.site1.example')")
def f07(spark, sf_dir):
    return pages(spark, sf_dir).where(U.allowed(F.col("url"), ("site1.example",), ())).select("page_id")


@query("S20_anchors", f"""{_P} SELECT page_id, href, min(place) - 1 AS place FROM (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) AS place FROM (
  SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS h FROM crawl_pages)) GROUP BY 1, 2""")
def s20(spark, sf_dir):
    return R.anchors(pages(spark, sf_dir))


@query("D09_D13_distinct_pages", f"""{_P} SELECT canonical, min(page_id) AS page_id, count(*) AS n FROM (
  SELECT page_id, 'https://' || {_HOST} || regexp_replace({_PATH}, '/+$', '') || CASE WHEN len({_KEPT}) > 0 THEN '?' || array_to_string({_KEPT}, '&') ELSE '' END AS canonical FROM crawl_pages) GROUP BY 1""")
def d09(spark, sf_dir):
    return pages(spark, sf_dir).groupBy(U.without_parameters(F.col("url")).alias("canonical")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


@query("X39_page_confidence", f"""{_P} SELECT page_id, CAST(round(CAST(CASE WHEN title <> '' THEN 0.2 ELSE 0 END + CASE WHEN url <> '' THEN 0.1 ELSE 0 END + CASE WHEN nav THEN 0.15 ELSE 0 END AS DECIMAL(18, 9)), 2) AS DOUBLE) AS confidence
  FROM (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, contains(html, '<nav') AS nav FROM crawl_pages)""")
def x39(spark, sf_dir):
    p = pages(spark, sf_dir).withColumn("title", F.regexp_extract("html", "<title>([^<]*)</title>", 1)).withColumn("nav", F.when(F.contains("html", F.lit("<nav")), "yes"))
    return p.select("page_id", R.page_confidence(p, {"title": 0.2, "url": 0.1, "nav": 0.15}).alias("confidence"))


@query("H01_tree", """WITH RECURSIVE n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 16 <> 0 THEN o_orderkey - o_orderkey % (CASE WHEN o_orderkey % 4 <> 0 THEN 4 ELSE 16 END) END AS parent FROM orders),
t AS (SELECT id, 0 AS depth, CAST(id AS VARCHAR) AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.id, t.depth + 1, t.path || '/' || n.id FROM n JOIN t ON n.parent = t.id) SELECT id, depth, path FROM t""")
def h01(spark, sf_dir):
    k = F.col("o_orderkey")
    step = F.when(k % 4 != 0, 4).otherwise(16)
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("id"), F.when(k % 16 != 0, k - k % step).alias("parent"))
    return R.tree(n, "id", "parent", 3)


@query("J06_earlier_parents", """SELECT c.o_orderkey AS child, arg_max(p.o_orderkey, p.o_orderkey) AS parent FROM orders c LEFT JOIN orders p ON p.o_custkey = c.o_custkey AND p.o_orderkey < c.o_orderkey GROUP BY 1""")
def j06(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return R.attach_earlier(o, F.col("o_custkey"), F.col("o_custkey"), "o_orderkey", "o_orderkey")


@query("O12_covering_prefix", """SELECT l_orderkey, min(k) AS k FROM (SELECT l_orderkey, row_number() OVER w AS k, sum(l_quantity) OVER w >= 60 AND sum(l_extendedprice) OVER w >= 1000 AS ok
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_quantity) AS rk FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY rk)) WHERE ok GROUP BY 1""")
def o12(spark, sf_dir):
    from pyspark.sql import Window

    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ranked = items.withColumn("rk", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_quantity")))
    return R.covering_prefix(ranked, "l_orderkey", "rk", {"l_quantity": 60, "l_extendedprice": 1000})


@query("J11_query_plans", "SELECT n_name, plan FROM nation, (VALUES ('recent'), ('remote')) p(plan)")
def j11(spark, sf_dir):
    plans = F.explode(F.array(F.lit("recent"), F.lit("remote")))
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", plans.alias("plan"))


@query("J08_J09_longest_term", """SELECT doc_id, arg_max(r_name, (length(t), r_name)) AS region FROM documents JOIN (SELECT r_name, lower(substring(r_name, 1, 3)) AS t FROM region) ON contains(lower(text), t) GROUP BY 1""")
def j08(spark, sf_dir):
    terms = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_name", F.lower(F.substring("r_name", 1, 3)).alias("t"))
    found = docs(spark, sf_dir).join(F.broadcast(terms), F.contains(F.lower("text"), F.col("t")))
    return found.groupBy("doc_id").agg(F.max_by("r_name", F.struct(F.length("t"), "r_name")).alias("region"))
