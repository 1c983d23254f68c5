"""Ranking queries over candidates made from ``pages`` and ``documents``, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import url as U
from tessera.operators import ranking as K
from tessera.plans.registry import query

POLICY = K.Policy(
    terms=("item", "the", "that"), noise=("page",), navigation=("tag", "a", "index"), evergreen=("license", "travel advisory"), positive=("the", "and", "for"), tangential=("der",), sections=("post", "item"), broad=("tag",),
    preferred=("site1.example", "www1.example"), suffixes=("example",), trusted=("example.com",),
)
REF = "2024-02-15"


def candidates(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.substring(F.regexp_extract("html", "<p>([^<]*)</p>", 1), 1, 200).alias("snippet"))


_C = "c AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, substring(regexp_extract(html, '<p>([^<]*)</p>', 1), 1, 200) AS snippet FROM pages)"
_HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', '')"
_SEG = r"list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> '')"
_PATH = r"lower(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1))"
_IN = lambda text, words: " + ".join([f"CASE WHEN contains({text}, '{w}') THEN 1 ELSE 0 END" for w in words]) or "0"
_DOMAIN = lambda ds: "(" + " OR ".join(f"h = '{d}' OR h LIKE '%.{d}'" for d in ds) + ")"
_DATED = r"regexp_matches(path, '(19|20)[0-9]{2}[/\-]?[0-9]{2}[/\-]?[0-9]{2}')"
_HUB = "(len(seg) = 0 OR list_has_any(list_transform(seg, lambda s: lower(s)), ['tag', 'a', 'index']) OR coalesce(regexp_matches(lower(seg[-1]), '^index\\.[a-z]+$'), false))"
_SCORED = f"""WITH {_C}, b AS (SELECT *, {_HOST} AS h, {_SEG} AS seg, {_PATH} AS path, lower(title || ' ' || snippet || ' ' || url) AS blob,
  translate(lower(title || ' ' || snippet || ' ' || url), '{X.MARKED}', '{X.PLAIN}') AS fb, translate(lower(title || ' ' || url), '{X.MARKED}', '{X.PLAIN}') AS fs FROM c),
r AS (SELECT *, 3 * ({_IN('fb', POLICY.positive)}) + 4 * ({_IN('fs', POLICY.sections)}) - 5 * ({_IN('fb', POLICY.tangential)}) - 2 * ({_IN('fs', POLICY.broad)}) AS base FROM b),
scored AS (SELECT *, 3 * ({_IN('blob', POLICY.terms)}) + CASE WHEN regexp_matches(blob, '\\b[0-9]+\\s*-\\s*[0-9]+\\b') THEN 2 ELSE 0 END
  + CASE WHEN {_DATED} OR regexp_matches(path, '[0-9]{{6,8}}') THEN 4 ELSE 0 END + CASE WHEN len(seg) >= 3 THEN 2 ELSE 0 END + CASE WHEN len(seg) <= 2 AND NOT {_DATED} THEN -3 ELSE 0 END
  + CASE WHEN list_has_any(seg, ['tag', 'a', 'index']) THEN -4 ELSE 0 END + CASE WHEN contains(blob, 'page') THEN -2 ELSE 0 END
  + CASE WHEN NOT (contains(lower(title), 'item') OR contains(lower(title), 'that')) THEN -6 ELSE 0 END + CASE WHEN {_HUB} THEN -12 ELSE 0 END AS score,
  base - CASE WHEN contains(fs, 'tag') AND base < 4 THEN 5 ELSE 0 END AS relevance,
  CASE WHEN {_DOMAIN(POLICY.preferred)} THEN 0 WHEN {_DOMAIN(POLICY.suffixes)} THEN 1 WHEN {_DOMAIN(POLICY.trusted)} THEN 2 ELSE 3 END AS priority,
  contains(blob, 'license') OR contains(blob, 'travel advisory') OR (regexp_matches(lower(url), '[./]go[bv]\\.') AND regexp_matches(lower(url), '/prensa/|/comunicado|/press-release')) AS evergreen,
  CASE WHEN {_HUB} THEN 'hub_hit' WHEN len(seg) >= 2 AND length(seg[-1]) >= 5 THEN 'article_hit' ELSE 'topic_hit' END AS kind FROM r)
"""


@query("X21_X24_F10_F11_J07_scored", f"{_SCORED} SELECT page_id, score, relevance, priority, evergreen, kind FROM scored")
def x21(spark, sf_dir):
    return K.scored(candidates(spark, sf_dir), POLICY).select("page_id", "score", "relevance", "priority", "evergreen", "kind")


@query("O05_O06_ranked", f"{_SCORED} SELECT page_id FROM scored ORDER BY priority, score DESC, page_id LIMIT 20")
def o05(spark, sf_dir):
    return K.ranked(candidates(spark, sf_dir), POLICY, "page_id").limit(20).select("page_id")


@query("F15_relevant", f"{_SCORED} SELECT page_id FROM scored WHERE relevance >= 4")
def f15(spark, sf_dir):
    return K.scored(candidates(spark, sf_dir), POLICY).where(F.col("relevance") >= POLICY.least_relevance).select("page_id")


@query("O13_distinct_best")
def o13(spark, sf_dir):
    return K.distinct_best(candidates(spark, sf_dir), POLICY, "page_id", 4).select("page_id", "score", "relevance")


_URL = "'https://news.example/' || strftime(o_orderdate, CASE WHEN o_orderkey % 2 = 0 THEN '%Y/%m/%d' ELSE '%Y%m%d' END) || '/story'"


#: Dates without separators are read from 2000 on, so earlier ones count as no date.
@query("F14_recent", f"SELECT o_orderkey, CAST(o_orderdate AS DATE) >= DATE '{REF}' - 30 OR o_orderkey % 5 = 0 OR o_orderkey % 2 = 1 AND year(o_orderdate) < 2000 AS recent FROM orders")
def f14(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    url = F.when(F.col("o_orderkey") % 5 == 0, F.lit("https://news.example/story")).otherwise(F.concat(F.lit("https://news.example/"), day, F.lit("/story")))
    return o.select("o_orderkey", K.recent(url, REF, 30).alias("recent"))


_TOPICS = (("law", ("license", "released")), ("secret", ("password", "token", "secret")), ("speech", ("that", "was")))


@query("A28_topics", f"""SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'none' WHEN a = greatest(a, b, c) THEN 'law' WHEN b = greatest(a, b, c) THEN 'secret' ELSE 'speech' END AS topic FROM (
  SELECT doc_id, {', '.join(f"{_IN('lower(text)', w)} AS {n}" for n, (_, w) in zip('abc', _TOPICS, strict=True))} FROM documents)""")
def a28(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", K.topic(F.lower("text"), _TOPICS, "none").alias("topic"))


@query("F16_topical_lines", """SELECT doc_id, md5(array_to_string(CASE WHEN len(hit) >= 2 AND len(hit) < len(l) THEN hit ELSE l END, chr(10))) AS text, len(hit) AS hits FROM (
  SELECT doc_id, l, list_filter(l, lambda x: contains(lower(x), 'that') OR contains(lower(x), 'license')) AS hit FROM (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents))""")
def f16(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return K.topical_lines(d, "doc_id", "text", ("that", "license")).withColumn("text", F.md5("text"))


@query("D08_chunked", """SELECT o_custkey, o_orderkey, CASE WHEN i < more * (base + 1) THEN i // (base + 1) ELSE more + (i - more * (base + 1)) // base END AS part FROM (
  SELECT *, greatest(n // 3, 1) AS base, n % 3 AS more FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, least(count(*) OVER (PARTITION BY o_custkey), 15) AS n FROM orders)) WHERE i < n
  AND CASE WHEN i < more * (base + 1) THEN i // (base + 1) ELSE more + (i - more * (base + 1)) // base END < 3""")
def d08(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey")
    return K.chunked(o, "o_custkey", "o_orderkey", 3)


@query("F31_script_ratio", r"""SELECT doc_id, o <= 12 AND o <= greatest(4, l // 8) AS ok FROM (SELECT doc_id, length(regexp_replace(text, '[^A-Za-zÀ-ÿ]', '', 'g')) AS l, length(regexp_replace(text, '[\x{0000}-\x{024F}]', '', 'g')) AS o FROM documents)""")
def f31(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", K.script_ratio_ok(F.col("text")).alias("ok"))


@query("X28_prices", "SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders")
def x28(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    plain = F.format_number(F.round("o_totalprice", 2), 2)
    swapped = F.translate(plain, ",.", ".,")
    said = F.concat(F.lit("Total: "), F.when(F.col("o_orderkey") % 2 == 0, plain).otherwise(swapped), F.lit(" USD"))
    return o.select("o_orderkey", K.price(said).alias("price"))


@query("J18_suffix_hints", "SELECT DISTINCT n_name AS name, CASE WHEN n_nationkey % 4 = 0 THEN '.own' ELSE lower(substring(r_name, 1, 2)) END AS suffix FROM nation JOIN region ON n_regionkey = r_regionkey")
def j18(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    groups = n.select(F.col("n_name").alias("name"), F.array(F.col("n_regionkey").cast("string")).alias("terms"), F.when(F.col("n_nationkey") % 4 == 0, F.array(F.lit(".own"))).otherwise(F.array().cast("array<string>")).alias("suffixes"))
    hints = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.array(F.col("r_regionkey").cast("string"), F.lit("x")).alias("terms"), F.array(F.lower(F.substring("r_name", 1, 2))).alias("suffixes"))
    return K.suffix_hints(groups, hints)


@query("M14_paired_calls", "SELECT event_id AS call_id, CASE WHEN event_id % 3 = 0 THEN '(missing tool output)' ELSE event_type END AS output FROM events")
def m14(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return K.paired_calls(e.select(F.col("event_id").alias("call_id")), e.where("event_id % 3 != 0").select(F.col("event_id").alias("call_id"), F.col("event_type").alias("output")))


@query("J03_evidence", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) ELSE DATE '1990-01-01' END AS date FROM orders")
def j03(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    old = o.withColumn("date", F.when(F.col("o_orderkey") % 4 == 0, F.lit(None)).otherwise(F.lit("1990-01-01")).cast("date"))
    return K.dated_where_stale(old, o.where("o_orderkey % 2 = 0"), "o_orderkey")


@query("D12_validated", """SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'missing_title' WHEN o_orderkey % 10 = 0 THEN 'missing_date'
  WHEN row_number() OVER (PARTITION BY CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE lower(o_orderpriority) END, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS DATE) END ORDER BY o_orderkey) > 1 THEN 'duplicate' END AS problem FROM orders""")
def d12(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = o.select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "").otherwise(F.col("o_orderpriority")).alias("title"), F.when(F.col("o_orderkey") % 10 != 0, F.to_date("o_orderdate")).alias("due"))
    return K.validated(rows, "title", "due", "o_orderkey").select("o_orderkey", "problem")


@query("K13_calendar_drafts", """SELECT o_orderkey AS id, o_orderpriority || ': ' || o_orderstatus AS summary, CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate AS DATE) + 1 AS "end" FROM orders WHERE o_orderstatus <> 'F'""")
def k13(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "due_today").otherwise("done")
    return K.calendar_drafts(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("course"), F.col("o_orderstatus").alias("title"), F.to_date("o_orderdate").alias("due"), status.alias("status")))


@query("J17_first_link", r"""SELECT page_id, arg_min(href, place) AS href FROM (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) AS place FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS h FROM pages))
  WHERE contains(lower(href), '/') AND contains(lower(href), 'th') GROUP BY 1""")
def j17(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    links = p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]*)"'), 1)).alias("place", "href"))
    return K.first_link(links, "page_id", "place", F.lower("href"), "/", "th")


@query("F21_url_reasons", r"""SELECT page_id, CASE WHEN NOT regexp_matches(url, '^https?://') THEN 'scheme' WHEN NOT regexp_matches(url, '^https?://[^/?#]+\.[a-z]+') THEN 'host' WHEN regexp_matches(url, '[?&]utm_') THEN 'query_parameter' END AS reason FROM pages""")
def f21(spark, sf_dir):
    u = F.col("url")
    keys = F.transform(F.split(U.query(u), "&"), lambda p: F.split_part(p, F.lit("="), F.lit(1)))
    tracked = F.exists(keys, lambda k: F.startswith(k, F.lit("utm_")))
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", F.when(~u.rlike("^https?://"), "scheme").when(~U.host(u).rlike(r"\.[a-z]+$"), "host").when(tracked, "query_parameter").alias("reason"))
