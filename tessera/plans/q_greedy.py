"""Greedy rules over messages: one report of each event, one bullet of each matter."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import greedy as G
from tessera.plans.registry import query
from tessera.plans.views import view, with_views

_M = with_views("messages").replace("WITH ", "WITH RECURSIVE ", 1)
_LINES = "regexp_replace(coalesce(content, ''), '\\r\\n|[\\r\\x0b\\f\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]', chr(10), 'g')"


def _words(text: str) -> str:
    """Words of five letters or more, in lower case, without stop words."""
    return f"list_distinct(list_transform(list_filter(string_split_regex({text}, '\\s+'), lambda w: length(w) > 4 AND lower(w) NOT IN {G.STOP}), lambda w: lower(w)))"


def _stem(words: str) -> str:
    return f"list_distinct(list_transform({words}, lambda w: CASE WHEN w LIKE '%s' AND length(w) > 5 THEN left(w, length(w) - 1) ELSE w END))"


@query("D06_events", f"""{_M}, reports AS (SELECT session_id AS g, id AS p, row_number() OVER (PARTITION BY session_id ORDER BY id) AS i,
  {_words("split_part(coalesce(content, ''), chr(10), 1)")} AS t, {_words("coalesce(content, '')")} AS f FROM messages),
fold AS (SELECT g, 0 AS i, CAST([] AS STRUCT(p BIGINT, t VARCHAR[], f VARCHAR[])[]) AS kept FROM reports GROUP BY g
  UNION ALL SELECT fold.g, r.i, CASE WHEN len(list_filter(kept, lambda k: len(list_intersect(k.t, r.t)) >= 3 OR len(list_intersect(k.f, r.f)) >= 5)) > 0 THEN kept ELSE list_append(kept, struct_pack(p := r.p, t := r.t, f := r.f)) END
  FROM fold JOIN reports r ON r.g = fold.g AND r.i = fold.i + 1)
SELECT session_id, id FROM (SELECT g AS session_id, unnest(list_transform(arg_max(kept, i), lambda k: k.p)) AS id FROM fold GROUP BY g)""")
def d06(spark, sf_dir):
    m = view(spark, sf_dir, "messages").withColumn("title", F.split_part(F.coalesce("content", F.lit("")), F.lit("\n"), F.lit(1)))
    rest = m.withColumn("snippet", F.substring(F.col("content"), F.length("title") + 1, F.length("content")))
    return G.events(rest, "session_id", "id", "title", "snippet").select("session_id", "id")


@query("D07_bullets", f"""{_M}, parts AS (SELECT id, string_split('- ' || replace({_LINES}, chr(10), chr(10) || '- '), chr(10)) AS lines FROM messages),
numbered AS (SELECT id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM parts),
blocked AS (SELECT *, count(*) FILTER (n > 1 AND regexp_matches(line, '^\\s*[•*-]\\s+\\S')) OVER (PARTITION BY id ORDER BY n) AS b FROM numbered),
blocks AS (SELECT id, b + 1 AS i, string_agg(line, chr(10) ORDER BY n) AS block FROM blocked GROUP BY id, b),
bullets AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) AS i, block, {_stem(_words('block'))} AS w FROM blocks WHERE regexp_matches(trim(block, chr(10) || ' ' || chr(9)), '^[•*-]\\s')),
rest AS (SELECT id, list(block ORDER BY i) AS own FROM blocks WHERE NOT regexp_matches(trim(block, chr(10) || ' ' || chr(9)), '^[•*-]\\s') GROUP BY id),
fold AS (SELECT id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(block VARCHAR, w VARCHAR[])[]) AS kept FROM messages
  UNION ALL SELECT f.id, b.i, CASE WHEN hit > 0 THEN list_transform(kept, lambda k, j: CASE WHEN j = hit AND length(b.block) > length(k.block) THEN struct_pack(block := b.block, w := b.w) ELSE k END)
    ELSE list_append(kept, struct_pack(block := b.block, w := b.w)) END
  FROM (SELECT fold.*, coalesce(list_position(list_transform(fold.kept, lambda k: len(list_intersect(k.w, n.w)) >= CASE WHEN len(list_intersect(k.w, {list(G.DISASTER)})) > 0 AND len(list_intersect(n.w, {list(G.DISASTER)})) > 0 THEN 2 ELSE 4 END), true), 0) AS hit
    FROM fold JOIN bullets n ON n.id = fold.id AND n.i = fold.i + 1) f JOIN bullets b ON b.id = f.id AND b.i = f.i + 1),
last AS (SELECT id, arg_max(kept, i) AS kept FROM fold GROUP BY id)
SELECT last.id, md5(array_to_string(list_filter(list_transform(list_concat(coalesce(own, []), list_transform(kept, lambda k: k.block)), lambda x: trim(x, chr(10) || ' ' || chr(9))), lambda x: x <> ''), chr(10) || chr(10))) AS merged
FROM last LEFT JOIN rest ON rest.id = last.id""")
def d07(spark, sf_dir):
    m = view(spark, sf_dir, "messages")
    bullets = F.concat(F.lit("- "), F.replace(F.coalesce("content", F.lit("")), F.lit("\n"), F.lit("\n- ")))
    return m.select("id", F.md5(G.merged_bullets(bullets)).alias("merged"))
