"""Tree queries over the pages of a site: depths, sums, pruning, like siblings, the tree to show."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import hierarchy as H
from tessera.plans.registry import query
from tessera.plans.views import view, with_views

_N = with_views("site_nodes").replace("WITH ", "WITH RECURSIVE ", 1)
_KEY = "regexp_replace(regexp_replace({0}, '^[a-z]+://', ''), '^www\\.', '')"


def _target(t: str = "") -> str:
    return f"coalesce({_KEY.format(f'coalesce({t}canonical_url, {t}url)')}, '')"


_BELOW = """, below AS (SELECT node_id AS top, node_id, 0 AS d FROM site_nodes UNION ALL SELECT top, n.node_id, d + 1 FROM below b JOIN site_nodes n ON n.parent_id = b.node_id)
"""
_SIGNATURE = f"""CASE WHEN kind = 'external_redirect' THEN concat('signature|', kind, '|', coalesce({_KEY.format('url')}, ''), '|', coalesce({_KEY.format('redirect_url')}, ''))
  WHEN {_target()} = '' THEN concat('title|', kind, '|', lower(title)) ELSE concat('signature|', kind, '|', {_target()}) END"""
_GROUPS = f""", keys AS (SELECT node_id, parent_id, unnest(list_append(CASE WHEN kind = 'external_redirect' THEN CAST([] AS VARCHAR[]) ELSE
    list_transform(list_filter([canonical_url, url, redirect_url, nullif(download_url, '')], lambda u: u IS NOT NULL), lambda u: concat('url|', {_KEY.format('u')})) END, {_SIGNATURE})) AS k FROM site_nodes),
met AS (SELECT DISTINCT a.node_id AS a, b.node_id AS b FROM keys a JOIN keys b ON a.k = b.k AND a.parent_id IS NOT DISTINCT FROM b.parent_id),
reach AS (SELECT node_id AS a, node_id AS b FROM site_nodes UNION SELECT reach.a, met.b FROM reach JOIN met ON met.a = reach.b),
groups AS (SELECT a AS node_id, min(b) AS first_id FROM reach GROUP BY 1)
"""
_SCORE = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in H.PRIORITY.items()) + """ ELSE 0 END + 4 * (SELECT count(*) FROM site_nodes c WHERE c.parent_id = n.node_id)
  + 2 * len(list_filter(string_split(badge_list, ','), lambda b: b <> '')) + CASE WHEN description <> '' THEN 8 ELSE 0 END + CASE WHEN download_url <> '' THEN 8 ELSE 0 END
  + CASE WHEN preview_url <> '' THEN 6 ELSE 0 END + CASE WHEN mime_type <> '' THEN 4 ELSE 0 END + least(n_meta, 8)"""


def nodes(spark, sf_dir):
    n = view(spark, sf_dir, "site_nodes")
    return n.withColumn("badges", F.filter(F.split("badge_list", ","), lambda b: b != "")).drop("badge_list")


def noise():
    return F.lower("title") == "perfil"


@query("H02_subtree_sums", f"""{_N}{_BELOW} SELECT top AS node_id, (SELECT count(*) FROM below u WHERE u.node_id = b.top) - 1 AS depth, count(*) AS n_nodes,
count(*) FILTER (kind IN ('document', 'google_drive', 'image')) AS n_assets, CAST(sum(n_meta) AS BIGINT) AS meta FROM below b JOIN site_nodes n ON n.node_id = b.node_id GROUP BY top""")
def h02_sums(spark, sf_dir):
    n = nodes(spark, sf_dir)
    values = {"n_nodes": F.lit(1).cast("long"), "n_assets": F.col("kind").isin("document", "google_drive", "image").cast("long"), "meta": F.col("n_meta").cast("long")}
    return H.subtree_sums(n, "node_id", "parent_id", values).join(H.depths(n, "node_id", "parent_id").hint("merge"), "node_id").select("node_id", "depth", *values)


@query("H02_pruned", f"""{_N}, alive AS (SELECT node_id FROM site_nodes WHERE parent_id IS NULL AND lower(title) <> 'perfil' UNION ALL
SELECT n.node_id FROM alive a JOIN site_nodes n ON n.parent_id = a.node_id WHERE lower(title) <> 'perfil') SELECT node_id FROM alive""")
def h02_pruned(spark, sf_dir):
    return H.pruned(nodes(spark, sf_dir), "node_id", "parent_id", noise()).select("node_id")


@query("D10_sibling_groups", f"{_N}{_GROUPS} SELECT node_id, first_id, count(*) OVER (PARTITION BY first_id) AS members FROM groups")
def d10_groups(spark, sf_dir):
    g = H.sibling_groups(nodes(spark, sf_dir))
    sizes = g.groupBy("first_id").agg(F.count("*").alias("members"))
    return H.lookup(g, sizes, "first_id", "node_id").select("node_id", "first_id", "members")


@query("D10_merged_siblings", f"""{_N}{_GROUPS}, ranked AS (SELECT n.*, first_id, (({_SCORE}) * 1000000 - n.node_id) AS r FROM site_nodes n JOIN groups g ON g.node_id = n.node_id)
SELECT arg_max(node_id, r) AS node_id, min(parent_id) AS parent_id, arg_max(kind, r) AS kind,
CASE WHEN arg_max(kind, r) IN ('page', 'section') THEN coalesce(arg_max(trim(title), r) FILTER (kind = 'link'), arg_max(trim(title), r)) ELSE arg_max(trim(title), r) END AS title,
arg_max(canonical_url, r) FILTER (canonical_url <> '') AS canonical_url, arg_max(url, r) FILTER (url <> '') AS url, arg_max(redirect_url, r) FILTER (redirect_url <> '') AS redirect_url,
arg_max(download_url, r) FILTER (download_url <> '') AS download_url, arg_max(description, r) FILTER (description <> '') AS description, arg_max(mime_type, r) FILTER (mime_type <> '') AS mime_type,
max(n_meta) AS n_meta, coalesce(max(len(list_filter(string_split(badge_list, ','), lambda b: b <> ''))), 0) AS n_badges, count(*) AS members FROM ranked GROUP BY first_id""")
def d10_merged(spark, sf_dir):
    merged, _ = H.merge_siblings(nodes(spark, sf_dir))
    return merged.select("node_id", "parent_id", "kind", F.trim("title").alias("title"), "canonical_url", "url", "redirect_url", "download_url", "description", "mime_type", "n_meta", F.size("badges").cast("long").alias("n_badges"), "members")


@query("H03_child_rules", f"""{_N}, hit AS (SELECT c.node_id, c.parent_id, c.kind, p.kind AS p_kind, p.preview_url AS pre, {_target('c.')} AS t, {_target('p.')} AS pt,
  {_target('c.')} = {_target('p.')} AND {_target('c.')} <> '' AS same, c.kind = 'external_redirect' AND {_target('p.')} <> '' AND p.redirect_url <> ''
  AND coalesce({_KEY.format('c.url')}, '') = coalesce({_KEY.format('p.url')}, '') AND coalesce({_KEY.format('c.redirect_url')}, '') = {_KEY.format('p.redirect_url')} AS again
  FROM site_nodes c JOIN site_nodes p ON p.node_id = c.parent_id),
numbered AS (SELECT *, same AND kind = p_kind AS twin, kind = 'image' AND t <> '' AND (t = pt OR t = coalesce({_KEY.format('pre')}, '')) AS image,
  row_number() OVER (PARTITION BY parent_id, same AND kind = p_kind, coalesce(again, false) ORDER BY node_id) AS i FROM hit WHERE same OR coalesce(again, false) OR (kind = 'image' AND t <> '' AND (t = pt OR t = coalesce({_KEY.format('pre')}, '')))),
ruled AS (SELECT node_id, parent_id, CASE WHEN twin AND p_kind IN {H.ASSETS} AND i = 1 THEN 'promoted' WHEN twin AND p_kind IN {H.LIFTED} AND i = 2 THEN 'collapsed'
  WHEN same AND (twin OR kind IN {H.REPEATING}) THEN 'repeated' WHEN image THEN 'preview' WHEN again AND i > 1 THEN 'redirect' END AS rule FROM numbered)
SELECT * FROM ruled WHERE rule IS NOT NULL""")
def h03(spark, sf_dir):
    return H.child_rules(nodes(spark, sf_dir))


@query("H02_H03_presentable")
def h02_h03(spark, sf_dir):
    return H.presentable(nodes(spark, sf_dir), noise).select("node_id", "parent_id", "kind", "title", *H.FIELDS, F.concat_ws(",", "badges").alias("badges"), "n_meta")
