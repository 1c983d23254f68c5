"""Name resolution over parts: each brand knows the names of its parts."""

from __future__ import annotations

from tessera.operators import naming as N
from tessera.plans.registry import query
from tessera.plans.views import view, with_views

_N = with_views("name_queries")


@query("X26_resolved_names", f"""{_N}, names AS (SELECT p_brand AS g, p_partkey AS pos, regexp_replace(trim(lower(p_name)), '\\s+', ' ', 'g') AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place FROM part),
asked AS (SELECT query_id, g, trim(query) AS raw, regexp_replace(trim(lower(query)), '\\s+', ' ', 'g') AS q FROM name_queries),
met AS (SELECT query_id, raw, count(*) FILTER (place = try_cast(raw AS BIGINT)) AS i, count(*) FILTER (name = q) AS e, count(*) FILTER (contains(name, q)) AS c,
  count(*) FILTER (len(list_filter(string_split(q, ' '), lambda t: NOT contains(name, t))) = 0) AS f, min(pos) FILTER (place = try_cast(raw AS BIGINT)) AS i_at, min(pos) FILTER (name = q) AS e_at,
  min(pos) FILTER (contains(name, q)) AS c_at, min(pos) FILTER (len(list_filter(string_split(q, ' '), lambda t: NOT contains(name, t))) = 0) AS f_at FROM asked LEFT JOIN names USING (g) GROUP BY 1, 2)
SELECT query_id, CASE WHEN raw = '' THEN 'empty_query' WHEN regexp_matches(raw, '^[0-9]+$') THEN CASE WHEN i = 1 THEN 'index' ELSE 'index_out_of_range' END WHEN e = 1 THEN 'exact' WHEN e > 1 THEN 'ambiguous_exact'
  WHEN c = 1 THEN 'contains' WHEN c > 1 THEN 'ambiguous_contains' WHEN f = 1 THEN 'fuzzy' WHEN f > 1 THEN 'ambiguous_fuzzy' ELSE 'not_found' END AS code,
CASE WHEN raw = '' THEN NULL WHEN regexp_matches(raw, '^[0-9]+$') THEN i_at WHEN e > 0 THEN CASE WHEN e = 1 THEN e_at END WHEN c > 0 THEN CASE WHEN c = 1 THEN c_at END WHEN f = 1 THEN f_at END AS position,
CASE WHEN raw = '' THEN 0 WHEN regexp_matches(raw, '^[0-9]+$') THEN i WHEN e > 0 THEN e WHEN c > 0 THEN c ELSE f END AS matches FROM met""")
def x26(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_brand as g", "p_partkey as position", "p_name as name")
    return N.resolved(view(spark, sf_dir, "name_queries"), names)
