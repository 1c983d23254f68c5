"""Boxes on pages, inputs of unknown form, versions of records, a dashboard computed anew."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators.adhoc import profiles
from tessera.operators.layout import smallest_rows
from tessera.operators.records import shared_folder
from tessera.plans.registry import query
from tessera.plans.views import view, with_views
from tessera.sources import history as H
from tessera.sources import readers
from tessera.streaming.recompute import latest, recomputed

_B = with_views("boxes").replace("WITH ", "WITH RECURSIVE ", 1)
_A, _U = with_views("adhoc"), with_views("audit")
_BOX = "STRUCT(id BIGINT, x BIGINT, y BIGINT, w BIGINT, h BIGINT, identity BIGINT)"
_LIKE = "least(c.y + c.h, k.y + k.h) - greatest(c.y, k.y) >= greatest(10, least(c.h, k.h) // 2) AND least(c.w, k.w) >= greatest(120, CAST(floor(greatest(c.w, k.w) * 0.55) AS BIGINT)) AND abs(c.x - k.x) <= greatest(40, least(c.h, k.h))"


@query("D20_smallest_rows", f"""{_B}, numbered AS (SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY y, x, width * height, box) AS BIGINT) AS i, CAST(struct_pack(id := box, x := x, y := y, w := width, h := height, identity := identity) AS {_BOX}) AS c FROM boxes),
fold AS (SELECT DISTINCT page, CAST(0 AS BIGINT) AS i, CAST([] AS {_BOX}[]) AS kept, CAST([] AS BIGINT[]) AS seen FROM boxes
  UNION ALL SELECT f.page, n.i, CASE WHEN stays THEN list_append(list_filter(kept, lambda k: NOT ({_LIKE})), c) ELSE kept END, CASE WHEN stays THEN list_append(seen, c.identity) ELSE seen END
  FROM (SELECT fold.*, n.i AS next, NOT list_contains(seen, n.c.identity) AND len(list_filter(kept, lambda k: {_LIKE.replace('c.', 'n.c.')} AND n.c.w * n.c.h >= k.w * k.h)) = 0 AS stays FROM fold JOIN numbered n ON n.page = fold.page AND n.i = fold.i + 1) f JOIN numbered n ON n.page = f.page AND n.i = f.next)
SELECT page, unnest(list_transform(arg_max(kept, i), lambda k: k.id)) AS box FROM fold GROUP BY page""")
def d20(spark, sf_dir):
    return smallest_rows(view(spark, sf_dir, "boxes"), "page", "box", "identity").select("page", "box")


@query("S23_profiles", f"""{_A}, o AS (SELECT o_orderkey AS input, o_orderkey % 6 AS form, o_custkey AS k, o_orderstatus AS s FROM orders)
SELECT input, 'numbers' AS form, 3 AS n_rows, 'value' AS "column", 'number' AS kind, CAST(3 AS BIGINT) AS n, -2.5 :: DOUBLE AS lo, CAST(greatest(k, k % 7) AS DOUBLE) AS hi, round((k + k % 7 - 2.5 :: DOUBLE) / 3, 2) AS mean,
  round(list_stddev_samp([k, k % 7, -2.5 :: DOUBLE]), 2) AS std, round(k + k % 7 - 2.5 :: DOUBLE, 2) AS total, CAST(NULL AS BIGINT) AS n_distinct FROM o WHERE form = 0
UNION ALL SELECT input, 'objects', 4, 'a', 'number', 2, least(k, 7), greatest(k, 7), (k + 7) / 2, round(list_stddev_samp([k, 7 :: DOUBLE]), 2), k + 7, NULL FROM o WHERE form = 1
UNION ALL SELECT input, 'objects', 4, 'b', 'category', 0, NULL, NULL, NULL, NULL, NULL, 2 FROM o WHERE form = 1
UNION ALL SELECT input, 'csv', 2, 'k', 'number', 2, least(k, 5), greatest(k, 5), (k + 5) / 2, round(list_stddev_samp([k, 5 :: DOUBLE]), 2), k + 5, NULL FROM o WHERE form = 2
UNION ALL SELECT input, 'csv', 2, 'v', 'category', 0, NULL, NULL, NULL, NULL, NULL, 2 FROM o WHERE form = 2
UNION ALL SELECT input, 'text', 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM o WHERE form >= 3""")
def s23(spark, sf_dir):
    return profiles(view(spark, sf_dir, "adhoc"), "input", "data")


@query("K08_intervals", f"""{_U}, t AS (SELECT session_id, ts_ms, max(struct_pack(r := request_id, c := category, o := outcome)) AS v FROM audit GROUP BY 1, 2),
c AS (SELECT *, lag(struct_pack(c := v.c, o := v.o)) OVER w IS DISTINCT FROM struct_pack(c := v.c, o := v.o) AS new FROM t WINDOW w AS (PARTITION BY session_id ORDER BY ts_ms))
SELECT session_id, v.c AS category, v.o AS outcome, ts_ms AS valid_from, lead(ts_ms) OVER w AS valid_to, lead(ts_ms) OVER w IS NULL AS is_current, CAST(row_number() OVER w AS INT) AS version FROM c WHERE new WINDOW w AS (PARTITION BY session_id ORDER BY ts_ms)""")
def k08(spark, sf_dir):
    return H.intervals(view(spark, sf_dir, "audit"), ["session_id"], "ts_ms", "request_id", ["category", "outcome"])


@query("S12_as_of", f"""{_U}, m AS (SELECT (min(ts_ms) + max(ts_ms)) // 2 AS at FROM audit) SELECT session_id, max(struct_pack(t := ts_ms, r := request_id, c := category)).c AS category FROM audit, m WHERE ts_ms <= m.at GROUP BY 1""".replace(" AS at FROM", " AS middle FROM").replace("m.at", "m.middle"))
def s12(spark, sf_dir):
    a = view(spark, sf_dir, "audit")
    lo, hi = a.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    moment = F.lit(None).cast("long") if lo is None else F.lit((lo + hi) // 2)
    return H.as_of(H.intervals(a, ["session_id"], "ts_ms", "request_id", ["category"]), moment).select("session_id", "category")


@query("S12_saved_state", f"""{_U} SELECT session_id, max(struct_pack(t := ts_ms, r := request_id, c := category)).c AS category, count(*) AS n FROM audit GROUP BY 1""")
def s12_saved(spark, sf_dir):
    a = view(spark, sf_dir, "audit").select("session_id", F.struct("ts_ms", "request_id").alias("moment"), "category")
    path = f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    middle = F.pmod(F.xxhash64("moment.request_id"), F.lit(2)) == 0
    H.save(a.where(middle), path, 0, ["session_id"], "moment")
    H.save(a.where(~middle), path, 1, ["session_id"], "moment")
    counts = H.history(spark, path).groupBy("session_id").agg(F.count("*").alias("n"))
    return H.current(spark, path, ["session_id"], "moment").join(counts, "session_id").select("session_id", "category", "n")


@query("ST05_recomputed", """SELECT event_type, count(*) AS n, round(sum(CAST(value AS DECIMAL(38, 9))), 2) :: DOUBLE AS total, max(event_id) AS last_id FROM events GROUP BY 1""")
def st05(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "value")
    path = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    events.write.parquet(f"{path}/log")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 100).parquet(f"{path}/log")
    total = F.round(F.sum(F.col("value").cast("decimal(28,9)")), 2).cast("double")
    summary = lambda df: df.groupBy("event_type").agg(F.count("*").alias("n"), total.alias("total"), F.max("event_id").alias("last_id"))
    recomputed(stream, summary, f"{path}/board").awaitTermination()
    return latest(spark, f"{path}/board")


@query("S18_job_postings", "SELECT page_id, page_id AS posting FROM pages WHERE page_id % 5 < 3")
def s18(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    script = lambda body: F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))
    node = lambda kind: F.concat(F.lit('{"@type": ' + kind + ', "id": '), F.col("page_id").cast("string"), F.lit("}"))
    other, kind = F.lit('{"@type": "Organization"}'), F.col("page_id") % 5
    added = (
        F.when(kind == 0, script(node('"JobPosting"'))).when(kind == 1, script(F.concat(F.lit("[["), other, F.lit(', {"@graph": ['), node('["Thing", "jobposting"]'), F.lit("]}]]"))))
        .when(kind == 2, F.concat(script(F.lit('{"@type": ')), script(F.concat(F.lit('{"@graph": [['), node('"JOBPOSTING"'), F.lit('], {"@type": "JobPosting", "id": -1}]}'))))).when(kind == 3, script(other)).otherwise(F.lit(""))
    )
    found = readers.job_postings(p.select("page_id", F.concat(F.coalesce("html", F.lit("")), added).alias("html")))
    return found.select("page_id", F.get_json_object("posting", "$.id").cast("long").alias("posting"))


@query("ST11_runtime_policies", """SELECT o_orderkey AS file, CASE o_orderkey % 4 WHEN 0 THEN '3' ELSE 'legacy' END AS version, o_orderstatus AS category, CAST(p AS INT) AS place, CASE p WHEN 0 THEN 'api_price' ELSE 'free' END AS strategy,
CASE WHEN p = 1 THEN 1.0 WHEN o_orderkey % 4 = 0 THEN round(o_custkey % 10 / 10 * exp(-(o_custkey % 14) * 86400 / 604800.0 :: DOUBLE), 3) ELSE o_custkey % 10 / 10 END AS confidence FROM orders, range(2) r(p) WHERE o_orderkey % 4 < 2""")
def st11(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    own = F.concat(F.lit('{"'), F.col("o_orderstatus"), F.lit('": {"promoted": [{"strategy": "api_price", "confidence": 0.'), (F.col("o_custkey") % 10).cast("string"), F.lit('}, "free"]}, "empty": {}}'))
    at = F.lit(1_000_000_000) - F.col("o_custkey") % 14 * 86400
    text = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit('{"version": 3, "generated_ts": '), at.cast("string"), F.lit(', "categories": '), own, F.lit("}"))).when(F.col("o_orderkey") % 4 == 1, own).when(F.col("o_orderkey") % 4 == 2, F.lit("[1, 2]")).otherwise(F.lit("broken {"))
    return readers.runtime_policies(o.select(F.col("o_orderkey").alias("file"), text.alias("text")), "file", "text", F.lit(1_000_000_000))
