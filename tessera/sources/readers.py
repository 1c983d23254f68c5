"""Readers of the file forms that the stores use; each gives a DataFrame and reads nothing on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.records import written

#: Fixed value: the seconds in which a policy's confidence fades to 1 / e.
POLICY_TAU = 7 * 24 * 3600
AUDIT_SCHEMA = (
    "event_type string, request_id string, session_id string, trace_id string, node string, outcome string, ts_ms bigint, duration_ms double, category string, strategy string, "
    "scrape_reliability string, prior_score double, scrape_score double, raw_words int, source_type string, quality_target int, recovery_turns int, regret_estimate double, "
    "prediction_match boolean, model string, tokens_available boolean, total_tokens bigint, estimated_cost_usd double, tool_name string, allowed boolean"
)


def json_objects(spark: SparkSession, path: str, schema: str = AUDIT_SCHEMA) -> DataFrame:
    """Lines that are JSON objects; blank and malformed lines, arrays and scalars are dropped."""
    lines = spark.read.text(path).where(F.trim("value").startswith("{"))
    parsed = lines.select(F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    return parsed.where("_corrupt_record is null").drop("_corrupt_record")


def scrape_records(spark: SparkSession, path: str) -> DataFrame:
    """Audit rows that have a quality target and a strategy."""
    return json_objects(spark, path).where("quality_target is not null and strategy is not null")


def node_outcomes(spark: SparkSession, path: str) -> DataFrame:
    return json_objects(spark, path).dropna(subset=["request_id", "outcome", "duration_ms"])


def per_session(spark: SparkSession, root: str, name: str, schema: str = AUDIT_SCHEMA) -> DataFrame:
    """``<root>/<session>/<name>`` of every session, with the session's id from the path."""
    found = spark.read.schema(schema).json(f"{root}/*/{name}")
    return found.withColumn("session_id", F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+)/{name}$", 1))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Lines of role (or type) and content; lines without content are dropped."""
    rows = spark.read.schema("role string, type string, content string").json(path).where("content is not null")
    return rows.select(F.coalesce("type", "role", F.lit("ai")).alias("role"), "content")


def whole_texts(spark: SparkSession, glob: str) -> DataFrame:
    """Whole files with their session and time of change."""
    found = spark.read.text(glob, wholetext=True)
    return found.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("session_id"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified_at"))


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of an RSS feed: title, link, description, source."""
    return spark.read.format("xml").option("rowTag", "item").schema("title string, link string, description string, source string").load(path)


def unified_hits(hits: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Search hits of several providers under one schema, after the kept columns; hits with neither title nor URL are dropped."""
    known = lambda *names: F.coalesce(*(F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in hits.columns), F.lit(""))
    out = hits.select(*keep, known("title", "name").alias("title"), known("url", "link").alias("url"), known("content", "snippet").alias("content"))
    return out.where("title != '' or url != ''")


def json_nodes(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, path, node of all objects in a variant: lists are gone into, and the lists that objects have as @graph, at any depth.

    ``path`` holds the places on the way, so that its order is that of the text, an object before those of its graph. A round goes one level deeper.
    """
    left = rows.select(F.col(key).alias("key"), F.array(F.lit(0)).alias("path"), F.col(value).alias("v")).where("v is not null")
    found = None
    while True:
        lists = F.try_variant_get("v", "$", "array<variant>")
        left = written(left.withColumn("kind", F.schema_of_variant("v")), "nodes")
        objects = left.where(F.col("kind").startswith("OBJECT"))
        found = objects.select("key", "path", "v") if found is None else found.unionByName(objects.select("key", "path", "v"))
        graphs = objects.select("key", "path", F.try_variant_get("v", "$['@graph']", "array<variant>").alias("items"))
        inner = left.where(F.col("kind").startswith("ARRAY")).select("key", "path", lists.alias("items")).unionByName(graphs).where("items is not null")
        left = inner.select("key", "path", F.posexplode("items").alias("at", "v")).where("v is not null").select("key", F.concat("path", F.array("at")).alias("path"), "v")
        if left.isEmpty():
            return found.withColumnRenamed("v", "node")


def job_postings(pages: DataFrame, html: str = "html", kind: str = "JobPosting") -> DataFrame:
    """The first JSON-LD node of a type of each page, as JSON. The type may be one of a list, and case is of no matter; broken scripts are passed over.

    The other columns of ``pages`` tell its rows apart.
    """
    names = [c for c in pages.columns if c != html]
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*\btype=[\"']?application/ld\+json[^>]*>(.*?)</script>"), 1)
    raw = pages.select(F.struct(*names).alias("page"), F.posexplode(scripts).alias("place", "raw")).select(F.struct("page", "place").alias("key"), F.try_parse_json("raw").alias("v"))
    nodes = json_nodes(raw, "key", "v")
    types = F.to_json(F.try_variant_get("node", "$['@type']", "variant"))
    own = F.transform(F.regexp_extract_all(types, F.lit(r'"((?:[^"\\]|\\.)*)"'), 1), F.lower)
    posting = nodes.where(F.array_contains(own, kind.lower()) & ~F.contains(types, F.lit("{")))
    best = posting.groupBy(F.col("key.page").alias("page")).agg(F.min_by(F.to_json("node"), F.struct("key.place", "path")).alias("posting"))
    return best.select(*(F.col(f"page.{c}").alias(c) for c in names), "posting")


def runtime_policies(files: DataFrame, key: str, text: str, now: Column, tau: float = POLICY_TAU) -> DataFrame:
    """key, version, category, place, strategy, confidence of the promoted strategies in policy files of either format.

    A file with ``categories`` is versioned: its confidences, 1 where none is given, fade with its age by exp(-age / tau), to three places; without a
    time they don't. Any other object is a file of categories alone, version legacy, which doesn't fade. A strategy that is a bare string has
    confidence 1. Files that are no objects, and categories without a list, promote nothing. ``now`` and the file's time are in seconds.
    """
    v = F.try_parse_json(F.col(text))
    rows = files.select(F.col(key).alias("key"), now.cast("double").alias("now"), F.try_variant_get(v, "$", "map<string,variant>").alias("m")).where("m is not null")
    versioned = F.map_contains_key("m", "categories")
    stamp = F.coalesce(F.try_variant_get(F.try_element_at("m", F.lit("generated_ts")), "$", "double"), F.col("now"))
    rows = rows.select(
        "key", F.when(versioned, F.coalesce(F.try_variant_get(F.try_element_at("m", F.lit("version")), "$", "string"), F.lit("unknown"))).otherwise("legacy").alias("version"),
        F.when(versioned, F.exp((stamp - F.col("now")) / tau)).otherwise(1.0).alias("fade"), F.when(versioned, F.try_variant_get(F.try_element_at("m", F.lit("categories")), "$", "map<string,variant>")).otherwise(F.col("m")).alias("categories"),
    )
    each = rows.select("key", "version", "fade", F.explode("categories").alias("category", "own"))
    each = each.select("key", "version", "fade", "category", F.posexplode(F.try_variant_get("own", "$.promoted", "array<variant>")).alias("place", "p"))
    whole = F.schema_of_variant("p").startswith("OBJECT")
    confidence = F.coalesce(F.try_variant_get("p", "$.confidence", "double"), F.lit(1.0))
    strategy = F.when(whole, F.try_variant_get("p", "$.strategy", "string")).otherwise(F.try_variant_get("p", "$", "string"))
    return each.select(F.col("key").alias(key), "version", "category", "place", strategy.alias("strategy"), F.when(whole, F.round(confidence * F.col("fade"), 3)).otherwise(1.0).alias("confidence"))


def event_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A folder of Parquet files as a stream, a file at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
