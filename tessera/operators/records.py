"""Record pipelines: keyed and near-duplicate collapse, interleaving, ranking and crawl trees.

Order-dependent rules carry an explicit position column; where a rule keeps the first of several
rows, the position decides.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import url as U


def first_wins(df: DataFrame, key: Column, position: str) -> DataFrame:
    """The row of least position for each key; a null or empty key is no key, and its rows stay."""
    rows = df.withColumn("__key", key)
    none = F.col("__key").isNull() | (F.col("__key") == "")
    w = Window.partitionBy("__key").orderBy(position)
    kept = rows.where(~none).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return kept.unionByName(rows.where(none)).drop("__key")


def best_wins(df: DataFrame, key: Column, quality: list[Column], position: str) -> DataFrame:
    """For each key the row of best quality, at the position of the key's first row."""
    rank = F.struct(*quality, (-F.col(position)).alias("__p"))
    rest = F.struct(*[c for c in df.columns if c != position])
    best = df.groupBy(key.alias("__key")).agg(F.max_by(rest, rank).alias("r"), F.min(position).alias(position), F.count("*").alias("members"))
    return best.select(position, "members", *(F.col(f"r.{c}").alias(c) for c in df.columns if c != position))


def semantic_key(title: str, company: str, body: str, least: int = 160) -> Column:
    """Title, company and body as one fingerprint; null where one is missing or the body is short."""
    t, c, b = X.fingerprint(F.col(title), 160), X.fingerprint(F.col(company), 160), X.fingerprint(F.col(body))
    return F.when((F.length(b) >= least) & (t != "") & (c != ""), F.concat_ws("|", t, c, b))


def merged(df: DataFrame, key: str, position: str, filled: list[str], gathered: str) -> DataFrame:
    """One row for each key: the first known value of each column, and the sorted union of one."""
    known = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(position))).alias(c)
    return df.groupBy(key).agg(*(known(c) for c in filled), F.array_join(F.sort_array(F.collect_set(gathered)), ",").alias(gathered))


def placed(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``name``: each row's place, from 1, in the order of the columns ``order``, which tell all rows apart.

    Rows are dealt by ranges of that order and numbered in each; the offsets are sums of one number a task.
    """
    dealt = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    dealt = written(dealt, "placed")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__in", inside).join(offsets, "__part").withColumn(name, F.col("__before") + F.col("__in")).drop("__part", "__in", "__before")


def interleaved(df: DataFrame, group: str, position: str) -> DataFrame:
    """``turn``: the row's place when groups take turns, each in its own order, groups by name; (position, group) tells rows apart."""
    from tessera.operators.skew import lookup  # it needs nothing of this module

    own = placed(df.withColumn("__g", F.struct(F.col(group).alias("of"))), ["__g", position], "__at")
    first = own.groupBy("__g").agg(F.min("__at").alias("__first"))
    numbered = lookup(own, first, "__g", position).withColumn("__n", F.col("__at") - F.col("__first"))
    return placed(numbered.drop("__at", "__first", "__g"), ["__n", group], "turn").drop("__n")


def source_order(df: DataFrame, source: str, position: str) -> DataFrame:
    """Each row with its source's first position, by which sources keep together in order of appearance."""
    return df.withColumn("source_first", F.min(position).over(Window.partitionBy(source)))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens as a share of the smaller set."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset on one machine, a temporary folder, which no cluster could share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: later plans start from these files."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def greedy(df: DataFrame, group: str, position: str, tokens: str, share: float, least: int) -> DataFrame:
    """Rows of each group that share less than ``share`` of their tokens with every earlier kept row.

    Positions are distinct whole numbers, and so are a row's tokens. Of rows of one token set only the first can stay.
    Pairs that may be alike come from ``overlaps.candidates``, are compared in full, the smaller set sent to
    the larger one, and the order of each set of connected pairs is settled at once.
    """
    from tessera.operators.greedy import settled  # they write tables with this module
    from tessera.operators.overlaps import candidates

    rows = written(df.select(F.struct(F.col(group).alias("of")).alias("g"), F.col(position).alias("p"), F.array_sort(tokens).alias("t")), "rows")
    big = rows.where(F.size("t") >= least)
    sets = big.groupBy("g", "t").agg(F.min("p").alias("p")).select(F.xxhash64("g").alias("g"), F.col("p").cast("long").alias("p"), "t")
    sets = written(sets, "sets")
    gone = big.join(sets.select("p"), "p", "left_anti").select("p")

    pairs = written(candidates(sets.select("g", "p", F.transform("t", lambda x: F.xxhash64(x)).alias("h")), share), "pairs")
    with_small = pairs.join(sets.select("p", F.col("g").alias("of"), F.col("t").alias("x")), "p")
    both = with_small.join(sets.select(F.col("p").alias("q"), "g", F.col("t").alias("y")), "q").where("of = g")
    edges = written(both.where(overlap(F.col("x"), F.col("y")) >= share).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")), "edges")
    gone = gone.unionByName(settled(edges))
    return rows.select("g", "p").join(gone, "p", "left_anti").select(F.col("g.of").alias(group), F.col("p").alias(position))


def anchors(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Distinct link targets of each page with the place of their first occurrence."""
    found = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r'<a [^>]*href="([^"]*)"'), 1)).alias("place", "href"))
    return found.groupBy(key, "href").agg(F.min("place").cast("long").alias("place"))


def page_confidence(pages: DataFrame, weights: dict[str, float]) -> Column:
    """The sum of the weights of the fields that a page has, 1 at most."""
    total = sum((F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.lit(w)).otherwise(F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    return F.round(F.least(total.cast("decimal(18,9)"), F.lit(1).cast("decimal(18,9)")), 2).cast("double")


def tree(nodes: DataFrame, id_col: str, parent_col: str, depth: int) -> DataFrame:
    """Depth and path of every node below the roots, level by level, to ``depth`` levels at most.

    Each level is one join of the frontier with the edges; nodes of cycles, which no root reaches, are
    left out.
    """
    frontier = nodes.where(F.col(parent_col).isNull()).select(id_col, F.lit(0).alias("depth"), F.col(id_col).cast("string").alias("path"))
    out = frontier
    for _ in range(depth):
        frontier = nodes.join(frontier.select(F.col(id_col).alias("__parent"), "depth", "path"), F.col(parent_col) == F.col("__parent")).select(id_col, (F.col("depth") + 1).alias("depth"), F.concat_ws("/", "path", F.col(id_col).cast("string")).alias("path"))
        out = out.unionByName(frontier)
    return out


def attach_earlier(nodes: DataFrame, key: Column, parent_key: Column, order: str, id_col: str) -> DataFrame:
    """For each node the latest earlier node of its parent's key, or null: it hangs on the root. ``order`` holds whole numbers."""
    none = F.lit(None).cast(nodes.schema[id_col].dataType)
    child = nodes.select(F.col(id_col).alias("child"), none.alias("parent"), F.col(order).alias("at"), parent_key.alias("k"))
    parent = nodes.select(none.alias("child"), F.col(id_col).alias("parent"), F.col(order).alias("at"), key.alias("k"))
    earlier = Window.partitionBy("k").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    found = child.unionByName(parent).withColumn("parent", F.last("parent", ignorenulls=True).over(earlier))
    return found.where("child is not null").select("child", F.when(F.col("k").isNotNull(), F.col("parent")).alias("parent"))


def covering_prefix(df: DataFrame, group: str, rank: str, needed: dict[str, float]) -> DataFrame:
    """For each group the least number of best-ranked rows whose running sums reach every need."""
    w = Window.partitionBy(group).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    test = F.lit(True)
    for c, most in needed.items():
        test = test & (F.sum(c).over(w) >= most)
    return df.select(group, F.row_number().over(Window.partitionBy(group).orderBy(rank)).alias("k"), test.alias("enough")).where("enough").groupBy(group).agg(F.min("k").cast("long").alias("k"))


def missing_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row for each field that a row lacks."""
    names = F.array(*(F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in fields))
    return df.select(key, F.explode(F.array_compact(names)).alias("field"))


def routed(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without and rows with a reason to reject them."""
    rows = df.withColumn("reject_reason", reason)
    return rows.where("reject_reason is null").drop("reject_reason"), rows.where("reject_reason is not null")


def story_signature(content: str, lines: int = 3) -> Column:
    """The first non-blank lines, collapsed and lower-cased."""
    own = F.filter(F.transform(F.split(content, "\n"), lambda x: X.collapsed(x)), lambda x: x != "")
    return F.lower(F.array_join(F.slice(own, 1, lines), " "))


def page_keys(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", U.bare_host(F.col("url")).alias("host"), U.path(F.col("url")).alias("path"), U.without_parameters(F.col("url")).alias("canonical"), U.node_key(F.col("url")).alias("node_key"), U.is_article(F.col("url")).alias("article"), U.dated(F.col("url")).alias("dated"))
