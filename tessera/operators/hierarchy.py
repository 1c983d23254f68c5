"""Trees of nodes with parent pointers: depths, sums over subtrees, pruning, merging of like siblings, rewriting.

All nodes of a table are worked on at once. What goes along a path is found by doubling: a pointer that
leads 2**k levels up is followed by itself, so a path takes as many rounds as the logarithm of its length.
A node is a root if its parent is null. Nodes on a cycle, below one, or below a parent that is no
node, reach no root: they are left out. Node ids are distinct and not null. An empty table gives an empty result.
Joins are merges, as all their tables grow with the nodes and their guessed sizes fall short of the whole rows: none is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import url as U
from tessera.operators.graphs import linked_by_keys
from tessera.operators.records import written
from tessera.operators.skew import lookup

#: What a node's kind is worth, and which kinds the rules on parent and child name.
PRIORITY = {"assignment": 100, "quiz": 95, "google_slides": 92, "google_drive": 92, "document": 90, "forum": 85, "page": 80, "section": 75, "video": 70, "image": 20, "link": 10, "external_redirect": 5}
ASSETS = ("document", "video", "image", "google_slides", "google_drive")
LIFTED = ("google_slides", "google_drive")
REPEATING = ("link", "quiz", "document", "google_slides", "google_drive", "page", "section")
FIELDS = ("description", "subtitle", "preview_url", "download_url", "redirect_url", "mime_type", "canonical_url", "url")


def upward(nodes: DataFrame, node: str, parent: str, own: Column) -> DataFrame:
    """node, up, path of all rooted nodes: how many levels lie above, and whether ``own`` holds for it or any node above."""
    start = nodes.select(F.col(node).alias("node"), F.col(parent).alias("p"), F.coalesce(own, F.lit(False)).alias("path"))
    missing = start.select("p").where("p is not null").distinct().join(start.select(F.col("node").alias("p")).hint("merge"), "p", "left_anti")
    start = lookup(start, missing.withColumn("lost", F.lit(True)), "p", "node", "left").withColumn("lost", F.coalesce("lost", F.lit(False)))
    now = start.select("node", F.when(~F.col("lost"), F.col("p")).alias("p"), F.when(F.col("p").isNull() | F.col("lost"), 0).otherwise(1).cast("long").alias("up"), "path", "lost")
    now = written(now, "up")
    size, steps = now.count(), 0
    while 2**steps <= size:  # pointers that are left then belong to cycles
        ahead = now.select(F.col("node").alias("p"), F.col("p").alias("pp"), F.col("up").alias("more"), F.col("path").alias("further"), F.col("lost").alias("gone"))
        going = lookup(now.where("p is not null"), ahead, "p", "node")
        going = going.select("node", F.col("pp").alias("p"), (F.col("up") + F.col("more")).alias("up"), (F.col("path") | F.col("further")).alias("path"), (F.col("lost") | F.col("gone")).alias("lost"))
        now = written(now.where("p is null").unionByName(going), "up")
        steps += 1
        if now.where("p is not null").isEmpty():
            break
    return now.where("p is null and not lost").select("node", "up", "path")


def depths(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """node, depth of all rooted nodes; a root's is 0."""
    return upward(nodes, node, parent, F.lit(False)).select(F.col("node").alias(node), F.col("up").alias("depth"))


def pruned(nodes: DataFrame, node: str, parent: str, dead: Column) -> DataFrame:
    """The rooted nodes for which ``dead`` holds neither itself nor above."""
    alive = upward(nodes, node, parent, dead).where("not path").select(F.col("node").alias(node))
    return nodes.join(alive.hint("merge"), node, "left_semi")


def subtree_sums(nodes: DataFrame, node: str, parent: str, values: dict[str, Column]) -> DataFrame:
    """For each rooted node the sums of ``values`` over itself and all nodes below, leaf to root.

    After k rounds a node holds the sums of the 2**k levels from itself on, and sends them to the node 2**k
    levels up; sums of one receiver are combined before they move.
    """
    rooted = depths(nodes, node, parent)
    names = list(values)
    top = rooted.agg(F.max("depth")).first()[0]
    own = nodes.join(rooted.select(node).hint("merge"), node, "left_semi")
    now = written(own.select(F.col(node).alias("node"), F.col(parent).alias("p"), *(F.coalesce(v, F.lit(0)).alias(c) for c, v in values.items())), "sums")
    for k in range(int(top or 0).bit_length()):
        sent = now.where("p is not null").groupBy(F.col("p").alias("node")).agg(*(F.sum(c).alias(f"{c}__in") for c in names))
        summed = now.join(sent.hint("merge"), "node", "left").select("node", "p", *((F.col(c) + F.coalesce(f"{c}__in", F.lit(0))).alias(c) for c in names))
        ahead = now.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        now = written(lookup(summed, ahead, "p", "node", "left").select("node", F.col("pp").alias("p"), *names), "sums")
    return now.select(F.col("node").alias(node), *names)


def target(canonical: str = "canonical_url", url: str = "url") -> Column:
    """What a node shows: the key of its canonical URL or, without one, of its URL; empty without both."""
    return F.coalesce(U.node_key(F.coalesce(filled(canonical), filled(url))), F.lit(""))


def filled(name: str) -> Column:
    """The column trimmed, or null where nothing is left."""
    return F.nullif(F.trim(F.col(name)), F.lit(""))


def identity_keys() -> Column:
    """The keys by which siblings are one: kind with target, or with title where there is none, and any of four URLs.

    Redirects are one only if kind, URL and destination are.
    """
    redirect = F.col("kind") == "external_redirect"
    ends = F.concat_ws("|", F.lit("signature"), "kind", F.coalesce(U.node_key(filled("url")), F.lit("")), F.coalesce(U.node_key(filled("redirect_url")), F.lit("")))
    named = F.concat_ws("|", F.lit("title"), "kind", F.lower(F.coalesce("title", F.lit(""))))
    own = F.when(redirect, ends).when(target() == "", named).otherwise(F.concat_ws("|", F.lit("signature"), "kind", target()))
    urls = F.transform(F.array_compact(F.array(*(filled(c) for c in ("canonical_url", "url", "redirect_url", "download_url")))), lambda u: F.concat(F.lit("url|"), U.node_key(u)))
    return F.array_distinct(F.concat(F.array(own), F.when(~F.coalesce(redirect, F.lit(False)), urls).otherwise(F.array().cast("array<string>"))))


def node_score(children: str = "n_children") -> Column:
    """How much a node shows: its kind, children, badges and filled fields."""
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in PRIORITY.items() for x in pair)), F.coalesce("kind", F.lit(""))), F.lit(0))
    points = {"description": 8, "download_url": 8, "preview_url": 6, "mime_type": 4}
    fields = sum((F.when(filled(c).isNotNull(), n).otherwise(0) for c, n in points.items()), F.lit(0))
    return (kind + 4 * F.coalesce(children, F.lit(0)) + 2 * F.size(F.coalesce("badges", F.array().cast("array<string>"))) + fields + F.least(F.coalesce("n_meta", F.lit(0)), F.lit(8))).cast("long")


def with_children(nodes: DataFrame) -> DataFrame:
    """``nodes`` with n_children, the number of nodes that name one as parent."""
    count = nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n_children"))
    return nodes.drop("n_children").join(count.hint("merge"), "node_id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))


def sibling_groups(nodes: DataFrame) -> DataFrame:
    """node_id, first_id: the least node of its group of siblings that share an identity key, directly or through others."""
    parent = F.coalesce(F.col("parent_id").cast("string"), F.lit("root"))
    keyed = nodes.select("node_id", F.transform(identity_keys(), lambda k: F.concat(parent, F.lit("|"), k)).alias("keys"))
    return linked_by_keys(keyed, "node_id", "keys").select(F.col("node").alias("node_id"), F.col("label").alias("first_id"))


def merge_siblings(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One node of each group, and (node_id, keep_id) of all: the best scored node stays, of equals the least id.

    Each field that it lacks is that of the best scored node with one. A page or section whose group has a
    titled link takes the best scored link's title. Badges are united in that order of nodes; n_meta is the group's most.
    """
    scored = with_children(nodes)
    ranked = scored.withColumn("rank", F.struct(node_score().alias("score"), (-F.col("node_id")).alias("at")))
    groups = written(ranked.join(sibling_groups(nodes).hint("merge"), "node_id"), "groups")
    best = lambda value, test=None: F.max_by(value, F.when(test, F.col("rank")) if test is not None else F.col("rank"))
    titled = F.col("kind").isin("link", "course_section") & filled("title").isNotNull()
    badges = F.collect_set(F.struct("rank", "badges"))
    merged = groups.groupBy("first_id").agg(
        best(F.col("node_id")).alias("node_id"), F.first("parent_id").alias("parent_id"), best(F.col("kind")).alias("kind"), best(F.col("title")).alias("__title"),
        best(F.col("title"), titled).alias("__link"), *(best(F.col(c), filled(c).isNotNull()).alias(c) for c in FIELDS),
        F.max("n_meta").alias("n_meta"), F.count("*").alias("members"),
    )
    # badges are few words: of each the best rank that has it, not all nodes' lists
    words = groups.select("first_id", "rank", F.posexplode("badges").alias("place", "badge")).groupBy("first_id", "badge").agg(F.max(F.struct("rank", (-F.col("place")).alias("place"))).alias("r"))
    united = words.groupBy("first_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "badge")), asc=False), lambda x: x["badge"]).alias("badges"))
    merged = merged.join(united.hint("merge"), "first_id", "left")
    title = F.when(F.col("kind").isin("page", "section") & F.col("__link").isNotNull(), F.col("__link")).otherwise(F.col("__title"))
    merged = merged.withColumn("title", title).withColumn("badges", F.coalesce("badges", F.array().cast("array<string>")))
    kept = lookup(groups.select("node_id", "first_id"), merged.select("first_id", F.col("node_id").alias("keep_id")), "first_id", "node_id").select("node_id", "keep_id")
    return merged.select(*[c for c in nodes.columns if c != "n_children"], "members"), kept


def _places(hit: DataFrame, of: Column) -> DataFrame:
    """i: 1 for the least node of a group, 2 for the next one, 3 for all others; groups may be large."""
    hit = hit.withColumn("of", of)
    first = hit.groupBy("of").agg(F.min("node_id").alias("first"))
    hit = lookup(hit, first, "of", "node_id")
    second = hit.where("node_id > first").groupBy("of").agg(F.min("node_id").alias("second"))
    hit = lookup(hit, second, "of", "node_id", "left")
    return hit.withColumn("i", F.when(F.col("node_id") == F.col("first"), 1).when(F.col("node_id") == F.col("second"), 2).otherwise(3)).drop("of", "first", "second")


def child_rules(nodes: DataFrame) -> DataFrame:
    """node_id, parent_id, rule of the children that their parent makes redundant; of several rules the first holds.

    promoted: the first child of an asset's own kind and target; collapsed: the second one, of kinds whose
    log-in page stands between; repeated: any other child of the parent's target that is of its kind or of
    a kind in REPEATING; preview: an image that is the parent's preview or target; redirect: a redirect from
    the parent's URL to its destination that stands there already.
    """
    p = nodes.select(
        F.col("node_id").alias("parent_id"), F.col("kind").alias("p_kind"), target().alias("p_target"), F.coalesce(U.node_key(filled("preview_url")), F.lit("")).alias("p_preview"),
        F.coalesce(U.node_key(filled("url")), F.lit("")).alias("p_from"), F.coalesce(U.node_key(filled("redirect_url")), F.lit("")).alias("p_to"),
    )
    c = nodes.select("node_id", "parent_id", "kind", target().alias("target"), F.coalesce(U.node_key(filled("url")), F.lit("")).alias("from"), F.coalesce(U.node_key(filled("redirect_url")), F.lit("")).alias("to"))
    both = lookup(c.where("parent_id is not null"), p, "parent_id", "node_id")
    same = (F.col("target") == F.col("p_target")) & (F.col("target") != "")
    again = (F.col("kind") == "external_redirect") & (F.col("p_target") != "") & (F.col("p_to") != "") & (F.col("from") == F.col("p_from")) & (F.col("to") == F.col("p_to"))
    image = (F.col("kind") == "image") & (F.col("target") != "") & F.col("target").isin(F.col("p_preview"), F.col("p_target"))
    hit = both.where(same | again | image).withColumn("twin", same & (F.col("kind") == F.col("p_kind"))).withColumn("again", again)
    hit = _places(hit, F.concat_ws("|", "parent_id", "twin", "again"))
    twin = F.col("twin") & F.col("p_kind").isin(*ASSETS)
    rule = (
        F.when(twin & (F.col("i") == 1), "promoted").when(twin & (F.col("i") == 2) & F.col("p_kind").isin(*LIFTED), "collapsed")
        .when(same & (F.col("twin") | F.col("kind").isin(*REPEATING)), "repeated").when(image, "preview").when(F.col("again") & (F.col("i") > 1), "redirect")
    )
    return hit.select("node_id", "parent_id", rule.alias("rule")).where("rule is not null")


def apply_rules(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Parents take what they lack from promoted and collapsed children; a collapsed child's children move up to its parent; redundant children go with all below."""
    rules = written(rules, "rules")
    if rules.isEmpty():
        return nodes
    giving = nodes.join(rules.where("rule in ('promoted', 'collapsed')").select("node_id", "rule").hint("merge"), "node_id")
    rank = F.when(F.col("rule") == "promoted", 0).otherwise(1)
    given = giving.groupBy(F.col("parent_id").alias("node_id")).agg(*(F.min_by(filled(c), F.when(filled(c).isNotNull(), rank)).alias(f"__{c}") for c in FIELDS), F.min_by("badges", rank).alias("__b0"), F.max_by("badges", rank).alias("__b1"), F.max("n_meta").alias("__meta"))
    none = F.array().cast("array<string>")
    lists = F.array_distinct(F.concat(*(F.coalesce(c, none) for c in ("badges", "__b0", "__b1"))))
    taken = nodes.join(given.hint("merge"), "node_id", "left").select(
        *(F.coalesce(filled(c), F.col(f"__{c}")).alias(c) if c in FIELDS else lists.alias(c) if c == "badges" else F.greatest(c, "__meta").alias(c) if c == "n_meta" else F.col(c) for c in nodes.columns)
    )
    lifted = rules.where("rule = 'collapsed'").select(F.col("node_id").alias("parent_id"), F.col("parent_id").alias("__up"))
    moved = lookup(taken, lifted, "parent_id", "node_id", "left").withColumn("parent_id", F.coalesce("__up", "parent_id")).drop("__up").select(*nodes.columns)
    left = moved.join(rules.select("node_id").hint("merge"), "node_id", "left_anti")
    return pruned(written(left, "left"), "node_id", "parent_id", F.lit(False))  # what hung on a dropped child reaches no root now


def presentable(nodes: DataFrame, noise: Callable[[], Column], most: int = 100) -> DataFrame:
    """The tree to show: noise goes with all below, redundant children go, like siblings are one; until nothing changes.

    ``nodes`` has node_id, parent_id, kind, title, FIELDS, badges, n_meta. Each pass takes all levels at once; a pass that
    joins two nodes brings their children together for the next one. A pass after the last change ends it; ``most`` passes
    without an end raise, so no half-done tree is returned.
    """
    now = written(pruned(nodes, "node_id", "parent_id", noise()), "tree")
    size = now.count()
    for _ in range(most):
        ruled = written(apply_rules(now, child_rules(now)), "tree")
        merged, kept = merge_siblings(ruled)
        merged = written(merged.drop("members"), "tree")
        moved = lookup(merged, written(kept, "kept").select(F.col("node_id").alias("parent_id"), F.col("keep_id").alias("__to")), "parent_id", "node_id", "left")
        now = written(moved.withColumn("parent_id", F.coalesce("__to", "parent_id")).select(*nodes.columns), "tree")
        before, size = size, now.count()
        if size == before:
            return pruned(now, "node_id", "parent_id", noise())
    raise RuntimeError(f"the tree still changes after {most} passes")
