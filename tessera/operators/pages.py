"""What pages show, from their node tables: anchors by selectors, navigation links with the areas they stand in, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import url as U
from tessera.operators.records import written

#: Terms of links that lead to no section, hints of areas that navigate, marks of labels that are no words.
BANNED = ("facebook", "instagram", "twitter", "x.com", "youtube", "tiktok", "whatsapp", "author", "authors", "archive", "archives", "tag", "tags", "category", "categories", "newsletter", "subscribe", "login", "signin", "register", "advertise", "podcast")
AREAS = ("nav", "menu", "header", "section", "category", "topic", "subnav", "drawer", "navbar", "gnb", "lnb", "tab", "breadcrumb", "global", "local")
DIRTY = ("<", ">", "</a", "<a", "href=", "http://", "https://", "&lt;", "&gt;", "javascript:", "mailto:", "tel:")


def absolute(href: Column, base: Column) -> Column:
    """``href`` seen from ``base``: whole URLs stay, //host and /path take what they lack, other paths replace the last part; no fragment."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    folder = F.regexp_replace(F.regexp_replace(F.substring(base, F.length(root) + 1, F.length(base)), r"[?#].*$", ""), "[^/]*$", "")
    clean = F.regexp_replace(href, "#.*$", "")
    whole = (
        F.when(clean.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), clean).when(clean.startswith("//"), F.concat(scheme, clean)).when(clean.startswith("/"), F.concat(root, clean))
        .when(clean == "", F.regexp_replace(base, "#.*$", "")).when(clean.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), clean))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), clean))
    )
    return F.when(root != "", whole).otherwise(clean)


def any_in(text: Column, terms: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def named_anchors(nodes: DataFrame, base: DataFrame, selectors: list[Column], keep: Column) -> DataFrame:
    """page, url, name: the distinct links of a page whose anchors meet one of ``selectors``, in the order of selectors, then of the page.

    ``base`` has page and base, the page's own URL; ``keep`` tests the column ``url``. A link is named by its text, or its title or aria-label;
    nameless ones and those without a target are no links, and don't keep a later one of their URL out.
    """
    met = F.coalesce(*(F.when(s, i) for i, s in enumerate(selectors)))
    href = F.trim(F.element_at("attributes", F.lit("href")))
    links = nodes.where((F.col("tag") == "a") & (href != "")).withColumn("selector", met).where("selector is not null").join(base, "page")
    links = links.withColumn("url", absolute(href, F.col("base"))).where(keep)
    name = F.coalesce(*(X.blank_to_null(c) for c in (F.col("text"), F.element_at("attributes", F.lit("title")), F.element_at("attributes", F.lit("aria-label")))))
    links = links.withColumn("name", name).where("name is not null")
    return first_of(links, ["page", "url"], ["selector", "node"]).select("page", "url", "name", "selector", "node")


def areas(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """page, node, area: tags, ids, classes and roles of the nearest ancestors of the rows ``of`` (page, node, above), innermost first."""
    up = of.select("page", "node", F.posexplode("above").alias("place", "anc"))
    attribute = lambda name: F.element_at("attributes", F.lit(name))
    words = F.concat_ws(" ", "tag", F.nullif(attribute("id"), F.lit("")), F.concat_ws(" ", "classes"), F.when(attribute("role") != "", F.concat(F.lit("role "), attribute("role"))))
    found = up.join(nodes.select("page", F.col("node").alias("anc"), words.alias("words")), ["page", "anc"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "words"))), lambda x: x["words"]), " ")
    return found.groupBy("page", "node").agg(joined.alias("area"))


def area_score(area: Column, label: Column) -> Column:
    """4 for an area that is navigation by tag or role, 3 for one whose names hint at it, 1 for a label of one to four words."""
    own = X.folded(area)
    padded = F.concat(F.lit(" "), own, F.lit(" "))
    navigates = F.contains(padded, F.lit(" role navigation ")) | F.contains(padded, F.lit(" nav "))
    size = F.size(F.filter(F.split(label, r"(?U)\s+"), lambda w: w != ""))
    return F.when(navigates, 4).otherwise(0) + F.when(any_in(own, AREAS), 3).otherwise(0) + F.when(size.between(1, 4), 1).otherwise(0)


def navigation(nodes: DataFrame, base: DataFrame) -> DataFrame:
    """page, url, title, area_score of the links of a page to sections of its own host.

    Left out are links to other hosts, to the front page, to articles and dated pages, with banned terms in title or path, and with
    labels that are empty, over 80 characters or no words. Of links of one title and path, the first stays.
    """
    href = F.trim(F.element_at("attributes", F.lit("href")))
    links = nodes.where((F.col("tag") == "a") & (href != "") & ~href.rlike("^(#|javascript:|mailto:|tel:)")).where((F.col("text") != "") & (F.length("text") <= 80) & ~any_in(F.lower("text"), DIRTY))
    links = links.join(base, "page").withColumn("whole", absolute(href, F.col("base")))
    path = U.plain_path(F.col("whole"))
    front = F.regexp_extract("whole", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    links = links.withColumn("path", path).withColumn("url", F.regexp_replace(F.concat(front, path), "/+$", ""))
    links = links.where((U.plain_host(F.col("whole")) == U.plain_host(F.col("base"))) & ~F.col("path").isin("", "/"))
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    article = (F.size(parts) >= 2) & (F.length(F.try_element_at(parts, F.lit(-1))) >= 5)
    links = links.where(~article & ~U.dated(F.col("url")))
    links = links.where(~any_in(F.concat(X.folded(F.col("text")), F.lit(" "), X.folded(F.col("path"))), BANNED))
    links = links.withColumn("__t", X.slug(F.col("text"))).withColumn("__p", X.slug(F.col("path")))
    links = written(first_of(links, ["page", "__t", "__p"], ["node"]).select("page", "node", "above", "url", "text"), "links")
    scored = links.join(areas(nodes, links), ["page", "node"], "left")
    return scored.select("page", "node", "url", F.col("text").alias("title"), area_score(F.coalesce("area", F.lit("")), F.col("text")).alias("area_score"))


def signals(nodes: DataFrame, identity: str, urn: str, card: str = "card", item: str = "item") -> DataFrame:
    """page, job_id, source, node, card: what on a page names an item.

    job_href: an anchor whose href holds the pattern ``identity``, its group 1 the id; urn: an element whose data-entity-urn does so
    for ``urn``; card, list_item: the nearest card or list item around one of these.
    """
    attribute = lambda name: F.coalesce(F.element_at("attributes", F.lit(name)), F.lit(""))
    href = F.when(F.col("tag") == "a", F.regexp_extract(attribute("href"), identity, 1))
    own = nodes.select("page", "node", F.element_at("marks", F.lit(card)).alias("card"), F.element_at("marks", F.lit(item)).alias("item"), F.array(F.struct(F.lit("job_href").alias("source"), href.alias("id")), F.struct(F.lit("urn").alias("source"), F.regexp_extract(attribute("data-entity-urn"), urn, 1).alias("id"))).alias("s"))
    named = own.select("page", "node", "card", "item", F.explode("s").alias("s")).where("s.id <> ''").select("page", "node", "card", "item", F.col("s.source").alias("source"), F.col("s.id").alias("job_id"))
    around = lambda at, source: named.where(F.col(at).isNotNull()).select("page", F.col(at).alias("node"), "card", F.lit(source).alias("source"), "job_id").distinct()
    return named.select("page", "node", "card", "source", "job_id").unionByName(around("card", "card")).unionByName(around("item", "list_item"))


def cards(nodes: DataFrame, pages: DataFrame, identity: str, urn: str, fields: dict[str, tuple[str, ...]], selectors: dict[str, Column], excluded: str = "excluded") -> tuple[DataFrame, DataFrame]:
    """The items that a page lists, and a row of counts for each page.

    A page's signals of one id are one item. Its link is its first anchor; items whose link stands in an ``excluded`` area are discarded.
    A field is the text of the first class, in the order given, for which an element of the item's card has text, of equal ones the first in
    the page; a title without any is the link's text or aria-label, and one that says its first half twice says it once.
    ``pages`` has one row for each page, so pages without items are counted too. ``selectors`` are tests of nodes to be counted.
    """
    found = written(signals(nodes, identity, urn), "signals")
    anchor = F.col("source") == "job_href"
    buckets = found.groupBy("page", "job_id").agg(
        F.min("node").alias("first"), F.min(F.when(anchor, F.col("node"))).alias("link"), F.min_by("card", F.when(F.col("card").isNotNull(), F.col("node"))).alias("card"),
        F.array_sort(F.collect_set("source")).alias("sources"), F.count("*").alias("n_signals"),
    )
    buckets = written(buckets, "buckets")
    links = nodes.select("page", F.col("node").alias("link"), F.coalesce(X.blank_to_null(F.col("text")), X.blank_to_null(F.element_at("attributes", F.lit("aria-label")))).alias("link_title"), F.element_at("marks", F.lit(excluded)).isNotNull().alias("bad"))
    items = buckets.join(links, ["page", "link"], "left").withColumn("bad", F.coalesce("bad", F.lit(False)))

    rank = lambda names: F.coalesce(*(F.when(F.array_contains("classes", c), i) for i, c in enumerate(names)), F.lit(None))
    inside = nodes.where((F.trim("text") != "")).select("page", F.element_at("marks", F.lit("card")).alias("card"), "node", "text", *(rank(names).alias(f"__{f}") for f, names in fields.items()))
    inside = inside.where(F.col("card").isNotNull() & F.coalesce(*(F.col(f"__{f}") for f in fields)).isNotNull())
    texts = inside.groupBy("page", "card").agg(*(F.min_by("text", F.when(F.col(f"__{f}").isNotNull(), F.struct(f"__{f}", "node"))).alias(f) for f in fields))
    items = items.join(texts, ["page", "card"], "left").withColumn("title", once(F.coalesce("title", "link_title")))
    lacking = F.coalesce(*(F.when(F.coalesce(F.col(f), F.lit("")) == "", True) for f in fields), F.lit(False))
    records = items.where("not bad").select("page", "job_id", *fields, F.concat_ws(",", "sources").alias("sources"), lacking.alias("incomplete"))

    selected = nodes.groupBy("page").agg(*(F.count_if(test).alias(name) for name, test in selectors.items()))
    raw = found.groupBy("page").agg(*(F.count_if(F.col("source") == s).alias(f"n_{s}") for s in ("card", "job_href", "urn", "list_item")), F.count("*").alias("n_signals"))
    whole = items.groupBy("page").agg(F.count("*").alias("n_items"), F.count_if("bad").alias("n_excluded"), F.count_if(~F.col("bad") & lacking).alias("n_incomplete"))
    counts = pages.select("page").distinct().join(selected, "page", "left").join(raw, "page", "left").join(whole, "page", "left").na.fill(0)
    counts = counts.withColumn("n_duplicates", F.col("n_signals") - F.col("n_items"))
    any_selected = sum((F.col(c) for c in selectors), F.lit(0)) > 0
    return records, counts.withColumn("missing_identity", (F.col("n_items") == 0) & any_selected)


def once(title: Column) -> Column:
    """A title without the mark of verification, once where it is written twice."""
    return X.halved(F.regexp_replace(X.collapsed(title), r"(?i) with verification$", ""))
