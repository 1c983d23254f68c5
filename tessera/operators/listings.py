"""Records in listings of text, their clean-up, and nested property documents: expressions without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import url as U

SPACE = r"[ \t\r\f]"
HIT = rf"{SPACE}*[0-9]+\. (?:\[(article|hub)\]{SPACE}*)?\[(.+?)\]\((https?://[^)\n]+)\)"
ITEM = rf"{SPACE}*[0-9]+\.{SPACE}+[^ \t\r\f\n]"

#: Starts of lines that belong to no hit, titles that say nothing, relative dates, marks of an overdue item.
HIT_NOISE = ("Sources:", "-", "Call web_fetch", "Next step")
GENERIC_TITLES = ("enlace", "link", "source", "fuente")
RELATIVE_DATES = (
    r"\bhace\s+(?:unos?\s+segundos?|un\s+momento|\d+\s+(?:minutos?|horas?|d[ií]as?))\b",
    r"\b(?:just now|moments ago|a few seconds ago|\d+\s+(?:minutes?|hours?|days?)\s+ago)\b",
    r"\b(?:hoy|today)\b",
    r"\b\d+\s*(?:시간|분|일)\s*전\b",
    r"\b\d+\s*(?:時間|分|日)前\b",
)
OVERDUE_MARK, OVERDUE = "⚠", "VENCIDA"
QUERY_LENGTH = 180


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}+|{SPACE}+$", "")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\r\f]+", " "))


def blocks(text: Column, header: str) -> Column:
    """The parts of a text that start at a line like ``header``, as arrays of lines; what stands before the first is left out."""
    parts = F.split(F.concat(F.lit("\n"), F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n")), rf"\n(?={header})")
    return F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda b: F.split(b, "\n"))


def search_hits(text: Column) -> Column:
    """Numbered links with the lines below them as snippet: array of (item, hit_type, title, url, snippet), the first of each url."""

    def hit(lines: Column, at: Column) -> Column:
        part = lambda n: F.trim(F.regexp_extract(lines[0], HIT, n))
        noise = lambda x: F.greatest(*(F.startswith(x, F.lit(s)) for s in HIT_NOISE))
        said = F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: (stripped(x) != "") & ~noise(x))
        return F.struct((at + 1).alias("item"), part(1).alias("hit_type"), part(2).alias("title"), part(3).alias("url"), F.array_join(F.transform(said, stripped), " ").alias("snippet"))

    hits = F.transform(blocks(text, HIT), hit)
    return F.filter(hits, lambda h: F.array_position(hits["url"], h["url"]) == h["item"])


def numbered_items(text: Column, fields: dict[str, str]) -> Column:
    """Numbered titles with labelled lines below: array of (item, title, overdue, *fields); the last line of a label counts."""

    def item(lines: Column, at: Column) -> Column:
        title = F.regexp_extract(lines[0], rf"^{SPACE}*[0-9]+\.{SPACE}+(.+?)(?:{SPACE}+{OVERDUE_MARK}{SPACE}+{OVERDUE})?{SPACE}*$", 1)

        def field(label: str) -> Column:
            own = F.filter(lines, lambda x: F.startswith(stripped(x), F.lit(label)))
            return F.coalesce(F.trim(F.substring(stripped(F.try_element_at(own, F.lit(-1))), F.lit(len(label) + 1), F.lit(1 << 30)), F.lit(" :")), F.lit(""))

        return F.struct((at + 1).alias("item"), title.alias("title"), F.contains(lines[0], F.lit(OVERDUE)).alias("overdue"), *(field(label).alias(name) for name, label in fields.items()))

    return F.transform(blocks(text, ITEM), item)


def press_sources(links: DataFrame, page: str, place: str, url: str, title: str, directory: str) -> DataFrame:
    """The first link of each url of a page but the directory's own; titles that say nothing give way to the host."""
    valid = links.where(~F.contains(url, F.lit(directory)) & (F.coalesce(U.bare_host(F.col(url)), F.lit("")) != ""))
    first = valid.groupBy(page, url).agg(F.min_by(F.trim(F.coalesce(title, F.lit(""))), place).alias(title))
    host = U.bare_host(F.col(url))
    return first.select(page, url, F.when((F.col(title) == "") | F.lower(title).isin(*GENERIC_TITLES), host).otherwise(F.col(title)).alias(title), host.alias("domain"))


def safe_query(raw: Column, site: str) -> Column:
    """A search text that may be shown: no links, no names of the site, no markup, 180 characters."""
    text = collapsed(raw)
    hidden = F.contains(text, F.lit("://")) | F.contains(F.lower(text), F.lit(site)) | (F.contains(text, F.lit("<")) & F.contains(text, F.lit(">")))
    return F.when(hidden, "redacted").otherwise(F.coalesce(F.nullif(F.substring(text, 1, QUERY_LENGTH), F.lit("")), F.lit("unknown")))


def relative_date(raw: Column) -> Column:
    """The first relative date of the first form that occurs, or the text with its white space collapsed."""
    text = collapsed(raw)
    return F.coalesce(*(F.nullif(F.trim(F.regexp_extract(text, f"(?iU){p}", 0)), F.lit("")) for p in RELATIVE_DATES), text)


def detail_rejection(description: Column, incomplete: Column, published: Column, recent: Column, with_description: bool = True) -> Column:
    """Why a record is left out, the first reason that holds; empty for none."""
    reason = F.when(F.lit(with_description) & (collapsed(description) == ""), "missing_description").when(F.lit(with_description) & incomplete, "incomplete_description")
    return reason.when(published.isNull(), "missing_date").when(~F.coalesce(recent, F.lit(False)), "outside_24_hours").otherwise("")


def ranked_files(files: DataFrame, path: str, text: str, keywords: tuple[str, ...], most: int = 5) -> DataFrame:
    """Files by where keywords occur: 4 points in the path, 5 in the name, 1 in the text of files that have any of these."""
    low, stem = F.lower(path), F.regexp_replace(F.element_at(F.split(F.lower(path), "/"), -1), r"\.[^.]*$", "")
    count = lambda where, points: sum((F.contains(where, F.lit(k)).cast("int") * points for k in keywords), F.lit(0))
    named = files.withColumn("score", count(low, 4) + count(stem, 5)).where("score > 0")
    scored = named.withColumn("score", F.col("score") + count(F.lower(F.coalesce(text, F.lit(""))), 1))
    return scored.orderBy(F.desc("score"), F.length(path), path).limit(most)


TEXT_DOC = "array<struct<plain_text: string>>"
PROPERTIES = {"title": f"struct<title: {TEXT_DOC}>", "rich_text": f"struct<rich_text: {TEXT_DOC}>", "date": "struct<date: struct<start: string>>", "select": "struct<select: struct<name: string>>", "url": "struct<url: string>"}


def property_document(kinds: dict[str, str]) -> Column:
    """JSON of the named columns as a nested property document; a kind is a key of ``PROPERTIES``."""
    form = {
        "title": lambda c: F.struct(F.array(F.struct(c.alias("plain_text"))).alias("title")), "rich_text": lambda c: F.struct(F.array(F.struct(c.alias("plain_text"))).alias("rich_text")),
        "date": lambda c: F.struct(F.struct(c.alias("start")).alias("date")), "select": lambda c: F.struct(F.struct(c.alias("name")).alias("select")), "url": lambda c: F.struct(c.alias("url")),
    }
    return F.to_json(F.struct(F.struct(*(form[k](F.col(c)).alias(c) for c, k in kinds.items())).alias("properties")))


def flattened_properties(document: Column, kinds: dict[str, str]) -> list[Column]:
    """The values of a property document by name; what is missing is empty."""
    schema = f"properties struct<{', '.join(f'`{c}`: {PROPERTIES[k]}' for c, k in kinds.items())}>"
    props = F.from_json(document, schema)["properties"]
    read = {"title": lambda p: F.array_join(p["title"]["plain_text"], ""), "rich_text": lambda p: F.array_join(p["rich_text"]["plain_text"], ""), "date": lambda p: p["date"]["start"], "select": lambda p: p["select"]["name"], "url": lambda p: p["url"]}
    return [F.coalesce(read[k](props[c]), F.lit("")).alias(c) for c, k in kinds.items()]
