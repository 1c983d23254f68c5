"""Ranking of search candidates: structure, age, relevance and source policy. Word lists are parameters."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import time as T
from tessera.functions import url as U


def any_in(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words), F.lit(False))


def count_in(text: Column, words) -> Column:
    return reduce(lambda a, b: a + b, (F.when(F.contains(text, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))


@dataclass(frozen=True)
class Policy:
    """What a candidate's words, path and host are held against, and the points of each test."""

    terms: tuple[str, ...]
    noise: tuple[str, ...] = ()
    navigation: tuple[str, ...] = ("tag", "tags", "category", "author", "search", "archive")
    evergreen: tuple[str, ...] = ()
    positive: tuple[str, ...] = ()
    tangential: tuple[str, ...] = ()
    sections: tuple[str, ...] = ()
    broad: tuple[str, ...] = ()
    preferred: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()
    trusted: tuple[str, ...] = ()
    least_relevance: int = 4
    points: dict = field(default_factory=lambda: {"term": 3, "range": 2, "date": 4, "deep": 2, "shallow": -3, "navigation": -4, "noise": -2, "title": -6, "hub": -12})


def of_domain(url: Column, domains) -> Column:
    h = U.bare_host(url)
    return reduce(lambda a, b: a | b, ((h == d.lstrip(".")) | F.endswith(h, F.lit(f".{d.lstrip('.')}")) for d in domains), F.lit(False))


def source_priority(url: Column, policy: Policy) -> Column:
    """0 for a preferred domain, 1 for a preferred suffix, 2 for a trusted domain, else 3."""
    return F.when(of_domain(url, policy.preferred), 0).when(of_domain(url, policy.suffixes), 1).when(of_domain(url, policy.trusted), 2).otherwise(3)


def is_hub(url: Column, policy: Policy) -> Column:
    """No path, a navigation segment, or an index page."""
    own = F.transform(U.segments(url), F.lower)
    return (F.size(own) == 0) | F.arrays_overlap(own, F.array(*map(F.lit, policy.navigation))) | F.coalesce(F.element_at(own, -1).rlike(r"^index\.[a-z]+$"), F.lit(False)) if policy.navigation else F.size(own) == 0


def is_evergreen(blob: Column, url: Column, policy: Policy) -> Column:
    official = F.lower(url).rlike(r"[./]go[bv]\.") & F.lower(url).rlike("/prensa/|/comunicado|/press-release")
    return any_in(blob, policy.evergreen) | official


def _first_date(text: Column, pattern: str, as_date) -> Column:
    """The first match of ``pattern`` that ``as_date`` makes a date of; null if there is none."""
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), as_date)
    return F.get(F.filter(found, lambda d: d.isNotNull()), F.lit(0))


def url_date(url: Column) -> Column:
    """The date in a URL: with separators, else without, else a month's name and a year; null if there is none."""
    low = F.lower(url)
    digits = lambda m: F.try_to_date(F.regexp_replace(m, "[^0-9]", ""), "yyyyMMdd")
    names = "|".join((*T.MONTHS, *T.ENGLISH_MONTHS))
    month = lambda m: F.coalesce(*(F.nullif(F.array_position(F.array(*map(F.lit, table)), F.regexp_extract(m, names, 0)), F.lit(0)) for table in (T.MONTHS, T.ENGLISH_MONTHS)))
    named = lambda m: F.try_to_date(F.concat(F.regexp_extract(m, "[0-9]{4}", 0), F.lpad(month(m).cast("string"), 2, "0"), F.lit("01")), "yyyyMMdd")
    return F.coalesce(
        _first_date(low, r"[/\-](?!0000)[0-9]{4}[/\-][0-9]{2}[/\-][0-9]{2}", digits), _first_date(low, r"20[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])", digits), _first_date(low, rf"(?:{names})[- ](?!0000)[0-9]{{4}}|(?!0000)[0-9]{{4}}[- ](?:{names})", named)
    )


def recent(url: Column, ref_date: str, days: int) -> Column:
    """Whether the date in a URL isn't older than ``days``; without a date, true."""
    return F.coalesce(url_date(url) >= F.date_sub(F.lit(ref_date).cast("date"), days), F.lit(True))


def relevance(blob: Column, section: Column, policy: Policy) -> Column:
    base = 3 * count_in(blob, policy.positive) + 4 * count_in(section, policy.sections) - 5 * count_in(blob, policy.tangential) - 2 * count_in(section, policy.broad)
    return base - F.when(any_in(section, policy.broad) & (base < policy.least_relevance), 5).otherwise(0)


def scored(candidates: DataFrame, policy: Policy) -> DataFrame:
    """Candidates (title, snippet, url) with score, relevance, source priority and classes."""
    p = policy.points
    title, url = F.lower(F.coalesce("title", F.lit(""))), F.coalesce("url", F.lit(""))
    blob = F.lower(F.concat_ws(" ", "title", "snippet", "url"))
    segments, path = U.segments(url), F.lower(U.path(url))
    when = lambda test, n: F.when(test, n).otherwise(0)
    dated = path.rlike(r"(19|20)[0-9]{2}[/\-]?[0-9]{2}[/\-]?[0-9]{2}")
    long_terms = [t for t in policy.terms if len(t) >= 4]
    score = (
        p["term"] * count_in(blob, policy.terms) + when(blob.rlike(r"\b[0-9]+\s*-\s*[0-9]+\b"), p["range"]) + when(dated | path.rlike("[0-9]{6,8}"), p["date"]) + when(F.size(segments) >= 3, p["deep"])
        + when((F.size(segments) <= 2) & ~dated, p["shallow"]) + when(F.arrays_overlap(segments, F.array(*map(F.lit, policy.navigation))), p["navigation"]) + when(any_in(blob, policy.noise), p["noise"])
        + (when(~any_in(title, long_terms), p["title"]) if long_terms else 0) + when(is_hub(url, policy), p["hub"])
    )
    kind = F.when(is_hub(url, policy), "hub_hit").when(U.is_article(url), "article_hit").otherwise("topic_hit")
    return candidates.select(
        *candidates.columns, score.alias("score"), relevance(X.folded(blob), X.folded(F.concat_ws(" ", "title", "url")), policy).alias("relevance"), source_priority(url, policy).alias("priority"),
        is_evergreen(blob, url, policy).alias("evergreen"), kind.alias("kind"), F.size(F.split(F.trim(F.coalesce("snippet", F.lit(""))), r"\s+")).alias("words"),
    )


def ranked(candidates: DataFrame, policy: Policy, position: str) -> DataFrame:
    """By source priority, then score, then position."""
    return scored(candidates, policy).orderBy("priority", F.desc("score"), position)


def distinct_best(candidates: DataFrame, policy: Policy, position: str, limit: int) -> DataFrame:
    """The best candidate of each first six title words; the best ``limit`` of these."""
    key = F.array_join(F.slice(F.split(X.fingerprint(F.col("title"), 400), " "), 1, 6), " ")
    by = [F.when(F.col("relevance") < policy.least_relevance, 1).otherwise(0), F.col("priority"), F.desc("score"), F.col(position)]
    rows = scored(candidates, policy).withColumn("k", key)
    best = rows.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(*by))).where("r = 1")
    return best.orderBy(*by).limit(limit)


def topic(text: Column, topics: tuple[tuple[str, tuple[str, ...]], ...], default: str) -> Column:
    """The topic with most of its words in the text; of equals the first; without any, the default."""
    hits = [count_in(text, words) for _, words in topics]
    best = F.greatest(*hits)
    out = F.lit(default)
    for (name, _), n in reversed(list(zip(topics, hits, strict=True))):
        out = F.when((n == best) & (best > 0), name).otherwise(out)
    return out


def script_ratio_ok(text: Column) -> Column:
    """Few letters outside Latin: 12 at most, and no more than an eighth of the Latin ones or four."""
    latin = F.length(F.regexp_replace(text, "[^A-Za-zÀ-ÿ]", ""))
    other = F.length(F.regexp_replace(text, "[\\x00-\\x{24F}]", ""))
    return (other <= 12) & (other <= F.greatest(F.lit(4), F.floor(latin / 8)))


def price(text: Column) -> Column:
    """The first number of a text, with either decimal mark; null if there is none."""
    raw = F.regexp_replace(F.regexp_extract(text, r"([0-9][0-9.,]*[0-9]|[0-9])", 1), " ", "")
    dot, comma = F.length(F.substring_index(raw, ".", -1)), F.length(F.substring_index(raw, ",", -1))
    has = lambda c: F.contains(raw, F.lit(c))
    both = F.when(comma < dot, F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(raw, F.lit(","), F.lit("")))
    plain = F.when(has(".") & has(","), both).when(has(","), F.replace(raw, F.lit(","), F.lit("."))).otherwise(raw)
    return plain.try_cast("double")


def topical_lines(docs: DataFrame, key: str, text: str, words) -> DataFrame:
    """Each text with only its lines on the topic, if there are two of them and others too."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    hit = F.filter(lines, lambda x: any_in(F.lower(x), words))
    return docs.select(key, F.when((F.size(hit) >= 2) & (F.size(hit) < F.size(lines)), F.array_join(hit, "\n")).otherwise(F.array_join(lines, "\n")).alias("text"), F.size(hit).alias("hits"))


def chunked(lines: DataFrame, group: str, position: str, parts: int, most: int = 5) -> DataFrame:
    """Each group's rows dealt evenly, in order, to ``parts`` sections of at most ``most`` rows; the rest is left out."""
    own = Window.partitionBy(group)
    rows = lines.withColumn("i", F.row_number().over(own.orderBy(position)) - 1).withColumn("n", F.least(F.count("*").over(own), F.lit(parts * most)))
    base, more = F.greatest(F.floor(F.col("n") / parts), F.lit(1)), F.col("n") % parts
    head = more * (base + 1)
    part = F.when(F.col("i") < head, F.floor(F.col("i") / (base + 1))).otherwise(more + F.floor((F.col("i") - head) / base))
    return rows.where("i < n").withColumn("part", part.cast("long")).where(F.col("part") < parts).drop("i", "n")


def suffix_hints(groups: DataFrame, hints: DataFrame) -> DataFrame:
    """Suffixes of each group: its own or, without any, those of hints that share a term with it."""
    own = groups.where(F.size("suffixes") > 0).select("name", F.explode("suffixes").alias("suffix"))
    g = groups.where(F.size("suffixes") == 0).select("name", F.explode("terms").alias("term"))
    h = hints.select(F.explode("terms").alias("term"), "suffixes")
    return own.unionByName(g.join(h, "term").select("name", F.explode("suffixes").alias("suffix"))).distinct()


def paired_calls(calls: DataFrame, outputs: DataFrame, missing: str = "(missing tool output)") -> DataFrame:
    return calls.join(outputs, "call_id", "left").withColumn("output", F.coalesce("output", F.lit(missing)))


def dated_where_stale(records: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """A record's date, from the evidence unless it has one that is as fresh."""
    e = evidence.select(key, F.col("date").alias("seen"))
    return records.join(e, key, "left").withColumn("date", F.greatest("date", "seen")).drop("seen")


def first_link(links: DataFrame, key: str, position: str, haystack: Column, *needed: str) -> DataFrame:
    """For each key the first link whose text holds everything that is needed."""
    rows = reduce(lambda d, w: d.where(F.contains(haystack, F.lit(w))), needed, links)
    return rows.groupBy(key).agg(F.min_by("href", position).alias("href"))


def validated(rows: DataFrame, title: str, date: str, position: str) -> DataFrame:
    """Each row's problem: no title, no date, or a twin of an earlier row; null if there is none."""
    w = Window.partitionBy(F.lower(F.trim(title)), date).orderBy(position)
    twin = F.row_number().over(w) > 1
    return rows.withColumn("problem", F.when(F.coalesce(F.trim(title), F.lit("")) == "", "missing_title").when(F.col(date).isNull(), "missing_date").when(twin, "duplicate"))


def calendar_drafts(tasks: DataFrame) -> DataFrame:
    """One-day events of tasks that have a date and are pending or due."""
    rows = tasks.where(F.col("due").isNotNull() & F.col("status").isin("pending", "due_today"))
    return rows.select("id", F.concat_ws(": ", "course", "title").alias("summary"), F.col("due").alias("start"), F.date_add("due", 1).alias("end"))
