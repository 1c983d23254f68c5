"""Greedy rules: a row stays unless an earlier row that stays is like it.

``settled`` decides such an order from the pairs that are alike; ``events`` finds like rows by shared
words; ``merged_bullets`` folds the bullets of one text, where a longer bullet takes the place of the kept one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graphs import components
from tessera.operators.records import written
from tessera.operators.skew import folded_in_order, lookup

#: Words of titles that tell nothing; words of one kind of event, whose bullets need fewer shared words.
STOP = ("de", "la", "el", "en", "a", "los", "las", "del", "que", "un", "una", "por", "con", "se", "ha", "al", "es", "su", "y", "e", "o", "the", "of", "in", "to", "and", "for", "on", "at", "by", "with", "from")
DISASTER = ("terremoto", "sismo", "maremoto", "tsunami", "earthquake", "seismic")


def _dropped(pairs: Iterator[dict]) -> Iterator[int]:
    gone: set[int] = set()
    for pair in pairs:
        if pair["a"] not in gone:
            gone.add(pair["b"])
    return iter(gone)


def settled(pairs: DataFrame, most: int = 100_000) -> DataFrame:
    """p: the rows that go, of the like pairs (a, b), a before b in the order of these numbers.

    Connected pairs are settled in one step by one task, up to ``most`` of them. Those of larger components go
    in rounds: a row with no earlier like row left stays, those like it go.
    """
    pairs = written(pairs.where("a < b").select("a", "b").distinct(), "pairs")
    labels = written(components(pairs), "labels")
    held = lookup(pairs, labels.withColumnRenamed("node", "a"), "a", "b")
    sizes = held.groupBy("label").agg(F.count("*").alias("size"))
    held = written(lookup(held, sizes, "label", "b"), "held")
    gone = [written(folded_in_order(held.where(F.col("size") <= most), "label", ["a", "b"], _dropped, "p"), "gone")]
    left = written(held.where(F.col("size") > most).select("a", "b"), "left")
    while not left.isEmpty():
        first = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        like = written(lookup(left, first, "a", "b").select(F.col("b").alias("p")).distinct(), "like")
        gone.append(like)
        left = lookup(lookup(left, like.withColumnRenamed("p", "b"), "b", "a", "left_anti"), like.withColumnRenamed("p", "a"), "a", "b", "left_anti")
        left = written(lookup(left, first, "a", "b", "left_anti"), "left")
    out = gone[0]
    for x in gone[1:]:
        out = out.unionByName(x)
    return out


def keywords(text: Column, drop: Iterable[str] = ()) -> Column:
    """The distinct words of five letters or more that are no stop words and not in ``drop``, in lower case."""
    none = [*STOP, *(w.lower() for w in drop)]
    own = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: (F.length(w) > 4) & ~F.lower(w).isin(*none))
    return F.array_sort(F.array_distinct(F.transform(own, F.lower)))


def _alike(a: Column, b: Column, title: int, text: int) -> Column:
    shared = lambda c: F.size(F.array_intersect(a[c], b[c]))
    return (shared("t") >= title) | (shared("f") >= text)


def _pairs(rows: DataFrame, tokens: str, least: int) -> DataFrame:
    """g, a, b of the rows that may share ``least`` tokens: one of the n - least + 1 rarest of each is common."""
    held = rows.where(F.size(tokens) >= least).select("g", "p", F.size(tokens).alias("n"), F.explode(tokens).alias("token"))
    spread = held.groupBy("g", "token").agg(F.count("*").alias("d"))
    ranked = held.join(spread, ["g", "token"]).withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy("d", "token")))
    rare = written(ranked.where((F.col("i") <= F.col("n") - least + 1) & (F.col("d") > 1)).select("g", "token", "p"), "rare")
    return rare.withColumnRenamed("p", "a").join(rare.withColumnRenamed("p", "b"), ["g", "token"]).where("a < b").select("g", "a", "b").distinct()


def events(df: DataFrame, group: str, position: str, title: str, text: str, drop: Iterable[str] = (), least_title: int = 3, least_text: int = 5, batch: int = 64, share: float = 0.1) -> DataFrame:
    """The rows of each group that tell of another event than all earlier rows that stay.

    Two rows tell of one event if their titles share ``least_title`` keywords, or titles and texts together
    ``least_text``. Positions are distinct over the table. A null title or text is empty, and shares nothing; a null
    group is a group of its own. Order decides ties; repeated rows are like the first of them only if they have enough words.

    Of each group the first ``batch`` undecided rows are folded in one array, and all later rows compared with those that
    stay; most rows go so, as they share common words with an early one. Where a round takes less than ``share``
    of the undecided rows, the rest meets by its rarer words, and the like pairs are settled.
    """
    words = df.select(F.col(group).alias("g0"), F.col(position).cast("long").alias("p"), keywords(F.col(title), drop).alias("t"), keywords(F.concat_ws(" ", title, text), drop).alias("f"))
    left = written(words.select(F.coalesce(F.concat(F.lit("g"), F.col("g0").cast("string")), F.lit("")).alias("g"), "p", "t", "f"), "undecided")
    stay, undecided = [], left.count()
    while undecided:
        first = left.withColumn("i", F.row_number().over(Window.partitionBy("g").orderBy("p"))).where(F.col("i") <= batch)
        fold = lambda acc, x: F.when(F.exists(acc, lambda y: _alike(y, x, least_title, least_text)), acc).otherwise(F.concat(acc, F.array(x)))
        ordered = F.array_sort(F.collect_list(F.struct("p", "t", "f")))
        kept = first.groupBy("g").agg(ordered.alias("rows"), F.max("p").alias("last")).select("g", "last", F.aggregate("rows", F.slice("rows", 1, 0), fold).alias("kept"))
        kept = written(kept, "kept")
        stay.append(kept.select(F.explode("kept.p").alias("p")))
        later = lookup(left, kept, "g", "p").where(F.col("p") > F.col("last"))
        own = F.struct("t", "f")
        rest = written(later.where(~F.exists("kept", lambda y: _alike(y, own, least_title, least_text))).select("g", "p", "t", "f"), "undecided")
        before, undecided, left = undecided, rest.count(), rest
        if undecided > (1 - share) * before:
            break
    if undecided:
        met = written(_pairs(left, "t", least_title).unionByName(_pairs(left, "f", least_text)).distinct(), "met")
        side = lambda at, name: left.select(F.col("p").alias(at), F.struct("t", "f").alias(name))
        like = lookup(lookup(met, side("a", "x"), "a", "b"), side("b", "y"), "b", "a").where(_alike(F.col("x"), F.col("y"), least_title, least_text)).select("a", "b")
        stay.append(left.select("p").join(settled(like), "p", "left_anti"))
    if not stay:
        return df.limit(0)
    out = stay[0]
    for x in stay[1:]:
        out = out.unionByName(x)
    return df.join(out.withColumnRenamed("p", position), position, "left_semi").select(*df.columns)


def bullet_words(block: Column, drop: Iterable[str] = ()) -> Column:
    """As ``keywords``, without the plural s of words of six letters or more."""
    none = [*STOP, *(w.lower() for w in drop)]
    own = F.filter(F.transform(F.split(block, r"(?U)\s+"), F.lower), lambda w: (F.length(w) > 4) & ~w.isin(*none))
    plural = lambda w: F.endswith(w, F.lit("s")) & (F.length(w) > 5)
    return F.array_distinct(F.transform(own, lambda w: F.when(plural(w), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)))


def merged_bullets(text: Column, drop: Iterable[str] = (), least: int = 4, least_disaster: int = 2) -> Column:
    """A text whose like bullets are one, after what stands before the first bullet; blank lines between all.

    A bullet begins at a line with a bullet sign and runs to the next one. It is like the first kept one with which it shares
    ``least`` words, or ``least_disaster`` where both have a word of DISASTER; the longer of the two then stands
    in that place, and later bullets are compared with it. Null counts as empty. The fold holds one text's bullets.
    """
    lines = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n|[\r\x0b\f\x1c-\x1e\x85\u2028\u2029]", "\n")
    blocks = F.split(lines, r"(?U)\n(?=[^\S\n]*[•*-][^\S\n]+\S)")
    is_bullet = lambda b: F.trim(b, F.lit(" \t\n")).rlike(r"(?U)^[•*-]\s")
    rows = F.transform(F.filter(blocks, is_bullet), lambda b: F.struct(b.alias("block"), bullet_words(b, drop).alias("words")))
    disaster = lambda w: F.arrays_overlap(w, F.array(*map(F.lit, DISASTER)))
    needed = lambda a, x: F.when(disaster(a["words"]) & disaster(x["words"]), least_disaster).otherwise(least)

    def step(kept: Column, x: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda a: F.size(F.array_intersect(a["words"], x["words"])) >= needed(a, x)), True)
        placed = F.transform(kept, lambda a, i: F.when((i + 1 == at) & (F.length(x["block"]) > F.length(a["block"])), x).otherwise(a))
        return F.when(at > 0, placed).otherwise(F.concat(kept, F.array(x)))

    kept = F.transform(F.aggregate(rows, F.slice(rows, 1, 0), step), lambda k: k["block"])
    parts = F.transform(F.concat(F.filter(blocks, lambda b: ~is_bullet(b)), kept), lambda b: F.trim(b, F.lit(" \t\n")))
    return F.array_join(F.filter(parts, lambda b: b != ""), "\n\n")
