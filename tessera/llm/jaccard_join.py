"""N-gram Jaccard join of a corpus with itself, with a token-group matrix.

A document is its set of distinct word shingles, as 64-bit hashes (``tokens``); two documents link when
their sets' Jaccard similarity is ``num / den`` or more.

1. Documents of one set are one class, so exact copies never meet as pairs.
2. Tokens are ordered from rare to frequent, by a count-min sketch of fixed size that counts how often
   a token repeats within a batch of documents. Linked classes share one of the first (1 - num/den)
   of their tokens in any fixed order, their keys, and in this one the passages that a third of all
   documents hold come last. How exact the sketch is moves cost, never results. The first token that
   two sets share also bounds what they share by what follows it in each.
3. Classes are partitioned into groups of similar ones: each class is compared with its keys' hubs, a
   hub being the class that has the key earliest, and the links found so form the groups. A key of
   any number of classes has one hub.
4. The token-group matrix holds a row for each group: its token union, folded into hashed bins, a bin
   holding the most tokens that any member has there; a quarter as many bins as tokens. The sum over
   bins of the smaller count is the most that a member of one group can share with one of another.
   Groups that share a key meet in the matrix, group with group, and most of them end there.
5. Only groups that qualify are opened, the smaller one first: its members meet those of the other one
   by a key from whose places in both sets enough may follow, so a group's size makes no pairs of its
   own. Then their own bins decide, and what is left is compared in full.
6. The links' connected components are the result; links found in step 5 join whole groups.

A group of one class has that class's bins as its row, so 4 and 5 are one way for all sizes. No group
is held by one task: its row is combined within partitions first, and the rest are joins and aggregates
over (key, class), (key, group) and pairs.

Null and empty texts and those without words have no tokens and link with nothing. Repeated rows are
members of one class. A null id belongs to the class of its text but names no component, and a class
of null ids only links with no other class. Equal ids with different texts are compared by the text
of each. An empty table gives an empty result. Only the id and the text column are read. Sets are
whole, of however long a text. Two sets are taken for one if their 64-bit hashes agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.blocks import from_planes, planes
from tessera.llm.components import components
from tessera.llm.store import dropped, limited, text_digest, written
from tessera.llm.text import mix, segments, utf8, window_hashes, word_hashes

SKETCH_BITS = 20
SKETCH_ROWS = 2
SKETCH_RANGES = 64
SENT_IDS = 500_000
ROWS_HELD = 32 << 20
_ROW_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
BATCH_BYTES = 2 << 20


def _sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct tokens of each text."""
    data, offsets = utf8(column)
    for a, b in segments(offsets, BATCH_BYTES):
        own = offsets[a : b + 1]
        hashes, first = word_hashes(data[own[0] : own[-1]], own - own[0], lower=True)
        windows = window_hashes(hashes, words)
        for i in range(b - a):
            n = int(first[i + 1] - first[i])
            if n >= words:
                yield np.unique(windows[first[i] : first[i + 1] - words + 1])
            elif n:
                yield window_hashes(hashes[first[i] : first[i + 1]], n)
            else:
                yield np.zeros(0, np.uint64)


def _cells(tokens: np.ndarray) -> list[np.ndarray]:
    return [(mix(tokens ^ seed) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64) + (row << SKETCH_BITS) for row, seed in enumerate(_ROW_SEEDS)]


def _count(words: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(SKETCH_ROWS << SKETCH_BITS, np.uint32)
        for batch in batches:
            tokens = np.sort(np.concatenate([np.zeros(0, np.uint64), *_sets(batch.column("text"), words)]))
            for at in _cells(tokens[1:][tokens[1:] == tokens[:-1]]):
                cells += np.bincount(at, minlength=len(cells)).astype(np.uint32)
        if cells.any():
            parts = np.split(cells, SKETCH_RANGES)
            yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_RANGES), pa.int32()), pa.array([planes(x) for x in parts], pa.binary())], ["range", "cells"])

    return count


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each range's cells summed over all tasks, as frequency levels."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, raw in zip(batch.column("range").to_pylist(), batch.column("cells"), strict=True):
            more = from_planes(raw.as_py(), np.uint32)
            before = total.setdefault(at, np.zeros(len(more), np.uint32))
            before += np.minimum(more, np.iinfo(np.uint32).max - before)
    for at, cells in total.items():
        raw = np.floor(4 * np.log2(1 + cells.astype(np.float32))).astype(np.uint8).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([raw], pa.binary())], ["range", "cells"])


def token_levels(texts: DataFrame, words: int) -> np.ndarray:
    """Frequency levels, one byte for each cell of a sketch of all texts; 2 MB, whatever the corpus.

    Ranges of cells are summed by separate tasks.
    """
    kind = "range int, cells binary"
    summed = texts.mapInArrow(_count(words), kind).repartition(SKETCH_RANGES, "range").mapInArrow(_levels, kind)
    out = np.zeros((SKETCH_RANGES, (SKETCH_ROWS << SKETCH_BITS) // SKETCH_RANGES), np.uint8)
    for r in summed.collect():  # SKETCH_RANGES at most
        out[r["range"]] = np.frombuffer(r["cells"], np.uint8)
    return out.reshape(-1)


def bin_counts(tokens: np.ndarray) -> bytes:
    """How many tokens fall into each bin; the number of bins is a power of two, about a quarter of the tokens'."""
    width = 1 << max(3, int(len(tokens) // 4).bit_length())
    return np.minimum(np.bincount((mix(tokens) & np.uint64(width - 1)).astype(np.int64), minlength=width), 255).astype(np.uint8).tobytes()


def shared_at_most(x: bytes, y: bytes) -> int:
    """The most tokens that two sets can share, by their bins' counts (full bins: no bound)."""
    a, b = sorted((np.frombuffer(v, np.uint8).astype(np.int64) for v in (x, y)), key=len)
    if max(a.max(), b.max()) == 255:
        return int(np.iinfo(np.int64).max // 1000)
    return int(np.minimum(a, b.reshape(-1, len(a)).sum(axis=0)).sum())


def _bounded(num: int, den: int):
    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            sizes = (batch.column("nx").to_numpy() + batch.column("ny").to_numpy()).tolist()
            keep = pa.array([(num + den) * shared_at_most(x, y) >= num * n for x, y, n in zip(xs, ys, sizes, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return bounded


def _possible(pairs: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that sizes and bins leave possible; ``rows``: c, n (the least size), most and bins of classes or groups."""
    side = lambda at, n, most, bins: rows.select(F.col("c").alias(at), F.col("n").alias(n), F.col("most").alias(most), F.col("bins").alias(bins))
    sized = pairs.join(side("a", "nx", "mx", "x"), "a").join(side("b", "ny", "my", "y"), "b").where((F.col("mx") * den >= F.col("ny") * num) & (F.col("my") * den >= F.col("nx") * num))
    return sized.select("a", "b", "nx", "ny", "x", "y").mapInArrow(_bounded(num, den), "a long, b long")


def folded(x: bytes, y: bytes) -> bytes:
    """A row of the matrix over two others: for each bin the larger count, with the fewer bins of the two."""
    a, b = sorted((np.frombuffer(v, np.uint8) for v in (x, y)), key=len)
    wide = np.minimum(b.reshape(-1, len(a)).sum(axis=0, dtype=np.int64), 255).astype(np.uint8)
    return np.maximum(a, wide).tobytes()


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (c, n, most, bins) of one group combined, as far as a partition holds them."""
    held: dict[int, tuple[int, int, bytes]] = {}
    size = 0

    for batch in batches:
        for c, n, most, bins in zip(*(batch.column(k).to_pylist() for k in ("c", "n", "most", "bins")), strict=True):
            if c in held:
                least, largest, before = held[c]
                held[c] = (min(n, least), max(most, largest), folded(before, bins))
            else:
                held[c] = (n, most, bins)
                size += len(bins) + 200
        if size > ROWS_HELD:
            yield _rows([(c, *v) for c, v in held.items()])
            held, size = {}, 0
    yield _rows([(c, *v) for c, v in held.items()])


def _matrix(rows: DataFrame, by: str) -> DataFrame:
    """Rows (by, n, most, bins) as rows of the token-group matrix: c, n and most (sizes of the smallest and largest member), bins."""
    row = "c long, n int, most int, bins binary"
    return rows.select(F.col(by).alias("c"), "n", "most", "bins").mapInArrow(_fold, row).repartition("c").sortWithinPartitions("c").mapInArrow(_fold_sorted, row)


def _fold_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rest of ``_fold``: the rows of a group follow each other, so one group is held at a time."""
    now = None
    for batch in batches:
        done = []
        for row in zip(*(batch.column(k).to_pylist() for k in ("c", "n", "most", "bins")), strict=True):
            if now and now[0] == row[0]:
                now = (now[0], min(now[1], row[1]), max(now[2], row[2]), folded(now[3], row[3]))
            else:
                done += [now] if now else []
                now = row
        if done:
            yield _rows(done)
    if now:
        yield _rows([now])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["c", "n", "most", "bins"])


def _prefixes(words: int, num: int, den: int, levels):
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = levels.value
        for batch in batches:
            sizes, names, keys, bins = [], [], [], []
            for tokens in _sets(batch.column("text"), words):
                n = len(tokens)
                sizes.append(n)
                names.append(np.uint64(0) if not n else mix(np.array([mix(tokens).sum() ^ np.uint64(n)]))[0])
                most = n - (num * n + den - 1) // den + 1 if n else 0
                bins.append(bin_counts(tokens))
                level = np.minimum(*(table[at] for at in _cells(tokens))) if n else tokens
                keys.append(tokens[np.lexsort((tokens, level))[:most]].astype(np.int64))
            ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), pa.array(sizes, pa.int32()), pa.array(np.array(names, np.uint64).astype(np.int64), pa.int64()), lists, pa.array(bins, pa.binary())], ["id", "digest", "n", "c", "keys", "bins"])

    return prefixes


def _whole(words: int):
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_sets(batch.column("text"), words))
            names = [np.uint64(0) if not len(t) else mix(np.array([mix(t).sum() ^ np.uint64(len(t))]))[0] for t in sets]
            ends = np.concatenate(([0], np.cumsum([len(t) for t in sets]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(names, np.uint64).astype(np.int64), pa.int64()), lists], ["c", "tokens"])

    return whole


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the similarity, compared in full."""
    sized = pairs.join(sets.select(F.col("c").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("c").alias("b"), F.col("tokens").alias("tb")), "b")
    both = F.size(F.array_intersect("ta", "tb"))
    return sized.where(den * both >= num * (F.size("ta") + F.size("tb") - both)).select("a", "b")


def _fit(x: str, y: str, num: int, den: int) -> Column:
    """Whether sets of these sizes can be that similar."""
    return (F.col(x) * den >= F.col(y) * num) & (F.col(y) * den >= F.col(x) * num)


def _reach(n: str, i: str, m: str, num: int, den: int) -> Column:
    """Whether what follows place i in a set of size n leaves enough to share with one of size m."""
    return (F.col(n) - F.col(i)) * (num + den) >= num * (F.col(n) + F.col(m))


def _shared(classes: DataFrame) -> DataFrame:
    """key, c, n, i of the keys that several classes hold, with the key's hub: (i, c, n) of the class that has it earliest.

    Most keys are of one class alone, so the rows are dealt by key once, and what one class alone holds ends there.
    """
    held = classes.where("id is not null").select("c", "n", F.posexplode("keys").alias("i", "key"))
    key = Window.partitionBy("key")
    return held.select("key", "c", "n", "i", F.count("*").over(key).alias("d"), F.min(F.struct("i", "c", "n")).over(key).alias("hub")).where("d > 1").drop("d")


def _opened(qualifying: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes of qualifying groups that share a key from whose places in both sets enough may follow.

    The group of fewer rows (key, c, n, i, g) is opened first, and its classes meet those of the other one by key.
    """
    size = lambda at, name: members.groupBy(F.col("g").alias(at)).agg(F.count("*").alias(name))
    fewer = F.col("ra") <= F.col("rb")
    sided = qualifying.join(size("a", "ra"), "a").join(size("b", "rb"), "b").select(F.when(fewer, F.col("a")).otherwise(F.col("b")).alias("few"), F.when(fewer, F.col("b")).otherwise(F.col("a")).alias("many"))
    u = members.select(F.col("g").alias("few"), "key", F.col("c").alias("u"), "n", "i")
    v = members.select(F.col("g").alias("many"), "key", F.col("c").alias("v"), F.col("n").alias("m"), F.col("i").alias("j"))
    met = sided.join(u, "few").join(v, ["many", "key"]).where(_fit("n", "m", num, den) & _reach("n", "i", "m", num, den) & _reach("m", "j", "n", num, den))
    return met.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()


def _merged(groups: DataFrame, extra: DataFrame, classes: DataFrame) -> DataFrame:
    """``groups`` (c, label) after further links (a, b) between ``classes``: only the groups that these meet are linked again."""
    own = written(classes.join(groups, "c", "left").select("c", F.coalesce("label", "c").alias("g")), "groups")
    met = extra.join(own.select(F.col("c").alias("a"), F.col("g").alias("x")), "a").join(own.select(F.col("c").alias("b"), F.col("g").alias("y")), "b")
    over = components(met.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("c", "g").withColumnRenamed("label", "least")
    every = groups.withColumnRenamed("label", "g").unionByName(own).distinct()
    return every.join(over, "g", "left").select("c", F.coalesce("least", "g").alias("label"))


def _labelled(df: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int, digest: Column) -> tuple[DataFrame, DataFrame]:
    """A row for each input row (id, digest, n, c), and for each class: c, id, label."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), digest.alias("digest"), F.col(text_col).cast("string").alias("text"))
    levels = spark.sparkContext.broadcast(token_levels(rows.select("text"), words))
    prefixes = written(rows.mapInArrow(_prefixes(words, num, den, levels), "id long, digest binary, n int, c long, keys array<long>, bins binary"), "prefixes")
    firsts = prefixes.where("n > 0").groupBy("c").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.first("keys").alias("keys"), F.first("bins").alias("bins"))
    firsts = written(firsts, "firsts")
    docs = written(prefixes.select("id", "digest", "n", "c"), "docs")
    dropped(prefixes)
    shared = written(_shared(firsts), "shared")
    classes = written(firsts.select("c", "id", "n", F.col("n").alias("most"), "bins"), "classes")
    dropped(firsts)
    ends = lambda p: p.select(F.col("a").alias("c")).unionByName(p.select(F.col("b").alias("c"))).distinct()

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs whose whole sets, read for them alone, are as similar as asked."""
        wanted = written(classes.select("c", "id").join(ends(pairs), "c"), "wanted")
        found = rows.select("id", "text").join(limited(wanted.select("id"), SENT_IDS), "id", "left_semi").select("text").mapInArrow(_whole(words), "c long, tokens array<long>")
        sets = written(found.join(wanted.select("c"), "c", "left_semi").dropDuplicates(["c"]), "sets")
        out = written(_linked(pairs, sets, num, den), "links")
        dropped(sets)
        return out

    star = shared.where("c != hub.c").where(_fit("n", "hub.n", num, den) & _reach("n", "i", "hub.n", num, den) & _reach("hub.n", "hub.i", "n", num, den))
    star = star.select(F.greatest("c", "hub.c").alias("a"), F.least("c", "hub.c").alias("b")).distinct()
    links = linked(written(_possible(star, classes, num, den), "pairs"))
    groups = components(links)

    members = written(shared.select("key", "c", "n", "i").join(groups, "c", "left").withColumn("g", F.coalesce("label", "c")).drop("label"), "members")
    dropped(shared)
    per_key = members.groupBy("key", "g").agg(F.min("n").alias("n"), F.max("n").alias("most"), F.max(F.col("n") - F.col("i")).alias("rest"))
    x, y = per_key.alias("x"), per_key.alias("y")
    sizes_fit = (F.col("x.most") * den >= F.col("y.n") * num) & (F.col("y.most") * den >= F.col("x.n") * num)
    enough = lambda rest: F.col(rest) * (num + den) >= num * (F.col("x.n") + F.col("y.n"))
    met = x.join(y, "key").where(F.col("x.g") < F.col("y.g")).where(sizes_fit & enough("x.rest") & enough("y.rest"))
    met = met.select("key", F.col("x.g").alias("a"), F.col("y.g").alias("b"))
    asked = written(met.select("a", "b").distinct(), "asked")
    held_by = classes.select("c", "n", "most", "bins").join(groups, "c", "left").withColumn("g", F.coalesce("label", "c")).join(ends(asked).withColumnRenamed("c", "g"), "g", "left_semi")
    matrix = written(_matrix(held_by, "g"), "matrix")
    qualifying = written(_possible(asked, matrix, num, den), "qualifying")
    labels = groups
    if not qualifying.isEmpty():
        opened = written(_opened(qualifying, members, num, den), "opened")
        extra = linked(written(_possible(opened, classes, num, den), "pairs"))
        labels = groups if extra.isEmpty() else _merged(groups, extra, ends(extra))
    dropped(members)
    named = classes.select("c", "id").join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    return docs.select("id", "digest", "n", "c"), named


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row for each input row: id, n_shingles, component_id (the least id reachable by links)."""
    docs, named = _labelled(df, id_col, text_col, words, num, den, F.lit(None).cast("binary"))
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    linked = docs.where("n > 0").select("id", "n", "c").join(named.join(least, "label").select("c", "component_id"), "c")
    alone = docs.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    out = linked.select("id", "n", "component_id").unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The input's rows, with all columns, of which one of each component stays: its least id.

    A row is known by its id and text, so ids may be null or repeated: of rows of one id and different
    texts each is judged by its own text. A component without an id keeps one row, and of rows without
    words those of one id and text count as one.
    """
    docs, named = _labelled(df, id_col, text_col, words, num, den, text_digest(text_col))
    own = docs.where("n > 0").join(named.select("c", "label"), "c").groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("k"))
    kept = own.select("k.id", "k.digest").unionByName(docs.where("n = 0").select("id", "digest")).distinct()
    kept = kept.select(_row_key("id", "digest").alias("__key"))
    rows = df.withColumn("__key", _row_key(id_col, text_digest(text_col)))
    return rows.join(kept, ["__key"], "left_semi").dropDuplicates(["__key"]).drop("__key")


def _row_key(id_col: str, digest: str | Column) -> Column:
    """A row's id and text as one digest; null text is a text of its own."""
    return F.sha2(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("none")), F.coalesce(F.hex(digest), F.lit("none"))), 256)
