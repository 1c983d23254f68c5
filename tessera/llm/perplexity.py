"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model's symbols are the bytes of UTF-8, so a document of any script can be scored, and its n-grams
of ``order`` bytes (six at most) are exact numbers; each text is read after ``order - 1`` line feeds.

1. Documents become compressed blocks, in as many groups as there are shuffle partitions, written
   once, bucketed by group, so that text is never shuffled. Ids meet the labels without their texts.
2. Counts of all trusted documents' n-grams are summed over the corpus; continuation counts, context
   sums, and the three discounts of each order follow from them by aggregations.
3. Each group asks for its distinct n-grams. The corpus's distinct n-grams join the sharded counts of
   every order, from which their interpolated probabilities come, and the answers go back to the
   groups. So a frequent n-gram moves once for each group, not once for each occurrence.
4. A group scores its documents: perplexity is the exponential of the mean negative log probability
   of a byte. For each language, quantiles of the trusted documents' perplexities are the thresholds,
   upper for text unlike the trusted, lower for text that repeats itself. Short texts spread more, so
   a language has thresholds of its own for each power of four of the texts' bytes. Where these, or a
   language, have fewer than ``LEAST_IN_BAND`` or ``LEAST_TRUSTED`` trusted documents, those of the
   language, or of all, take their place. Quantiles are found by counts of logarithms in steps of
   ``1 / BINS``, the largest value of a step for all in it, so they don't depend on the order in which tasks end, or on tasks run again.

Null and empty texts have no perplexity and are not kept. A null language is the language ''. A null
id is scored and never trusted. Repeated rows are scored, and counted, each. Without trusted text
there is no model: perplexities are null, and all texts but empty ones are kept. An empty table
gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.blocks import grouped, unpack
from tessera.llm.store import limited, release, small_batches, text_digest, written
from tessera.llm.text import segments, utf8

ORDER, MOST_ORDER = 4, 6
LOW, HIGH, MARGIN = 0.001, 0.994, 0.03
SLOT_BITS, FEW_LANGUAGES = 21, 10_000
BINS = 10_000  # for each unit of a perplexity's logarithm, which is under 40
LEAST_TRUSTED = LEAST_IN_BAND = 1000  # 1 / LOW: quantiles of fewer documents are their range
STEP_BYTES = 1 << 18  # of text whose n-grams are held at a time


def grams(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The n-gram, as a number, that ends at each byte of the texts."""
    n, rows = len(data), np.flatnonzero(np.diff(offsets) > 0)
    kind = np.uint32 if order <= 4 else np.uint64
    out = data.astype(kind)
    for back in range(1, order):
        before = np.empty(n, kind)
        before[back:] = data[:-back] if n > back else 0
        for j in range(back):  # the lead stands before each text
            at = offsets[rows] + j
            before[at[at < offsets[rows + 1]]] = 0x0A
        out |= before << kind(8 * back)
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers and how often each occurs."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(at, append=len(keys))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _texts(rows: pa.RecordBatch, keep: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    column = rows.column("text")
    data, offsets = utf8(column if keep is None else column.filter(pa.array(keep)))
    for a, b in segments(offsets, STEP_BYTES):
        yield data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _batch(columns: dict[str, tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def _count(order: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """n-grams of the trusted texts of a partition, with counts."""
        found = [(np.zeros(0, np.uint32), np.zeros(0, np.int64))]
        for batch in batches:
            for payload, trusted in zip(batch.column("payload"), batch.column("trusted"), strict=True):
                if trusted.is_valid:
                    rows = unpack(payload.as_py())
                    keep = pa.compute.is_in(rows.column("id"), trusted.values.combine_chunks() if isinstance(trusted.values, pa.ChunkedArray) else trusted.values)
                    found = [_merge([*found, *(distinct(grams(*t, order)) for t in _texts(rows, keep.to_numpy(zero_copy_only=False)))])]
        keys, counts = found[0]
        del found
        release()
        yield _batch({"gram": (keys.astype(np.int64), pa.int64()), "n": (counts, pa.int64())})

    return count


def _ask(order: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct n-grams of each group."""
        wanted: dict[int, np.ndarray] = {}
        for batch in batches:
            for group, payload in zip(batch.column("group").to_pylist(), batch.column("payload"), strict=True):
                parts = [distinct(grams(*t, order))[0] for t in _texts(unpack(payload.as_py()))]
                wanted[group] = distinct(np.concatenate([wanted.get(group, np.zeros(0, np.uint32)), *parts]))[0]
        release()
        for group, keys in wanted.items():
            yield _batch({"group": (np.full(len(keys), group), pa.int64()), "gram": (keys.astype(np.int64), pa.int64())})

    return ask


class _Lookup:
    """Values of known keys: most by one slot of a table, those that share a slot by search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        by = np.argsort(keys)
        self.keys, self.values = keys[by], values[by].astype(np.float32)
        slots = self.slot(self.keys)
        self.table = np.full(1 << SLOT_BITS, np.nan, np.float32)
        self.table[slots] = self.values
        self.table[np.flatnonzero(np.bincount(slots.astype(np.int64), minlength=1 << SLOT_BITS) > 1)] = np.nan

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = self.table[self.slot(keys)]
        missed = np.flatnonzero(np.isnan(out))
        out[missed] = self.values[np.searchsorted(self.keys, keys[missed])]
        return out


def _unit(order: int) -> int:
    """What a natural log probability is multiplied by, to fit with its n-gram in one number."""
    return 1 << (64 - 8 * order - 6)


def _score(order: int):
    bits = 64 - 8 * order

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, known = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                rows, answer = unpack(batch.column("payload")[i].as_py()), batch.column("answer")[i]
                means, sizes, digests = [np.zeros(0)], [np.zeros(0, np.int64)], []
                if answer.is_valid and group != batch.column("group")[i].as_py():
                    flat = np.asarray(answer.values).view(np.uint64)
                    known = _Lookup(flat >> np.uint64(bits), (flat & np.uint64((1 << bits) - 1)) / -float(_unit(order)))
                    group = batch.column("group")[i].as_py()
                for data, offsets in _texts(rows):
                    n = np.diff(offsets)
                    sums = np.zeros(len(n))
                    if answer.is_valid and len(data):
                        total = np.concatenate(([0.0], np.cumsum(known(grams(data, offsets, order)), dtype=np.float64)))
                        sums = total[offsets[1:]] - total[offsets[:-1]]
                    means.append(np.divide(sums, n, out=np.full(len(n), np.nan), where=n > 0) if answer.is_valid else np.full(len(n), np.nan))
                    sizes.append(n)
                    raw = data.tobytes()
                    digests += [hashlib.sha256(raw[a:b]).digest() for a, b in pairwise(offsets.tolist())]
                mean = np.concatenate(means)
                ppl = pa.array(np.exp(-mean), pa.float64(), from_pandas=True)
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("lang"), pa.array(digests, pa.binary()), pa.array(np.concatenate(sizes), pa.int64()), ppl], ["id", "lang", "digest", "n_bytes", "perplexity"])
        known = None
        release()

    return score


def _discounts(table: DataFrame) -> Column:
    """The three discounts of modified Kneser-Ney, as a column of ``n``, from the counts of counts."""
    found = {r["n"]: r["k"] for r in table.where("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()}
    n1, n2, n3, n4 = (found.get(k, 0) for k in (1, 2, 3, 4))
    if min(n1, n2, n3) == 0:
        d = [0.5, 0.75, 0.9]
    else:
        y = n1 / (n1 + 2 * n2)
        d = [min(max(x, 0.05), k - 0.05) for k, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
    return F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])


def probabilities(counts: DataFrame, wanted: DataFrame, most: int = ORDER) -> DataFrame:
    """gram and lp, its natural log probability, for the n-grams of ``wanted``; ``counts``: gram, n."""
    out = wanted.select("gram", F.lit(0.0).alias("p"), F.lit(1.0).alias("rest"))
    table = counts
    for order in range(most, 0, -1):
        table = written(table, "counts")
        held = table.select("gram", F.col("n").cast("double").alias("n"), _discounts(table).alias("d"))
        sums = held.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("s"), F.sum("d").alias("kept"))
        low = F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1))
        out = out.withColumn("own", low).withColumn("context", F.shiftright(low, 8))
        out = out.join(held.select(F.col("gram").alias("own"), "n", "d"), "own", "left").join(sums, "context", "left")
        out = out.select(
            "gram",
            (F.col("p") + F.col("rest") * F.coalesce((F.col("n") - F.col("d")) / F.col("s"), F.lit(0.0))).alias("p"),
            (F.col("rest") * F.coalesce(F.col("kept") / F.col("s"), F.lit(1.0))).alias("rest"),
        )
        table = table.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1)).alias("gram")).agg(F.count("*").alias("n"))
    return out.select("gram", F.log(F.col("p") + F.col("rest") / 256).alias("lp"))


def _edges(base: DataFrame, keys: list[str], least: int, name: str) -> DataFrame:
    """keys, and ``name``: the two quantiles of the perplexities of each group of ``least`` rows or more.

    A group's rows are counted by bin before they meet, so its window holds a row for each bin.
    """
    bins = base.groupBy(*keys, F.ceil(F.log("perplexity") * BINS).alias("bin")).agg(F.count("*").alias("n"), F.max("perplexity").alias("top"))
    own = Window.partitionBy(*keys)
    bins = bins.withColumn("upto", F.sum("n").over(own.orderBy("bin"))).withColumn("all", F.sum("n").over(own))
    edge = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("top")))
    return bins.where(F.col("all") >= least).groupBy(*keys).agg(F.array(edge(LOW), edge(HIGH)).alias(name))


def _ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        for group, payload in zip(frame["group"], frame["payload"], strict=True):
            yield unpack(payload).select(["id"]).to_pandas().dropna().astype("int64").assign(group=group)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", order: int = ORDER) -> DataFrame:
    """One row for each input row: id, lang, n_bytes, perplexity, low, high (the thresholds), kept."""
    return _judged(docs, labels, id_col, text_col, lang_col, label_col, order).drop("digest")


def _judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, label_col: str, order: int) -> DataFrame:
    """``quality`` with the digest of each text."""
    if not 2 <= order <= MOST_ORDER:
        raise ValueError(f"the order must be from 2 to {MOST_ORDER}")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"))
    held = grouped(rows)
    good = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).alias("q")).where("q = 1").select("id")
    trusted = held.select("group", "payload").mapInPandas(_ids, "id long, group long").join(good, "id")
    by_group = trusted.groupBy("group").agg(F.collect_set("id").alias("trusted"))
    counted = held.join(by_group, "group").select("payload", "trusted").mapInArrow(_count(order), "gram long, n long")
    with small_batches(docs.sparkSession):
        counts = written(counted.groupBy("gram").agg(F.sum("n").alias("n")), "counts")
    any_trusted = not counts.isEmpty()
    if any_trusted:
        asked = held.select("group", "payload").mapInArrow(_ask(order), "group long, gram long")
        with small_batches(docs.sparkSession):
            asked = written(asked, "asked")
        packed = F.shiftleft("gram", 64 - 8 * order).bitwiseOR(F.round(F.col("lp") * -_unit(order)).cast("long"))  # one number each: a group's answer is held whole
        answers = asked.join(probabilities(counts, asked.select("gram").distinct(), order), "gram").groupBy("group").agg(F.collect_list(packed).alias("answer"))
        scored = held.join(answers, "group", "left")
    else:
        scored = held.withColumn("answer", F.lit(None).cast("array<bigint>"))
    with small_batches(docs.sparkSession):
        scored = written(scored.select("group", "payload", "answer").mapInArrow(_score(order), "id long, lang string, digest binary, n_bytes long, perplexity double"), "scored")
    base = scored.where("perplexity is not null").join(good, "id", "left_semi")
    band = F.floor(F.log2(F.greatest("n_bytes", F.lit(1))) / 2)
    limits, narrow = _edges(base, ["lang"], LEAST_TRUSTED, "e"), _edges(base.withColumn("band", band), ["lang", "band"], LEAST_IN_BAND, "own")
    whole = _edges(base, [], 0, "every")
    out = scored.withColumn("band", band).join(F.broadcast(whole)).join(limited(limits, FEW_LANGUAGES), "lang", "left").join(limited(narrow, FEW_LANGUAGES), ["lang", "band"], "left")
    out = out.withColumn("e", F.coalesce("own", "e", "every"))
    out = out.withColumn("low", F.col("e")[0] * (1 - MARGIN)).withColumn("high", F.col("e")[1] * (1 + MARGIN))
    kept = (F.col("n_bytes") > 0) & F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return out.select(F.col("id").alias(id_col), "lang", "digest", "n_bytes", "perplexity", "low", "high", kept.alias("kept"))


def kept_by_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", order: int = ORDER) -> DataFrame:
    """The input's rows that ``quality`` keeps, with all columns; a row is judged by its id, language and text."""
    kept = _judged(docs, labels, id_col, text_col, lang_col, label_col, order).where("kept").select(F.col(id_col).alias("__id"), F.col("lang").alias("__lang"), F.col("digest").alias("__digest")).distinct()
    own = F.col(id_col).eqNullSafe(F.col("__id")) & (F.coalesce(F.col(lang_col).cast("string"), F.lit("")) == F.col("__lang")) & (text_digest(text_col) == F.col("__digest"))
    return docs.join(kept, own, "left_semi")
