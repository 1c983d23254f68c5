"""Packing token sequences: shortest-pack-first over the length histogram.

1. Each whole text is tokenised once. A document's ids, its end mark included, are cut into full
   sequences and one rest; checksums of the pieces are taken in the same pass, so ids needn't move.
2. The histogram of piece lengths, ``size`` numbers at most, is packed on the driver: lengths are
   placed longest first, each into the pack with the most room, and packs of one content are one
   pattern with a count. A length that fits no pack opens new ones, and fills each with itself.
   Each length adds two patterns at most (it splits one, or opens full ones and one for the
   remainder), so there are no more than twice ``size`` patterns, however many documents.
3. Patterns are joined back by rank: the pieces of a length are numbered over all tasks by prefix
   sums of the tasks' counts, and each length of a pattern takes a range of these numbers. No length,
   however common, meets in one task.

Null text is empty text, which is the end mark alone. Repeated rows and ids are packed each. A null
id stays null. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.store import release, written
from tessera.llm.text import hash_spans, utf8

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, task int, rank long"
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _may_end_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each position may be white space of any script."""
    last = data[at - 1]
    two = data[np.maximum(at - 2, 0)]
    three = data[np.maximum(at - 3, 0)]
    return _ASCII_SPACE[last] | (last >= 0x80) & ((two == 0xC2) | (three >= 0xE1) & (three <= 0xE3))


def chunk_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of chunks, each white space and the word after it, and the index of each row's first chunk.

    A byte-level BPE never merges over the start of white space that follows anything else, so a
    text's ids are those of its chunks, one after the other.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    at = np.flatnonzero(_ASCII_SPACE[data])
    at = at[at > 0]
    at = at[~_may_end_space(data, at)]
    rows = offsets[:-1][np.diff(offsets) > 0]
    starts = np.union1d(at, rows)
    return starts, np.searchsorted(starts, offsets)


class ChunkEncoder:
    """Token ids of many texts: each distinct chunk is given to the tokenizer once, and its ids kept.

    What is kept is bounded by ``most`` chunks, about 40 bytes each with their ids; beyond, it starts anew.
    """

    def __init__(self, path: str, special_as_text: bool = False, most: int = 2_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        size = self.tokenizer.get_vocab_size()
        self.width = np.zeros(size, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(token)
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys, self.start, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(x.ids, np.uint32) for x in found]

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        raw = data.tobytes()
        first, odd_end = data[starts], _may_end_space(data, ends)
        alone = odd_end | (first == 0xC2) | (first >= 0xE1) & (first <= 0xE3)
        joined, lengths = [], []
        plain = np.flatnonzero(~alone)
        bare = ~_ASCII_SPACE[first]
        counts = np.zeros(len(keys), np.int64)
        parts: list[np.ndarray] = []
        order: list[np.ndarray] = []
        for group in np.array_split(plain, max(1, len(plain) // 400)):
            if len(group):
                joined.append(b"".join((b"\n" if bare[i] else b"") + raw[starts[i] : ends[i]] for i in group))
                lengths.append(group)
        for group, ids in zip(lengths, self._encode(joined), strict=True):
            to = np.cumsum(ends[group] - starts[group] + bare[group])
            token_ends = np.cumsum(self.width[ids])
            last = np.searchsorted(token_ends, to)
            if len(to) and not (token_ends[last] == to).all():
                raise ValueError("a token reaches over the end of a chunk")
            n = np.diff(last + 1, prepend=0)
            keep = np.ones(len(ids), bool)
            keep[(last + 1 - n)[bare[group]]] = False  # the line feed put before
            parts.append(ids[keep])
            counts[group] = n - bare[group]
            order.append(group)
        odd = np.flatnonzero(alone)
        for i, ids in zip(odd, self._encode([raw[starts[i] : ends[i]] for i in odd]), strict=True):
            parts.append(ids)
            counts[i] = len(ids)
        order.append(odd)
        which = np.concatenate(order)
        begins = np.zeros(len(keys), np.int64)
        begins[which] = len(self.ids) + np.concatenate(([0], np.cumsum(counts[which])[:-1])) if len(which) else 0
        self.ids = np.concatenate([self.ids, *parts])
        every = np.concatenate([self.keys, keys])
        by = np.argsort(every, kind="stable")
        self.keys, self.start, self.count = every[by], np.concatenate([self.start, begins])[by], np.concatenate([self.count, counts])[by]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids, and the offsets of the rows in them."""
        starts, first = chunk_bounds(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        keys, at, which = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.most:
            self.clear()
        new = np.flatnonzero(~np.isin(keys, self.keys, assume_unique=True))
        if len(new):
            self._learn(data, starts[at[new]], ends[at[new]], keys[new])
        slot = np.searchsorted(self.keys, keys)[which]
        counts = self.count[slot]
        total = np.concatenate(([0], np.cumsum(counts)))
        ids = self.ids[np.repeat(self.start[slot] - total[:-1], counts) + np.arange(total[-1])]
        return ids, total[first]


_ENCODERS: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(path: str, special_as_text: bool) -> ChunkEncoder:
    key = (path, special_as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, special_as_text)
    return _ENCODERS[key]


def _pieces(path: str, size: int, end_id: int, special_as_text: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ranks = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        try:
            for whole in batches:
                for batch in (whole.slice(i, 4000) for i in range(0, whole.num_rows, 4000)):
                    data, offsets = utf8(batch.column("text"))
                    ids, bounds = encoder(path, special_as_text).encode(data, offsets)
                    rows = []
                    for row, doc in enumerate(batch.column("doc_id").to_pylist()):
                        own = np.append(ids[bounds[row] : bounds[row + 1]], np.uint32(end_id)).astype("<u4")
                        for start in range(0, len(own), size):
                            piece = own[start : start + size]
                            rows.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(own), task, ranks[len(piece)]))
                            ranks[len(piece)] += 1
                    columns = list(zip(*rows, strict=True)) or [()] * 7
                    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "rank"])
        finally:
            encoder(path, special_as_text).clear()  # workers live on, and other stages need their memory
            release()

    return cut


def pack(histogram: dict[int, int], size: int = 2048) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (count, lengths) that hold every length of the histogram as often as it says.

    Lengths are placed longest first into the packs with the most room, shortest packs first.
    """
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            most = max((r for r, packs in room.items() if packs), default=0)
            if most < length:
                each = size // length  # the pack just opened has the most room
                for times, packs in ((each, left // each), (left % each, 1)):
                    if times and packs:
                        room[size - times * length][(length,) * times] += packs
                break
            content, packs = room[most].popitem()
            if not room[most]:
                del room[most]
            n = min(left, packs)
            if packs > n:
                room[most][content] += packs - n
            room[most - length][(*content, length)] += n
            left -= n
    return [(n, content) for r in sorted(room) for content, n in sorted(room[r].items())]


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1, special_as_text: bool = False) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The name of a special token in a text is that token, as the tokenizer's file has it, or with ``special_as_text`` plain text.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = written(rows.mapInArrow(_pieces(tokenizer_path, size, end_id, special_as_text), PIECES), "pieces")
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, taken, sequences = [], defaultdict(int), 0
    for n, content in pack(histogram, size):
        offset = 0
        for length, run in groupby(content):
            times = len(list(run))
            slots.append((length, taken[length], taken[length] + n * times, sequences, offset, times))
            taken[length] += n * times
            offset += length * times
        sequences += n
    slot = spark.createDataFrame(slots, "length int, first long, last long, sequence long, offset long, times int")
    ranked = pieces.join(bases, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "task")
    placed = ranked.join(F.broadcast(slot), (ranked["length"] == slot["length"]) & (ranked["rank"] >= slot["first"]) & (ranked["rank"] < slot["last"])).drop(slot["length"])
    return placed.select(
        F.col("doc_id").alias(id_col),
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.col("sequence") + F.expr("(rank - first) div times")).alias("sequence_id"),
        (F.col("offset") + (F.col("rank") - F.col("first")) % F.col("times") * F.col("length")).alias("offset"),
    )
