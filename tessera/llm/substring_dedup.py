"""Substring deduplication by Rabin-Karp hashes of every fixed-length token window.

1. Documents become blocks of a few megabytes, written once, so that each later step, also one that is
   run again after a lost executor, finds the same rows in them. A block hashes each of its windows of ``window`` words.
   A window that also starts in a smaller id of the block is marked there; of each other hash, the
   windows of its smallest id in the block go on. So a passage that a third of all documents hold
   goes on once for each block.
2. Hashes meet by bucket, as many buckets as shuffle partitions. A bucket sorts its hashes and
   answers, to each block, which of its windows a smaller id also holds.
3. A block gets all answers, merges the marked windows into maximal intervals and drops their words.

Hashes have 56 bits and, of a second hash, the bucket; two different windows are taken for one with
a probability of 2**-56 for each pair of a bucket: 7e-4 for any of ten million windows in a bucket,
and falling with the square of the windows in a bucket, of which there are as many as shuffle partitions.

Null text has no words. A null id counts as larger than all others. Equal ids are one document, so
repeated rows don't remove each other's words, and there is a row for each. An empty table gives an
empty result. Only the id and the text column are read. A long text is one row of a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import from_planes, group_of, grouped, planes, unpack
from tessera.llm.store import partitions
from tessera.llm.text import mix, rows_of, utf8, window_hashes, word_bounds, word_hashes

ASKED = "bucket long, block long, hashes binary, ids binary, counts binary, at binary"
ANSWER = "block long, at binary"
RESULT = "id long, n_words long, removed array<struct<start:long, end:long>>, kept_text string"
_HASH_BYTES = 7
_LARGEST = np.iinfo(np.int64).max


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("id").fill_null(_LARGEST).to_numpy(zero_copy_only=False)


def _delta(at: np.ndarray) -> bytes:
    return planes(np.diff(at, prepend=0).astype(np.uint32))


def _undelta(raw: bytes) -> np.ndarray:
    return np.cumsum(from_planes(raw, np.uint32), dtype=np.int64)


def _ask(window: int, buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                rows = unpack(payload.as_py())
                words, first = word_hashes(*utf8(rows.column("text")))
                own = rows_of(first)
                at = np.arange(max(0, len(words) - window + 1))
                at = at[at + window <= first[1:][own[at]]]
                hashes = window_hashes(words, window)[at]
                bucket = mix(window_hashes(words, window, 0xA0761D6478BD642F)[at]) % np.uint64(buckets)
                ids = _ids(rows)[own[at]]
                by = np.argsort(hashes, kind="stable")
                new = np.append(True, hashes[by][1:] != hashes[by][:-1]) if len(by) else np.zeros(0, bool)
                leader = ids[by][np.flatnonzero(new)][np.cumsum(new) - 1] if len(by) else ids
                here = np.zeros(len(at), bool)
                here[by] = ids[by] > leader
                out = [(buckets + block % buckets, block, b"", b"", b"", _delta(at[here]))] if here.any() else []
                sent = np.flatnonzero(~here)
                sent = sent[np.argsort(bucket[sent], kind="stable")]
                edges = np.searchsorted(bucket[sent], np.arange(buckets + 1, dtype=np.uint64))
                for b in np.flatnonzero(np.diff(edges)):
                    part = sent[edges[b] : edges[b + 1]]
                    begins = np.flatnonzero(np.append(True, np.diff(ids[part]) != 0))
                    raw = np.ascontiguousarray(hashes[part].view(np.uint8).reshape(-1, 8)[:, :_HASH_BYTES]).tobytes()
                    out.append((int(b), block, raw, planes(np.diff(ids[part][begins], prepend=0)), planes(np.diff(begins, append=len(part)).astype(np.uint32)), _delta(at[part])))
                columns = list(zip(*out, strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.int64()] + [pa.binary()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "block", "hashes", "ids", "counts", "at"])

    return ask


def _answer(buckets: int):
    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        if frame["bucket"].iloc[0] >= buckets:
            return frame[["block", "at"]]
        hashes, ids, sizes = [], [], []
        for h, i, n in zip(frame["hashes"], frame["ids"], frame["counts"], strict=True):
            wide = np.zeros((len(h) // _HASH_BYTES, 8), np.uint8)
            wide[:, :_HASH_BYTES] = np.frombuffer(h, np.uint8).reshape(-1, _HASH_BYTES)
            hashes.append(wide.reshape(-1).view(np.uint64))
            ids.append(np.repeat(np.cumsum(from_planes(i, np.int64)), from_planes(n, np.uint32)))
            sizes.append(len(wide))
        hashes, ids = np.concatenate(hashes), np.concatenate(ids)
        by = np.argsort(hashes, kind="stable")
        begins = np.flatnonzero(np.append(True, hashes[by][1:] != hashes[by][:-1]))
        least = np.repeat(np.minimum.reduceat(ids[by], begins), np.diff(begins, append=len(by)))
        marked = np.zeros(len(by), bool)
        marked[by] = ids[by] > least
        parts = np.split(marked, np.cumsum(sizes)[:-1])
        found = [(block, _delta(_undelta(at)[part])) for block, at, part in zip(frame["block"], frame["at"], parts, strict=True) if part.any()]
        return pd.DataFrame(found, columns=["block", "at"])

    return answer


def _remove(window: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload, answers in zip(batch.column("block").to_pylist(), batch.column("payload"), batch.column("answers"), strict=True):
                rows = unpack(payload.as_py())
                data, offsets = utf8(rows.column("text"))
                starts, ends, first = word_bounds(data, offsets)
                change = np.zeros(len(starts) + 1, np.int32)
                for answer in answers.as_py() or ():
                    if answer["block"] == block:
                        at = _undelta(answer["at"])
                        change[at] += 1
                        change[at + window] -= 1
                gone = np.cumsum(change)[:-1] > 0
                own = rows_of(first)
                opens = np.flatnonzero(gone & ~(np.append(False, gone[:-1]) & (own == np.append(-1, own[:-1]))))
                closes = np.flatnonzero(gone & ~(np.append(gone[1:], False) & (own == np.append(own[1:], -1)))) + 1
                spans = pa.StructArray.from_arrays([pa.array(opens - first[own[opens]]), pa.array(closes - first[own[opens]])], ["start", "end"])
                removed = pa.ListArray.from_arrays(pa.array(np.searchsorted(own[opens], np.arange(len(offsets))), pa.int32()), spans)
                kept = kept_texts(data, offsets, starts[~gone], ends[~gone])
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(np.diff(first)), removed.cast(kind), kept], ["id", "n_words", "removed", "kept_text"])

    return remove


def kept_texts(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Each row's words, given by their bounds, joined by one space."""
    lengths = ends - starts + 1
    place = np.concatenate(([0], np.cumsum(lengths)))
    out = np.full(place[-1], 0x20, np.uint8)
    at = np.arange(place[-1])
    inside = np.ones(place[-1], bool)
    inside[place[1:] - 1] = False
    out[inside] = data[(at + np.repeat(starts - place[:-1], lengths))[inside]]
    bounds = place[np.searchsorted(starts, offsets)]
    last = np.maximum(bounds[1:] - 1, bounds[:-1])  # without the space after a row's last word
    raw = out.tobytes()
    return pa.array([raw[a:b].decode() for a, b in zip(bounds[:-1].tolist(), last.tolist(), strict=True)], pa.string())


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """One row for each input row: id, n_words, removed (word intervals, end exclusive), kept_text."""
    buckets = partitions(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    held = grouped(rows)
    asked = held.select("block", "payload").mapInArrow(_ask(window, buckets), ASKED)
    answers = asked.groupBy("bucket").applyInPandas(_answer(buckets), ANSWER)
    by_group = answers.groupBy(group_of(df.sparkSession).alias("group")).agg(F.collect_list(F.struct("block", "at")).alias("answers"))
    out = held.join(by_group, "group", "left").select("block", "payload", "answers").mapInArrow(_remove(window), RESULT)
    return out.withColumnRenamed("id", id_col)
