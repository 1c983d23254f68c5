"""Words and hashes of whole Arrow string columns, computed on their byte buffers with numpy.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return. UTF-8 never uses these bytes inside another character, so bytes and code points
give the same words. Nothing here knows Spark; the operators call it on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
SEGMENT_BYTES = 1 << 20


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the int64 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def segments(offsets: np.ndarray, most: int = SEGMENT_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``most`` bytes each, or of one row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(rows, max(last, first + 1))
        yield first, last
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each row's first word (one more at the end).

    ``between`` says for each byte whether it lies between words.
    """
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in segments(offsets):
        s, e, _ = _bounds(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], between)
        starts.append(s + offsets[a])
        ends.append(e + offsets[a])
    whole = np.concatenate(starts)
    return whole, np.concatenate(ends), np.searchsorted(whole, offsets)


def _bounds(data: np.ndarray, offsets: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~between[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all (the finaliser of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@lru_cache(4)
def _letters(lower: bool, seed: int) -> np.ndarray:
    """A random 64-bit number for each byte; with lower, A to Z share those of a to z."""
    table = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        table[0x41:0x5B] = table[0x61:0x7B]
    return table


@lru_cache(1)
def _power_table(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, _BASE, np.uint64))


def powers(n: int) -> np.ndarray:
    return _power_table(1 << max(10, int(n - 1).bit_length()))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 1) -> np.ndarray:
    """64-bit hashes of ascending byte spans that don't overlap."""
    out = np.empty(len(starts), np.uint64)
    for a, b in segments(np.append(starts, len(data))):
        s, e = starts[a:b], ends[a:b]
        lengths = e - s
        keep = np.repeat(s - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
        at = np.arange(len(keep)) + keep
        inside = at - np.repeat(s, lengths)
        terms = _letters(lower, seed)[data[at]]
        terms *= powers(int(lengths.max(initial=1)))[inside]
        sums = np.add.reduceat(terms, np.concatenate(([0], np.cumsum(lengths)[:-1]))) if len(terms) else np.zeros(0, np.uint64)
        out[a:b] = mix(sums + lengths.astype(np.uint64))
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word, and the index of each row's first word (one more at the end)."""
    starts, ends, first = word_bounds(data, offsets)
    return hash_spans(data, starts, ends, lower, seed), first


def window_hashes(words: np.ndarray, size: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2**64, of each run of ``size`` consecutive words."""
    n = max(0, len(words) - size + 1)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h *= np.uint64(base)
        h += words[j : j + n]
    return mix(h)


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row that each word belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
