"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text is cut into chunks, each spaces and what follows up to the next space; no piece of the
vocabulary reaches over such a cut. A chunk's lattice has an edge for each vocabulary piece at each
place of its bytes, and for each character that is no piece the byte pieces of its bytes. A piece's
log probability falls with its rank, ``-log(rank + 1)``, times ``sharpness``.

1. Forward filtering sums, for each distinct chunk of a batch once, the probabilities of all ways to
   reach each place, and so gives the distribution of the last piece before each place.
2. Backward sampling draws the last piece of every occurrence of every chunk, then the one before it,
   and so on. The random numbers are hashes of the row's key, the occurrence's place in the row and
   the step, so a row's segmentation is the same on every run, machine and partitioning.

Decoding joins the pieces' bytes. Spaces are pieces' spaces, and the mark that stands for a space in
the vocabulary, where a text itself holds it, is encoded by its bytes; so decoding gives every text back.

Null text encodes to null and decodes to null; empty text to no pieces. A null key is a key of its own.
Repeated rows get equal segmentations. Chunks are whole however long they are. An empty table gives
an empty result. Only the named columns are read, and ``keep``. Encoding and decoding are maps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.text import hash_spans, mix, segments, utf8

SPACE_MARK = "▁"
BYTE_COST = 12.0
SHARPNESS = 1.0
LONG = 48
BATCH_BYTES, BATCH_IDS = 3 << 20, 1 << 19
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_PRIME = np.uint64(0xD6E8FEB86659FD93)


class Vocabulary:
    def __init__(self, path: str, sharpness: float = SHARPNESS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.raw: list[bytes] = [b""] * n
        usable = []
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.raw[i] = bytes([int(piece[1:-1], 16)])
                self.byte_ids[self.raw[i][0]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.raw[i] = piece.replace(SPACE_MARK, " ").encode()
                if " " not in piece and SPACE_MARK not in piece.lstrip(SPACE_MARK):
                    usable.append((-model.get_score(i), i))
        rank = {i: k for k, (_, i) in enumerate(sorted(usable))}
        ids = np.array(sorted(rank), np.int64)
        weights = -np.log(np.array([rank[i] + 1.0 for i in ids.tolist()]))
        weights -= np.logaddexp.reduce(weights)
        keys = np.array([self.key(self.raw[i]) for i in ids.tolist()], np.uint64)
        by = np.argsort(keys)
        self.keys, self.ids, self.weights = keys[by], ids[by], weights[by] * sharpness
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one hash")
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys * _MULTIPLIER) >> np.uint64(44)] = True
        self.longest = max(len(self.raw[i]) for i in ids.tolist())
        self.byte_weight = float((weights.min() - BYTE_COST) * sharpness)
        self.width = np.array([len(r) for r in self.raw], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.width)))
        self.bytes = np.frombuffer(b"".join(self.raw), np.uint8)

    @staticmethod
    def key(raw: bytes) -> np.uint64:
        h = 0
        for b in raw:
            h = (h * int(_PRIME) + b + 1) & 0xFFFFFFFFFFFFFFFF
        return np.uint64(h)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key among the pieces, or -1."""
        out = np.full(len(keys), -1, np.int32)
        some = np.flatnonzero(self.maybe[(keys * _MULTIPLIER) >> np.uint64(44)])
        own = keys[some]
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        out[some] = np.where(self.keys[at] == own, at, -1)
        return out

    def edges(self, data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For chunks as rows of equal length: width, and for each row and start the piece (or -1) of this width."""
        n, size = data.shape
        h = np.zeros((n, size), np.uint64)
        for width in range(1, min(size, self.longest) + 1):
            h = h[:, : size - width + 1] * _PRIME + data[:, width - 1 :].astype(np.uint64) + np.uint64(1)
            yield width, self.find(h.reshape(-1)).reshape(h.shape)


def fallback(data: np.ndarray, found: dict[int, np.ndarray]) -> np.ndarray:
    """Which bytes belong to a character that is no piece."""
    lead = np.zeros(256, np.int64)
    lead[:0x80], lead[0xC0:0xE0], lead[0xE0:0xF0], lead[0xF0:] = 1, 2, 3, 4
    size = lead[data]
    out = np.zeros(data.shape, bool)
    for width, pieces in found.items():
        if width <= 4:
            unknown = (size[:, : pieces.shape[1]] == width) & (pieces < 0)
            for j in range(width):
                out[:, j : j + unknown.shape[1]] |= unknown
    return out


def lattice(data: np.ndarray, vocabulary: Vocabulary):
    """Edges of chunks of one length: (row, end, width, piece id, probability as the last piece before end)."""
    n, size = data.shape
    found = dict(vocabulary.edges(data))
    bare = fallback(data, found)
    forward = np.full((n, size + 1), -np.inf)
    forward[:, 0] = 0
    steps = []
    for end in range(1, size + 1):
        total = np.full(n, -np.inf)
        own = []
        for width in range(1, min(end, vocabulary.longest) + 1):
            piece = found[width][:, end - width]
            at = np.flatnonzero((piece >= 0) & np.isfinite(forward[:, end - width]))
            if len(at):
                own.append((at, width, vocabulary.ids[piece[at]], forward[at, end - width] + vocabulary.weights[piece[at]]))
        at = np.flatnonzero(bare[:, end - 1] & np.isfinite(forward[:, end - 1]))
        if len(at):
            own.append((at, 1, vocabulary.byte_ids[data[at, end - 1]], forward[at, end - 1] + vocabulary.byte_weight))
        for at, _, _, weight in own:
            total[at] = np.logaddexp(total[at], weight)
        forward[:, end] = total
        for at, width, ids, weight in own:
            steps.append((at, np.full(len(at), end), np.full(len(at), width), ids, np.exp(weight - total[at])))
    return [np.concatenate(x) for x in zip(*steps, strict=True)]


def long_lattice(data: np.ndarray, vocabulary: Vocabulary):
    """As ``lattice``, for one long chunk: pieces are found at all places at once."""
    found = dict(vocabulary.edges(data[None]))
    bare = fallback(data[None], found)[0]
    ends: list[list[tuple[int, int, float]]] = [[] for _ in range(len(data) + 1)]
    for width, piece in found.items():
        for start in np.flatnonzero(piece[0] >= 0).tolist():
            k = piece[0, start]
            ends[start + width].append((width, int(vocabulary.ids[k]), float(vocabulary.weights[k])))
    for start in np.flatnonzero(bare).tolist():
        ends[start + 1].append((1, int(vocabulary.byte_ids[data[start]]), vocabulary.byte_weight))
    forward = np.full(len(data) + 1, -np.inf)
    forward[0] = 0
    steps = []
    for end in range(1, len(data) + 1):
        weights = np.array([forward[end - w] + p for w, _, p in ends[end]])
        if len(weights) and np.isfinite(weights.max()):
            forward[end] = np.logaddexp.reduce(weights)
            steps += [(end, w, i, p) for (w, i, _), p in zip(ends[end], np.exp(weights - forward[end]).tolist(), strict=True) if p > 0]
    end, width, ids, p = (np.array(x) for x in zip(*steps, strict=True))
    return [np.zeros(len(end), np.int64), end, width, ids, p]


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    space = data == 0x20
    start = np.zeros(len(data) + 1, bool)
    start[1:-1] = space[1:] & ~space[:-1]
    start[offsets] = True
    return np.flatnonzero(start[:-1])


def sample(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, vocabulary: Vocabulary, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled piece ids of all texts, and the offsets of the texts in them."""
    starts = chunk_starts(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ends = np.append(starts[1:], len(data))
    hashes, at, kind = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
    sizes = (ends - starts)[at]
    base = np.concatenate(([0], np.cumsum(sizes + 1)))  # a chunk's places
    parts = []
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        for some in np.array_split(own, len(own) // 20_000 + 1) if size <= LONG else own[:, None]:
            rows = data[starts[at[some]][:, None] + np.arange(size)]
            row, end, width, ids, p = lattice(rows, vocabulary) if size <= LONG else long_lattice(rows[0], vocabulary)
            parts.append((base[some[row]] + end, width, ids, p))
    place, width, ids, p = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.argsort(place, kind="stable")
    place, width, ids, p = place[by], width[by], ids[by], p[by]
    first = np.searchsorted(place, np.arange(base[-1] + 1))
    sums = np.concatenate(([0.0], np.cumsum(p)))
    upto = np.minimum(sums[1:] - sums[first[place]], 1.0) + place  # rises within a place, and from place to place

    row = np.searchsorted(offsets, starts, "right") - 1
    stream = mix(keys ^ np.uint64(seed))[row] + (np.arange(len(starts)) - np.searchsorted(starts, offsets)[row]).astype(np.uint64) * _MULTIPLIER
    active = np.argsort(kind, kind="stable")  # equal chunks side by side, so that their edges are near
    state, stop, stream, step = (base[kind] + ends - starts)[active], base[kind][active], stream[active], 0
    count = np.zeros(len(starts), np.int64)
    drawn = []
    while len(active):
        u = (mix(stream ^ mix(np.array([step + 1], np.uint64))) >> np.uint64(11)).astype(np.float64) / 2.0**53
        low, high = first[state], first[state + 1] - 1
        edge = np.clip(np.searchsorted(upto, state + u, "right"), low, high)
        drawn.append((active, ids[edge]))
        count[active] += 1
        state = state - width[edge]
        going = np.flatnonzero(state > stop)
        active, state, stop, stream, step = active[going], state[going], stop[going], stream[going], step + 1
    total = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros(total[-1], np.int64)
    for k, (which, piece) in enumerate(drawn):
        out[total[which + 1] - 1 - k] = piece
    return out, total[np.searchsorted(starts, offsets)]


_VOCABULARIES: dict[tuple, Vocabulary] = {}


def vocabulary(path: str, sharpness: float = SHARPNESS) -> Vocabulary:
    if (path, sharpness) not in _VOCABULARIES:
        _VOCABULARIES[path, sharpness] = Vocabulary(path, sharpness)
    return _VOCABULARIES[path, sharpness]


def encode(df: DataFrame, model_path: str, key_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), seed: int = 0, sharpness: float = SHARPNESS) -> DataFrame:
    """One row for each input row: key, the kept columns, and ``ids``, a sampled segmentation."""
    rows = df.select(key_col, *keep, F.xxhash64(key_col).alias("__key"), F.col(text_col).cast("string").alias("__text"))
    names = [key_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model_path, sharpness)
        for batch in batches:
            column = batch.column("__text")
            data, offsets = utf8(column)
            keys = batch.column("__key").to_numpy().view(np.uint64)
            for a, b in segments(offsets, BATCH_BYTES):
                found, bounds = sample(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], keys[a:b], words, seed)
                part = batch.slice(a, b - a)
                missing = part.column("__text").is_null()
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found, pa.int32()), mask=missing)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), lists], [*names, "ids"])

    schema = df.select(*names).schema.add("ids", T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The input with its ids decoded into ``text_col``."""
    names = [c for c in df.columns if c not in (ids_col, text_col)]
    schema = df.select(*names).schema.add(text_col, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model_path)
        for batch in batches:
            sizes = batch.column(ids_col).value_lengths().fill_null(0).to_numpy()
            for a, b in segments(np.concatenate(([0], np.cumsum(sizes))), BATCH_IDS):
                part = batch.slice(a, b - a)
                lists = part.column(ids_col)
                ids = np.asarray(lists.flatten())
                widths = words.width[ids]
                place = np.concatenate(([0], np.cumsum(widths)))
                raw = words.bytes[np.repeat(words.begin[ids] - place[:-1], widths) + np.arange(place[-1])].tobytes()
                bounds = place[np.concatenate(([0], np.cumsum(sizes[a:b])))].tolist()
                texts = [None if missing else raw[x:y].decode() for x, y, missing in zip(bounds[:-1], bounds[1:], lists.is_null().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(texts, pa.string())], [*names, text_col])

    return df.select(*names, ids_col).mapInArrow(run, schema)
