"""Toxicity by a convolutional text classifier, trained in numpy, with thresholds calibrated by language.

Words are runs of letters, lower-cased in ASCII. A word's embedding is the sum of hashed embeddings of
the word and of its first bytes (``PREFIXES``), so forms of one stem share what is learnt. Filters of
several widths slide over the words, each filter's maximum over the text is kept, and a linear layer
scores the maxima. Max pooling sends each gradient to one window, so training is sparse.

The classifier is fitted to a bounded sample of labelled rows: ``SAMPLE`` rows of each class, those
with the least hashes of their ids, of texts up to ``SAMPLE_CHARS`` characters. Four fifths train it;
on the rest a threshold is chosen for each language, or for all where the rest has fewer than
``CALIBRATED_ON`` rows of a class in it. Languages come from the text: frequent words of
the sample's languages tell which one a text is in. The language column, like the source, the id and
the labels, is no input of a score. A score is 0.7 exactly at the threshold of its text's language.

Scoring is a map over all rows and whole texts, without a shuffle; the model is about 2 MB whatever
the corpus. Null and empty texts, and texts without letters, get the score of a text without evidence.
Repeated rows get equal scores. Without labels of both classes every score is 0. An empty table gives
an empty result. Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import hash_spans, rows_of, segments, utf8, word_bounds

SAMPLE, SAMPLE_CHARS = 2500, 40_000
BUCKETS, DIMS, FILTERS, WIDTHS, PREFIXES = 1 << 16, 8, 6, (1, 2, 3), (4, 6, 7)
EPOCHS, STEPS, BATCH, RATE = 8, 1000, 32, 0.1
CALIBRATED_ON = 12
START, DAMPING, DROPPED = 0.01, 0.01, 0.3
PREDICTED_AT = 0.7
_NO_LETTER = np.ones(256, bool)
_NO_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
PAD = max(WIDTHS) - 1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedding rows of all words (words x kinds), the words' hashes, and each text's first word."""
    starts, ends, first = word_bounds(data, offsets, _NO_LETTER)
    words = hash_spans(data, starts, ends, lower=True)
    kinds = [words, *(hash_spans(data, starts, np.minimum(starts + n, ends), lower=True, seed=n) for n in PREFIXES)]
    return np.stack([(k % np.uint64(BUCKETS - 1)).astype(np.int64) + 1 for k in kinds], axis=1), words, first


def padded(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words with PAD empty rows after each text, and where each text begins."""
    begins = first[:-1] + PAD * np.arange(len(first) - 1)
    out = np.zeros((len(rows) + PAD * (len(first) - 1), rows.shape[1]), np.int64)
    out[np.arange(len(rows)) + PAD * rows_of(first)] = rows
    return out, begins


@dataclass
class Model:
    embeddings: np.ndarray
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    offset: float = 0.0
    slope: float = 1.0
    languages: tuple = ()
    vocabulary: np.ndarray = None
    weights: np.ndarray = None
    thresholds: np.ndarray = None

    def convolve(self, x: np.ndarray, width: int) -> np.ndarray:
        """Each filter's value at each word; windows reach into the padding, never into another text."""
        w, n = self.filters[width], len(x) - PAD
        return sum(x[j : n + j] @ w[j] for j in range(width))

    def margins(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        words, begins = padded(rows, first)
        table = self.embeddings
        x = sum(table[words[:, k]] for k in range(words.shape[1]))
        x = np.concatenate([x, np.zeros((PAD, DIMS), np.float32)])
        pooled = [np.maximum.reduceat(self.convolve(x, w), begins, axis=0) for w in WIDTHS]
        return np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0) @ self.out + self.offset

    def language(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each text the index of the language that its frequent words fit best."""
        votes = np.zeros((len(first) - 1, len(self.languages)))
        if len(self.vocabulary) and len(words):
            at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
            known = np.flatnonzero(self.vocabulary[at] == words)
            own = rows_of(first)[known]
            for k in range(len(self.languages)):
                votes[:, k] = np.bincount(own, self.weights[at[known], k], minlength=len(votes))
        return votes.argmax(axis=1)

    def scores(self, column: pa.Array) -> np.ndarray:
        data, offsets = utf8(column)
        out = [np.zeros(0)]
        for a, b in segments(offsets):
            rows, words, first = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            margin = self.margins(rows, first)
            at = self.thresholds[self.language(words, first)]
            out.append(1 / (1 + np.exp(-np.clip(self.slope * (margin - at) + np.log(PREDICTED_AT / (1 - PREDICTED_AT)), -30, 30))))
        return np.concatenate(out)


def train(texts: list[str], toxic: list[int], langs: list[str], seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    rows, words, first = features(*utf8(pa.array(texts, pa.large_string())))
    y = np.array(toxic, np.float32)
    model = Model(
        rng.normal(0, START, (BUCKETS, DIMS)).astype(np.float32),
        {w: rng.normal(0, 0.4, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS},
        np.zeros(len(WIDTHS) * FILTERS, np.float32),
        rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32),
    )
    model.embeddings[0] = 0
    fold = np.arange(len(y)) % 5 == 4
    learn = np.flatnonzero(~fold)
    sums = {k: np.full(v.shape, 1e-3, np.float32) for k, v in (("e", model.embeddings), ("b", model.bias), ("o", model.out), *((w, f) for w, f in model.filters.items()))}

    sums["e"] += DAMPING

    def step(name, value: np.ndarray, gradient: np.ndarray) -> None:
        sums[name] += gradient**2
        value -= RATE * gradient / np.sqrt(sums[name])

    for _ in range(max(EPOCHS, min(40, STEPS * BATCH // max(1, len(learn))))):
        for batch in np.array_split(rng.permutation(learn), max(1, len(learn) // BATCH)):
            spans = [np.arange(first[i], first[i + 1]) for i in batch]
            ends = np.concatenate(([0], np.cumsum([len(s) for s in spans])))
            seen = rows[np.concatenate(spans)]
            seen[rng.random(len(seen)) < DROPPED] = 0
            padded_rows, begins = padded(seen, ends)
            x = model.embeddings[padded_rows].sum(axis=1)
            x = np.concatenate([x, np.zeros((PAD, DIMS), np.float32)])
            padded_rows = np.concatenate([padded_rows, np.zeros((PAD, padded_rows.shape[1]), np.int64)])
            stops = np.append(begins[1:], len(x) - PAD)
            pooled, where = [], {}
            for w in WIDTHS:
                value = model.convolve(x, w)
                at = np.stack([a + value[a:b].argmax(axis=0) for a, b in zip(begins, stops, strict=True)])
                where[w] = at
                pooled.append(np.take_along_axis(value, at, axis=0))
            raw = np.concatenate(pooled, axis=1) + model.bias
            hidden = np.maximum(raw, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.offset, -30, 30)))
            error = (p - y[batch]) / len(batch)
            back = (error[:, None] * model.out) * (raw > 0)
            grads = {}
            touched, changes = [], []
            for n, w in enumerate(WIDTHS):
                part = back[:, n * FILTERS : (n + 1) * FILTERS]
                grads[w] = np.zeros_like(model.filters[w])
                for j in range(w):
                    seen = x[where[w] + j]  # texts x filters x dims
                    grads[w][j] = np.einsum("tf,tfd->df", part, seen)
                    change = part[:, :, None] * model.filters[w][j].T[None]
                    touched.append(padded_rows[where[w] + j].reshape(-1, padded_rows.shape[1]))
                    changes.append(change.reshape(-1, DIMS))
            rows_touched, changes = np.concatenate(touched), np.concatenate(changes)
            some = np.abs(changes).sum(axis=1) > 0
            ids, inverse = np.unique(rows_touched[some], return_inverse=True)
            gradient = np.zeros((len(ids), DIMS), np.float32)
            np.add.at(gradient, inverse.reshape(-1), np.repeat(changes[some], rows_touched.shape[1], axis=0))
            gradient[ids == 0] = 0
            sums["e"][ids] += gradient**2
            model.embeddings[ids] -= RATE * gradient / np.sqrt(sums["e"][ids])
            step("o", model.out, hidden.T @ error)
            step("b", model.bias, back.sum(axis=0))
            model.offset -= RATE * float(error.sum())
            for w in WIDTHS:
                step(w, model.filters[w], grads[w])
    _calibrate(model, rows, words, first, y, fold, langs)
    return model


def _calibrate(model: Model, rows, words, first, y, fold, langs) -> None:
    """Frequent words of each language, and for each language the threshold that errs least on the held fold."""
    own = rows_of(first)
    model.languages = tuple(sorted(set(langs)))
    of = np.array([model.languages.index(x) for x in langs])
    counts = [Counter(dict(zip(*(v.tolist() for v in np.unique(words[of[own] == k], return_counts=True)), strict=True))) for k in range(len(model.languages))]
    model.vocabulary = np.array(sorted({w for c in counts for w, _ in c.most_common(60)}), np.uint64)
    share = np.array([[(c[w] + 0.5) / (sum(c.values()) + 100) for c in counts] for w in model.vocabulary.tolist()]).reshape(-1, len(counts))
    model.weights = np.log(share)
    margin = model.margins(rows, first)
    told = model.language(words, first)

    def best(at: np.ndarray, least: int) -> float:
        m, t = margin[at], y[at] > 0
        if min(t.sum(), (~t).sum()) < least:
            return np.nan
        cuts = np.unique(m)
        cuts = np.concatenate(([cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]))
        wrong = np.array([(m[~t] >= c).mean() + (m[t] < c).mean() for c in cuts])
        good = cuts[wrong <= wrong.min() + 1e-12]
        return float((good[0] + good[-1]) / 2)

    every = best(np.flatnonzero(fold), 1)
    every = 0.0 if np.isnan(every) else every
    found = [best(np.flatnonzero(fold & (told == k)), CALIBRATED_ON) for k in range(len(model.languages))]
    model.thresholds = np.array([every if np.isnan(x) else x for x in found])


def crc(id_col: str) -> F.Column:
    """crc32 of an id's digits; a null id has none."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, label_col: str) -> list:
    """At most SAMPLE rows of each class, labelled and not held out."""
    allowed = labels.where(f"{id_col} is not null and {label_col} in (0, 1)").where(crc(id_col) % 3 != 1).groupBy(id_col).agg(F.max(label_col).cast("int").alias("toxic"))
    chosen = [allowed.where(F.col("toxic") == k).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE) for k in (0, 1)]
    some = chosen[0].unionByName(chosen[1])
    texts = docs.select(id_col, F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang")).where(F.length("text").between(1, SAMPLE_CHARS))
    return sorted(texts.join(F.broadcast(some), id_col).dropDuplicates([id_col]).select(id_col, "text", "lang", "toxic").collect(), key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> DataFrame:
    """One row for each input row: id, held_out, score, predicted."""
    rows = sample(docs, labels, id_col, text_col, lang_col, label_col)
    model = train([r["text"] for r in rows], [r["toxic"] for r in rows], [r["lang"] for r in rows]) if len({r["toxic"] for r in rows}) == 2 else None
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            found = np.zeros(len(text)) if held.value is None else held.value.scores(text)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(found, pa.float64())], ["id", "held_out", "score"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), (crc(id_col) % 3 == 1).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    scored = texts.mapInArrow(score, "id long, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", F.when(F.col("score") >= PREDICTED_AT, 1).otherwise(0).alias("predicted"))
