"""Pairs of sets of one group that may share enough of the smaller one, met by rare tokens and compared by signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = 1 << 20
WORDS = 4
_POSTING = "key long, p long, n int, i int, " + ", ".join(f"s{k} long" for k in range(WORDS))


def _counts(sets: DataFrame) -> np.ndarray:
    """How often the tokens of each of CELLS cells occur; 4 MB, whatever the table. How exact it is moves cost, never results."""
    cells = sets.select(F.explode("h").alias("h")).groupBy(F.col("h").bitwiseAND(F.lit(CELLS - 1)).alias("cell")).agg(F.count("*").alias("d"))
    found, out = cells.toArrow(), np.zeros(CELLS, np.uint32)  # CELLS rows at most
    out[found.column("cell").to_numpy()] = np.minimum(found.column("d").to_numpy(), np.iinfo(np.uint32).max)
    return out


def _postings(counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, one = counts.value, np.uint64(1)
        for batch in batches:
            n = pc.list_value_length(batch.column("h")).to_numpy(zero_copy_only=False).astype(np.int64)
            row, h = np.repeat(np.arange(len(n)), n), batch.column("h").flatten().to_numpy()
            h = h[np.lexsort((h, table[h & (CELLS - 1)], row))].view(np.uint64)
            bit = (h >> np.uint64(20)) % np.uint64(64 * WORDS)
            signs = np.zeros((len(n), WORDS), np.uint64)
            np.bitwise_or.at(signs, (row, (bit // np.uint64(64)).astype(np.int64)), one << (bit % np.uint64(64)))
            key = (h ^ batch.column("g").to_numpy().view(np.uint64)[row]).view(np.int64)
            place = np.arange(1, len(h) + 1) - np.repeat(np.cumsum(n) - n, n)
            columns = [key, batch.column("p").to_numpy()[row], n[row].astype(np.int32), place.astype(np.int32), *(signs[row, k].view(np.int64) for k in range(WORDS))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "p", "n", "i", *(f"s{k}" for k in range(WORDS))])

    return run


def candidates(sets: DataFrame, share: float) -> DataFrame:
    """Distinct p, q: sets of one group of which q, no smaller, may hold ``share`` of p; every such pair is among them.

    ``sets``: g (a hash of the group), p, h (hashes of the distinct tokens). Of two alike sets, one of the rarest tokens
    of the smaller is in the larger, and what follows it in each leaves enough to share. Each token carries its
    set's signature of 256 bits: a bit that only the smaller has is a token that only it has. So sets
    that share a token end in the join, unwritten, unless their signatures leave them alike.
    """
    counts = sets.sparkSession.sparkContext.broadcast(_counts(sets))
    ranked = sets.select("g", "p", "h").mapInArrow(_postings(counts), _POSTING)
    need = F.floor(F.col("n") * share).cast("int")  # rounding down: what is left is compared in full later
    small = ranked.withColumn("need", need).where(F.col("i") <= F.col("n") - F.col("need") + 1).drop("i")
    large = ranked.select("key", F.col("p").alias("q"), F.col("n").alias("m"), F.col("i").alias("j"), *(F.col(f"s{k}").alias(f"t{k}") for k in range(WORDS)))
    own = sum((F.bit_count(F.col(f"s{k}").bitwiseAND(F.bitwise_not(f"t{k}"))) for k in range(WORDS)), F.lit(0))
    fit = ((F.col("n") < F.col("m")) | (F.col("n") == F.col("m")) & (F.col("p") < F.col("q"))) & (F.col("m") - F.col("j") + 1 >= F.col("need")) & (F.col("n") - own >= F.col("need"))
    return large.join(small, (large["key"] == small["key"]) & fit).select("p", "q").distinct()
