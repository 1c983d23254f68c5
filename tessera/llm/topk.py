"""Exact top-k search by inner product with a three-phase uniform threshold.

A vector's dimensions are split into ``PARTS`` parts; each block of candidates and each part is a node
with its own list of partial scores, and a score is the sum over the parts.

1. Each node sends, for each query, the entries with its ``k`` highest partial scores. The k-th best
   of the exact scores of the entries that came is a safe cutoff: k candidates reach it.
2. The cutoff goes back with the queries. An entry whose score reaches cutoff C has a partial score
   of C / PARTS or more in some part, so nodes collect just those entries: they suffice.
3. For these the other part is bounded by the threshold where it isn't collected itself; what still
   can reach the cutoff is resolved exactly, and a node sends its k best.

Queries meet candidates in blocks: every query block is sent once to each of ``groups`` groups of
candidate blocks, by an equi-join on the group; there are no more groups than candidate blocks. Neither
side is broadcast, as a hint to merge says: Spark would judge a side by its size before it is copied to all
groups. Both can outgrow memory, and ties can't swell what is sent, since equal scores are ordered by id within a node too.

Components become floor(scale * x) as 32-bit floats, in which sums of products stay exact while a
vector's squared length is below 2**24; beyond, 64-bit floats take their place. Vectors that are null
or hold null or non-finite components take no part, nor do those with a null id; a vector of another
length than the one it meets has its missing components as zeros. Repeated ids are candidates each,
but one query. A query's own id is never its candidate. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.store import partitions, written

PARTS = 2
QUERY_ROWS, CANDIDATE_ROWS, TILE_ROWS = 1024, 8192, 4096
BLOCK = "block long, n int, dims int, ids binary, vectors binary"
ENTRY = "query_id long, vec_id long, score long"


def _block(rows: int, scale: float):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            vectors = batch.column("vector")
            lengths = np.diff(vectors.offsets.to_numpy())
            values = np.asarray(vectors.flatten().cast(pa.float64()).fill_null(np.nan))
            ids = batch.column("id").to_numpy()
            for dims in np.unique(lengths):
                own = np.flatnonzero(lengths == dims)
                starts = vectors.offsets.to_numpy()[:-1][own] - vectors.offsets[0].as_py()
                matrix = values[starts[:, None] + np.arange(dims)]
                fine = np.isfinite(matrix).all(axis=1)
                matrix, kept = np.floor(scale * matrix[fine]), ids[own][fine]
                for i in range(0, len(kept), rows):
                    part = np.ascontiguousarray(matrix[i : i + rows])
                    kind = np.float32 if part.size == 0 or float(np.abs(part).max()) ** 2 * max(1, dims) < 2**24 else np.float64
                    yield pa.RecordBatch.from_pydict(
                        {"block": pa.array([(task << 32) + count], pa.int64()), "n": pa.array([len(part)], pa.int32()), "dims": pa.array([dims], pa.int32()), "ids": [kept[i : i + rows].tobytes()], "vectors": [part.astype(kind).tobytes()]}
                    )
                    count += 1

    return build


def _matrix(n: int, dims: int, raw: bytes) -> np.ndarray:
    kind = np.float32 if len(raw) == 4 * n * dims else np.float64
    return np.frombuffer(raw, kind).reshape(n, dims)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _tiles(batches: Iterator[pd.DataFrame]):
    """Query ids and vectors, candidate ids and vectors, and cutoffs, of each pair of blocks, in tiles."""
    for frame in batches:
        for r in frame.itertuples():
            dims = max(r.dims, r.c_dims)
            q, c = _matrix(r.n, r.dims, r.vectors), _matrix(r.c_n, r.c_dims, r.c_vectors)
            q, c = (np.pad(m, ((0, 0), (0, dims - m.shape[1]))) for m in (q, c))
            qi, ci = np.frombuffer(r.ids, np.int64), np.frombuffer(r.c_ids, np.int64)
            cut = np.frombuffer(r.cutoffs, np.float64) if hasattr(r, "cutoffs") else None
            for i in range(0, len(ci), TILE_ROWS):
                yield qi, q, ci[i : i + TILE_ROWS], c[i : i + TILE_ROWS], cut


def _partial(q: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    edges = [q.shape[1] * p // PARTS for p in range(PARTS + 1)]
    return [q[:, a:b] @ c[:, a:b].T for a, b in zip(edges, edges[1:], strict=False)]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    columns = [np.concatenate(x) for x in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 3
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), (np.asarray(c, np.int64) for c in columns), strict=True)))


def _lists(k: int):
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for qi, q, ci, c, _ in _tiles(batches):
            parts = _partial(q, c)
            total, m = sum(parts), min(k + 1, len(ci))
            listed = np.zeros(total.shape, bool)
            for p in parts:
                np.put_along_axis(listed, np.argpartition(p, len(ci) - m, axis=1)[:, len(ci) - m :], True, axis=1)
            listed &= qi[:, None] != ci[None, :]
            rows = []
            for row, (query, which) in enumerate(zip(qi, listed, strict=True)):
                at = np.flatnonzero(which)
                at = at[_best(total[row, at], ci[at], k)]
                rows.append((np.full(len(at), query), ci[at], total[row, at]))
            yield _frame(rows)

    return send


def _collect(k: int):
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for qi, q, ci, c, cut in _tiles(batches):
            parts = _partial(q, c)
            least = np.ceil(cut / PARTS)[:, None]
            collected = [p >= least for p in parts]
            sufficient = np.logical_or.reduce(collected)
            bound = sum(np.where(known, p, least - 1) for p, known in zip(parts, collected, strict=True))
            sufficient &= (bound >= cut[:, None]) & (qi[:, None] != ci[None, :])
            rows = []
            for row in np.flatnonzero(sufficient.any(axis=1)):
                at = np.flatnonzero(sufficient[row])
                exact = sum(p[row, at] for p in parts)
                at, exact = at[exact >= cut[row]], exact[exact >= cut[row]]
                best = _best(exact, ci[at], k)
                rows.append((np.full(len(best), qi[row]), ci[at][best], exact[best]))
            yield _frame(rows)

    return send


def _with_cutoffs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Query blocks with their queries' cutoffs; a query of fewer than k candidates so far has none."""
    for frame in batches:
        cutoffs = []
        for ids, known in zip(frame["ids"], frame["known"], strict=True):
            cut = {r["query_id"]: r["cutoff"] for r in ([] if known is None else known)}
            cutoffs.append(np.array([cut.get(i, -np.inf) for i in np.frombuffer(ids, np.int64).tolist()], np.float64).tobytes())
        yield frame.drop(columns="known").assign(cutoffs=cutoffs)


def _explode_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        for block, ids in zip(frame["block"], frame["ids"], strict=True):
            yield pd.DataFrame({"query_id": np.frombuffer(ids, np.int64)}).assign(block=block)


def _top(entries: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return entries.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def top_k(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """For each query its k best candidates: query_id, rank from 1, vec_id, score."""
    plain = lambda d: d.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id is not null and vector is not null")
    candidates = written(plain(df).mapInArrow(_block(CANDIDATE_ROWS, scale), BLOCK), "candidates")
    blocks = written(plain(queries).dropDuplicates(["id"]).mapInArrow(_block(QUERY_ROWS, scale), BLOCK), "queries")
    groups = max(1, min(partitions(df.sparkSession), candidates.count()))
    held = candidates.select(F.pmod(F.xxhash64("block"), F.lit(groups)).alias("group"), *(F.col(c).alias(f"c_{c}") for c in candidates.columns))

    def meet(sent: DataFrame) -> DataFrame:
        every = sent.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>")))
        return every.join(held.hint("merge"), "group")

    lists = meet(blocks).mapInPandas(_lists(k), ENTRY)
    cutoffs = _top(lists, k).where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("cutoff"))
    asked = blocks.select("block", "ids").mapInPandas(_explode_ids, "query_id long, block long").join(cutoffs, "query_id")
    by_block = asked.groupBy("block").agg(F.collect_list(F.struct("query_id", "cutoff")).alias("known"))
    known = blocks.join(by_block.hint("merge"), "block", "left").mapInPandas(_with_cutoffs, f"{BLOCK}, cutoffs binary")
    found = _top(meet(written(known, "cutoffs")).mapInPandas(_collect(k), ENTRY), k)
    return found.select("query_id", "rank", F.col("vec_id").alias(id_col), "score")
