"""Whitening of vectors: distributed centred covariance, eigenvectors of it, broadcast projection.

1. Exact sums of all dimensions: each task adds its rows, Spark adds the tasks' sums as decimals.
2. Covariance: each task centres its rows by the exact mean (whole part and remainder apart, so that a
   large common offset costs no digits) and adds their products; Spark adds the entries of the tasks'
   upper triangles. A task sends d * (d + 1) / 2 numbers, however many rows it has.
3. On the driver, from d * d numbers: Householder reflections make the covariance tridiagonal, Sturm
   counts bisect for the leading eigenvalues, inverse iteration gives their vectors, which are made
   orthogonal again within clusters of near eigenvalues, and the reflections lead back.
4. The k * d components are broadcast, and each row is centred and projected where it is.

Vectors hold whole numbers (``fixed_point`` makes them), so sums don't hang on the order of tasks. Null
vectors take no part, nor do those with a null entry, one of 2**40 or more in size, or a length other
than the most frequent one (of equally frequent ones the greatest). Repeated rows and ids, ties and
null ids count as often as they stand. Components whose variance is at most 1e-12 of the first one's
can't be scaled to one and are left out; so no vectors, a single one, or equal ones give no component.
Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, RANK, CLUSTER = 1 << 40, 1e-12, 1e-3
EPS = float(np.finfo(float).eps)


def fixed_point(vector: Column, scale: int = 64, shift: int = 0) -> Column:
    """floor(scale * entry) + shift of each entry; null for vectors with an entry that is null, not finite or too large."""
    size = F.lit(float(LIMIT // 2) / scale)
    fits = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < size), F.lit(False)))
    return F.when(fits, F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long") + F.lit(shift)))


@dataclass(frozen=True)
class Model:
    """n vectors with these sums; the leading eigenvalues of their covariance, falling, a component a row."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    components: np.ndarray

    def offsets(self) -> tuple[np.ndarray, np.ndarray]:
        """The whole part of the mean and n times the rest."""
        whole = [s // self.n for s in self.sums]
        return np.array(whole, np.int64), np.array([s - self.n * w for s, w in zip(self.sums, whole)], np.int64)


def _rows(column: pa.Array) -> np.ndarray:
    d = len(column[0])
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def usable(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """id and v of the vectors that take part, and their length."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<long>").alias("v"))
    rows = rows.where("v is not null and size(v) > 0").where(F.forall("v", lambda x: F.coalesce(F.abs(x) < LIMIT, F.lit(False))))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = length.d if length else 0
    return rows.where(F.size("v") == d), d


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            v = _rows(batch.column(0))
            own = v.sum(axis=0).tolist()  # a batch's sum fits: fewer than 2**22 rows below 2**40
            n, total = n + len(v), own if total is None else [a + b for a, b in zip(total, own)]
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array(list(map(str, total)))], ["i", "n", "s"])


def centred(v: np.ndarray, model: Model) -> np.ndarray:
    whole, rest = model.offsets()
    return (v - whole).astype(float) - rest / model.n


def _products(rows: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The upper triangle of the sum of all outer products."""
    total = None
    for y in rows:
        total = y.T @ y if total is None else total + y.T @ y
    if total is not None:
        i, j = np.triu_indices(len(total))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "x"])


def _second_moments(rows: DataFrame, shape, d: int) -> np.ndarray:
    """The sum over all rows of the outer products of ``shape(v)``; d * d numbers come to the driver."""
    parts = rows.select("v").mapInArrow(lambda batches: _products(shape(_rows(b.column(0))) for b in batches if b.num_rows), "i int, j int, x double")
    out = np.zeros((d, d))
    for r in parts.groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.x
    return out


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and subdiagonal of the matrix after Householder reflections, and their unit vectors."""
    a, vectors = a.copy(), []
    for j in range(len(a) - 2):
        v = a[j + 1 :, j].copy()
        alpha = -np.copysign(np.linalg.norm(v), v[0])
        v[0] -= alpha
        size = np.linalg.norm(v)
        v = v / size if size else v
        sub = a[j + 1 :, j + 1 :]
        p = sub @ v
        w = p - (v @ p) * v
        sub -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[j + 1, j] = alpha
        vectors.append(v)
    return a.diagonal().copy(), a.diagonal(-1).copy(), vectors


def below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm count: for each x the number of eigenvalues below it."""
    tiny = np.finfo(float).tiny
    q, count = np.ones_like(x), np.zeros(len(x), int)
    with np.errstate(over="ignore"):  # an endless quotient only tells its sign
        for i, d in enumerate(diagonal):
            q = d - x - (off[i - 1] ** 2 / q if i else 0.0)
            q = np.where(np.abs(q) < tiny, -tiny, q)
            count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k greatest eigenvalues, falling, each bisected until no number lies between its bounds."""
    d = len(diagonal)
    reach = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    slack = EPS * np.abs(diagonal).max() + np.finfo(float).tiny
    low, high = np.full(k, (diagonal - reach).min() - slack), np.full(k, (diagonal + reach).max() + slack)
    above = d - np.arange(1, k + 1)  # so many are smaller than the one sought
    while True:
        mid = (low + high) / 2
        if ((mid <= low) | (mid >= high)).all():
            return mid
        over = below(diagonal, off, mid) > above
        low, high = np.where(over, low, mid), np.where(over, mid, high)


def _solver(diagonal: np.ndarray, off: np.ndarray, x: float, least: float):
    """Gaussian elimination with row exchanges of the tridiagonal matrix less x; pivots are ``least`` at least."""
    n = len(diagonal)
    steps, rows = [], []
    a, b = diagonal[0] - x, off[0] if n > 1 else 0.0
    for i in range(n - 1):
        under, nd, nu = off[i], diagonal[i + 1] - x, off[i + 1] if i + 2 < n else 0.0
        swap = abs(under) > abs(a)
        pivot = (under, nd, nu) if swap else (a if abs(a) > least else least, b, 0.0)
        low = (a, b, 0.0) if swap else (under, nd, nu)
        m = low[0] / pivot[0]
        steps.append((swap, m))
        rows.append(pivot)
        a, b = low[1] - m * pivot[1], low[2] - m * pivot[2]
    rows.append((a if abs(a) > least else least, 0.0, 0.0))

    def solve(y: np.ndarray) -> np.ndarray:
        y = y.copy()
        for i, (swap, m) in enumerate(steps):
            if swap:
                y[i], y[i + 1] = y[i + 1], y[i]
            y[i + 1] -= m * y[i]
        z = np.zeros(n + 2)
        for i in range(n - 1, -1, -1):
            p, u, w = rows[i]
            z[i] = (y[i] - u * z[i + 1] - w * z[i + 2]) / p
        return z[:n]

    return solve


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A unit vector a row for each value. Within a cluster each one is kept orthogonal to those before it."""
    size = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0)) or 1.0
    random, out, cluster, shift = np.random.default_rng(1), [], 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * size:
            cluster = k
        shift = min(value, shift - 10 * EPS * size) if k > cluster else value  # equal values need shifts of their own
        solve = _solver(diagonal, off, shift, EPS * size)
        z = random.standard_normal(len(diagonal))
        for _ in range(5):
            z = solve(z / np.abs(z).max())
            for _ in range(2):
                for w in out[cluster:]:
                    z = z - (w @ z) * w
            z /= np.linalg.norm(z)
        out.append(z)
    return np.array(out).reshape(len(values), len(diagonal))


def eigen(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues of a symmetric matrix, falling, and their unit vectors, one a row."""
    diagonal, off, vectors = tridiagonal(v)
    values = leading_values(diagonal, off, min(k, len(v)))
    z = inverse_iteration(diagonal, off, values)
    for j in range(len(vectors) - 1, -1, -1):
        part = z[:, j + 1 :]
        part -= 2 * np.outer(part @ vectors[j], vectors[j])
    return values, z


def fit(df: DataFrame, id_col: str, vector_col: str, k: int = 32) -> Model:
    """The model of all vectors: at most k components, falling in variance."""
    rows, d = usable(df, id_col, vector_col)
    sums = rows.select("v").mapInArrow(_sums, "i int, n long, s string").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    if not sums:
        return Model(0, (), 0.0, np.zeros(0), np.zeros((0, 0)))
    base = Model(sums[0].n, tuple(int(r.s) for r in sums), 0.0, np.zeros(0), np.zeros((0, d)))
    v = _second_moments(rows, lambda x: centred(x, base), d) / base.n
    values, components = eigen(v, k)
    kept = values > RANK * max(values[0], 0.0)
    return Model(base.n, base.sums, float(np.trace(v)), values[kept], components[kept])


def _deviations(v: np.ndarray, model: Model) -> list[int | None]:
    """The sum over dimensions of (n * x - S) ** 2, exact; null where it is over a long."""
    whole, rest = model.offsets()
    near = v - whole
    if model.n * (float(np.abs(near).max(initial=0)) + 1) < 2**31 / max(1, v.shape[1]) ** 0.5:
        return ((model.n * near - rest) ** 2).sum(axis=1).tolist()
    out: list[int | None] = [None] * len(v)
    for i in np.flatnonzero(((model.n * near.astype(float) - rest) ** 2).sum(axis=1) < 1e19):
        far = model.n * near[i].astype(object) - rest.astype(object)
        exact = int((far * far).sum())
        out[i] = exact if exact < 2**63 else None
    return out


def _projection(model: Model) -> np.ndarray:
    return (model.components / np.sqrt(model.values)[:, None]).T


def _projected(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            v = _rows(batch.column(1))
            white = centred(v, model) @ _projection(model)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * white.shape[1], pa.int32()), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_deviations(v, model), pa.int64()), lists], ["id", "deviation", "whitened"])


def whiten(df: DataFrame, id_col: str, vector_col: str, model: Model) -> DataFrame:
    """For each vector that takes part: id, deviation (n times off the mean, squared and summed), whitened, a number for each component."""
    rows, _ = usable(df, id_col, vector_col)
    kind = rows.schema["id"].dataType.simpleString()
    held = df.sparkSession.sparkContext.broadcast(model)
    out = rows.select("id", "v").mapInArrow(lambda batches: _projected(batches, held.value), f"id {kind}, deviation long, whitened array<double>")
    return out.withColumnRenamed("id", id_col)


def identity_error(df: DataFrame, id_col: str, vector_col: str, model: Model) -> float:
    """The largest entry of the whitened vectors' covariance less the identity; their mean is zero, as they are centred exactly."""
    rows, _ = usable(df, id_col, vector_col)
    k = len(model.values)
    held = df.sparkSession.sparkContext.broadcast(model)
    v = _second_moments(rows, lambda x: centred(x, held.value) @ _projection(held.value), k)
    return float(np.abs(v / model.n - np.eye(k)).max()) if k else 0.0
