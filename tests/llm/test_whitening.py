"""Whitening against plain linear algebra, and on odd vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.q_whitening import op12_whitening
from tessera.llm.whitening import eigen, fit, fixed_point, identity_error, whiten

rng = np.random.default_rng(4)


@pytest.mark.parametrize("kind", ["random", "equal", "clusters", "diagonal", "graded", "low rank", "one", "two", "zero"])
def test_eigen(kind):
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    spectra = {"random": rng.random(40), "equal": np.full(40, 3.0), "clusters": np.repeat([9, 5, 1, 1e-3], 10) + 1e-13 * rng.random(40), "graded": 10.0 ** -np.arange(0, 10, 0.25), "low rank": np.append([5.0, 2.0], np.zeros(38))}
    small = {"one": np.array([[2.5]]), "two": np.array([[2.0, 1.0], [1.0, 2.0]]), "zero": np.zeros((5, 5)), "diagonal": np.diag(np.arange(12.0))}
    a = small[kind] if kind in small else (q * spectra[kind]) @ q.T
    a = (a + a.T) / 2
    values, z = eigen(a, 32)
    want = np.linalg.eigvalsh(a)[::-1][: len(values)]
    size = np.abs(a).max() or 1
    assert len(values) == min(32, len(a)) and np.abs(values - want).max() < 1e-13 * size * len(a)
    assert np.abs(z @ z.T - np.eye(len(z))).max() < 1e-9
    assert np.abs(z @ a - values[:, None] * z).max() < 1e-11 * size


def plain(own, k):
    """n, deviations, whitened, explained of the vectors by numpy's own solver and whole numbers."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in own]
    n, s = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(v, s)) for v in x]
    y = np.array([[(n * a - b) / n for a, b in zip(v, s)] for v in x])
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return n, deviation, y @ q / np.sqrt(e), e / np.trace(y.T @ y / n)


def table(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n int, deviation long").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_query(spark, tmp_path):
    own = (rng.standard_normal((900, 40)) * np.linspace(3, 0.5, 40)).astype(np.float32).tolist()
    odd = [None, [None] + own[0][1:], [float("nan")] + own[0][1:], [float("inf")] + own[0][1:], own[0][:7], [], [3e38] + own[0][1:]]
    rows = [(i, v, 1, 2, 3) for i, v in enumerate(own)] + [(5000 + i, v, 1, 2, 3) for i, v in enumerate(odd)]
    got = op12_whitening(spark, table(spark, tmp_path, rows)).toPandas()
    n, deviation, white, share = plain(own, 32)
    assert len(got) == 900 * 32 and set(got.n) == {n} and got.identity_error.max() < 1e-9
    got = got.sort_values(["vec_id", "component"])
    assert got.deviation.tolist() == [d for d in deviation for _ in range(32)]
    w = got.whitened.to_numpy().reshape(900, 32)
    assert np.abs(w * np.sign((w * white).sum(axis=0)) - white).max() < 1e-8
    assert np.abs(got.explained.to_numpy().reshape(900, 32) - share).max() < 1e-12


@pytest.mark.parametrize("rows", [[], [(1, None, 0, 0, 0)], [(1, [1.0, 2.0], 0, 0, 0)], [(1, [1.0, 2.0], 0, 0, 0)] * 3])
def test_no_component(spark, tmp_path, rows):
    out = op12_whitening(spark, table(spark, tmp_path, rows))
    assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_few_dimensions_repeats_and_null_ids(spark):
    rows = [(None, [4, 0]), (7, [0, 2]), (7, [0, 2]), (8, [0, 0])]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    model = fit(df, "id", "v")
    assert model.n == 4 and model.sums == (4, 4) and len(model.values) == 2
    assert identity_error(df, "id", "v", model) < 1e-12
    assert sorted((str(r.id), r.deviation) for r in whiten(df, "id", "v", model).collect()) == [("7", 32), ("7", 32), ("8", 32), ("None", 160)]


def test_far_from_zero(spark):
    far = [(i, [10**11 + int(a), 5 - int(b)]) for i, (a, b) in enumerate(rng.integers(0, 900, (500, 2)))]
    df = spark.createDataFrame([*far, (900, [2**39, 1])], "id long, v array<long>")
    near = spark.createDataFrame([(i, [a - 10**11, b]) for i, (a, b) in far], "id long, v array<long>")
    one, two = fit(df.where("id < 900"), "id", "v"), fit(near, "id", "v")
    assert np.array_equal(one.values, two.values)
    deviation = {r.id: r.deviation for r in whiten(df, "id", "v", fit(df, "id", "v")).collect()}
    assert deviation[900] is None and len(deviation) == 501


def test_fixed_point(spark):
    got = spark.sql("select array(0.51f, -0.01f) as v union all select array(cast('inf' as float)) union all select array(1e30f)").select(fixed_point(F.col("v"), 64, 100).alias("x")).collect()
    assert [r.x for r in got] == [[132, 99], None, None]
