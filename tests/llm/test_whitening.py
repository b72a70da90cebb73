"""Whitening against a dense eigensolver and exact sums."""

import math

import numpy as np
import pytest

from latticework.llm import whitening
from latticework.llm.queries import LLM_QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("kind", ["random", "equal", "blocks", "low rank", "close"])
def test_components_of_symmetric_matrices(kind):
    rng = np.random.default_rng(7)
    d = 40
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = {"random": rng.random(d), "equal": np.repeat([3.0, 2.0, 1.0, 0.5], 10), "blocks": np.arange(d, dtype=float),
              "low rank": np.concatenate([[9.0, 5.0], np.zeros(d - 2)]), "close": 1 + 1e-9 * np.arange(d)}[kind]
    matrix = np.diag(values) if kind == "blocks" else (q * values) @ q.T
    matrix = 1e4 * (matrix + matrix.T) / 2
    found, vectors = whitening.leading_components(matrix, 12)
    assert np.allclose(found, np.linalg.eigvalsh(matrix)[::-1][:12], rtol=0, atol=1e-10 * np.abs(matrix).max() * d)
    assert np.abs(vectors.T @ vectors - np.eye(12)).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-12 * d * np.abs(matrix).max()


def test_small_matrices():
    for d in (1, 2, 3):
        matrix = np.diag(np.arange(1.0, d + 1))
        found, vectors = whitening.leading_components(matrix, 5)
        assert np.allclose(found, np.arange(d, 0, -1)) and np.allclose(np.abs(vectors), np.eye(d)[::-1])
    assert np.allclose(whitening.leading_components(np.zeros((3, 3)), 2)[0], 0)


def _run(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return LLM_QUERIES["op11_embedding_whitening"](spark, str(tmp_path))


def test_query_equals_a_dense_solver(spark, tmp_path):
    rng = np.random.default_rng(1)
    mix = rng.standard_normal((40, 40)) / 40
    vectors = (rng.standard_normal((3_000, 40)) @ mix).astype(np.float32)
    vectors[5:9] = vectors[5]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    odd = [(-1, None, 1), (-2, [math.nan] * 40, 1), (-3, [None] + [0.1] * 39, 1), (-4, [math.inf] + [0.1] * 39, 1),
           (-5, [], 1), (-6, [1.0] * 39, None)]
    found = _run(spark, tmp_path, rows + odd)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = found.toPandas().sort_values(["vec_id", "component"])
    x = np.floor(64 * vectors.astype(float)).astype(np.int64) + 1_000_000
    n = len(x)
    assert (found.n == n).all() and len(found) == 32 * n and set(found.vec_id) == set(range(n))
    assert found.identity_error.nunique() == 1 and found.identity_error.iloc[0] < 1e-9
    deviation = ((n * x - x.sum(axis=0)) ** 2).sum(axis=1)
    assert (found.deviation.to_numpy().reshape(n, 32) == deviation[:, None]).all()
    centred = x - x.mean(axis=0)
    values, components = np.linalg.eigh(centred.T @ centred / n)
    values, components = values[::-1][:32], components[:, ::-1][:, :32]
    assert np.allclose(found.explained.to_numpy().reshape(n, 32), values / np.trace(centred.T @ centred / n), rtol=1e-8)
    want, got = centred @ components / np.sqrt(values), found.whitened.to_numpy().reshape(n, 32)
    assert np.abs(got - want * np.sign((got * want).sum(axis=0))).max() < 1e-7


def test_few_and_no_vectors(spark, tmp_path):
    assert _run(spark, tmp_path / "none", []).count() == 0
    assert _run(spark, tmp_path / "null", [(1, None, 0), (2, [], 0)]).count() == 0
    assert _run(spark, tmp_path / "equal", [(1, [0.5, 0.25], 0)] * 3).count() == 0
    two = _run(spark, tmp_path / "two", [(1, [0.0, 0.0], 0), (2, [1.0, 0.0], 0), (None, [0.0, 0.0], 0)]).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation) for r in two} == {(1, 1, 3, 64 ** 2), (2, 1, 3, 128 ** 2), (None, 1, 3, 64 ** 2)}


def test_deviations_beyond_a_long_are_null():
    model = whitening.Whitening(10 ** 9, np.array([10 ** 15]), np.ones(1), np.ones((1, 1)), 1.0)
    assert model.deviations(np.array([[10 ** 6 + 3], [10 ** 6 + 4]])) == [9 * 10 ** 18, None]


def test_other_columns_may_clash(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0], 5, "x"), (2, [1.0, 0.0], 6, "y"), (2, [1.0, 0.0], 6, "y")],
                                 "vec_id long, embedding array<double>, n int, whitened string")
    got = whitening.whiten(rows, whitening.fit(rows), keep=["vec_id"])
    assert got.columns == ["vec_id", "deviation", "whitened"] and got.count() == 3
