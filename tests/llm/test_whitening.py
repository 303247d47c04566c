"""Whitening against numpy's eigenvectors and exact whole numbers."""

import math

import numpy as np
import pytest

from docketry.llm import queries
from docketry.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows):
    """Exact deviations, eigenvalues and components of usable rows."""
    kept = [(k, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for k, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(x) for _, x in kept]
    width = max(sorted(set(lengths)), key=lengths.count)
    kept = [(k, x) for k, x in kept if len(x) == width]
    fit_list = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit_list), [sum(c) for c in zip(*fit_list, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in fit_list])
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    deviations = [(k, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))) for k, x in kept]
    return n, sums, deviations, values[::-1], directions[:, ::-1], kept


def random_rows(count, width, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(width, width)) * np.geomspace(1, 0.05, width)
    vectors = (rng.normal(size=(count, width)) @ mix.T * scale).astype(np.float32)
    return [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]


def check(spark, rows, components=16):
    frame = spark.createDataFrame(rows, SCHEMA)
    model = W.fit(frame, components)
    n, sums, deviations, values, directions, kept = brute(rows)
    assert model.n == n and model.sums == sums
    count = min(components, int((values > 1e-12 * values[0] * len(values)).sum()))
    assert len(model.eigenvalues) == count
    np.testing.assert_allclose(model.eigenvalues, values[:count], rtol=1e-9)
    np.testing.assert_allclose(model.explained, values[:count] / values.sum(), rtol=1e-9)
    assert model.identity_error < 1e-9
    got = W.transform(frame, model).collect()
    assert sorted((r.vec_id, r.deviation) for r in got) == sorted((k, d if d < 2**63 else None) for k, d in deviations)
    by_id = {r.vec_id: r.whitened for r in got}
    for k, x in kept:
        want = ((np.array(x) - 1_000_000) - (np.array(sums) / n - 1_000_000)) @ directions[:, :count] / np.sqrt(values[:count])
        np.testing.assert_allclose(np.abs(by_id[k]), np.abs(want), rtol=1e-5, atol=1e-6)
    return model


def test_like_numpy(spark):
    check(spark, random_rows(400, 24, 1))
    check(spark, random_rows(300, 5, 2, 30.0))
    check(spark, random_rows(60, 17, 3), components=4)


def test_odd_vectors(spark):
    rows = random_rows(50, 6, 4)
    rows += [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (103, [float("nan")] * 6),
             (104, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (105, [1.0, 2.0]), (None, rows[0][1]), (7, rows[7][1]),
             (106, rows[3][1]), (107, [0.0] * 6)]
    model = check(spark, [r for r in rows if r[0] is not None])
    frame = spark.createDataFrame(rows, SCHEMA)
    assert W.fit(frame).n == model.n == 51
    told = [r.vec_id for r in W.transform(frame, model).collect()]
    assert len(told) == 54 and told.count(7) == 2 and None in told


def test_low_rank(spark):
    base = np.random.default_rng(5).integers(-4, 5, size=(80, 2))
    vectors = np.column_stack([base, base.sum(1), np.full(80, 3), base[:, 0] * 2]).astype(float)
    model = check(spark, [(i, v.tolist()) for i, v in enumerate(vectors)])
    assert len(model.eigenvalues) == 2
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)
    model = W.fit(one)
    assert model.n == 1 and [(r.deviation, r.whitened) for r in W.transform(one, model).collect()] == [(0, [])] * 2


def test_large_entries(spark):
    rows = [(i, [float(2.0**40 * (i % 7)), float(i)]) for i in range(30)] + [(99, [3.0e38, -3.0e38])]
    frame = spark.createDataFrame(rows, SCHEMA)
    model = W.fit(frame)
    got = {r.vec_id: r.deviation for r in W.transform(frame, model).collect()}
    assert model.n == 31 and len(got) == 31 and got[99] is None


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert W.transform(empty, W.fit(empty)).count() == 0
    frame = spark.createDataFrame([(i, [float(i), 1.0 - i * i], "x", 2.0) for i in range(5)],
                                  SCHEMA + ", deviation string, whitened double")
    assert W.transform(frame, W.fit(frame)).columns == ["vec_id", "deviation", "whitened"]
    with pytest.raises(ValueError, match="id column"):
        W.transform(frame, W.fit(frame), id="deviation")


def test_equal_eigenvalues_and_wide_factors():
    values, directions = W.jacobi(W.pivoted_cholesky(np.diag([2.0, 5.0, 5.0, 5.0])))
    np.testing.assert_allclose(values, [5, 5, 5, 2])
    rng = np.random.default_rng(8)
    half = rng.normal(size=(90, 90)) * np.geomspace(1, 1e-4, 90)
    a = half @ half.T
    factor = W.pivoted_cholesky(a)
    np.testing.assert_allclose(factor @ factor.T, a, atol=1e-12)
    values, directions = W.jacobi(factor)
    np.testing.assert_allclose(values, np.linalg.eigvalsh(a)[::-1][:len(values)], rtol=1e-6, atol=1e-12)
    np.testing.assert_allclose(directions.T @ directions, np.eye(len(values)), atol=1e-9)


def test_registered_query(spark):
    got = queries.op12_whitening(spark, "/root/testdata/sf0.001").collect()
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    n, _, deviations, values, _, kept = brute(rows)
    assert len(got) == 16 * len(kept) and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 17))
    assert {(r.vec_id, r.deviation) for r in got} == set(deviations)
    for c in range(1, 17):
        share = {r.explained for r in got if r.component == c}
        assert len(share) == 1 and abs(share.pop() / (values[c - 1] / values.sum()) - 1) < 1e-9
    assert {r.identity_error for r in got}.pop() < 1e-4
