"""Vantage-point trees: exact at factor 1, recall below it, ties and unusable vectors."""

import numpy as np
import pytest

from docketry.llm import vptree as V


def brute(rows, queries, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v)
            and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    out = {}
    for q, vec in good:
        if q not in queries:
            continue
        found = [(-float((v * vec).sum()), i) for i, v in good if i != q and len(v) == len(vec)]
        out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return out


def rows(n=400, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(20, dim))
    out = [(i, (base[i % 20] + rng.normal(scale=.3, size=dim)).astype(np.float32).tolist()) for i in range(n)]
    out += [(n + i, out[7][1]) for i in range(60)]          # one very common vector
    return out + [(1000, None), (1001, [0.0] * dim), (1002, [float("nan")] + [1.0] * (dim - 1)), (1003, [None] * dim),
                  (1004, [float("inf")] * dim), (None, [1.0] * dim), (1020, [1.0, 2.0]), (1021, [2.0, 1.0]), (1005, [])]


def answers(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.id, r.score))
    return out


@pytest.mark.parametrize("shard_rows,leaf,query_rows", [(100, 8, 7), (10_000, 300, 500)])
def test_factor_one_is_exact(spark, shard_rows, leaf, query_rows):
    data = rows()
    df = spark.createDataFrame(data, "i long, v array<float>").repartition(3)
    p = V.VantagePoint(k=20, factor=1.0, leaf=leaf, shard_rows=shard_rows, query_rows=query_rows)
    got = answers(V.nearest(df, df.where("i % 10 = 0"), p))
    want = brute(data, {i for i, _ in data if i is not None and i % 10 == 0}, 20)
    assert set(got) == {q for q, v in want.items() if v}
    for q, near in got.items():
        assert [i for i, _ in near] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in near], [s for _, s in want[q]], rtol=1e-12)


def test_recall_of_the_default_factor(spark):
    data = rows(3000, 32, 5)[:3000]
    df = spark.createDataFrame(data, "i long, v array<float>")
    got = answers(V.nearest(df, df.where("i % 20 = 0"), V.VantagePoint(shard_rows=1000, leaf=64)))
    want = brute(data, {i for i, _ in data if i % 20 == 0}, 20)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_empty_tables(spark):
    df = spark.createDataFrame([], "i long, v array<float>")
    one = spark.createDataFrame([(20, [1.0, 2.0])], "i long, v array<float>")
    assert V.nearest(df, df).collect() == [] and V.nearest(one, one).collect() == []
    assert V.nearest(one, df).collect() == [] and V.nearest(df, one).collect() == []


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])], "i long, v array<float>")
    assert [tuple(r) for r in V.nearest(df, df.where("i = 1")).collect()] == [(1, 1, 2, 1.0)]


@pytest.mark.parametrize("kind", ["one of ten times the norm", "log-normal", "one of a million times the norm"])
def test_all_neighbours_whatever_the_norms(spark, kind):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(40, 32))
    vectors = base[rng.integers(40, size=2000)] + rng.normal(scale=.4, size=(2000, 32))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    if kind == "log-normal":
        vectors *= rng.lognormal(sigma=.4, size=(2000, 1))
    else:
        vectors[17] *= 10 if "ten" in kind else 1e6
    data = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(data, "i long, v array<double>")
    got = answers(V.nearest(df, df.where("i % 40 = 0"), V.VantagePoint(shard_rows=1000, leaf=64)))
    want = brute(data, {i for i, _ in data if i % 40 == 0}, 20)
    assert {q: [i for i, _ in near] for q, near in got.items()} == {q: [i for i, _ in near] for q, near in want.items()}


@pytest.mark.parametrize("kind", ["binary", "ternary", "one_hot", "equal"])
def test_equal_scores_of_different_vectors(spark, kind):
    rng = np.random.default_rng(4)
    data = {"binary": rng.integers(0, 2, (900, 16)), "ternary": rng.integers(-1, 2, (900, 24)),
            "one_hot": np.eye(40, dtype=int)[rng.integers(0, 40, 900)], "equal": np.ones((900, 5), int)}[kind]
    data = [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(900), data, strict=True)]
    df = spark.createDataFrame(data, "i long, v array<float>")
    got = answers(V.nearest(df, df.where("i % 20 = 0"), V.VantagePoint(shard_rows=250, leaf=16)))
    want = brute(data, {i for i, _ in data if i % 20 == 0}, 20)
    assert got == {q: [(i, s) for i, s in near] for q, near in want.items()}
