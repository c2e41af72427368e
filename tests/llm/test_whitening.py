import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, n string, whitened string"


def frame(spark, vectors, ids=None):
    ids = ids or range(len(vectors))
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "other", None) for i, v in zip(ids, vectors, strict=True)], SCHEMA).repartition(3)


def by_hand(vectors):
    x = np.floor(64 * np.asarray(vectors, np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    far = x * n - s
    v = (far.T.astype(object) @ far.astype(object)).astype(float) / n**3
    values, vectors_ = np.linalg.eigh(v)
    return x, n, far, v, values[::-1], vectors_[:, ::-1]


def test_against_eigenvectors(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(700, 12)) @ rng.normal(size=(12, 12)) * np.linspace(0.1, 3, 12)
    x, n, far, v, values, basis = by_hand(vectors)
    rows = W.by_component(W.whiten(frame(spark, vectors), components=7)).collect()
    assert len(rows) == 700 * 7 and {r["n"] for r in rows} == {700}
    for k in range(1, 8):
        mine = {r["vec_id"]: r for r in rows if r["component"] == k}
        want = (far / n) @ basis[:, k - 1] / math.sqrt(values[k - 1])
        got = np.array([mine[i]["whitened"] for i in range(700)])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-9
        assert mine[0]["explained"] == pytest.approx(values[k - 1] / np.trace(v), rel=1e-11)
    assert all(r["deviation"] == int((far[r["vec_id"]] ** 2).sum()) for r in rows)
    assert {r["identity_error"] for r in rows}.pop() < 1e-9


def test_factor_and_rotation():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(9, 5))
    v = a @ a.T
    factor = W.pivoted_cholesky(v)
    assert factor.shape == (9, 5) and np.allclose(factor @ factor.T, v)
    values, basis = W.one_sided_jacobi(factor)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:5]) and np.allclose(basis.T @ basis, np.eye(5), atol=1e-13)
    assert np.allclose(v @ basis, basis * values)


def test_odd_rows(spark):
    good = [[1, 2, 3], [2, 1, 5], [0, 7, 1], [4, 4, 4]]
    bad = [None, [None, 1, 2], [1, float("nan"), 2], [1, 2, float("-inf")], [1, 2], []]
    ids = [1, 1, None, 4, *range(5, 11)]
    got = W.whiten(frame(spark, good + bad, ids)).collect()
    _, n, far, _, values, _ = by_hand(good)
    assert len(got) == 4 and sorted(str(r["vec_id"]) for r in got) == ["1", "1", "4", "None"]
    assert sorted(r["deviation"] for r in got) == sorted(int(d) for d in (far**2).sum(axis=1)) and got[0]["n"] == 4
    assert len(got[0]["whitened"]) == 3 and got[0]["identity_error"] < 1e-9


def test_nothing_varies(spark):
    for vectors in ([], [[1, 2]], [[1, 2]] * 5, [None], [[]]):
        table = frame(spark, vectors)
        assert W.by_component(W.whiten(table)).collect() == []
    flat = W.whiten(frame(spark, [[1, 2, 5], [2, 4, 5], [3, 6, 5]])).collect()
    assert {len(r["whitened"]) for r in flat} == {1} and flat[0]["explained"] == [pytest.approx(1)]


def test_large_entries(spark):
    vectors = [[1e12, 1.0], [-3e12, 2.0], [2e12, 4.0]]
    got = W.whiten(frame(spark, vectors)).orderBy("vec_id").collect()
    x = [[int(c) for c in row] for row in np.floor(64 * np.asarray(vectors, np.float32).astype(np.float64))]
    s = [sum(c) for c in zip(*x, strict=True)]
    assert [r["deviation"] for r in got] == [min(sum((3 * c - t) ** 2 for c, t in zip(row, s, strict=True)), 2**63 - 1) for row in x]
    assert W.whiten(frame(spark, [[3e38, 1.0], [1.0, 2.0]])).agg(F.count("*")).first()[0] == 2
