"""Refined eigenvectors on matrices of known spectrum; whitening against numpy and exact integers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tillroll.llm import queries, whitening

SPECTRA = {
    "plain": np.linspace(1, 64, 64),
    "repeated": [1, 1, 1, 2, 2, 3] + [5] * 10,
    "clusters": [1 + 1e-9 * i for i in range(10)] + [2 + 1e-12 * i for i in range(5)] + [7],
    "all close": [1 + 1e-5 * i for i in range(40)],
    "scales": [0] * 10 + [1e-8, 1, 1e8],
    "one": [3.0],
}


@pytest.mark.parametrize("name", SPECTRA)
def test_refined_eigen(name):
    values = np.sort(np.array(SPECTRA[name], np.longdouble))[::-1]
    n, rng = len(values), np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(n, n)))[0].astype(np.longdouble)
    for _ in range(2):
        q = q @ (1.5 * np.eye(n, dtype=np.longdouble) - (q.T @ q) / 2)
    a = q @ np.diag(values) @ q.T
    got, x = whitening.refined_eigen((a + a.T) / 2)
    assert np.abs(a @ x - x * got).max() < 1e-16 * values[0]
    assert np.abs(x.T @ x - np.eye(n)).max() < 1e-16
    assert np.abs(got - values).max() < 1e-16 * values[0]


def test_zero_matrix():
    values, x = whitening.refined_eigen(np.zeros((3, 3)))
    assert (values == 0).all() and (x == np.eye(3)).all()


def test_query_against_numpy(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = {r["vec_id"]: [math.floor(1024 * float(c)) + 100000 for c in r["embedding"]] for r in rows}
    n, sums = len(x), [sum(c) for c in zip(*x.values(), strict=True)]
    z = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in x.values()])
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = z @ vectors / np.sqrt(values)
    got = queries.op12_whitening(spark, sf).collect()
    assert len(got) == 8 * n and {r["component"] for r in got} == set(range(1, 9))
    at = {i: k for k, i in enumerate(x)}
    by = np.zeros((n, 8))
    for r in got:
        by[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x[r["vec_id"]], sums, strict=True))
        assert abs(r["explained"] / (values[r["component"] - 1] / values.sum()) - 1) < 1e-9
    sign = np.sign((by * want[:, :8]).sum(axis=0))
    assert np.abs(by * sign - want[:, :8]).max() < 1e-9


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, n string, component int")


def test_odd_input(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.0, 1.0]), (1, [0.5, 0.0, 1.0]), (2, [0.0, 0.25, 1.0]), (None, [0.1, 0.2, 1.0]), (4, None), (5, []),
            (6, [nan, 0.0, 0.0]), (7, [0.0, inf, 0.0]), (8, [0.0, None, 0.0]), (9, [1.0, 2.0]), (10, [0.0, 0.0, 1.0])]
    got = whitening.whiten(vectors_of(spark, rows)).collect()
    assert sorted(((r["vec_id"] or 0), r["component"]) for r in got) == sorted((i, k) for i in (1, 1, 2, 0, 10) for k in (1, 2, 3))
    assert {r["n"] for r in got} == {5}
    # the third dimension does not vary
    assert all((r["whitened"] is None) == (r["component"] == 3) for r in got)
    assert all(abs(sum(r["whitened"] for r in got if r["component"] == k)) < 1e-12 for k in (1, 2))
    assert max(r["identity_error"] for r in got) < 1e-12
    one = whitening.whiten(vectors_of(spark, [(3, [1.0, 2.0])])).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [
        (1, 0, None, 0.0, 0.0), (2, 0, None, 0.0, 0.0)]
    empty = whitening.whiten(vectors_of(spark, [(1, None)]))
    assert empty.count() == 0 and empty.columns == [*one[0].asDict()]


def test_values_of_any_size(spark):
    rows = [(i, [v, 1.0]) for i, v in enumerate([3e38, -3e38, 0.0, 1.0])]
    got = whitening.whiten(vectors_of(spark, rows), components=1).collect()
    assert len(got) == 4 and all(r["deviation"] is None for r in got if r["vec_id"] < 2)
    assert max(r["identity_error"] for r in got) < 1e-9


def test_close_variances(spark):
    """Two dimensions with nearly one variance: the components still whiten."""
    rng = np.random.default_rng(1)
    z = rng.normal(size=(400, 6)) * [1, 1 + 1e-7, 1, 0.5, 0.5, 2]
    got = whitening.whiten(vectors_of(spark, list(enumerate(z.tolist()))), components=6, scale=1 << 20)
    assert got.agg({"identity_error": "max"}).first()[0] < 1e-9


def test_dimensions_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MAX_DIMS", 2)
    with pytest.raises(ValueError):
        whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0, 3.0])]))
