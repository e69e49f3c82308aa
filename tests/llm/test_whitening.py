"""Whitening against a dense eigendecomposition, and awkward vectors."""

import math

import numpy as np
import pytest
from pricelens.llm import whitening

pytestmark = pytest.mark.usefixtures("shared_folder")
SCHEMA = "vec_id long, embedding array<float>"


def dense(x):
    """Fit size, centred rows of all, components and eigenvalues, exact deviations."""
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = (fit * n - s) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return n, (x * n - s) / n, values[::-1], vectors[:, ::-1], ((x * n - s) ** 2).sum(axis=1)


def integers(vectors):
    return np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors])


def agrees(got, ids, x, k):
    n, centred, values, vectors, deviation = dense(x)
    table = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(ids) * k
    for c in range(k):
        mine = np.array([table[i, c + 1].whitened for i in ids])
        want = centred @ vectors[:, c] / math.sqrt(values[c])
        assert np.abs(mine * np.sign(mine @ want) - want).max() < 1e-9
        assert abs(table[ids[0], c + 1].explained - values[c] / values.sum()) < 1e-9
    assert [table[i, 1].deviation for i in ids] == deviation.tolist()
    assert {r.n for r in got} == {n} and {r.identity_error for r in got}.pop() < 1e-9


def test_equals_dense_with_copies_and_bad_rows(spark):
    rng = np.random.default_rng(1)
    good = (rng.standard_normal((150, 24)) * np.linspace(2, 0.1, 24)).astype(np.float32).tolist()
    vectors = good + [good[0]] * 60 + [good[3]]
    rows = list(enumerate(vectors)) + [(900, None), (901, [None] * 24), (902, [float("nan")] + good[0][1:]), (903, [float("inf")] * 24),
                                       (904, []), (905, [0.5] * 23), (906, good[1][:5] + [None] + good[1][6:])]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as x", "2 as i", "3 as `meta.url`", "4 as payload")
    agrees(whitening.whiten(frame).collect(), list(range(len(vectors))), integers(vectors), 16)


def test_fewer_dimensions_than_components_and_constant_ones(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((40, 5)).astype(np.float32)
    v[:, 2] = 0.25
    got = whitening.whiten(spark.createDataFrame(list(enumerate(v.tolist())), SCHEMA)).collect()
    agrees(got, list(range(40)), integers(v.tolist()), 4)


def test_repeated_eigenvalues_are_all_found(spark):
    """Unit vectors up and down: five directions of one eigenvalue, another start finds each."""
    v = [[(1.0 if s else -1.0) * (k == j) * (2.0 if j == 0 else 1.0) for j in range(6)] for k in range(6) for s in (0, 1)]
    got = whitening.whiten(spark.createDataFrame(list(enumerate(v)), SCHEMA), wanted=6).collect()
    x = integers(v)
    n, _, values, _, _ = dense(x)
    explained = sorted({(r.component, r.explained) for r in got})
    assert len(explained) == 6 and np.allclose([e for _, e in explained], values / values.sum(), rtol=1e-9)
    y = np.array([[r.whitened for r in sorted(got, key=lambda r: r.component) if r.vec_id == i] for i in range(12)])
    assert np.abs(y.T @ y / n - np.eye(6)).max() < 1e-9


def test_bidiagonalise_confirms_with_fresh_starts():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((300, 80)))
    r, _ = np.linalg.qr(rng.standard_normal((80, 80)))
    spectrum = np.concatenate([[9, 9, 9, 7, 7], np.geomspace(5, 1e-3, 75)])
    x = (q * spectrum) @ r.T
    calls = []

    def product(w):
        u = x @ w
        calls.append(1)
        return x.T @ u, float(u @ u)

    values, rows = whitening.bidiagonalise(product, 80, 8)
    assert np.allclose(values, spectrum[:8], rtol=1e-10)
    assert np.allclose(np.linalg.norm(x @ rows.T, axis=0), values, rtol=1e-10)


def test_nothing_to_fit(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        got = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.collect() == []


def test_wide_entries_stay_exact(spark):
    v = [[float(10 ** k), -float(3 ** k), 0.5 * k] for k in range(12)]
    got = whitening.whiten(spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")).collect()
    x = [[math.floor(64 * c) + 1_000_000 for c in row] for row in v]
    sums = [sum(row[j] for row in x) for j in range(3)]
    want = {i: sum((12 * row[j] - sums[j]) ** 2 for j in range(3)) for i, row in enumerate(x)}
    assert {r.vec_id: r.deviation for r in got} == {i: d if d < 1 << 63 else None for i, d in want.items()}
