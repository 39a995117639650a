"""FEAST against a dense solver; whitening against its definition."""

import math

import numpy as np
import pytest

from copperbook.llm import feast, whitening
from copperbook.llm.common import table


def spectrum(values, seed=0):
    size = len(values)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))[0]
    matrix = (basis * np.asarray(values, float)) @ basis.T
    return (matrix + matrix.T) / 2


CASES = {
    "spread": np.arange(1, 41.0),
    "decades": 10.0 ** np.linspace(-6, 6, 40),
    "double": np.repeat(np.arange(1, 11.0), 4),
    "one value": np.full(20, 3.0),
    "low rank": np.concatenate((np.arange(1, 6.0), np.zeros(30))),
    "close": np.concatenate((1 + 1e-9 * np.arange(20), [0.5, 0.25])),
    "crowd": 1 + 0.01 * np.random.default_rng(1).random(100),
    "single": np.array([2.5]),
    "tiny": 1e-200 * np.arange(1, 9.0),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("most", [1, 7, 32])
def test_largest(name, most):
    matrix = spectrum(CASES[name])
    values, vectors = feast.largest(matrix, most)
    want = np.sort(CASES[name])[::-1]
    want = want[want > 1e-11 * want.max()][:most]
    assert len(values) == len(want)
    assert np.allclose(values, want, rtol=1e-9, atol=1e-13 * want.max())
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-12 * want.max()


def test_counts():
    matrix = spectrum(CASES["spread"])
    parts = feast.tridiagonal(matrix)
    assert [feast.count_above(*parts, s) for s in (0, 0.5, 1.5, 39.5, 40.5)] == [40, 40, 39, 1, 0]
    assert feast.largest(np.zeros((4, 4)), 3)[0].size == 0


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def expected(vectors, most=32):
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in x])
    spread = centred.T @ centred / n
    values, basis = np.linalg.eigh(spread)
    order = [k for k in np.argsort(-values) if values[k] > 1e-12 * values.max()][:most]
    white = centred @ (basis[:, order] / np.sqrt(values[order]))
    return [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x], white, values[order] / np.trace(spread)


def compare(found, ids, vectors):
    deviations, white, explained = expected(vectors)
    k = white.shape[1]
    assert len(found) == len(ids) * k
    by = {(r.vec_id, r.component): r for r in found}
    got = np.array([[by[i, c + 1].whitened for c in range(k)] for i in ids])
    assert np.abs(np.abs(got) - np.abs(white)).max() < 1e-6
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got * signs - white).max() < 1e-6
    for i, d in zip(ids, deviations):
        assert all(by[i, c + 1].deviation == d and by[i, c + 1].n == len(ids) for c in range(k))
    assert np.allclose([by[ids[0], c + 1].explained for c in range(k)], explained, rtol=1e-9)
    assert {r.identity_error for r in found} == {found[0].identity_error}
    assert found[0].identity_error < 1e-9


def test_table(spark, sf_dir):
    source = table(spark, sf_dir, "embeddings")
    rows = source.collect()
    compare(whitening.whiten(source).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    vectors = [[1.5, 0.0, -2.0], *rng.standard_normal((20, 3)).round(2).tolist(), [1.5, 0.0, -2.0]]
    good = list(enumerate(vectors))
    bad = [
        (100, None),
        (101, []),
        (102, [1.0, None, 2.0]),
        (103, [1.0, float("nan"), 2.0]),
        (104, [float("inf"), 0.0, 0.0]),
        (105, [1.0, 2.0]),
        (106, [1e300, 0.0, 0.0]),
    ]
    df = rows_of(spark, good + bad).selectExpr("*", "'a' AS x", "1 AS v", "2 AS component", "3 AS n")
    compare(whitening.whiten(df).collect(), [i for i, _ in good], vectors)


def test_null_id_stays(spark):
    rows = [(None, [0.0, 1.0]), (1, [3.0, 0.5]), (1, [3.0, 0.5])]
    found = whitening.whiten(rows_of(spark, rows)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in found) == [(0, 1), (1, 1), (1, 1)]


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_no_components(spark, rows):
    assert whitening.whiten(rows_of(spark, rows)).collect() == []


def test_large_entries_stay_exact():
    sums = [3 * 2**46 + 1, 5]
    centre = whitening._Centre(3, sums)
    x = np.array([[2**46, 1], [2**46 + 1, 4], [2**46, 0]])
    want = [sum((3 * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    assert centre.deviations(x) == want
    far = np.array([[0, 0]])
    assert centre.deviations(far) == [None]
