"""Eigenpairs against a dense solver, whitened rows against plain numpy, odd tables."""

import math

import numpy as np
import pytest

from floeline.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int"


def matrices():
    pick = np.random.default_rng(3)
    for d in (1, 2, 3, 8, 40):
        a = pick.normal(size=(d, d))
        yield a @ a.T
    q = np.linalg.qr(pick.normal(size=(12, 12)))[0]
    yield q @ np.diag([5, 5, 5, 5, 2, 2, 1 + 1e-14, 1, 1e-3, 0, 0, 0]) @ q.T  # equal, close and zero eigenvalues
    yield np.diag([3.0, 1, 3, 1, 2])  # nothing off the diagonal
    yield np.eye(6)
    yield 1e-9 * np.diag([1.0, 2, 3]) + 1e-12
    yield np.zeros((4, 4))


@pytest.mark.parametrize("matrix", list(matrices()))
def test_principal(matrix):
    k = min(16, len(matrix))
    values, found = wh.principal(matrix, k)
    size = max(np.abs(matrix).max(), 1e-300)
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:k], rtol=1e-12, atol=1e-13 * size)
    assert np.abs(found.T @ found - np.eye(k)).max() < 1e-12
    assert np.abs(matrix @ found - found * values).max() <= 1e-12 * size


def test_tridiagonal_form_is_similar():
    a = np.random.default_rng(4).normal(size=(9, 9))
    a = a + a.T
    diagonal, off, reflectors = wh.tridiagonal(a)
    q = np.eye(9)
    for k, v in reversed(list(enumerate(reflectors))):
        q[k + 1 :] -= 2 * np.outer(v, v @ q[k + 1 :])
    t = np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1)
    assert np.allclose(q @ t @ q.T, a, atol=1e-12)


def test_sturm_counts():
    pick = np.random.default_rng(5)
    diagonal, off = pick.normal(size=20), pick.normal(size=19)
    off[7] = 0.0
    t = np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1)
    at = pick.uniform(-4, 4, 50)
    assert wh.sturm(diagonal, off, at).tolist() == [int((np.linalg.eigvalsh(t) < a).sum()) for a in at]


def plain(vectors):
    """Exact sums with whole numbers, eigenvectors by a dense solver."""
    x = [tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for v in vectors]
    fit = np.array(sorted(set(x)), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = np.array([[float((n * c - s) / n) for c, s in zip(r, sums, strict=True)] for r in fit])
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    rows = {}
    for r in set(x):
        dev = [n * c - s for c, s in zip(r, sums, strict=True)]
        rows[r] = sum(c * c for c in dev), np.array([c / n for c in dev]) @ u / np.sqrt(np.maximum(e, 1e-300))
    return x, n, e / np.trace(v), rows


def test_against_numpy(spark):
    pick = np.random.default_rng(6)
    vectors = (pick.normal(size=(300, 20)) * np.linspace(0.2, 6, 20)).astype(np.float32).tolist()
    vectors += [vectors[7]] * 200  # one very common vector
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], SCHEMA).repartition(5)
    found = wh.whitened(df).collect()
    x, n, explained, rows = plain(vectors)
    assert len(found) == 16 * len(vectors)
    signs = {}
    for r in found:
        deviation, projected = rows[x[r["vec_id"]]]
        k = r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation
        assert math.isclose(r["explained"], explained[k], rel_tol=1e-9)
        sign = signs.setdefault(k, 1 if r["whitened"] * projected[k] > 0 else -1)
        assert abs(r["whitened"] - sign * projected[k]) < 1e-8
        assert r["identity_error"] < 1e-10
    assert len({r["identity_error"] for r in found}) == 1


def test_odd_rows(spark):
    good = [[1.0, 2.0, 3.5], [0.0, -2.0, 3.5], [4.0, 0.5, 3.5], [1.0, 2.0, 3.5]]
    odd = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 1.0, 1.0], [1.0, 2.0]]
    rows = [(i, v) for i, v in enumerate([*good, *odd])] + [(None, [9.0, 9.0, 3.5])]
    df = spark.createDataFrame([(i, v, "c", "d", "e") for i, v in rows], "vec_id long, embedding array<double>, n string, component string, _x string")
    found = wh.whitened(df).collect()
    # the third entry has no spread: two components
    assert sorted((str(r["vec_id"]), r["component"]) for r in found) == sorted((k, c) for k in ["0", "1", "2", "3", "None"] for c in (1, 2))
    assert {r["n"] for r in found} == {4}


def test_no_spread_and_no_rows(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], SCHEMA)
    for df in (same, same.limit(0), same.where("vec_id = 1")):
        out = wh.whitened(df)
        assert out.count() == 0
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_beyond_64_bits_is_null(spark):
    df = spark.createDataFrame([(1, [1e7, 0.0], 0), (2, [3e9, 1.0], 0), (3, [5.0, 2.0], 0)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["deviation"] for r in wh.whitened(df).collect()}
    x = {k: [math.floor(64 * c) + 1_000_000 for c in v] for k, v in [(1, [1e7, 0.0]), (2, [3e9, 1.0]), (3, [5.0, 2.0])]}
    for k, v in x.items():
        want = sum((3 * v[i] - sum(o[i] for o in x.values())) ** 2 for i in (0, 1))
        assert got[k] == (want if want < 2**63 else None)
    assert None in got.values()
