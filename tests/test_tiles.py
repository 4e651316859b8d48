"""Tiled algebra against numpy: inverses, solutions, scalings of squares that one task wouldn't hold, here with small tiles."""

import numpy as np
import pandas as pd
import pytest

from sectora.operators import balance
from sectora.plans import elimination, kernels, krylov


@pytest.fixture(autouse=True)
def own_store(monkeypatch, tmp_path):
    """Inverses outlive a session where the shared folder does; tests begin without any."""
    monkeypatch.setattr(elimination, "shared_dir", lambda spark: str(tmp_path))


def frame(spark, x, rows=None, columns=None):
    rows, columns = (np.arange(n) if v is None else v for n, v in zip(x.shape, (rows, columns), strict=True))
    at = np.nonzero(x)
    return spark.createDataFrame(pd.DataFrame({"i": rows[at[0]], "j": columns[at[1]], "value": x[at]}), "i long, j long, value double")


def ids(spark, v):
    return spark.createDataFrame(pd.DataFrame({"id": v}))


def array(df, rows, columns):
    p, out = df.toPandas(), np.zeros((len(rows), len(columns)))
    out[np.searchsorted(rows, p["i"]), np.searchsorted(columns, p["j"])] = p["value"]
    return out


def labels(r, n):
    return np.sort(r.choice(10**9, n, replace=False))


@pytest.mark.parametrize(("n", "size", "kind"), [(26, 9, "any"), (14, 7, "permutation")])
def test_inverse_with_pivots(spark, n, size, kind):
    r = np.random.default_rng(n)
    rows, columns = labels(r, n), labels(r, n)
    x = r.normal(size=(n, n)) if kind == "any" else np.eye(n)[r.permutation(n)] * r.uniform(1, 2, n)
    found = elimination.factor(frame(spark, x, rows, columns), ids(spark, rows), ids(spark, columns), size)
    assert np.allclose(array(found.cells(), columns, rows), np.linalg.inv(x), rtol=1e-8, atol=1e-8)


@pytest.mark.parametrize("shape", [(9, 9), (9, 6)])
def test_singular_and_rectangular_blocks_get_the_pseudo_inverse(spark, shape):
    r = np.random.default_rng(5)
    x = np.linalg.qr(r.normal(size=(shape[0], 3)))[0] @ np.linalg.qr(r.normal(size=(shape[1], 3)))[0].T  # of rank 3
    rows, columns = np.arange(shape[0]), np.arange(shape[1])
    found = elimination.factor(frame(spark, x), ids(spark, rows), ids(spark, columns), 6)
    assert np.allclose(array(found.cells(), columns, rows), np.linalg.pinv(x), atol=1e-8)


def test_pivots_are_those_of_partial_pivoting():
    r = np.random.default_rng(2)
    x = r.normal(size=(90, 70))
    order, least = elimination.pivot_order(x)
    y, want = x.copy(), np.arange(90)
    for c in range(70):
        p = c + np.argmax(np.abs(y[c:, c]))
        y[[c, p]], want[[c, p]] = y[[p, c]], want[[p, c]]
        y[c + 1 :] -= np.outer(y[c + 1 :, c] / y[c, c], y[c])
    assert order.tolist() == want[:70].tolist() and np.isclose(least, np.abs(np.diag(y)).min())


def test_three_solutions_of_one_square_factor_it_once(spark):
    r = np.random.default_rng(6)
    n = 24
    a = r.random((n, n))
    a *= 1.7 / a.sum(0)  # a spectral radius of 1.7
    cells, every = frame(spark, a), spark.range(n)
    before = elimination.made
    for transposed, columns in ((False, 20), (True, 20), (False, 2)):
        b = r.normal(size=(n, columns))
        x = kernels.solve_on_tiles(cells, frame(spark, b), every, transposed, 10)
        m = np.eye(n) - a
        assert np.allclose(array(x, np.arange(n), np.arange(columns)), np.linalg.solve(m.T if transposed else m, b), atol=1e-8)
    assert elimination.made == before + 1
    assert np.allclose(array(kernels.inverse_on_tiles(cells, every, size=10), np.arange(n), np.arange(n)), np.linalg.inv(np.eye(n) - a), atol=1e-8)
    assert elimination.made == before + 1


@pytest.mark.parametrize("transposed", [False, True])
def test_few_right_sides_need_no_inverse(spark, transposed):
    r = np.random.default_rng(7)
    n = 30
    a = np.outer(r.random(n), r.random(n)) * 0.4 + np.diag(r.choice([0.1, 0.5, -2.0], n))  # few distinct eigenvalues, some beyond one
    b = np.stack([r.normal(size=n), np.zeros(n), np.eye(n)[3]], 1)
    before = elimination.made
    x = kernels.solve_on_tiles(frame(spark, a), frame(spark, b), spark.range(n), transposed, 11)
    m = np.eye(n) - a
    assert np.allclose(array(x, np.arange(n), np.arange(3)), np.linalg.solve(m.T if transposed else m, b), atol=1e-8)
    assert elimination.made == before


def test_searches_that_get_nowhere_fall_back(spark, monkeypatch):
    monkeypatch.setattr(krylov, "STEPS", 2)
    r = np.random.default_rng(8)
    a, b = r.normal(size=(20, 20)), r.normal(size=(20, 1))
    x = kernels.solve_on_tiles(frame(spark, a), frame(spark, b), spark.range(20), size=8)
    assert np.allclose(array(x, np.arange(20), np.arange(1)), np.linalg.solve(np.eye(20) - a, b), atol=1e-8)


def test_scaling_on_tiles_like_in_one_task(spark):
    r = np.random.default_rng(9)
    x = (r.random((11, 7)) + 0.5) * (r.random((11, 7)) < 0.9)
    x[4] = 0
    goal = x * r.uniform(0.8, 1.2, (11, 1)) * r.uniform(0.8, 1.2, 7)
    vector = lambda v: frame(spark, v[:, None])
    sides = vector(goal.sum(1)), vector(goal.sum(0))
    want = array(balance.ras(frame(spark, x), *sides), np.arange(11), np.arange(7))
    got = array(balance.on_tiles(frame(spark, x), *sides, 1e-6, size=6), np.arange(11), np.arange(7))
    assert np.allclose(got, want, atol=1e-5)
    assert np.allclose(got.sum(1), goal.sum(1), atol=1e-4) and np.allclose(got.sum(0), goal.sum(0), atol=1e-4)
