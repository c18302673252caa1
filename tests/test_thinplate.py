"""Thin-plate basis against natural cubic smoothing splines and a dense solve."""

import numpy as np
import pytest

from tidelog.functions.splines import Spline
from tidelog.functions.thinplate import thin_plate, thin_plate_of

X = np.array([1.0, 2, 3, 4.5, 5, 6, 8, 9, 10, 11, 12])
Y = np.sin(X) + 0.1 * X


def smooth(basis, penalty, y, level):
    beta = np.linalg.solve(basis.T @ basis + level * penalty, basis.T @ y)
    return basis @ beta


@pytest.mark.parametrize("level", [1e-3, 0.1, 10.0])
def test_full_basis_is_the_cubic_smoothing_spline(level):
    plate, cubic = thin_plate(X, len(X)), Spline(tuple(X), "cr")
    want = smooth(cubic.matrix(X), cubic.penalty, Y, level)
    assert smooth(plate.matrix(X), plate.penalty, Y, level) == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("k", [3, 6, 10])
def test_truncated_basis_against_the_constrained_problem(k):
    plate, level = thin_plate(X, k), 0.05
    e = np.abs(X[:, None] - X[None, :]) ** 3 / 12
    w, u = np.linalg.eigh(e)
    u = u[:, np.argsort(-np.abs(w))[:k]]
    t = np.column_stack([np.ones_like(X), X])
    # unknowns: k radial weights, line, two multipliers of t'u d = 0
    a = np.block([[u.T @ e @ e @ u + level * u.T @ e @ u, u.T @ e @ t, u.T @ t], [t.T @ e @ u, t.T @ t, np.zeros((2, 2))], [t.T @ u, np.zeros((2, 4))]])
    z = np.linalg.lstsq(a, np.concatenate([u.T @ e @ Y, t.T @ Y, np.zeros(2)]), rcond=None)[0]
    assert plate.size == k
    assert smooth(plate.matrix(X), plate.penalty, Y, level) == pytest.approx(e @ u @ z[:k] + t @ z[k:k + 2], abs=1e-7)


def test_lines_have_no_penalty_and_slopes_are_derivatives():
    plate = thin_plate(X)
    assert np.linalg.matrix_rank(plate.penalty, tol=1e-9) == plate.size - 2 and np.linalg.eigvalsh(plate.penalty).min() > -1e-12
    x, h = np.linspace(0.3, 13.1, 40), 1e-5
    assert plate.matrix(x, 1) == pytest.approx((plate.matrix(x + h) - plate.matrix(x - h)) / (2 * h), abs=1e-6)


def test_columns_equal_the_matrix(spark):
    plate = thin_plate(X)
    x = [0.0, 1.0, 4.7, 13.0]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(x)], "m double, i int")
    for derivative in (0, 1):
        wide, names = plate.attach(df, "m", derivative)
        got = np.array([[r[n] for n in names] for r in wide.orderBy("i").collect()])
        assert got == pytest.approx(plate.matrix(x, derivative), abs=1e-12)


def test_values_from_a_column(spark):
    df = spark.createDataFrame([(v,) for v in [3, 1, 2, 2, None, 7]], "m int")
    assert thin_plate_of(df, "m").knots == (1.0, 2.0, 3.0, 7.0) and thin_plate_of(df, "m").size == 4
    with pytest.raises(ValueError):
        thin_plate_of(df.filter("m < 3"), "m")
