"""Tails of weighted chi-squared sums against closed and simulated cases; fractional-rank tests of smooths."""

import math

import numpy as np
import pytest

from tidelog.functions.distributions import f_upper_tail, quadratic_upper_tail, smooth_tail
from tidelog.functions.splines import Spline
from tidelog.operators.linear import Cells
from tidelog.operators.seasonal import SeasonModel


@pytest.mark.parametrize("x", [0.1, 1.0, 5.0, 12.0])
def test_equal_weights_are_chi_squared(x):
    assert quadratic_upper_tail(x, [1.0, 1.0]) == pytest.approx(math.exp(-x / 2), abs=2e-6)
    assert quadratic_upper_tail(x * 3, [3.0] * 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2), abs=2e-6)
    assert quadratic_upper_tail(x, [1.0]) == pytest.approx(math.erfc(math.sqrt(x / 2)), abs=3e-5)


@pytest.mark.parametrize("x", [40.0, 80.0])
def test_far_tail_keeps_its_relative_size(x):
    assert quadratic_upper_tail(x, [1.0] * 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2), rel=0.02)


@pytest.mark.parametrize("weights,dofs", [([1.0, 0.7, 0.2], [1, 1, 1]), ([2.0, 1.0, -0.5], [1, 3, 2]), ([1.0, 1.0, 0.9, 0.3, -0.02], [1, 1, 1, 1, 100])])
def test_mixed_weights_against_simulation(weights, dofs):
    r = np.random.default_rng(5)
    q = sum(w * r.chisquare(h, 1_000_000) for w, h in zip(weights, dofs))
    for x in np.quantile(q, [0.02, 0.3, 0.7, 0.95, 0.999]):
        want = (q > x).mean()
        assert quadratic_upper_tail(float(x), weights, dofs) == pytest.approx(want, abs=4 * math.sqrt(want * (1 - want) / len(q)) + 1e-5)


def test_impossible_and_certain():
    assert quadratic_upper_tail(1.0, [-1.0, -2.0]) == 0.0 and quadratic_upper_tail(-1.0, [1.0]) == 1.0 and quadratic_upper_tail(-1.0, []) == 1.0


def test_smooth_tail_joins_the_whole_ranks():
    assert smooth_tail(12.0, 3.0, 50.0) == pytest.approx(f_upper_tail(4.0, 3, 50.0))
    below, between, above = (smooth_tail(12.0, r, 50.0) for r in (3.0, 3.5, 4.0))
    assert below < between < above
    assert smooth_tail(12.0, 3.0001, 50.0) == pytest.approx(below, rel=2e-2) and smooth_tail(float("nan"), 2.0, 5.0) is None


def season(rng, amplitude, per_month=8):
    month = np.arange(1.0, 13.0)
    y = amplitude * np.cos(np.pi * (month - 7) / 6)[:, None] + rng.normal(size=(12, per_month))
    return Cells(["all"], np.zeros(12, int), month, np.full(12, float(per_month)), y.sum(1), (y**2).sum(1), np.full(12, np.nan))


def test_p_values_are_rarely_small_without_a_season_and_small_with_one():
    rng, spline, p = np.random.default_rng(2), Spline.even(1.0, 12.0, 10, "cc"), []
    for _ in range(300):
        model = SeasonModel(season(rng, 0.0), "pooled", "gaussian", spline)
        (_, rank, plus, minus), = model.fractional_tests()
        p.append(np.mean([smooth_tail(s, rank, model.fit.df_residual) for s in (plus, minus)]))
    # a smooth that is shrunk away altogether has p near 1, so the test keeps below its level
    assert 0.005 < np.mean(np.array(p) < 0.05) < 0.07
    model = SeasonModel(season(rng, 1.0), "pooled", "gaussian", spline)
    (_, rank, plus, minus), = model.fractional_tests()
    assert 1 < rank <= 8 and max(smooth_tail(s, rank, model.fit.df_residual) for s in (plus, minus)) < 1e-5


def test_statistic_is_the_quadratic_form_of_its_rank():
    rng = np.random.default_rng(7)
    model = SeasonModel(season(rng, 0.7), "pooled", "gaussian", Spline.even(1.0, 12.0, 10, "cc"))
    (_, rank, plus, minus), = model.fractional_tests()
    _, start, z = model.blocks[0]
    x = model.design[:, start:start + z.shape[1]] * np.sqrt(model.cells.n)[:, None]
    f, cov = x @ model.fit.beta[start:], x @ model.fit.cov[start:, start:] @ x.T
    w, v = np.linalg.eigh(cov)
    w, v = w[::-1], v[:, ::-1]
    k, part = int(rank), rank - int(rank)
    half = math.sqrt(part * (1 - part) / 2)
    forms = []
    for sign in (1, -1):
        middle = np.diag(np.concatenate([np.ones(k), [part]]))
        middle[k - 1, k] = middle[k, k - 1] = sign * half
        root = v[:, :k + 1] / np.sqrt(w[:k + 1])
        forms.append(float(f @ root @ middle @ root.T @ f))
    assert sorted(forms) == pytest.approx(sorted((plus, minus)), rel=1e-6)
