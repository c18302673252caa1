"""Single-step p values against closed and simulated cases."""

import math

import numpy as np
import pytest

from tidelog.operators.simultaneous import directions, radius_tail, tukey_pairs
from tidelog.operators.siteblocks import SiteFit, Summary


def site_fit(spark, rows, scale=1.0, df=1000.0):
    sites = spark.createDataFrame(rows, "site string, a double, vaa double")
    return SiteFit(sites, "gaussian", "site", Summary(df + len(rows), len(rows), 1.0, scale), None)


def normal_p(z):
    return math.erfc(abs(z) / math.sqrt(2))


def t2_p(t):  # two degrees of freedom
    return 1 - abs(t) / math.sqrt(2 + t * t)


def test_directions_have_unit_length_and_spread_evenly():
    x = directions(0, 1 << 14, 6, np.full(6, 0.3))
    assert np.allclose((x * x).sum(1), 1) and np.allclose(x.T @ x / len(x), np.eye(6) / 6, atol=2e-3)


def test_radius_tail_closed_forms():
    q = np.array([0.0, 0.5, 3.0, 40.0])
    assert np.allclose(radius_tail(q, 2, None), np.exp(-q / 2))
    assert np.allclose(radius_tail(q, 4, None), np.exp(-q / 2) * (1 + q / 2))
    assert np.allclose(radius_tail(q, 2, 2.0), 1 / (1 + q / 2))
    assert np.allclose(radius_tail(q, 6, 1e9), radius_tail(q, 6, None), atol=1e-7)


@pytest.mark.parametrize("z", [0.0, 0.3, 1.5, 2.5, 4.0])
def test_two_sites_are_a_plain_test(spark, z):
    fit = site_fit(spark, [("a", 1.0, 0.09), ("b", 1.0 + z * 0.5, 0.16)], df=2.0)
    r = tukey_pairs(fit).first()
    assert r.contrast == "b - a" and r.z == pytest.approx(z, abs=1e-12) and r.p_value == pytest.approx(normal_p(z), abs=2e-5) and r.p_error < 1e-4
    assert tukey_pairs(fit, by_t=True).first().p_value == pytest.approx(t2_p(z), abs=2e-5)


def test_five_unequal_sites_against_simulation(spark):
    rows = [("a", 0.0, 1.0), ("b", 2.0, 0.5), ("c", 0.5, 2.0), ("d", -1.5, 0.1), ("e", 0.1, 0.7)]
    got = {r.contrast: r for r in tukey_pairs(site_fit(spark, rows, scale=0.8)).collect()}
    x = np.random.default_rng(1).normal(size=(400_000, 5)) * np.sqrt([0.8 * v for _, _, v in rows])
    i, j = np.triu_indices(5, 1)
    most = (np.abs(x[:, i] - x[:, j]) / np.sqrt([0.8 * (rows[a][2] + rows[b][2]) for a, b in zip(i, j)])).max(1)
    assert len(got) == 10
    for r in got.values():
        want = (most >= abs(r.z)).mean()
        assert abs(r.p_value - want) < 4 * math.sqrt(want * (1 - want) / len(most)) + 1e-5 and r.p_error < 1e-4
        assert r.p_value >= normal_p(r.z) - 1e-4  # never below the single test


def test_equal_sites_give_the_studentized_range(spark):
    # Tabled upper 5 % point of the range of three normal variables: 3.314493.
    rows = [("a", 0.0, 1.0), ("b", 3.314493, 1.0), ("c", 1.0, 1.0)]
    p = {r.contrast: r.p_value for r in tukey_pairs(site_fit(spark, rows)).collect()}
    assert p["b - a"] == pytest.approx(0.05, abs=5e-5)


def test_sites_without_levels_and_too_few(spark):
    rows = [("a", 1.0, 1.0), ("b", None, 1.0), ("c", 2.0, 0.0), ("d", 2.0, 1.0)]
    assert [r.contrast for r in tukey_pairs(site_fit(spark, rows)).collect()] == ["d - a"]
    for few in (rows[:1], []):
        assert tukey_pairs(site_fit(spark, few)).collect() == []
