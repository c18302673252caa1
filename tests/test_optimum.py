"""Curves at their exact optimum and the coefficient table, against plain numpy least squares."""

import numpy as np
import pytest

from tidelog.operators.lightcurve import curve_coefficients, polish_curves


def curve(x, p, a, r):
    return p * (1 - np.exp(-a / p * x)) - r


def gradient(x, p, a, r):
    e = np.exp(-a / p * x)
    return np.column_stack([1 - e - a / p * x * e, x * e, -np.ones_like(x)])


def plain_fit(x, y):
    theta = np.array([y.max() - y.min(), 1.0, -y.min()])
    step = 1e-3
    for _ in range(500):  # Levenberg-Marquardt
        j, rest = gradient(x, *theta), y - curve(x, *theta)
        move = np.linalg.solve(j.T @ j + step * np.diag(np.diag(j.T @ j)), j.T @ rest)
        better = ((y - curve(x, *(theta + move))) ** 2).sum() <= (rest**2).sum()
        theta, step = (theta + move, step / 3) if better else (theta, step * 4)
    j, rest = gradient(x, *theta), y - curve(x, *theta)
    return theta, np.linalg.inv(j.T @ j), (rest**2).sum()


@pytest.fixture(scope="module")
def sample(spark):
    r = np.random.default_rng(8)
    rows = []
    for site, (p, a, d) in {"a": (12.0, 1.5, 2.0), "b": (9.0, 0.8, 1.0), "c": (20.0, 3.0, 4.0)}.items():
        x = np.round(r.uniform(0, 30, 200), 2)
        rows += [(site, float(u), float(v)) for u, v in zip(x, curve(x, p, a, d) + r.normal(0, 0.7, 200))]
    rows += [("few", 1.0, 1.0), ("few", 2.0, 1.5), (None, 3.0, 1.0), ("a", None, 2.0), ("a", 2.0, None)]
    return spark.createDataFrame(rows, "site string, x double, y double"), rows


def test_optimum_and_covariance(sample):
    df, rows = sample
    got = {r.site: r for r in polish_curves(df, ["site"], "x", "y").collect()}
    assert got["few"].pmax is None and got["few"].gradient is None and got["few"].n == 2
    for site in "abc":
        x, y = np.array([(u, v) for s, u, v in rows if s == site and u is not None and v is not None]).T
        theta, cov, sse = plain_fit(x, y)
        g = got[site]
        assert np.allclose([g.pmax, g.alpha, g.rd], theta, rtol=1e-7) and g.sse == pytest.approx(sse, rel=1e-10) and g.gradient < 1e-8
        assert np.allclose([g.v00, g.v01, g.v02, g.v11, g.v12, g.v22], cov[np.triu_indices(3)], rtol=1e-5)


def test_one_group_for_all_rows(sample):
    df, _ = sample
    r = polish_curves(df.filter("site = 'a'"), [], "x", "y").collect()
    assert len(r) == 1 and r[0].gradient < 1e-8 and "_all" not in r[0].asDict()


def test_coefficient_table_is_that_of_the_joint_fit(sample):
    df, rows = sample
    got = {r.term: r for r in curve_coefficients(polish_curves(df.filter("site in ('a', 'b', 'few')"), ["site"], "x", "y"), "site").collect()}
    use = [(s, u, v) for s, u, v in rows if s in ("a", "b") and u is not None and v is not None]
    second = np.array([s == "b" for s, _, _ in use])
    x, y = np.array([(u, v) for _, u, v in use]).T
    theta = np.concatenate([plain_fit(x[~second], y[~second])[0], np.zeros(3)])
    theta[3:] = plain_fit(x[second], y[second])[0] - theta[:3]
    j = np.where(second[:, None], gradient(x, *(theta[:3] + theta[3:])), gradient(x, *theta[:3]))
    j = np.column_stack([j, j * second[:, None]])
    rest = y - np.where(second, curve(x, *(theta[:3] + theta[3:])), curve(x, *theta[:3]))
    se = np.sqrt(np.diag(np.linalg.inv(j.T @ j)) * (rest**2).sum() / (len(y) - 6))
    names = ["pmax", "alpha", "rd", "dpmax[b]", "dalpha[b]", "drd[b]"]
    assert set(got) == set(names)
    for name, t, s in zip(names, theta, se):
        assert got[name].estimate == pytest.approx(t, rel=1e-6) and got[name].se == pytest.approx(s, rel=1e-5)
        assert 0 <= got[name].p_value <= 1 and got[name].statistic == pytest.approx(t / s, rel=1e-5)


def test_no_rows(sample):
    df, _ = sample
    assert polish_curves(df.limit(0), ["site"], "x", "y").collect() == []
