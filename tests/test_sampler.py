"""Gibbs draws against a plain Metropolis sampler of the same posterior, and the Spark run of them."""

import math

import numpy as np
import pytest

from tidelog.operators.sampler import WINDOW, Chains, Priors, sample_curves, weighted_sums

PRIORS = Priors(pmax=(10.0, 20.0), log_alpha=(0.0, 1.0), rd=(2.0, 10.0), cauchy=2.5)
TRUE = [(10.0, 1.0, 2.0, 0.5), (14.0, 1.6, 1.0, 0.8), (8.0, 0.7, 3.0, 0.6)]


def made_rows(n=50):
    r = np.random.default_rng(12)
    out = []
    for p, a, d, s in TRUE:
        x = r.uniform(0, 30, n)
        out.append((x, p * (1 - np.exp(-a / p * x)) - d + s * r.standard_t(2, n)))
    return out


def log_posterior(theta, hyper, data):
    """theta [group, (pmax, log alpha, rd, log sigma)], hyper [(mean, log sd)] x 3; with the Jacobians of the logs."""
    if (theta[:, 0] <= 0).any() or hyper[0, 0] <= 0:
        return -np.inf
    total = 0.0
    for (p, a, d, s), (x, y) in zip(theta, data):
        z = (y - p * (1 - np.exp(-np.exp(a) / p * x)) + d) / np.exp(s)
        total += -len(x) * s - 1.5 * np.log1p(z * z / 2).sum() + s - np.log1p((np.exp(s) / PRIORS.cauchy) ** 2)
    for i, (centre, spread) in enumerate((PRIORS.pmax, PRIORS.log_alpha, PRIORS.rd)):
        mean, log_sd = hyper[i]
        total += -0.5 * ((mean - centre) / spread) ** 2 + log_sd - np.log1p((np.exp(log_sd) / PRIORS.cauchy) ** 2)
        total += (-0.5 * ((theta[:, i] - mean) / np.exp(log_sd)) ** 2 - log_sd).sum()
    return total


def plain_metropolis(data, sweeps=12_000):
    r = np.random.default_rng(3)
    theta = np.array([(p, math.log(a), d, math.log(s)) for p, a, d, s in TRUE])
    hyper = np.array([(10.0, 1.0), (0.0, -0.5), (2.0, 0.0)])
    step_t, step_h = np.array([0.25, 0.07, 0.2, 0.15]), np.array([[2.0, 0.8], [0.4, 0.7], [0.9, 0.8]])
    now, out = log_posterior(theta, hyper, data), []
    link = np.array([[1.0, 0.0, 0.6], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]])
    for sweep in range(sweeps):
        for k in range(len(theta)):
            for move in (r.normal(size=3) @ link * step_t[:3] * 0.7, r.normal(size=3) * step_t[:3] * 0.4):
                new = theta.copy()
                new[k, :3] += move
                new[k, 3] += r.normal() * step_t[3]
                then = log_posterior(new, hyper, data)
                if math.log(r.random()) < then - now:
                    theta, now = new, then
        for i in range(3):
            new = hyper.copy()
            new[i] += r.normal(size=2) * step_h[i]
            then = log_posterior(theta, new, data)
            if math.log(r.random()) < then - now:
                hyper, now = new, then
        if sweep >= 1000:
            out.append(np.concatenate([np.column_stack([theta[:, 0], np.exp(theta[:, 1]), theta[:, 2], np.exp(theta[:, 3])]).ravel(), hyper[:, 0]]))
    return np.array(out)


def gibbs(data, sweeps=2500, chains=4):
    start = np.array(TRUE)
    state = Chains(start, np.full(3, 0.06), np.array([float(len(x)) for x, _ in data]), PRIORS, chains, 7)
    r, out = np.random.default_rng(9), []
    for sweep in range(sweeps):
        grid = state.grid()
        sums = np.array([[weighted_sums(*data[k], grid[c, k], state.pmax[c, k], state.log_ratio[c, k], state.rd[c, k], state.sigma[c, k], r)
                          for k in range(3)] for c in range(chains)])
        state.update(grid, sums)
        if sweep >= 100:
            own = np.stack([state.pmax, np.exp(state.log_ratio) * state.pmax, state.rd, state.sigma], -1)
            out.append(np.concatenate([own.reshape(chains, -1), state.mean], 1))
    return np.array(out)


def batch_error(x, batches=20):
    parts = np.array_split(x, batches)
    return np.std([p.mean(0) for p in parts], axis=0, ddof=1) / math.sqrt(batches)


def test_means_agree_with_a_plain_sampler():
    data = made_rows()
    ours, plain = gibbs(data), plain_metropolis(data)
    flat = ours.mean(1)
    error = np.sqrt(batch_error(flat) ** 2 + batch_error(plain) ** 2)
    assert (np.abs(flat.mean(0) - plain.mean(0)) < 4 * error + 1e-3).all()
    # spreads too, for the groups' own parameters
    assert ours[:, :, :12].std((0, 1)) == pytest.approx(plain[:, :12].std(0), rel=0.2)
    # between chains
    within, between = ours.var(0, ddof=1).mean(0), ours.mean(0).var(0, ddof=1)
    assert (np.sqrt(1 + between / within) < 1.05).all()


def test_the_window_always_holds_the_present_place():
    state = Chains(np.array(TRUE), np.full(3, 0.1), np.full(3, 10.0), PRIORS, 2, 1)
    for _ in range(50):
        grid = state.grid()
        assert np.allclose(np.take_along_axis(grid, state.offset[:, :, None] + WINDOW, 2)[:, :, 0], state.log_ratio)


def test_sums_by_light_value_are_those_of_the_rows():
    (x, y), grid = made_rows(60)[0], np.linspace(-3, -1, 2 * WINDOW + 1)
    light, counts = np.unique(np.round(x / 5), return_counts=True)
    each = weighted_sums(np.repeat(light, counts), y, grid, 9.0, -2.0, 2.0, 0.7, np.random.default_rng(4))
    cells = weighted_sums(light, y, grid, 9.0, -2.0, 2.0, 0.7, np.random.default_rng(4), counts)
    assert cells == pytest.approx(each, rel=1e-9)


def test_spark_run_repeats_and_names_its_groups(spark):
    rows = [(s, float(x), float(y)) for s, (x, y) in zip(("a", "b", "c"), made_rows(40)) for x, y in zip(x, y)]
    rows += [("few", 1.0, 2.0), (None, 2.0, 3.0), ("a", None, 1.0), ("a", float("nan"), 1.0), ("b", 1.0, None)]
    df = spark.createDataFrame(rows, "site string, x double, y double").filter("site IS NULL OR site <> 'zz'")
    runs = [sample_curves(df.filter("x IS NULL OR NOT isnan(x)"), ["site"], "x", "y", PRIORS, chains=2, warmup=2, draws=6) for _ in range(2)]
    (first, groups), (second, _) = runs
    assert [tuple(r) for r in groups.orderBy("k").collect()] == [("a", 1), ("b", 2), ("c", 3)]
    order = ["chain", "iter", "param", "k"]
    a, b = (sorted(tuple(r) for r in d.collect()) for d in (first, second))
    assert [r[:4] for r in a] == [r[:4] for r in b] and len(a) == 2 * 6 * (3 * 4 + 6)
    assert [r[4] for r in a] == pytest.approx([r[4] for r in b], rel=1e-6)  # sums come back in any order
    assert set(first.groupBy(*order).count().select("count").distinct().toPandas()["count"]) == {1}
    none, groups = sample_curves(df.filter("site = 'few'"), ["site"], "x", "y", PRIORS)
    assert none.count() == 0 and groups.count() == 0
