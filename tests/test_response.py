"""Light-curve fits and draw summaries against direct numpy computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidelog.operators import draws as dr
from tidelog.operators import lightcurve as lc

RNG = np.random.default_rng(3)


def curve(x, p, a, r, b=0.0):
    return p * (1 - np.exp(-a / p * x)) * np.exp(-b / p * x) - r


@pytest.fixture(scope="module")
def observations(spark):
    data = []
    for key, (p, a, r) in {"g": (10.0, 0.5, 1.0), "h": (20.0, 2.0, 3.0)}.items():
        x = np.round(RNG.uniform(0, 60, 400), 1)
        data += [(key, float(u), float(v)) for u, v in zip(x, curve(x, p, a, r) + RNG.normal(0, 0.3, 400))]
    data += [("few", 1.0, 1.0), ("few", 2.0, 1.5), ("few", 3.0, 1.7)] + [("flat", 5.0, float(v)) for v in range(6)] + [("g", None, 1.0), ("g", 2.0, None)]
    return spark.createDataFrame(data, "k string, x double, y double").cache()


def sse_at(obs, key, p, a, r):
    pts = np.array([(o["x"], o["y"]) for o in obs.filter(F.col("k") == key).na.drop().collect()])
    return ((pts[:, 1] - curve(pts[:, 0], p, a, r)) ** 2).sum()


@pytest.mark.parametrize("pack", [10_000, 200, 0])
def test_fits_agree_whatever_the_path(observations, pack):
    # Groups have about 300 light values: all packed, one path each, all by levels.
    fits = {r["k"]: r for r in lc.fit_curves(observations, ["k"], "x", "y", pack_cells=pack).collect()}
    assert set(fits) == {"g", "h", "few", "flat"}
    assert fits["few"]["pmax"] is None and fits["few"]["n"] == 3 and fits["flat"]["sse"] is None
    for key, true in {"g": (10.0, 0.5, 1.0), "h": (20.0, 2.0, 3.0)}.items():
        f = fits[key]
        assert (f["pmax"], f["alpha"], f["rd"]) == pytest.approx(true, rel=0.12)
        assert f["sse"] == pytest.approx(sse_at(observations, key, f["pmax"], f["alpha"], f["rd"]), rel=1e-9)
        for move in np.eye(3) * 0.002:  # a minimum: every small step is worse
            for sign in (1, -1):
                p, a, r = np.array([f["pmax"], f["alpha"], f["rd"]]) * (1 + sign * move)
                assert sse_at(observations, key, p, a, r) >= f["sse"] * (1 - 1e-6)


def test_exact_curve_is_recovered(spark):
    x = np.linspace(0, 60, 30)
    df = spark.createDataFrame([(float(u), float(v)) for u, v in zip(x, curve(x, 10, 0.5, 1))], "x double, y double")
    f = lc.fit_curves(df, [], "x", "y").first()
    assert (f["pmax"], f["alpha"], f["rd"]) == pytest.approx((10, 0.5, 1), rel=1e-3)


def test_inhibition(spark):
    x = np.linspace(0, 100, 200)
    y = curve(x, 20, 2, 3, 0.15) + RNG.normal(0, 0.05, 200)
    df = spark.createDataFrame([("g", float(u), float(v)) for u, v in zip(x, y)], "k string, x double, y double")
    for pack in (10_000, 0):
        f = lc.fit_curves(df, ["k"], "x", "y", inhibition=True, pack_cells=pack).first()
        assert (f["pmax"], f["alpha"], f["beta"], f["rd"]) == pytest.approx((20, 2, 0.15, 3), rel=0.1)


def test_pooled_against_groups(observations):
    two = observations.filter("k in ('g', 'h')")
    pooled, own = lc.fit_curves(two, [], "x", "y"), lc.fit_curves(two, ["k"], "x", "y")
    out = lc.compare_pooled(pooled, own).first()
    full = sum(r["sse"] for r in own.collect())
    assert out["df"] == 3 and out["df_residual"] == 794
    assert out["f_value"] == pytest.approx((pooled.first()["sse"] - full) / 3 / (full / 794)) and out["p_value"] < 1e-10
    grid = lc.predict_grid(own, ["k"], "light", 0, 30, 101)
    assert grid.count() == 202


def test_robust_fit_ignores_outliers(spark):
    data = []
    for i, key in enumerate("abc"):
        x = RNG.uniform(0, 60, 500)
        y = curve(x, 18 + 2 * i, 1.5, 2) + RNG.standard_t(2, 500) * 0.3
        y[::25] += 40
        data += [(f"{key}", j, float(u), float(v)) for j, (u, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "k string, i int, x double, y double")
    out = {r["k"]: r for r in lc.robust_curves(df, ["k"], "x", "y", ["i"]).collect()}
    plain = {r["k"]: r for r in lc.fit_curves(df, ["k"], "x", "y").collect()}
    for i, key in enumerate("abc"):
        assert out[key]["pmax"] == pytest.approx(18 + 2 * i, abs=0.6) and out[key]["rd"] == pytest.approx(2, abs=0.6)
        assert abs(out[key]["rd"] - 2) < abs(plain[key]["rd"] - 2)
        assert 0.2 < out[key]["sigma"] < 0.6
    mean = np.mean([r["pmax_own"] for r in out.values()])
    assert all(abs(r["pmax"] - mean) <= abs(r["pmax_own"] - mean) + 0.05 for r in out.values())  # pooled towards the middle


# --- draws -------------------------------------------------------------------


def chains(spark, values, name="p"):
    data = [(name, c, i, float(v)) for c, chain in enumerate(values) for i, v in enumerate(chain)]
    return spark.createDataFrame(data, "param string, chain int, iter long, value double")


def test_rhat(spark):
    same = RNG.normal(size=200)
    half = np.concatenate([same[:100], same[:100]])
    equal = dr.split_rhat(chains(spark, [half] * 4), "param", "chain", "iter", "value").first()["rhat"]
    assert equal == pytest.approx(math.sqrt(99 / 100))
    moved = dr.split_rhat(chains(spark, [half, half, half, half + 5]), "param", "chain", "iter", "value").first()["rhat"]
    assert moved > 2
    odd = RNG.normal(size=(2, 7))
    parts = [c[s] for c in odd for s in (slice(0, 3), slice(4, 7))]
    w, b = np.mean([p.var(ddof=1) for p in parts]), np.var([p.mean() for p in parts], ddof=1)
    got = dr.split_rhat(chains(spark, odd), "param", "chain", "iter", "value").first()["rhat"]
    assert got == pytest.approx(math.sqrt((2 / 3 * w + b) / w))


def direct_ess(values):
    values = np.asarray(values)
    m, n = values.shape
    centred = values - values.mean(1, keepdims=True)
    acov = np.array([[(c[: n - t] * c[t:]).sum() / n for t in range(n)] for c in centred])
    return dr._geyer(acov.mean(0), values.mean(1).var(ddof=1) if m > 1 else 0.0, m, n, True) / (m * n)


def test_effective_ratio(spark, monkeypatch):
    monkeypatch.setattr(dr, "BLOCK", 64)  # many blocks, overlap over several of them
    noise = RNG.normal(size=(3, 500))
    slow = np.zeros((3, 500))
    for t in range(1, 500):
        slow[:, t] = 0.97 * slow[:, t - 1] + noise[:, t]
    df = chains(spark, noise, "white").union(chains(spark, slow, "slow"))
    got = {r["param"]: r["neff_ratio"] for r in dr.effective_ratio(df, "param", "chain", "iter", "value", lags=8).collect()}
    assert got["white"] == pytest.approx(direct_ess(noise)) and got["white"] > 0.7
    assert got["slow"] == pytest.approx(direct_ess(slow)) and got["slow"] < 0.1


def test_draw_summaries(spark):
    df = chains(spark, [[1.0, 2.0, 3.0], [3.0, 4.0, 5.0]])
    assert rows(dr.means_by_chain(df, "param", "chain", "value")) == [("p", None, 3.0), ("p", 0, 2.0), ("p", 1, 4.0)]
    both = dr.mean_and_interval(df, ["param"], "value", 0.8).first()
    assert (both["estimate"], both["hdi_low"], both["hdi_high"]) == (3.0, 1.0, 5.0)
    states = df.withColumn("depth", F.col("iter") + 9)
    assert rows(dr.sampler_counts(states, "chain", F.col("value") > 3, F.col("depth"), 10)) == [(0, 3, 0, 2), (1, 3, 2, 2)]


def test_curve_draws_and_likelihood(spark):
    par = spark.createDataFrame([("g", 1, 10.0, 0.5, 1.0, 0.4), ("g", 2, 12.0, 0.6, 1.5, 0.5)], "k string, d int, pmax double, alpha double, rd double, sigma double")
    out = dr.curve_draws(par, ["k", "d"], F.lit(30.0), 4, seed=1)
    again = dr.curve_draws(par.repartition(3), ["k", "d"], F.lit(30.0), 4, seed=1)
    assert rows(out) == rows(again)
    at = {(r["d"], r["m"]): r for r in out.collect()}
    assert at[(1, 4)]["light"] == 30.0 and at[(1, 4)]["yhat"] == pytest.approx(curve(30.0, 10, 0.5, 1))
    open_grid = dr.curve_draws(par, ["k", "d"], F.lit(30.0), 4, seed=1, closed=False)
    assert open_grid.agg(F.max("light")).first()[0] == pytest.approx(22.5)
    obs = spark.createDataFrame([(1, "g", 5.0, 2.0), (2, "z", 5.0, 2.0)], "i int, k string, x double, y double")
    ll = {r["d"]: r["log_lik"] for r in dr.pointwise_loglik(obs, par, "k", "x", "y", ["i"], ["d"]).collect()}
    z = (2.0 - curve(5.0, 10, 0.5, 1)) / 0.4
    assert len(ll) == 2 and ll[1] == pytest.approx(math.lgamma(1.5) - math.log(math.sqrt(2 * math.pi) * 0.4) - 1.5 * math.log(1 + z * z / 2))


def test_bundle(spark):
    par = spark.range(40).select(F.lit("g").alias("k"), F.col("id").alias("d"), (10 + F.col("id") / 10).alias("pmax"), F.lit(0.5).alias("alpha"), F.lit(1.0).alias("rd"), F.lit(0.2).alias("sigma"))
    raw = spark.createDataFrame([("g", 5.0, 2.0)], "k string, light double, value double")
    out = dr.fit_bundle(raw, dr.curve_draws(par, ["k", "d"], F.lit(20.0), 3, 1), ["k"], "light")
    assert {r["kind"]: r["count"] for r in out.groupBy("kind").count().collect()} == {"raw": 1, "fit": 3, "predict": 3}
    assert out.filter("kind <> 'raw' and not (hdi_low <= estimate and estimate <= hdi_high)").count() == 0


def test_fits_do_not_depend_on_the_unit_of_light(spark):
    rng = np.random.default_rng(3)
    x = np.tile(np.linspace(0, 30, 40), 3)
    y = 20 * (1 - np.exp(-2.0 * x / 20)) - 1.5 + rng.normal(0, 0.3, len(x))
    data = [(f"u{e}", float(v) * 10.0**e, float(w)) for e in (-3, 0, 2, 5) for v, w in zip(x, y)]
    fits = {r["k"]: r for r in lc.fit_curves(spark.createDataFrame(data, "k string, x double, y double"), ["k"], "x", "y").collect()}
    for e in (-3, 2, 5):
        r = fits[f"u{e}"]
        assert r["status"] == "ok" and r["pmax"] == pytest.approx(fits["u0"]["pmax"], rel=1e-6)
        assert r["alpha"] * 10.0**e == pytest.approx(fits["u0"]["alpha"], rel=1e-5) and r["sse"] == pytest.approx(fits["u0"]["sse"], rel=1e-9)


def test_every_group_keeps_its_row(spark):
    line = [("line", float(i), 2.0 * i) for i in range(10)]
    good = [("good", float(i), float(9 * (1 - np.exp(-i / 3)))) for i in range(12)]
    data = line + good + [("few", 1.0, 1.0), ("few", 2.0, 3.0), ("few", 3.0, 3.5), ("nul", None, 1.0), ("nul", None, 2.0), ("nul", 3.0, None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(data)], "k string, x double, y double, i int")
    fits = {r["k"]: r for r in lc.fit_curves(df, ["k"], "x", "y").collect()}
    assert {k: (r["status"], r["pmax"] is None) for k, r in fits.items()} == {
        "line": ("boundary", True), "good": ("ok", False), "few": ("few", True), "nul": ("few", True)}
    assert fits["nul"]["n"] == 0 and fits["line"]["sse"] is not None
    robust = {r["k"]: r["pmax"] is None for r in lc.robust_curves(df, ["k"], "x", "y", ["i"]).collect()}
    assert robust == {"line": True, "good": False, "few": True, "nul": True}


def test_rhat_cuts_every_chain_at_its_own_middle(spark):
    rng = np.random.default_rng(5)
    long = [("long", c, i, float(rng.normal())) for c in range(4) for i in range(1000)]
    moved = [("moved", c, i, float(rng.normal() + 3 * (i >= 50))) for c in range(4) for i in range(100)]
    schema = "param string, chain int, iter long, value double"
    alone = dr.split_rhat(spark.createDataFrame(moved, schema), "param", "chain", "iter", "value").first()["rhat"]
    both = {r["param"]: r["rhat"] for r in dr.split_rhat(spark.createDataFrame(long + moved, schema), "param", "chain", "iter", "value").collect()}
    assert both["moved"] == pytest.approx(alone) and alone > 1.8 and both["long"] < 1.02


def test_effective_size_of_a_slow_chain(spark):
    rng = np.random.default_rng(8)
    noise, x = rng.normal(size=20_000), np.zeros(20_000)
    for i in range(1, len(x)):
        x[i] = 0.999 * x[i - 1] + noise[i]
    df = spark.createDataFrame([("slow", 0, i, float(v)) for i, v in enumerate(x)], "param string, chain int, iter long, value double")
    ratio = dr.effective_ratio(df, "param", "chain", "iter", "value").first()["neff_ratio"]
    assert 0.0001 < ratio < 0.003  # (1 - 0.999) / (1 + 0.999) = 0.0005 for an endless chain
