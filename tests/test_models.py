"""Fits against plain numpy solves on the collected rows, and properties of the models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.functions.splines import Spline
from tidelog.operators import linear as ln
from tidelog.operators import seasonal as se
from tidelog.operators import siteblocks as sb
from tidelog.operators import smoothing as sm

RNG = np.random.default_rng(11)
SITES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data():
    out = []
    for i, s in enumerate(SITES):
        for m in range(1, 13):
            for _ in range(6 + i):
                mean = np.exp(1 + 0.3 * i + 0.5 * np.cos(np.pi * (m - 7) / 6))
                out.append((s, m, float(RNG.gamma(8, mean / 8))))
    return out


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data + [("a", 3, None), (None, 3, 1.0)], "site string, month int, y double").cache()


@pytest.fixture(scope="module")
def cells(frame):
    return ln.collect_cells(ln.month_cells(frame, "site", "month", "y"))


def design(data, form):
    h = np.array([m - 6.0 for _, m, _ in data])
    cols = [np.ones(len(data)), h]
    for s in SITES[1:]:
        cols.append(np.array([float(r[0] == s) for r in data]))
    if form == "slope*site":
        cols += [np.array([(r[0] == s) * (r[1] - 6.0) for r in data]) for s in SITES[1:]]
    return np.column_stack(cols), np.array([r[2] for r in data])


def test_gaussian_model_equals_row_solve(spark, data, cells):
    x, y = design(data, "slope*site")
    beta, rss = np.linalg.lstsq(x, y, rcond=None)[:2]
    fit = ln.linear_model(cells, "slope*site")
    assert fit.beta == pytest.approx(beta)
    assert fit.deviance == pytest.approx(float(rss[0]))
    cov = np.linalg.inv(x.T @ x) * rss[0] / (len(y) - x.shape[1])
    assert fit.cov == pytest.approx(cov)


@pytest.mark.parametrize("family,form", [("gaussian", "slope*site"), ("gamma", "slope*site"), ("gamma", "site")])
def test_site_blocks_equal_the_dense_model(frame, cells, family, form):
    fit, own = ln.linear_model(cells, form, family), sb.fit_site_lines(ln.month_cells(frame, "site", "month", "y"), form, family)
    table = {r["term"]: r for r in sb.coefficient_table(own).collect()}
    assert set(table) == set(fit.terms)
    for i, term in enumerate(fit.terms):
        assert (table[term]["estimate"], table[term]["se"]) == pytest.approx((fit.beta[i], fit.cov[i, i] ** 0.5), rel=1e-7, abs=1e-9)
    assert (own.summary.deviance, own.summary.scale, own.summary.df_residual) == pytest.approx((fit.deviance, fit.scale, fit.df_residual), rel=1e-8)


@pytest.mark.parametrize("family", ["gaussian", "gamma"])
def test_shared_curve_equals_the_dense_model(frame, cells, family):
    fit = se.SeasonModel(cells, "site", family, se.month_spline()).fit
    own = sb.fit_shared_curve(ln.month_cells(frame, "site", "month", "y"), family, se.month_spline())
    # both choose the smoothing level on the same ladder, in units that differ
    assert (own.deviance, own.scale) == pytest.approx((fit.deviance, fit.scale), rel=5e-3)
    assert own.df_residual == pytest.approx(fit.df_residual, abs=0.4)


def test_many_sites(spark):
    rng = np.random.default_rng(5)
    data = [(f"s{i:04d}", m, float(rng.gamma(9, np.exp(0.4 * np.cos(m / 2)) / 9))) for i in range(2000) for m in range(1, 13)]
    many = ln.month_cells(spark.createDataFrame(data, "site string, month int, y double"), "site", "month", "y")
    own = sb.fit_site_lines(many, "slope*site", "gamma")
    assert own.summary.df_residual == 24000 - 4000 and sb.coefficient_table(own).count() == 4000
    curves = sb.fit_site_curves(many, "gaussian", se.month_spline())
    assert curves.sites.count() == 2000 and sb.fit_shared_curve(many, "gaussian", se.month_spline()).deviance > curves.summary.deviance


def test_gamma_model_equals_row_iterations(data, cells):
    x, y = design(data, "slope+site")
    beta = np.zeros(x.shape[1])
    beta[0] = np.log(y.mean())
    for _ in range(60):
        mu = np.exp(x @ beta)
        beta = np.linalg.lstsq(x, x @ beta + (y - mu) / mu, rcond=None)[0]
    mu = np.exp(x @ beta)
    fit = ln.linear_model(cells, "slope+site", "gamma")
    assert fit.beta == pytest.approx(beta, abs=1e-6)
    assert fit.deviance == pytest.approx(2 * (-np.log(y / mu) + (y - mu) / mu).sum())
    phi = (((y - mu) / mu) ** 2).sum() / (len(y) - x.shape[1])
    assert fit.scale == pytest.approx(phi, rel=1e-6)
    assert fit.cov == pytest.approx(np.linalg.inv(x.T @ x) * phi, rel=1e-5)


def test_gamma_needs_positive_values(spark):
    df = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 1.0), ("a", 3, 2.0)], "site string, month int, y double")
    with pytest.raises(ValueError):
        ln.linear_model(ln.collect_cells(ln.month_cells(df, "site", "month", "y")), "slope", "gamma")


def test_months_outside_the_calendar_are_refused(spark):
    df = spark.createDataFrame([("a", 13, 1.0)], "site string, month int, y double")
    with pytest.raises(ValueError):
        ln.collect_cells(ln.month_cells(df, "site", "month", "y"))


def test_contrasts(spark, frame, cells):
    fit = ln.linear_model(cells, "slope*site")
    pos = {t: i for i, t in enumerate(fit.terms)}
    weights = ln.dimension(spark, [("x", "site[b]", 1.0), ("x", "site[c]", -1.0), ("y", "site[c]", 1.0), ("y", "site[b]", -1.0)],
                           ["contrast", "term", "weight"])
    own = sb.fit_site_lines(ln.month_cells(frame, "site", "month", "y"))
    got = {r["contrast"]: r for r in sb.contrasts(own, weights).collect()}
    k = np.zeros(len(fit.terms))
    k[pos["site[b]"]], k[pos["site[c]"]] = 1, -1
    assert got["x"]["estimate"] == pytest.approx(k @ fit.beta)
    assert got["x"]["se"] == pytest.approx((k @ fit.cov @ k) ** 0.5)
    assert got["y"]["z"] == pytest.approx(-got["x"]["z"]) and got["y"]["p_value"] == pytest.approx(got["x"]["p_value"])
    unknown = ln.dimension(spark, [("x", "site[q]", 1.0)], ["contrast", "term", "weight"])
    with pytest.raises(Exception, match="unknown term"):
        sb.contrasts(own, unknown).collect()
    pairs = sb.all_pairs(own).collect()
    assert len(pairs) == 3 and all(p["p_holm"] >= p["p_value"] for p in pairs)
    assert sb.neighbour_z(own).count() == 2


def test_site_lines_and_nested_models(spark, frame, cells):
    fits = {f: ln.linear_model(cells, f) for f in ("slope", "slope+site", "slope*site")}
    table = ln.compare_nested(spark, fits).collect()
    own = sb.fit_site_lines(ln.month_cells(frame, "site", "month", "y"))
    assert own.shared_slope.deviance == pytest.approx(fits["slope+site"].deviance) and own.shared_slope.df_residual == pytest.approx(fits["slope+site"].df_residual)
    assert [r["df"] for r in table] == [None, pytest.approx(2), pytest.approx(2)]
    assert table[1]["deviance_drop"] == pytest.approx(fits["slope"].deviance - fits["slope+site"].deviance)
    per_site = {r["site"]: r for r in sb.site_lines(sb.fit_site_lines(ln.month_cells(frame, "site", "month", "y"))).collect()}
    at = cells.site == 1
    slope = np.polyfit(np.repeat(cells.month[at] - 6, cells.n[at].astype(int)), np.repeat(cells.s1[at] / cells.n[at], cells.n[at].astype(int)), 1)
    assert (per_site["b"]["slope"], per_site["b"]["intercept"]) == pytest.approx(tuple(slope))


# --- splines -----------------------------------------------------------------


@pytest.mark.parametrize("kind", ["cr", "cs", "cc"])
def test_basis_columns_equal_matrix(spark, kind):
    spline = Spline((1.0, 2.0, 4.5, 7.0, 12.0), kind)
    x = [-3.0, 1.0, 1.5, 2.0, 4.4, 4.5, 9.0, 11.99, 12.0, 14.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    for derivative in (0, 1):
        wide, names = spline.attach(df, "x", derivative)
        got = np.array([[r[n] for n in names] for r in wide.orderBy("x").collect()])
        assert got == pytest.approx(spline.matrix(sorted(x), derivative), abs=1e-12)


def test_spline_properties():
    for kind in ("cr", "cs", "cc"):
        s = Spline.even(1, 12, 8, kind)
        x = np.linspace(1, 12, 40001)
        b = RNG.normal(size=s.size)
        assert s.matrix(x).sum(1) == pytest.approx(1)
        bend = np.gradient(s.matrix(x, 1) @ b, x)
        if kind != "cs":
            assert b @ s.penalty @ b == pytest.approx(np.trapezoid(bend**2, x), rel=1e-4)
    assert np.linalg.eigvalsh(Spline.even(0, 24, 5, "cs").penalty).min() > 0
    c = Spline.even(1, 12, 8, "cc")
    ends = c.matrix([1.0, 12.0]), c.matrix([1.0, 12.0], 1)
    assert all(np.allclose(e[0], e[1]) for e in ends)


def test_slope_recovers_a_known_curve(spark):
    hours = np.arange(144) / 6
    data = [(k, float(h), float(8 + a * np.sin(2 * np.pi * h / 24))) for k, a in (("p", 2.0), ("q", -1.0), (None, 0.5)) for h in hours]
    df = spark.createDataFrame(data + [("few", 1.0, 2.0), ("few", 2.0, 2.0), ("p", 1.0, None)], "k string, h double, y double")
    got = sm.slope_at_rows(df, ["k"], "h", "y", Spline.even(0, 24, 9, "cs"), ["h"])
    assert got.count() == df.count()
    worst = {"p": 0.0, "q": 0.0, None: 0.0}
    size = {"p": 2.0, "q": -1.0, None: 0.5}
    for r in got.filter("k is null or k <> 'few'").collect():
        true = size[r["k"]] * 2 * np.pi / 24 * np.cos(2 * np.pi * r["h"] / 24)
        worst[r["k"]] = max(worst[r["k"]], abs(r["rate"] - true))
    assert max(worst.values()) < 0.05
    assert got.filter("k = 'few' and rate is not null").count() == 0


def test_group_fit_equals_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 24, 90)
    y = np.sin(x / 3) + rng.normal(0, 0.3, 90)
    spline = Spline.even(0, 24, 6, "cr")
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)], "k string, x double, y double")
    row = sm.fit_groups(sm.gram(df, ["k"], spline, "x", "y"), ["k"], spline).first()
    b = spline.matrix(x)
    a = b.T @ b + row["lambda"] * spline.penalty
    beta = np.linalg.solve(a, b.T @ y)
    assert row["beta"] == pytest.approx(beta, rel=1e-6)
    edf = np.trace(np.linalg.solve(a, b.T @ b))
    assert row["edf"] == pytest.approx(edf) and 2 < edf < 6
    rss = ((y - b @ beta) ** 2).sum()
    assert row["sigma2"] == pytest.approx(rss / (90 - edf))
    score = [90 * ((y - b @ np.linalg.solve(b.T @ b + v * spline.penalty, b.T @ y)) ** 2).sum()
             / (90 - np.trace(np.linalg.solve(b.T @ b + v * spline.penalty, b.T @ b))) ** 2 for v in row["lambda"] * 10.0 ** np.arange(-3, 3.1, 0.5)]
    assert 90 * rss / (90 - edf) ** 2 <= min(score) * (1 + 1e-6)


@pytest.mark.parametrize("family", ["gaussian", "gamma"])
def test_seasonal_models(spark, data, cells, family):
    models = {f: se.SeasonModel(cells, f, family, se.month_spline()) for f in se.FORMS}
    devs = [models[f].fit.deviance for f in se.FORMS]
    assert devs[0] > devs[1] > 0 and devs[2] < devs[1] * 1.02
    # Cells give the same penalised fit as the rows.
    m = models["site"]
    y = np.array([r[2] for r in data])
    b = m.spline.matrix([r[1] for r in data]) @ m.blocks[0][2]
    x = np.column_stack([np.ones(len(y)), *[[float(r[0] == s) for r in data] for s in SITES[1:]], b])
    pen = np.zeros((x.shape[1],) * 2)
    pen[3:, 3:] = m.blocks[0][2].T @ m.spline.penalty @ m.blocks[0][2]
    cell_x = np.column_stack([np.ones(len(cells.n)), cells.site == 1, cells.site == 2, m.spline.matrix(cells.month) @ m.blocks[0][2]])
    gram = cell_x.T @ (cells.n[:, None] * cell_x)
    lam = m.fit.lambdas[0] * np.trace(gram) / np.trace(pen)
    if family == "gaussian":
        want = np.linalg.solve(x.T @ x + lam * pen, x.T @ y)
    else:
        eta = np.log(np.full(len(y), y.mean()))
        for _ in range(80):
            mu = np.exp(eta)
            want = np.linalg.solve(x.T @ x + lam * pen, x.T @ (eta + (y - mu) / mu))
            eta = x @ want
    assert m.fit.beta == pytest.approx(want, abs=1e-5)
    grid = ln.dimension(spark, [(s, float(v)) for s in SITES for v in (1.0, 4.5, 12.0)], ["site", "month"])
    curves = sb.fit_site_curves(ln.month_cells(spark.createDataFrame(data, "site string, month int, y double"), "site", "month", "y"), family, se.month_spline())
    got = {(r["site"], r["month"]): r for r in sb.predict_sites(curves, grid).collect()}
    assert all(r["l95"] < r["fit"] < r["u95"] for r in got.values())
    assert got[("a", 1.0)]["fit"] == pytest.approx(got[("a", 12.0)]["fit"])  # the year closes
    table = sb.smooth_table(curves, "v").collect()
    assert len(table) == 3 and all(r["p_value"] < 0.01 and 1 < r["edf"] < 9 for r in table)


def test_facets_fit_alone(spark, frame, data):
    own = frame.filter("site is not null").withColumn("y", F.col("y") + 0)
    facet_cells = ln.month_cells(own, "site", "month", "y").unionByName(
        ln.month_cells(spark.createDataFrame([("few", 2, 1.0)], "site string, month int, y double"), "site", "month", "y"))
    got = se.facet_curves(facet_cells, ["site"], se.month_spline(), "gamma", points=12)
    assert got.count() == 4 * 12
    one = ln.collect_cells(ln.month_cells(own.filter("site = 'b'"), "site", "month", "y"))
    single = se.SeasonModel(one, "pooled", "gamma", se.month_spline())
    grid = ln.dimension(spark, [("b", float(m)) for m in range(1, 13)], ["site", "month"])
    want = {r["month"]: r["fit"] for r in se.predict(single, grid).collect()}
    have = {round(r["month"]): r["fit"] for r in got.filter("site = 'b'").collect()}
    assert have == pytest.approx({round(k): v for k, v in want.items()}, rel=1e-6)


def test_slopes_keep_their_digits_under_a_large_offset(spark):
    rng = np.random.default_rng(4)
    x = np.linspace(0, 24, 145)
    y = 2 * np.sin(x / 4) + rng.normal(0, 0.05, len(x))
    data = [(g, i, float(v), float(w) + off) for g, off in (("low", 0.0), ("high", 1e7)) for i, (v, w) in enumerate(zip(x, y))]
    spline = Spline.even(0.0, 24.0, 10, "cr")
    out = sm.slope_at_rows(spark.createDataFrame(data, "g string, i int, x double, y double"), ["g"], "x", "y", spline, ["i"])
    got = {(r["g"], r["i"]): r["rate"] for r in out.collect()}
    assert max(abs(got["low", i] - got["high", i]) for i in range(len(x))) < 1e-5


@pytest.mark.parametrize("family", ["gaussian", "gamma"])
def test_shared_curve_by_jobs_equals_the_local_one(frame, family):
    cells, spline = ln.month_cells(frame, "site", "month", "y"), se.month_spline()
    here, jobs = (sb.fit_shared_curve(cells, family, spline, few) for few in (10, 0))
    assert (here.n, here.df_model, here.deviance, here.scale) == pytest.approx((jobs.n, jobs.df_model, jobs.deviance, jobs.scale), rel=1e-10)


def test_pairs_and_neighbours_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    sites = [(f"s{i:02d}", float(rng.normal(0, 1.5)), float(rng.uniform(0.05, 0.3))) for i in range(12)] + [("t0", 1.0, 0.1), ("t1", 1.0, 0.1)]
    fit = sb.SiteFit(spark.createDataFrame(sites, "site string, a double, vaa double"), "gaussian", "site", sb.Summary(200.0, float(len(sites)), 1.0, 1.0), None)
    found = []
    for rows_of_a_block in (sb.ranking.BLOCK_ROWS, 10):
        monkeypatch.setattr(sb.ranking, "BLOCK_ROWS", rows_of_a_block)
        found.append([sorted(tuple(r) for r in df.collect()) for df in (sb.all_pairs(fit).select("contrast", "p_value", "p_holm"), sb.neighbour_z(fit))])
    assert found[0] == found[1] and len(found[0][0]) == 91 and len(found[0][1]) == 13
