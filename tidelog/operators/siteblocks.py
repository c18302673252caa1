"""Season x site models for any number of sites.

A site has at most twelve month cells. Packed into one row per site, they are solved on the
executors; sites are independent given what they share, so only sums over all sites (a scale,
degrees of freedom, the coefficients of a shared smooth) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.curves import normal_p_two_sided
from ..functions.distributions import t_two_sided
from ..functions.splines import Spline
from ..session import materialize
from . import ranking
from .joins import linear_grid
from .linear import Cells, collect_months, stationary_levels
from .seasonal import SeasonModel, band, null_space
from .smoothing import dot, quadratic

MONTHS = np.arange(1, 13)
TOLERANCE, STEPS = 1e-11, 200
FEW_SITES = 2048  # their cells are about a megabyte


@dataclass
class Summary:
    """What an analysis of deviance needs of a model."""

    n: float
    df_model: float
    deviance: float
    scale: float

    @property
    def df_residual(self) -> float:
        return self.n - self.df_model


def pack_sites(cells: DataFrame) -> DataFrame:
    """One row per site with its month cells (at most twelve, as other months are refused)."""
    month = F.when(F.col("month").between(1, 12), F.col("month")).otherwise(F.raise_error(F.lit("expected months 1..12")).cast("int"))
    packed = cells.select("site", month.alias("month"), "n", "s1", "s2", "slog").groupBy("site").agg(
        F.collect_list(F.struct("month", "n", "s1", "s2", "slog")).alias("cells"))
    return packed


def _unpack(packed: pd.Series) -> dict[str, np.ndarray]:
    """Arrays [site, month] of the cells; a missing month has no rows."""
    out = {name: np.zeros((len(packed), 12)) for name in ("n", "s1", "s2", "slog")}
    for i, cells in enumerate(packed):
        for c in cells:
            for name in out:
                out[name][i, c["month"] - 1] = np.nan if c[name] is None else c[name]
    out["mean"] = out["s1"] / np.maximum(out["n"], 1)
    out["within"] = np.maximum(out["s2"] - out["n"] * out["mean"] ** 2, 0.0)
    return out


def _check_positive(c: dict[str, np.ndarray]) -> None:
    if ((c["mean"] <= 0) & (c["n"] > 0)).any() or np.isnan(c["slog"]).any():
        raise ValueError("a Gamma model needs positive values")


def _gamma_sums(c: dict[str, np.ndarray], eta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Deviance and Pearson sum of each site at the fitted logs ``eta``."""
    mu = np.exp(eta)
    deviance = 2 * (c["n"] * eta - c["slog"] + c["s1"] / mu - c["n"]).sum(1)
    return deviance, ((c["s2"] - 2 * mu * c["s1"] + c["n"] * mu**2) / mu**2).sum(1)


@dataclass
class SiteFit:
    """Level ``a`` and slope ``b`` per site with their unscaled variances, and the sums over all sites."""

    sites: DataFrame
    family: str
    form: str
    summary: Summary
    shared_slope: Summary | None  # the same model with one slope for all (Gaussian only)


def fit_site_lines(cells: DataFrame, form: str = "slope*site", family: str = "gaussian", origin: float = 6.0) -> SiteFit:
    """Own line (or, with form 'site', own level) of every site, with one common scale."""
    h = (MONTHS - origin) * ("slope" in form)
    size = 2 if "slope" in form else 1

    def solve(c, z):
        n = c["n"]
        sn, sh, shh = n.sum(1), n @ h, n @ (h * h)
        sz, shz = (n * z).sum(1), (n * z) @ h
        det = sn * shh - sh**2 if size == 2 else np.ones(len(sn))
        with np.errstate(divide="ignore", invalid="ignore"):
            b = (sn * shz - sh * sz) / det if size == 2 else np.zeros(len(sn))
            a = (sz - b * sh) / sn
            cov = (shh / det, -sh / det, sn / det) if size == 2 else (1 / sn, 0 * sn, 0 * sn)
        return a, b, cov

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            c = _unpack(pdf["cells"])
            if family == "gaussian":
                a, b, cov = solve(c, c["mean"])
                eta = a[:, None] + b[:, None] * h
                rss = (c["n"] * (c["mean"] - eta) ** 2 + c["within"]).sum(1)
                deviance, spread = rss, rss
            else:
                _check_positive(c)
                eta = np.repeat(np.log(c["s1"].sum(1) / c["n"].sum(1))[:, None], 12, 1)
                for _ in range(STEPS):
                    mu = np.exp(eta)
                    a, b, cov = solve(c, eta + (c["mean"] - mu) / mu)
                    new = a[:, None] + b[:, None] * h
                    change = np.nanmax(np.abs(new - eta) * (c["n"] > 0), initial=0.0)
                    eta = new
                    if change < TOLERANCE * max(1.0, float(np.nanmax(np.abs(eta)))):
                        break
                else:
                    raise ArithmeticError("the Gamma model did not converge")
                deviance, spread = _gamma_sums(c, eta)
            n = c["n"].sum(1)
            mh, my = (c["n"] @ h) / n, c["s1"].sum(1) / n
            yield pd.DataFrame({
                "site": pdf["site"], "a": a, "b": b, "vaa": cov[0], "vab": cov[1], "vbb": cov[2], "n": n, "deviance": deviance, "spread": spread,
                "sxx": (c["n"] @ (h * h)) - n * mh**2, "sxy": c["s1"] @ h - n * mh * my, "syy": (c["n"] * (c["mean"] - my[:, None]) ** 2 + c["within"]).sum(1)})

    numbers = ["a", "b", "vaa", "vab", "vbb", "n", "deviance", "spread", "sxx", "sxy", "syy"]
    sites = materialize(pack_sites(cells).mapInPandas(run, "site string, " + ", ".join(f"{c} double" for c in numbers)), "site-lines")
    t = sites.agg(F.count(F.lit(1)).alias("k"), *[F.sum(c).alias(c) for c in ("n", "deviance", "spread", "sxx", "sxy", "syy")]).first()
    model = float(size * t["k"])
    shared = None
    if family == "gaussian" and size == 2 and t["k"]:
        rss = t["syy"] - t["sxy"] ** 2 / t["sxx"]
        shared = Summary(t["n"], t["k"] + 1.0, rss, rss / (t["n"] - t["k"] - 1))
    return SiteFit(sites, family, form, Summary(t["n"] or 0.0, model, t["deviance"] or 0.0, (t["spread"] or 0.0) / ((t["n"] or 0.0) - model or np.nan)), shared)


def _terms(fit: SiteFit) -> DataFrame:
    """Treatment-coded terms as sums of site parameters: (term, site, part, sign); the first site is the base."""
    base = fit.sites.agg(F.min("site")).scalar()
    t = fit.sites.select("site", base.alias("base"))

    def part(term: Column, site: str, name: str, sign: float) -> Column:
        return F.struct(term.alias("term"), F.col(site).alias("site"), F.lit(name).alias("part"), F.lit(sign).alias("sign"))

    level, slope = F.concat(F.lit("site["), "site", F.lit("]")), F.concat(F.lit("month:site["), "site", F.lit("]"))
    own = [part(F.lit("intercept"), "site", "a", 1.0)] + ([part(F.lit("month"), "site", "b", 1.0)] if "slope" in fit.form else [])
    other = [part(level, "site", "a", 1.0), part(level, "base", "a", -1.0)]
    if "slope" in fit.form:
        other += [part(slope, "site", "b", 1.0), part(slope, "base", "b", -1.0)]
    return t.select(F.inline(F.when(F.col("site") == F.col("base"), F.array(*own)).otherwise(F.array(*other))))


def _combine(fit: SiteFit, weights: DataFrame, key: str) -> DataFrame:
    """(key, estimate, se) of weighted sums of site parameters ``weights(key, site, part, weight)``."""
    by_site = weights.groupBy(key, "site").agg(
        F.sum(F.when(F.col("part") == "a", F.col("weight")).otherwise(0.0)).alias("wa"),
        F.sum(F.when(F.col("part") == "b", F.col("weight")).otherwise(0.0)).alias("wb"))
    joined = by_site.join(fit.sites, "site")
    variance = F.col("wa") ** 2 * F.col("vaa") + 2 * F.col("wa") * F.col("wb") * F.col("vab") + F.col("wb") ** 2 * F.col("vbb")
    return joined.groupBy(key).agg(
        F.sum(F.col("wa") * F.col("a") + F.col("wb") * F.col("b")).alias("estimate"),
        F.sqrt(F.sum(variance) * fit.summary.scale).alias("se"))


def coefficient_table(fit: SiteFit) -> DataFrame:
    """(term, estimate, se, statistic, p_value) of the treatment-coded model."""
    table = _combine(fit, _terms(fit).withColumnRenamed("sign", "weight"), "term").withColumn("statistic", F.col("estimate") / F.col("se"))
    df = fit.summary.df_residual

    def tail(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["p_value"] = [t_two_sided(t, df) for t in pdf["statistic"]]
            yield pdf

    return table.mapInPandas(tail, "term string, estimate double, se double, statistic double, p_value double")


def site_lines(fit: SiteFit) -> DataFrame:
    """Intercept and slope of each site; a log-link intercept is given on the response scale."""
    a = F.exp("a") if fit.family == "gamma" else F.col("a")
    return fit.sites.select("site", a.alias("intercept"), F.col("b").alias("slope"))


def line_bands(fit: SiteFit, low: float, high: float, points: int = 51, origin: float = 6.0, z: float = 1.96) -> DataFrame:
    """(site, month, fit, l95, u95): each site's line with a band by its own scale; NULL band without spare rows."""
    grid = linear_grid(fit.sites, "month", low, high, points)
    h = F.col("month") - origin
    own = F.when(F.col("n") > 2, F.col("spread") / (F.col("n") - 2))
    variance = (F.col("vaa") + 2 * h * F.col("vab") + h * h * F.col("vbb")) * own
    out = band(grid.select("site", "month", (F.col("a") + F.col("b") * h).alias("eta"), variance.alias("v")), F.col("eta"), F.col("v"), fit.family == "gamma", z)
    return out.select("site", "month", "fit", "l95", "u95")


def contrasts(fit: SiteFit, weights: DataFrame) -> DataFrame:
    """Tests of weighted sums of coefficients, ``weights(contrast, term, weight)``.

    Terms are matched by name, so a term the model does not have is an error, not a shift.
    Sites are independent given the scale, so no table of covariances between terms is needed.
    """
    parts = weights.join(_terms(fit), "term", "left").withColumn(
        "site", F.coalesce("site", F.raise_error(F.concat(F.lit("unknown term "), F.col("term")))))
    out = _combine(fit, parts.withColumn("weight", F.col("weight") * F.col("sign")), "contrast").withColumn("z", F.col("estimate") / F.col("se"))
    return out.withColumn("p_value", normal_p_two_sided("z"))


def all_pairs(fit: SiteFit) -> DataFrame:
    """Differences between the levels of all sites, with Holm-adjusted p values. The result is all pairs, by definition."""
    s = fit.sites.select("site", "a", "vaa")
    low = s.select(F.col("site").alias("_site"), F.col("a").alias("_a"), F.col("vaa").alias("_vaa"))
    pairs = s.join(low, F.col("site") > F.col("_site")).select(
        F.concat_ws(" - ", "site", "_site").alias("contrast"), (F.col("a") - F.col("_a")).alias("estimate"),
        F.sqrt((F.col("vaa") + F.col("_vaa")) * fit.summary.scale).alias("se"))
    pairs = pairs.withColumn("z", F.col("estimate") / F.col("se")).withColumn("p_value", normal_p_two_sided("z"))
    return _holm(pairs, _count(fit) * (_count(fit) - 1) // 2)


def _count(fit: SiteFit) -> int:
    """Number of sites, from the model's degrees of freedom."""
    return round(fit.summary.df_model / (2 if "slope" in fit.form else 1))


def _holm(pairs: DataFrame, count: int) -> DataFrame:
    """Holm-adjusted p values; more pairs than one task ranks are ranked in blocks, which carry the maximum of those before."""
    if count <= ranking.BLOCK_ROWS:
        order = Window.orderBy("p_value", "contrast")
        step = F.least(F.lit(1.0), (F.count(F.lit(1)).over(Window.partitionBy()) - F.row_number().over(order) + 1) * F.col("p_value"))
        return pairs.withColumn("_step", step).withColumn("p_holm", F.max("_step").over(order)).drop("_step")
    ranked = ranking.rank_values(pairs, [], ["p_value", "contrast"]).rows
    stepped = ranked.withColumn("_step", F.least(F.lit(1.0), (F.col("n") - F.col("hi") + 1) * F.col("p_value")))
    inside = Window.partitionBy("_block").orderBy("p_value", "contrast")
    before = Window.partitionBy("_g").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    tops = stepped.groupBy("_block").agg(F.max("_step").alias("_top")).withColumn("_g", F.lit(1)).select("_block", F.max("_top").over(before).alias("_before"))
    out = stepped.withColumn("_inside", F.max("_step").over(inside)).join(tops, "_block").select("contrast", F.greatest("_inside", "_before").alias("p_holm"))
    return pairs.join(out, "contrast", "left")


def neighbour_z(fit: SiteFit) -> DataFrame:
    """z tests between sites that are neighbours in falling order of level."""
    sites = fit.sites.select("site", "a", "vaa")
    if _count(fit) <= ranking.BLOCK_ROWS:
        order = Window.orderBy(F.col("a").desc(), "site")
        t = sites.select("*", *[F.lead(c).over(order).alias(f"_{c}") for c in ("site", "a", "vaa")]).where("_site is not null")
    else:
        falling = sites.withColumn("_down", -F.col("a"))
        placed = falling.join(ranking.rank_values(falling, [], ["_down", "site"]).rows.select("site", "hi"), "site")
        after = placed.select((F.col("hi") - 1).alias("hi"), *[F.col(c).alias(f"_{c}") for c in ("site", "a", "vaa")])
        t = placed.join(after, "hi")
    z = (F.col("a") - F.col("_a")) / F.sqrt((F.col("vaa") + F.col("_vaa")) * fit.summary.scale)
    return t.select(F.concat_ws(" - ", "site", "_site").alias("compare"), z.alias("z")).withColumn("p_value", normal_p_two_sided("z"))


@dataclass
class SiteCurves:
    """One smooth per site: ``theta`` (level and basis values), unscaled covariance, and test sums."""

    sites: DataFrame
    family: str
    spline: Spline
    summary: Summary


def fit_site_curves(cells: DataFrame, family: str, spline: Spline) -> SiteCurves:
    """Own level and smooth of every site, its smoothing level by its own GCV, with one common scale."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for site, packed in zip(pdf["site"], pdf["cells"]):
                c = sorted(packed, key=lambda r: r["month"])
                col = {k: np.array([np.nan if r[k] is None else r[k] for r in c], dtype=float) for k in ("month", "n", "s1", "s2", "slog")}
                model = SeasonModel(Cells(["all"], np.zeros(len(c), int), col["month"], col["n"], col["s1"], col["s2"], col["slog"]), "pooled", family, spline)
                t, fit = model.site_map(0), model.fit
                _, _, edf, rank, stat, _ = model.smooth_table("")[0]
                _, fine, plus, minus = model.fractional_tests()[0]
                left = fit.n - fit.df_model
                rows.append((site, (t @ fit.beta).tolist(), (t @ fit.cov @ t.T / fit.scale).ravel().tolist(), fit.n, fit.df_model, fit.deviance,
                             fit.scale * left, edf, rank, stat * fit.scale, fine, plus * fit.scale, minus * fit.scale))
            yield pd.DataFrame(rows, columns=["site", "theta", "theta_cov", "n", "df", "deviance", "spread", "edf", "rank", "stat", "fine_rank", "fine_plus", "fine_minus"])

    schema = "site string, theta array<double>, theta_cov array<double>, n double, df double, deviance double, spread double, edf double, rank double, stat double, fine_rank double, fine_plus double, fine_minus double"
    sites = materialize(pack_sites(cells).mapInPandas(run, schema), "site-curves")
    t = sites.agg(*[F.sum(c).alias(c) for c in ("n", "df", "deviance", "spread")]).first()
    return SiteCurves(sites, family, spline, Summary(t["n"], t["df"], t["deviance"], t["spread"] / (t["n"] - t["df"])))


def predict_sites(curves: SiteCurves, grid: DataFrame, month: str = "month") -> DataFrame:
    """Fit and 95 % band on the response scale for the (site, month) rows of ``grid``."""
    wide, names = curves.spline.attach(grid, month)
    basis = ["1", *names]
    wide = wide.join(curves.sites.select("site", "theta", "theta_cov"), "site")
    banded = band(wide, dot("theta", basis), quadratic("theta_cov", basis) * curves.summary.scale, curves.family == "gamma")
    return banded.select(*grid.columns, "fit", "l95", "u95")


def smooth_table(curves: SiteCurves, variable: str) -> DataFrame:
    """Per site: edf, reference df, Wald F and p of its smooth."""
    from ..functions.distributions import f_upper_tail

    df, scale = curves.summary.df_residual, curves.summary.scale

    def tail(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            f = pdf["stat"] / scale
            yield pd.DataFrame({"variable": variable, "site": pdf["site"], "edf": pdf["edf"], "ref_df": pdf["rank"], "f_value": f,
                                "p_value": [f_upper_tail(v, r, df) for v, r in zip(f, pdf["rank"])]})

    return curves.sites.mapInPandas(tail, "variable string, site string, edf double, ref_df double, f_value double, p_value double")


def smooth_reference_table(curves: SiteCurves, variable: str) -> DataFrame:
    """Per site: edf, reference df, F of its smooth and p from the distribution of a statistic with fractional rank.

    p is the mean over the two signs of the coupling (see SeasonModel.fractional_tests).
    """
    from ..functions.distributions import smooth_tail

    df, scale = curves.summary.df_residual, curves.summary.scale

    def tail(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            plus, minus = pdf["fine_plus"] / scale, pdf["fine_minus"] / scale
            p = [None if None in (a, b) else (a + b) / 2 for a, b in (
                (smooth_tail(u, r, df), smooth_tail(v, r, df)) for u, v, r in zip(plus, minus, pdf["fine_rank"]))]
            yield pd.DataFrame({"variable": variable, "site": pdf["site"], "edf": pdf["edf"], "ref_df": pdf["fine_rank"],
                                "f_value": (plus + minus) / 2 / pdf["fine_rank"], "p_value": p})

    return curves.sites.mapInPandas(tail, "variable string, site string, edf double, ref_df double, f_value double, p_value double")


def fit_shared_curve(cells: DataFrame, family: str, spline: Spline, few_sites: int = FEW_SITES) -> Summary:
    """One smooth for all sites and a level for each.

    Given the smooth, the level of a site has a closed form, so each step needs only sums over the
    sites, with the levels taken out of the normal equations; nothing is kept per site. The packed cells of
    at most ``few_sites`` sites are added up where the steps are made, those of more sites by a job a step.
    """
    packed = materialize(pack_sites(cells), "sites")
    local = packed.toPandas() if packed.count() <= few_sites else None
    total = collect_months(cells)
    weight = np.zeros(12)
    weight[total.month.astype(int) - 1] = total.n
    x = spline.matrix(MONTHS)
    z = null_space(weight @ x)
    x, penalty, p = x @ z, z.T @ spline.penalty @ z, z.shape[1]
    names = [f"r{i}" for i in range(p)] + ["zz", "spread", "deviance", "pearson", "n", "k"] + [f"g{i}" for i in range(p * p)]

    def sums(curve: np.ndarray) -> dict[str, float]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                c = _unpack(pdf["cells"])
                n = c["n"]
                sn = n.sum(1, keepdims=True)
                if family == "gaussian":
                    work, spread = c["mean"], c["within"].sum()
                    level = (n * (c["mean"] - curve)).sum(1, keepdims=True) / sn
                    rss = (n * (c["mean"] - level - curve) ** 2 + c["within"]).sum()
                    deviance, pearson = rss, rss
                else:
                    _check_positive(c)
                    eta = np.log((c["s1"] * np.exp(-curve)).sum(1, keepdims=True) / sn) + curve
                    mu = np.exp(eta)
                    work, spread = eta + (c["mean"] - mu) / mu, (c["within"] / mu**2).sum()
                    deviance, pearson = (v.sum() for v in _gamma_sums(c, eta))
                work = work - (n * work).sum(1, keepdims=True) / sn
                mean = (n @ x) / sn
                g = x.T @ (n.sum(0)[:, None] * x) - mean.T @ (sn * mean)
                yield pd.DataFrame([[*((n * work).sum(0) @ x), (n * work**2).sum(), spread, deviance, pearson, n.sum(), len(n), *g.ravel()]], columns=names)

        if local is not None:
            return sum((part.iloc[0] for part in run(iter([local]))), pd.Series(0.0, index=names)).to_dict()
        return packed.mapInPandas(run, ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c).alias(c) for c in names]).first().asDict()

    curve, level, settled = np.zeros(12), 0.0, 0
    for step in range(STEPS):
        s = sums(curve)
        r, g = np.array([s[f"r{i}"] for i in range(p)]), np.array([s[f"g{i}"] for i in range(p * p)]).reshape(p, p)
        unit = np.trace(g) / max(np.trace(penalty), 1e-300)

        def solve(log: float):
            inv = np.linalg.inv(g + 10.0**log * unit * penalty)
            beta = inv @ r
            edf = s["k"] + np.trace(inv @ g)
            rss = s["zz"] - 2 * beta @ r + beta @ g @ beta + s["spread"]
            return s["n"] * rss / max(s["n"] - edf, 1e-6) ** 2, beta, edf

        if settled < 2 and step < 12:  # the smoothing level is tuned until it stays
            before, level = level, stationary_levels(lambda v: solve(v[0])[0], [level])[0]
            settled = settled + 1 if level == before else 0
        _, beta, edf = solve(level)
        new = x @ beta
        change, curve = float(np.abs(new - curve).max()), new
        if family == "gaussian" or (change < TOLERANCE * max(1.0, float(np.abs(curve).max())) and (settled >= 2 or step >= 12)):
            break
    else:
        raise ArithmeticError("the Gamma model did not converge")
    s = sums(curve)
    return Summary(s["n"], float(edf), s["deviance"], s["pearson"] / (s["n"] - edf))
