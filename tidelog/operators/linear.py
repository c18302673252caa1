"""Season x site models fitted from (site, month) cells.

The covariates are a calendar month and a site, so every least-squares or Gamma fit
depends on the rows only through a few sums per cell. One aggregation over the data
yields at most 12 cells per site; iterations then cost nothing at any data size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distributions import f_upper_tail
from .joins import dimension

@dataclass
class Cells:
    """Sufficient statistics per (site, month)."""

    sites: list[str]
    site: np.ndarray
    month: np.ndarray
    n: np.ndarray
    s1: np.ndarray
    s2: np.ndarray
    slog: np.ndarray


def month_cells(df: DataFrame, site: str, month: str, value: str) -> DataFrame:
    y = F.col(value)
    return (
        df.filter(y.isNotNull() & F.col(site).isNotNull() & F.col(month).isNotNull())
        .groupBy(F.col(site).alias("site"), F.col(month).cast("int").alias("month"))
        .agg(F.count(y).alias("n"), F.sum(y).alias("s1"), F.sum(y * y).alias("s2"), F.sum(F.ln(y)).alias("slog"))
    )


def collect_months(cells: DataFrame) -> Cells:
    """The cells of all sites together, at most one per month, as one site."""
    whole = cells.groupBy("month").agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2", "slog")], F.max(F.col("slog").isNull()).alias("_bad"))
    slog = F.when(~F.col("_bad"), F.col("slog"))  # a value without logarithm stays visible
    return collect_cells(whole.select(F.lit("all").alias("site"), "month", "n", "s1", "s2", slog.alias("slog")))


def collect_cells(cells: DataFrame) -> Cells:
    """Cells of a few sites on the driver, for models of their own; see siteblocks for any number of sites."""
    rows = cells.collect()
    if any(not 1 <= r["month"] <= 12 for r in rows):
        raise ValueError("expected months 1..12")
    rows.sort(key=lambda r: (r["site"], r["month"]))
    sites = sorted({r["site"] for r in rows})

    def column(name):
        return np.array([np.nan if r[name] is None else r[name] for r in rows], dtype=float)

    index = np.array([sites.index(r["site"]) for r in rows])
    return Cells(sites, index, column("month"), column("n"), column("s1"), column("s2"), column("slog"))


@dataclass
class Fit:
    terms: list[str]
    beta: np.ndarray
    cov: np.ndarray
    edf: np.ndarray  # effective df per coefficient
    deviance: float
    scale: float
    n: float
    family: str
    lambdas: list[float]

    @property
    def df_model(self) -> float:
        return float(self.edf.sum())

    @property
    def df_residual(self) -> float:
        return self.n - self.df_model


def stationary_levels(score, start: list[float]) -> list[float]:
    """Coordinate search of the log10 smoothing levels on a coarse, then a fine grid."""
    logs = list(start)
    for step, sweeps in ((1.0, 2), (0.25, 2), (0.05, 1)):
        for _ in range(sweeps):
            for i in range(len(logs)):
                tries = [np.clip(logs[i] + step * j, -7.0, 7.0) for j in range(-6, 7)]
                scores = [score(logs[:i] + [t] + logs[i + 1 :]) for t in tries]
                logs[i] = float(tries[int(np.argmin(scores))])
    return logs


def fit_cells(
    cells: Cells, x: np.ndarray, terms: list[str], family: str = "gaussian", penalties: Sequence[np.ndarray] = ()
) -> Fit:
    """Gaussian (identity) or Gamma (log) fit of a cell-level design, penalised when asked.

    With the log link a Gamma model has unit working weights, so each iteration is an
    ordinary penalised solve with weights n. Smoothing levels minimise GCV.
    """
    n, mean = cells.n, cells.s1 / cells.n
    within = np.maximum(cells.s2 - cells.n * mean**2, 0.0)
    total = float(n.sum())
    g = x.T @ (n[:, None] * x)
    scales = [np.trace(g) / max(np.trace(p), 1e-300) for p in penalties]
    logs = [0.0] * len(penalties)

    def weighted(z, spread):
        c = x.T @ (n * z)

        def solve(levels):
            a = g + sum((10.0**v * sc) * p for v, sc, p in zip(levels, scales, penalties)) if penalties else g
            inv = np.linalg.inv(a)
            beta = inv @ c
            edf = np.diag(inv @ g)
            rss = float((n * (z - x @ beta) ** 2).sum() + spread)
            return total * rss / max(total - edf.sum(), 1e-6) ** 2, beta, edf, inv, rss

        return solve

    if family == "gaussian":
        solve = weighted(mean, float(within.sum()))
        if penalties:
            logs = stationary_levels(lambda v: solve(v)[0], logs)
        _, beta, edf, inv, rss = solve(logs)
        deviance, scale = rss, rss / (total - edf.sum())
    else:
        if (mean <= 0).any() or np.isnan(cells.slog).any():
            raise ValueError("a Gamma model needs positive values")
        eta = np.full(len(n), np.log(cells.s1.sum() / total))
        for step in range(200):
            mu = np.exp(eta)
            z = eta + (mean - mu) / mu
            solve = weighted(z, float((within / mu**2).sum()))
            if penalties and step < 12:
                logs = stationary_levels(lambda v: solve(v)[0], logs)
            _, beta, edf, inv, _ = solve(logs)
            change, eta = float(np.abs(x @ beta - eta).max()), x @ beta
            mu = np.exp(eta)
            if change < 1e-11 * max(1.0, float(np.abs(eta).max())) and step >= (12 if penalties else 2):
                break
        else:
            raise ArithmeticError("the Gamma model did not converge")
        deviance = float(2 * (n * eta - cells.slog + cells.s1 / mu - n).sum())
        pearson = float(((cells.s2 - 2 * mu * cells.s1 + n * mu**2) / mu**2).sum())
        scale = pearson / (total - edf.sum())
    return Fit(terms, beta, inv * scale, edf, deviance, scale, total, family, [10.0**v for v in logs])


def linear_design(cells: Cells, form: str, origin: float = 6.0) -> tuple[np.ndarray, list[str]]:
    """Treatment-coded design: ``form`` is 'slope', 'site', 'slope+site' or 'slope*site'.

    The first site is the base level; ``origin`` is the month where the slope term is zero.
    """
    h = cells.month - origin
    columns, terms = [np.ones_like(h)], ["intercept"]
    if "slope" in form:
        columns.append(h)
        terms.append("month")
    others = [(i, s) for i, s in enumerate(cells.sites) if i > 0]
    if "site" in form:
        for i, s in others:
            columns.append((cells.site == i).astype(float))
            terms.append(f"site[{s}]")
    if "*" in form:
        for i, s in others:
            columns.append((cells.site == i) * h)
            terms.append(f"month:site[{s}]")
    return np.column_stack(columns), terms


def linear_model(cells: Cells, form: str, family: str = "gaussian", origin: float = 6.0) -> Fit:
    x, terms = linear_design(cells, form, origin)
    return fit_cells(cells, x, terms, family)


def compare_nested(spark: SparkSession, fits: dict[str, Fit]) -> DataFrame:
    """Analysis of deviance for models listed from small to large; F uses the largest model's scale."""
    items = list(fits.items())
    scale, df_last = items[-1][1].scale, items[-1][1].df_residual
    rows = []
    for i, (name, f) in enumerate(items):
        if i == 0:
            rows.append((name, f.df_residual, f.deviance, None, None, None, None))
            continue
        before = items[i - 1][1]
        df, dev = before.df_residual - f.df_residual, before.deviance - f.deviance
        value = dev / df / scale if df > 1e-9 else float("nan")
        rows.append((name, f.df_residual, f.deviance, df, dev, value, f_upper_tail(value, df, df_last)))
    names = ["model", "df_residual", "deviance", "df", "deviance_drop", "f_value", "p_value"]
    return dimension(spark, rows, names)
