"""Smooth seasonal curves: pooled, with site levels, or one curve per site."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distributions import f_upper_tail
from ..functions.splines import Spline
from .joins import dimension, linear_grid
from .linear import Cells, Fit, fit_cells
from .smoothing import dot, quadratic

FORMS = ("pooled", "site", "by_site")


def month_spline(cyclic: bool = True, k: int = 10) -> Spline:
    """Knots spread over 1..12. The cyclic curve has equal value and slope at both ends."""
    return Spline.even(1.0, 12.0, k, "cc" if cyclic else "cr")


def null_space(row: np.ndarray) -> np.ndarray:
    """Orthonormal basis of the vectors orthogonal to ``row``."""
    q, _ = np.linalg.qr(row[:, None], mode="complete")
    return q[:, 1:]


class SeasonModel:
    """Design and fit of one seasonal model; everything here has the size of the model."""

    def __init__(self, cells: Cells, form: str, family: str, spline: Spline):
        if form not in FORMS:
            raise ValueError(form)
        self.cells, self.form, self.spline = cells, form, spline
        b = spline.matrix(cells.month)
        sites = range(len(cells.sites))
        columns, terms = [np.ones((len(cells.n), 1))], ["intercept"]
        if form != "pooled":
            for i in list(sites)[1:]:
                columns.append((cells.site == i).astype(float)[:, None])
                terms.append(f"site[{cells.sites[i]}]")
        # Each smooth sums to zero over its rows, which keeps it apart from the intercepts.
        self.blocks: list[tuple[str, int, np.ndarray]] = []
        for label, mask in ([("all", np.ones(len(cells.n), bool))] if form != "by_site"
                            else [(cells.sites[i], cells.site == i) for i in sites]):
            z = null_space((cells.n[mask, None] * b[mask]).sum(0))
            self.blocks.append((label, len(terms), z))
            columns.append((b @ z) * mask[:, None])
            terms += [f"s(month)[{label}].{j}" for j in range(z.shape[1])]
        p = len(terms)
        penalties = []
        for _, start, z in self.blocks:
            full = np.zeros((p, p))
            full[start : start + z.shape[1], start : start + z.shape[1]] = z.T @ spline.penalty @ z
            penalties.append(full)
        self.design = np.column_stack(columns)
        self.fit: Fit = fit_cells(cells, self.design, terms, family, penalties)

    def site_map(self, i: int) -> np.ndarray:
        """Matrix from model coefficients to (level, basis values at knots) of site ``i``."""
        k = self.spline.size
        t = np.zeros((1 + k, len(self.fit.terms)))
        t[0, 0] = 1.0
        if self.form != "pooled" and i > 0:
            t[0, i] = 1.0
        _, start, z = self.blocks[i if self.form == "by_site" else 0]
        t[1:, start : start + z.shape[1]] = z
        return t

    def curves(self, spark: SparkSession) -> DataFrame:
        """One row per site: local coefficients ``theta`` and their covariance (row-major)."""
        rows = []
        for i, s in enumerate(self.cells.sites):
            t = self.site_map(i)
            rows.append((s, (t @ self.fit.beta).tolist(), (t @ self.fit.cov @ t.T).ravel().tolist()))
        return dimension(spark, rows, ["site", "theta", "theta_cov"])

    def smooth_table(self, variable: str) -> list[tuple]:
        """Per smooth: edf, reference df, Wald F and p."""
        out = []
        for label, start, z in self.blocks:
            block = slice(start, start + z.shape[1])
            edf = float(self.fit.edf[block].sum())
            # Rank-limited Wald statistic over the directions the data really support.
            rank = max(1, int(np.ceil(edf - 0.05)))
            w, v = np.linalg.eigh(self.fit.cov[block, block])
            b = self.fit.beta[block]
            keep = np.argsort(w)[::-1][:rank]
            stat = float((((v[:, keep].T @ b) ** 2) / w[keep]).sum()) / rank
            out.append((variable, label, edf, float(rank), stat, f_upper_tail(stat, rank, self.fit.df_residual)))
        return out


    def fractional_tests(self) -> list[tuple[str, float, float, float]]:
        """Per smooth: its label, the rank of its test and the two Wald statistics of that rank (Wood 2013, Biometrika 100).

        The rank is 2 edf - trace(F F), with F the matrix from data to fit; it need not be whole. The part above
        the whole number couples two directions, and the sign of the coupling is arbitrary: both are given.
        """
        gram = self.design.T @ (self.cells.n[:, None] * self.design)
        f = self.fit.cov / self.fit.scale @ gram
        spare = 2 * np.diag(f) - np.einsum("ij,ji->i", f, f)
        out = []
        for label, start, z in self.blocks:
            block = slice(start, start + z.shape[1])
            r = np.linalg.cholesky(gram[block, block] + 1e-12 * np.trace(gram[block, block]) * np.eye(z.shape[1])).T
            w, v = np.linalg.eigh(r @ self.fit.cov[block, block] @ r.T)
            w, v = w[::-1], v[:, ::-1]
            b = v.T @ (r @ self.fit.beta[block])
            rank = float(min(spare[block].sum(), (w > w[0] * 1e-12).sum()))
            whole = int(rank + 1e-9)
            part = rank - whole
            plain = b**2 / w
            if part < 1e-6 or whole == 0:
                stat = float(plain[:max(whole, 1)].sum())
                out.append((label, max(rank, 1.0), stat, stat))
                continue
            pair, side = b[whole - 1:whole + 1] / np.sqrt(w[whole - 1:whole + 1]), np.sqrt(part * (1 - part) / 2)
            base = float(plain[:whole - 1].sum() + pair[0] ** 2 + part * pair[1] ** 2)
            out.append((label, rank, base + 2 * side * float(pair[0] * pair[1]), base - 2 * side * float(pair[0] * pair[1])))
        return out


def band(df: DataFrame, eta: Column, variance: Column, log_link: bool, z: float = 1.96) -> DataFrame:
    back = F.exp if log_link else (lambda c: c)
    half = F.lit(z) * F.sqrt(F.greatest(variance, F.lit(0.0)))
    df = df.withColumn("_eta", eta).withColumn("_half", half)
    return df.select(
        *[c for c in df.columns if c not in ("_eta", "_half")],
        back(F.col("_eta")).alias("fit"),
        back(F.col("_eta") - F.col("_half")).alias("l95"),
        back(F.col("_eta") + F.col("_half")).alias("u95"),
    )


def predict(model: SeasonModel, grid: DataFrame, month: str = "month") -> DataFrame:
    """Fit and 95 % band on the response scale for the (site, month) rows of ``grid``."""
    spark = grid.sparkSession
    wide, names = model.spline.attach(grid, month)
    basis = ["1", *names]
    wide = wide.join(model.curves(spark), "site")
    banded = band(wide, dot("theta", basis), quadratic("theta_cov", basis), model.fit.family == "gamma")
    return banded.select(*grid.columns, "fit", "l95", "u95")


def facet_curves(
    cells: DataFrame, facet: Sequence[str], spline: Spline, family: str, points: int = 51
) -> DataFrame:
    """Own smooth and band for every facet, for any number of facets.

    ``cells`` holds at most twelve month cells per facet, so the list gathered for one
    facet is bounded by the calendar; the small solves run on the executors.
    """
    facet = list(facet)
    packed = cells.groupBy(*facet).agg(
        F.collect_list(F.struct("month", "n", "s1", "s2", "slog")).alias("cells")
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema if f.name in facet)
    schema += ", theta array<double>, theta_cov array<double>, edf double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            fitted = [_fit_facet(c, spline, family) for c in pdf["cells"]]
            out = pdf[facet].copy()
            for i, name in enumerate(("theta", "theta_cov", "edf")):
                out[name] = [f[i] for f in fitted]
            yield out

    curves = packed.mapInPandas(run, schema)
    grid = linear_grid(curves, "month", spline.knots[0], spline.knots[-1], points)
    grid, names = spline.attach(grid, "month")
    basis = ["1", *names]
    banded = band(grid, dot("theta", basis), quadratic("theta_cov", basis), family == "gamma")
    return banded.select(*facet, "month", "edf", "fit", "l95", "u95")


def _fit_facet(cells, spline: Spline, family: str):
    """A facet that cannot be fitted gives NULLs instead of failing the job."""
    try:
        c = sorted(cells, key=lambda r: r["month"])
        col = {n: np.array([np.nan if r[n] is None else r[n] for r in c], dtype=float) for n in ("month", "n", "s1", "s2", "slog")}
        model = SeasonModel(
            Cells(["all"], np.zeros(len(c), int), col["month"], col["n"], col["s1"], col["s2"], col["slog"]),
            "pooled", family, spline,
        )
        t = model.site_map(0)
        return (t @ model.fit.beta).tolist(), (t @ model.fit.cov @ t.T).ravel().tolist(), model.fit.df_model
    except (ValueError, np.linalg.LinAlgError):
        return None, None, None
