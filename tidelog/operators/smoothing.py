"""Penalised spline per group: sums of products on Spark, then one small solve per group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.splines import Spline
from ..session import materialize
from .joins import hand_back


def gram(df: DataFrame, keys: Sequence[str], spline: Spline, x: str, y: str) -> DataFrame:
    """Per group: upper triangle of B'B, B'y, y'y and n. One aggregation, combined map-side."""
    k = spline.size
    rows = df.select(*keys, x, F.col(y).alias("_y")).filter(F.col("_y").isNotNull() & F.col(x).isNotNull())
    wide, _ = spline.attach(rows, x)
    pairs = ", ".join(f"sum(_b{i} * _b{j})" for i in range(k) for j in range(i, k))
    cross = ", ".join(f"sum(_b{i} * _y)" for i in range(k))
    return wide.groupBy(*keys).agg(
        F.expr(f"array({pairs})").alias("gram"),
        F.expr(f"array({cross})").alias("cross"),
        F.expr("sum(_y * _y)").alias("yy"),
        F.count(F.lit(1)).alias("n"),
    )


def unpack(flat: np.ndarray, k: int) -> np.ndarray:
    """Symmetric matrices from stacked upper triangles."""
    out = np.zeros((len(flat), k, k))
    rows, cols = np.triu_indices(k)
    out[:, rows, cols] = flat
    out[:, cols, rows] = flat
    return out


def solve_penalised(g: np.ndarray, c: np.ndarray, yy: np.ndarray, n: np.ndarray, s: np.ndarray):
    """Batch of ridge-type solves with the smoothing level that minimises n RSS / (n - edf)^2.

    Returns beta, edf, lambda, residual variance and covariance per group; groups with too
    few rows come back as NaN.
    """
    k = g.shape[1]
    trace = np.maximum(np.trace(g, axis1=1, axis2=2), 1e-300)
    scale = trace / np.trace(s)
    g = g + (1e-12 * trace / k)[:, None, None] * np.eye(k)

    def fit(lam):
        inv = np.linalg.inv(g + (lam * scale)[:, None, None] * s)
        beta = np.einsum("gij,gj->gi", inv, c)
        rss = np.maximum(yy - 2 * (beta * c).sum(1) + np.einsum("gi,gij,gj->g", beta, g, beta), 0.0)
        edf = np.einsum("gij,gji->g", inv, g)
        left = n - edf
        gcv = np.where(left > 1e-6, n * rss / np.maximum(left, 1e-6) ** 2, np.inf)
        return gcv, beta, rss, edf, inv

    best = np.full(len(g), np.inf)
    log_lam = np.zeros(len(g))
    for centre, offsets in ((np.zeros(len(g)), np.arange(-7, 7.01, 0.5)), (None, np.arange(-0.45, 0.451, 0.05))):
        centre = log_lam.copy() if centre is None else centre
        for off in offsets:
            gcv = fit(10.0 ** (centre + off))[0]
            better = gcv < best
            best = np.where(better, gcv, best)
            log_lam = np.where(better, centre + off, log_lam)
    _, beta, rss, edf, inv = fit(10.0**log_lam)
    ok = n > edf + 0.5
    sigma2 = np.where(ok, rss / np.where(ok, n - edf, 1.0), np.nan)
    beta = np.where(ok[:, None], beta, np.nan)
    return beta, edf, 10.0**log_lam * scale, sigma2, inv * sigma2[:, None, None]


def fit_groups(grams: DataFrame, keys: Sequence[str], spline: Spline) -> DataFrame:
    """One row per group: ``beta``, ``cov`` (row-major), ``edf``, ``lambda``, ``sigma2``, ``n``.

    Each input row is a whole group already reduced to k(k+1)/2 sums, so nothing is shuffled
    and a batch is solved at once. A group that cannot be fitted has NULL coefficients.
    """
    k, s, keys = spline.size, spline.penalty, list(keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grams.schema if f.name in keys)
    schema += ", beta array<double>, cov array<double>, edf double, lambda double, sigma2 double, n bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            g = unpack(np.stack(pdf["gram"].to_numpy()), k)
            c = np.stack(pdf["cross"].to_numpy())
            n = pdf["n"].to_numpy(dtype=float)
            beta, edf, lam, sigma2, cov = solve_penalised(g, c, pdf["yy"].to_numpy(dtype=float), n, s)
            ok = np.isfinite(beta).all(axis=1)
            out = pdf[keys].copy()
            out["beta"] = [b.tolist() if good else None for b, good in zip(beta, ok)]
            out["cov"] = [v.ravel().tolist() if good else None for v, good in zip(cov, ok)]
            for name, values in (("edf", edf), ("lambda", lam), ("sigma2", sigma2)):
                out[name] = [float(v) if good else None for v, good in zip(values, ok)]
            out["n"] = pdf["n"]
            yield out

    return grams.mapInPandas(run, schema)


def dot(coefficients: str, basis: Sequence[str]) -> Column:
    """Sum of coefficient array elements times the named columns ('1' for the level)."""
    return F.expr(" + ".join(f"get({coefficients}, {i}) * {b}" for i, b in enumerate(basis)))


def quadratic(cov: str, basis: Sequence[str]) -> Column:
    """b' V b for a row-major covariance array and named columns."""
    k = len(basis)
    return F.expr(" + ".join(
        f"{1 if i == j else 2}D * get({cov}, {i * k + j}) * {basis[i]} * {basis[j]}" for i in range(k) for j in range(i, k)
    ))


def slope_at_rows(
    df: DataFrame, keys: Sequence[str], x: str, y: str, spline: Spline, spread_by: Sequence[str], out: str = "rate"
) -> DataFrame:
    """Input rows plus the slope of their group's smooth curve (exact derivative, no finite difference).

    Values enter the sums less their group's mean, so a large offset costs no digits.
    """
    means = df.groupBy(*keys).agg(F.avg(y).alias("_mean"), F.count(F.lit(1)).alias("_rows"))
    centred = hand_back(df, means, keys, "_rows", spread_by).withColumn(y, F.col(y) - F.col("_mean"))
    fits = materialize(fit_groups(gram(centred, keys, spline, x, y), keys, spline), "slopes")
    joined = hand_back(df, fits.select(*keys, "beta", "n"), keys, "n", spread_by, fits.count())
    wide, names = spline.attach(joined, x, derivative=1)
    return wide.withColumn(out, dot("beta", names)).drop("beta", *names)
