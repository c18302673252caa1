"""Single-step p values of all pairwise site comparisons.

The p value of a comparison is the chance that the largest of all |t| statistics reaches its own, so it
needs an equicoordinate multivariate normal or t probability. Written in polar form, the largest
statistic is a radius times a function m of the direction; the radius is integrated in closed form and
the mean over directions is taken at lattice points with several random shifts, whose spread gives the
standard error. Lattice points are dealt to the executors in ranges; only sums come back.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .siteblocks import SiteFit

POINTS, SHIFTS = 1 << 15, 8
RANGE = 1 << 12       # lattice points of one input row
CELLS = 1 << 21       # numbers that one step of a task holds


def primes(count: int) -> list[int]:
    found: list[int] = []
    n = 2
    while len(found) < count:
        if all(n % p for p in found if p * p <= n):
            found.append(n)
        n += 1
    return found


def lattice_steps(dim: int) -> np.ndarray:
    """Fractional parts of square roots of primes: steps of a lattice without period."""
    return np.array([math.sqrt(p) - math.floor(math.sqrt(p)) for p in primes(dim)])


def shift_uniform(seed: int, shift: int, axis: int) -> float:
    """The same numbers as functions.curves.hash_uniform gives."""
    return (int(hashlib.md5(f"{seed}|{shift}|{axis}".encode()).hexdigest()[:8], 16) + 0.5) / 2.0**32


def directions(first: int, count: int, dim: int, shift: np.ndarray) -> np.ndarray:
    """Unit vectors [point, axis] for lattice points ``first`` ..., by the Box-Muller rule; ``dim`` is even."""
    u = (np.arange(first, first + count)[:, None] * lattice_steps(dim)[None, :] + shift) % 1.0
    radius = np.sqrt(-2 * np.log(np.maximum(u[:, 0::2], 1e-300)))
    angle = 2 * math.pi * u[:, 1::2]
    x = np.concatenate([radius * np.cos(angle), radius * np.sin(angle)], 1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def radius_tail(square: np.ndarray, dim: int, df: float | None) -> np.ndarray:
    """Chance that the squared radius exceeds ``square``: chi-squared with an even ``dim``, or its ratio to an estimated scale."""
    if df is None:
        part, front = square / 2, np.exp(-square / 2)
        ratio = lambda j: part / j
    else:
        u = df / (df + square)
        part, front = 1 - u, u ** (df / 2)
        ratio = lambda j: part * (df / 2 + j - 1) / j
    term, total = np.ones_like(part), np.ones_like(part)
    for j in range(1, dim // 2):
        term = term * ratio(j)
        total = total + term
    return front * total


def tukey_pairs(fit: SiteFit, by_t: bool = False, points: int = POINTS, shifts: int = SHIFTS, seed: int = 7) -> DataFrame:
    """(contrast, estimate, se, z, p_value, p_error) for the levels of all sites; p_value is single-step, p_error its standard error.

    ``by_t`` uses the t distribution with the model's residual degrees of freedom, else the normal one.
    A site without a level or with a variance that is not positive takes part in no comparison; fewer
    than two sites give no rows. The sites' levels (16 bytes each) go to the driver and to every task,
    which is little beside the result, whose rows are all pairs of them.
    """
    scale, df = fit.summary.scale, fit.summary.df_residual if by_t else None
    spark = fit.sites.sparkSession
    sites = sorted((r["site"], r["a"], r["vaa"] * scale) for r in fit.sites.select("site", "a", "vaa").where("a is not null and vaa > 0").collect())
    names, level = [s for s, _, _ in sites], np.array([a for _, a, _ in sites])
    variance = np.array([v for _, _, v in sites])
    k = len(sites)
    dim = max(2, k + k % 2)
    left, right = np.triu_indices(k, 1)
    spread = np.sqrt(variance[left] + variance[right]) if k else np.empty(0)
    z = (level[right] - level[left]) / spread if k else np.empty(0)
    shift = np.array([[shift_uniform(seed, s, j) for j in range(dim)] for s in range(shifts)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sd = np.sqrt(variance)
        for pdf in batches:
            for number in pdf["id"]:
                s, first = number // ranges, number % ranges * RANGE
                count = min(RANGE, points - first)
                total = np.zeros(len(z))
                step = max(1, CELLS // max(1, len(z)))
                for low in range(first, first + count, step):
                    x = directions(low, min(step, first + count - low), dim, shift[s])[:, :k] * sd
                    most = (np.abs(x[:, right] - x[:, left]) / spread).max(1)
                    total += radius_tail((z[None, :] / most[:, None]) ** 2, dim, df).sum(0)
                yield pd.DataFrame({"pair": np.arange(len(z)), "shift": s, "total": total})

    ranges = -(-points // RANGE)
    work = spark.range(0, shifts * ranges if k > 1 else 0, 1, max(1, min(shifts * ranges, spark.sparkContext.defaultParallelism * 2)))
    sums = work.mapInPandas(run, "pair long, shift long, total double").groupBy("pair", "shift").agg((F.sum("total") / points).alias("p"))
    means = sums.groupBy("pair").agg(F.avg("p").alias("p_value"), (F.stddev_samp("p") / math.sqrt(shifts)).alias("p_error"))

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = pdf["pair"].to_numpy()
            yield pd.DataFrame({
                "contrast": [f"{names[right[i]]} - {names[left[i]]}" for i in at], "estimate": level[right[at]] - level[left[at]], "se": spread[at],
                "z": z[at], "p_value": pdf["p_value"].clip(0, 1), "p_error": pdf["p_error"]})

    return means.mapInPandas(label, "contrast string, estimate double, se double, z double, p_value double, p_error double")
