"""Tables of posterior draws: curves, likelihoods, summaries and convergence checks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.curves import hash_uniform, saturating, student2_logpdf, student2_quantile
from ..session import materialize
from .joins import hand_back, key_join, linear_grid
from .ranking import shortest_interval

BLOCK = 2048  # iterations per block in the autocovariance


def curve_draws(draws: DataFrame, ids: Sequence[str], top, points: int, seed: int, closed: bool = True) -> DataFrame:
    """Curve value and predictive draw of every parameter draw on a light grid.

    ``draws`` is wide: ``ids``, pmax, alpha, rd, sigma. The noise is the t(2) quantile of a
    hash of the ids, so a re-run task gives the same numbers.
    """
    indexed = linear_grid(draws, "light", 0.0, top, points, closed)
    step = top / F.lit(float(points - 1 if closed else points))
    indexed = indexed.withColumn("m", (F.round(F.col("light") / step) + 1).cast("int"))
    yhat = saturating("light", "pmax", "alpha", "rd")
    noise = F.col("sigma") * student2_quantile(hash_uniform(F.lit(seed), *ids, "m"))
    return indexed.select(*ids, "m", "light", yhat.alias("yhat"), (yhat + noise).alias("ypred"))


def pointwise_loglik(
    data: DataFrame, draws: DataFrame, group: str, x: str, y: str, ids: Sequence[str], draw_ids: Sequence[str], parts: int = 16
) -> DataFrame:
    """Log density of each observation under each draw of its group.

    Draws are repeated once per part and observations hashed over the parts, so one group
    never forms a single shuffle partition; a draw table below the session's broadcast
    threshold is broadcast and nothing is shuffled.
    """
    left = data.select(*ids, group, F.col(x).alias("_x"), F.col(y).alias("_y"))
    left = left.withColumn("_part", F.pmod(F.xxhash64(*ids), F.lit(parts)).cast("int"))
    right = draws.select(group, *draw_ids, "pmax", "alpha", "rd", "sigma").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    )
    mu = saturating("_x", "pmax", "alpha", "rd")
    joined = key_join(left, right, [group, "_part"])
    return joined.select(*ids, *draw_ids, student2_logpdf("_y", mu, F.col("sigma")).alias("log_lik"))


def loglik_summary(
    data: DataFrame, draws: DataFrame, group: str, x: str, y: str, ids: Sequence[str], parts: int = 16
) -> DataFrame:
    """Per observation over all draws of its group: number, log of the mean density, mean and variance of the log density.

    The product of observations and draws is summed as it is made, map-side, and never written. The
    density is bounded and its tails fall as a power, so its mean needs no shift.
    """
    long = pointwise_loglik(data, draws, group, x, y, ids, [], parts)
    return long.groupBy(*ids).agg(
        F.count("log_lik").alias("n_draws"), F.ln(F.avg(F.exp("log_lik"))).alias("log_mean"),
        F.avg("log_lik").alias("mean_log"), F.var_samp("log_lik").alias("var_log"))


def mean_and_interval(draws: DataFrame, keys: Sequence[str], value: str, mass: float = 0.8) -> DataFrame:
    means = draws.groupBy(*keys).agg(F.avg(value).alias("estimate"))
    return key_join(means, shortest_interval(draws, keys, value, mass), keys, "left")


def means_by_chain(draws: DataFrame, param: str, chain: str, value: str) -> DataFrame:
    """Mean per parameter and chain, and over all chains (chain is NULL there)."""
    per = draws.groupBy(param, chain).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    overall = per.groupBy(param).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n")).withColumn(chain, F.lit(None).cast("int"))
    both = per.select(param, chain, "_s", "_n").unionByName(overall)
    return both.select(param, chain, (F.col("_s") / F.col("_n")).alias("mean"))


def split_rhat(draws: DataFrame, param: str, chain: str, iteration: str, value: str) -> DataFrame:
    """Split R-hat: between and within variance of half chains (the middle draw of odd chains is left out).

    Each chain is cut at its own middle; chains and parameters may differ in length.
    """
    lengths = draws.groupBy(param, chain).agg((F.max(iteration) + 1).alias("_length"), F.count(F.lit(1)).alias("_rows"))
    sized = hand_back(draws.select(param, chain, iteration, value), lengths, [param, chain], "_rows", [iteration])
    half = F.floor(F.col("_length") / 2)
    part = F.when(F.col(iteration) < half, 0).when(F.col(iteration) >= F.col("_length") - half, 1)
    halves = (
        sized.withColumn("_half", part).filter(F.col("_half").isNotNull())
        .groupBy(param, chain, "_half")
        .agg(F.avg(value).alias("_m"), F.var_samp(value).alias("_v"), F.count(value).alias("_n"))
    )
    out = halves.groupBy(param).agg(
        F.avg("_v").alias("_w"), F.var_samp("_m").alias("_b"), F.max("_n").alias("_n")
    )
    pooled = (F.col("_n") - 1) / F.col("_n") * F.col("_w") + F.col("_b")
    return out.select(param, F.sqrt(pooled / F.col("_w")).alias("rhat"))


def autocovariance(draws: DataFrame, param: str, chain: str, iteration: str, value: str, lags: int) -> DataFrame:
    """Sums of lagged products, one row per (parameter, chain, lag) for lags 0..``lags``; iterations must be gap-free.

    Chains are cut into blocks of at least BLOCK and ``lags`` rows, each with the ``lags`` rows after
    it, so a row goes to two blocks at most and a block's products are one correlation.
    """
    means = draws.groupBy(param, chain).agg(F.avg(value).alias("_mean"), F.count(value).alias("_n"))
    c = hand_back(draws.select(param, chain, iteration, value), means.withColumn("n", F.col("_n")), [param, chain], "_n", [iteration])
    size = max(BLOCK, lags)
    block = F.floor(F.col(iteration) / size).cast("bigint")
    reach = F.floor(F.greatest(F.col(iteration) - lags, F.lit(0)) / size).cast("bigint")
    c = c.select(param, chain, "n", F.col("_mean").alias("mean"), F.col(iteration).cast("bigint").alias("_at"), (F.col(value) - F.col("_mean")).alias("_x"),
                 F.explode(F.sequence(reach, block)).alias("_block"))
    kinds = dict(c.dtypes)

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        x, own = pdf["_x"].to_numpy(), int((pdf["_at"] // size == pdf["_block"].iloc[0]).sum())
        ahead = np.zeros(own + lags)
        ahead[:len(x)] = x[:own + lags]
        first = pdf.iloc[0]
        return pd.DataFrame({param: first[param], chain: first[chain], "n": first["n"], "mean": first["mean"],
                             "lag": np.arange(lags + 1), "s": np.correlate(ahead, x[:own], "valid")})

    long = c.groupBy(param, chain, "_block").applyInPandas(
        products, f"`{param}` {kinds[param]}, `{chain}` {kinds[chain]}, n bigint, mean double, lag bigint, s double")
    return long.groupBy(param, chain, "lag").agg(F.sum("s").alias("s"), F.first("n").alias("n"), F.first("mean").alias("mean"))


def _geyer(acov: np.ndarray, between: float, chains: int, n: int, complete: bool) -> float | None:
    """Effective draws from the autocovariances averaged over chains; None when more lags are needed."""
    within = acov[0] * n / (n - 1)
    pooled = within * (n - 1) / n + between
    rho = 1 - (within - acov * n / (n - 1)) / pooled
    rho[0] = 1.0
    total, last = 0.0, np.inf
    for t in range(0, len(rho) - 1, 2):
        pair = rho[t] + rho[t + 1]
        if pair < 0:
            break
        last = min(last, pair)
        total += last
    else:
        if not complete:
            return None
    tau = max(2 * total - 1, 1.0 / np.log10(max(chains * n, 10)))
    return chains * n / tau


def effective_ratio(draws: DataFrame, param: str, chain: str, iteration: str, value: str, lags: int = 32) -> DataFrame:
    """Effective sample size over the number of draws, initial monotone positive sequence.

    Lags are added (four times as many each round) only for parameters whose sequence has not ended, until it
    ends or the chain is used up: no lag is cut off. Chains are averaged per lag before anything is gathered.
    """
    done = None
    open_draws, longest = draws, draws.agg(F.max(iteration) + 1).first()[0]
    while True:
        lags = min(lags, longest - 1)
        acov = autocovariance(open_draws, param, chain, iteration, value, lags)
        per = acov.groupBy(param, "lag").agg(
            F.avg(F.col("s") / F.col("n")).alias("acov"), F.min("n").alias("n"), F.sum("n").alias("total"),
            F.count(F.lit(1)).alias("chains"), F.coalesce(F.var_samp("mean"), F.lit(0.0)).alias("between"))
        per = per.groupBy(param).agg(
            F.sort_array(F.collect_list(F.struct("lag", "acov"))).alias("c"), *[F.first(x).alias(x) for x in ("n", "total", "chains", "between")]).select(
            param, F.col("c.acov").alias("acov"), "n", "total", "chains", "between")
        schema = f"`{param}` {dict(per.dtypes)[param]}, n_draws bigint, ess double"

        def run(batches: Iterator[pd.DataFrame], all_lags: bool = lags >= longest - 1) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                ess = [_geyer(np.asarray(a, float), b, k, n, all_lags) for a, b, k, n in zip(pdf["acov"], pdf["between"], pdf["chains"], pdf["n"])]
                yield pd.DataFrame({param: pdf[param], "n_draws": pdf["total"], "ess": pd.Series(ess, dtype=float, index=pdf.index)})

        out = materialize(per.mapInPandas(run, schema).withColumn("ess", F.when(~F.isnan("ess"), F.col("ess"))), "ess")
        closed = out.filter(F.col("ess").isNotNull())
        done = closed if done is None else done.unionByName(closed)
        rest = out.filter(F.col("ess").isNull()).select(param)
        if lags >= longest - 1 or not rest.limit(1).count():
            break
        open_draws = key_join(draws, rest, [param], "left_semi")
        lags *= 4
    return done.select(param, "n_draws", (F.col("ess") / F.col("n_draws")).alias("neff_ratio"))


def sampler_counts(states: DataFrame, chain: str, divergent: Column, depth: Column, max_depth: int) -> DataFrame:
    """Divergent and depth-limited iterations per chain."""
    return states.groupBy(chain).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(divergent, 1)).alias("n_divergent"),
        F.count(F.when(depth >= max_depth, 1)).alias("n_max_depth"),
    )


def fit_bundle(raw: DataFrame, curve: DataFrame, keys: Sequence[str], light: str, mass: float = 0.8) -> DataFrame:
    """Raw rows, fitted bands and predictive bands of all groups in one tagged table."""
    from .ordering import union_tagged

    grid = [*keys, "m", light]
    bands = {
        kind: mean_and_interval(curve, grid, value, mass).drop("m")
        for kind, value in (("fit", "yhat"), ("predict", "ypred"))
    }
    return union_tagged({"raw": raw, **bands}, "kind")
