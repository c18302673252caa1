"""Posterior draws of partly pooled light-response curves by data-augmented Gibbs steps.

y = pmax (1 - e^(-alpha x / pmax)) - rd + t(2) error per group; pmax and rd come from normal, alpha from a
lognormal distribution over groups, all scales have half-Cauchy priors. A t(2) error is a normal one
with a gamma weight per row, so given the weights a group depends on its rows only through weighted sums.

A sweep is one job: every block of rows draws its weights and adds up its sums for the places of a small
grid of alpha / pmax; sums come back, parameters are drawn from them. Rows never move, a group may have
any number of them. All chains run in the same jobs. What is drawn depends on (seed, sweep, block) alone,
so a lost task is drawn again as it was.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, new_path
from .lightcurve import polish_curves

WINDOW = 8            # grid places to either side that a step can reach
STEP = 0.5            # distance of grid places in standard errors of log(alpha / pmax)
DIRECT = 1 << 20      # numbers of a sweep that tasks send to the driver themselves; more are added up in a shuffle first
BLOCK_ROWS = 1 << 15  # rows that are packed together
WRITE_EVERY = 50      # sweeps between writes of the draws
SCHEMA = "chain int, iter long, param string, k int, value double"


@dataclass
class Priors:
    """Normal priors of the means of pmax, log(alpha) and rd over groups, and the scale of the half-Cauchy priors."""

    pmax: tuple[float, float] = (10.0, 500.0)
    log_alpha: tuple[float, float] = (float(np.log(3.0)), 1.5)
    rd: tuple[float, float] = (5.0, 250.0)
    cauchy: float = 2.5


class Chains:
    """Parameters [chain, group] and the draws that follow from weighted sums."""

    def __init__(self, start: np.ndarray, steps: np.ndarray, counts: np.ndarray, priors: Priors, chains: int, seed: int):
        """``start``: pmax, alpha, rd, sigma per group; ``steps``: grid distances in log(alpha / pmax)."""
        self.rng = np.random.default_rng([seed, 1 << 32])
        self.priors, self.counts, self.steps = priors, counts, steps
        wide = start[None] * np.exp(self.rng.normal(0, 0.05, (chains, *start.shape)))
        self.pmax, alpha, self.rd, self.sigma = (wide[:, :, i].copy() for i in range(4))
        self.log_ratio = np.log(alpha / self.pmax)
        self.aux = np.ones_like(self.sigma)
        self.mean = np.stack([self.pmax.mean(1), (self.log_ratio + np.log(self.pmax)).mean(1), self.rd.mean(1)], 1)  # pmax, log alpha, rd
        self.sd = np.maximum(np.stack([self.pmax.std(1), alpha.std(1) / alpha.mean(1), self.rd.std(1)], 1), 0.3)
        self.hyper_aux = np.ones((chains, 3))

    def grid(self) -> np.ndarray:
        """log(alpha / pmax) [chain, group, place]: a window around the present place with a random offset."""
        self.offset = self.rng.integers(-WINDOW, WINDOW + 1, self.sigma.shape)
        places = np.arange(-WINDOW, WINDOW + 1)[None, None, :] - self.offset[:, :, None]
        return self.log_ratio[:, :, None] + places * self.steps[None, :, None]

    def _inverse_gamma(self, shape, rate) -> np.ndarray:
        return rate / self.rng.gamma(shape, size=np.shape(rate))

    def update(self, grid: np.ndarray, s: np.ndarray) -> None:
        """``s`` [chain, group, ...]: sums of w, wy, wyy, then wg, wgg, wgy for every place of the grid."""
        sw, swy, swyy = (s[..., i, None] for i in range(3))
        wg, wgg, wgy = np.split(s[..., 3:], 3, axis=-1)
        precision = 1 / self.sigma[..., None] ** 2
        p_m, p_s = self.mean[:, 0, None, None], self.sd[:, 0, None, None] ** -2
        r_m, r_s = self.mean[:, 2, None, None], self.sd[:, 2, None, None] ** -2
        a11, a12, a22 = wgg * precision + p_s, -wg * precision, sw * precision + r_s
        b1, b2 = wgy * precision + p_m * p_s, -swy * precision + r_m * r_s
        det = a11 * a22 - a12**2
        m1, m2 = (a22 * b1 - a12 * b2) / det, (a11 * b2 - a12 * b1) / det
        weight = -0.5 * np.log(det) + 0.5 * (b1 * m1 + b2 * m2)
        pick = (weight + self.rng.gumbel(size=weight.shape)).argmax(-1)[..., None]
        take = lambda v: np.take_along_axis(np.broadcast_to(v, weight.shape), pick, -1)[..., 0]
        a11, a12, a22, det = take(a11), take(a12), take(a22), take(det)
        pmax = take(m1) + np.sqrt(a22 / det) * self.rng.normal(size=det.shape)
        rd = take(m2) - a12 / a22 * (pmax - take(m1)) + self.rng.normal(size=det.shape) / np.sqrt(a22)
        ratio = take(grid)
        # the prior of alpha is not in the grid's weights: a Metropolis step puts it right
        with np.errstate(invalid="ignore", divide="ignore"):
            far = lambda log_alpha: -0.5 * ((log_alpha - self.mean[:, 1, None]) / self.sd[:, 1, None]) ** 2
            gain = far(ratio + np.log(pmax)) - far(self.log_ratio + np.log(self.pmax))
        good = (pmax > 0) & (np.log(self.rng.random(det.shape)) < np.nan_to_num(gain, nan=-np.inf))
        self.accepted = good
        for name, new in (("pmax", pmax), ("rd", rd), ("log_ratio", ratio)):
            setattr(self, name, np.where(good, new, getattr(self, name)))
        place = np.where(good[..., None], pick, self.offset[..., None] + WINDOW)
        at = lambda v: np.take_along_axis(v, place, -1)[..., 0]
        g, gg, gy = at(wg), at(wgg), at(wgy)
        rss = swyy[..., 0] - 2 * self.pmax * gy + 2 * self.rd * swy[..., 0] + self.pmax**2 * gg - 2 * self.pmax * self.rd * g + self.rd**2 * sw[..., 0]
        self.sigma = np.sqrt(self._inverse_gamma((self.counts + 1) / 2, np.maximum(rss, 0) / 2 + 1 / self.aux))
        self.aux = self._inverse_gamma(1.0, 1 / self.priors.cauchy**2 + 1 / self.sigma**2)
        self._hyper()

    def _hyper(self) -> None:
        values = np.stack([self.pmax, self.log_ratio + np.log(self.pmax), self.rd], 1)
        k = values.shape[2]
        for i, (centre, spread) in enumerate((self.priors.pmax, self.priors.log_alpha, self.priors.rd)):
            precision = k / self.sd[:, i] ** 2 + spread**-2
            mean = (values[:, i].sum(1) / self.sd[:, i] ** 2 + centre * spread**-2) / precision
            drawn = mean + self.rng.normal(size=len(mean)) / np.sqrt(precision)
            while i == 0 and (drawn <= 0).any():  # the mean of pmax is positive
                drawn = np.where(drawn > 0, drawn, mean + self.rng.normal(size=len(mean)) / np.sqrt(precision))
            self.mean[:, i] = drawn
        squares = ((values - self.mean[:, :, None]) ** 2).sum(2)
        self.sd = np.sqrt(self._inverse_gamma((k + 1) / 2, squares / 2 + 1 / self.hyper_aux))
        self.hyper_aux = self._inverse_gamma(1.0, 1 / self.priors.cauchy**2 + 1 / self.sd**2)

    def rows(self, iteration: int) -> pd.DataFrame:
        chains, k = self.sigma.shape
        alpha = np.exp(self.log_ratio) * self.pmax
        own = [(n, v) for n, v in (("pmax", self.pmax), ("alpha", alpha), ("rd", self.rd), ("sigma", self.sigma))]
        parts = [pd.DataFrame({"chain": np.repeat(np.arange(chains), k), "iter": iteration, "param": n, "k": np.tile(np.arange(1, k + 1), chains), "value": v.ravel()}) for n, v in own]
        shared = {"mu_pmax": self.mean[:, 0], "mu_alpha": np.exp(self.mean[:, 1]), "mu_rd": self.mean[:, 2],
                  "sigma_pmax": self.sd[:, 0], "sigma_alpha": self.sd[:, 1], "sigma_rd": self.sd[:, 2]}
        parts += [pd.DataFrame({"chain": np.arange(chains), "iter": iteration, "param": n, "k": 0, "value": v}) for n, v in shared.items()]
        return pd.concat(parts, ignore_index=True)


def weighted_sums(x: np.ndarray, y: np.ndarray, grid: np.ndarray, pmax: float, ratio: float, rd: float, sigma: float, rng,
                  counts: np.ndarray | None = None) -> np.ndarray:
    """Draw the weights of one group's rows and add up w, wy, wyy, then wg, wgg, wgy at every place of the grid.

    With ``counts`` x holds each light value of the block once and y the counts[i] values of x[i] one after another:
    every row has a weight of its own, curves are taken once per light value.
    """
    curve = pmax * (1 - np.exp(-np.exp(ratio) * x)) - rd
    z = (y - (curve if counts is None else np.repeat(curve, counts))) / sigma
    w = rng.gamma(1.5, size=len(y)) * 2 / (2 + z * z)
    wy = w * y
    wyy = wy @ y
    if counts is not None:
        at = np.cumsum(counts) - counts
        w, wy = np.add.reduceat(w, at), np.add.reduceat(wy, at)
    g = 1 - np.exp(-np.exp(grid)[:, None] * x[None, :])
    return np.concatenate([[w.sum(), wy.sum(), wyy], g @ w, (g * g) @ w, g @ wy])


def _pack(rows: DataFrame, tasks: int) -> DataFrame:
    """(block, k, x, counts, y), packed numbers: one row per group and up to BLOCK_ROWS input rows, dealt over ``tasks`` files; ``rows`` are (k, x, y).

    x holds each light value of a block once, in ascending order, y the values of each in turn.
    """
    def block(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        k, x, y = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((x, k))
        k, x, y = k[order], x[order], y[order]
        first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (x[1:] != x[:-1])])
        counts = np.diff(np.r_[first, len(k)]).astype(np.int32)
        found, at = np.unique(k, return_index=True)
        ends, own = np.r_[at, len(k)], np.searchsorted(first, np.r_[at, len(k)])
        cells = [[x[first[c:d]].tobytes() for c, d in zip(own, own[1:])], [counts[c:d].tobytes() for c, d in zip(own, own[1:])], [y[c:d].tobytes() for c, d in zip(ends, ends[1:])]]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *(pa.array(c, pa.binary()) for c in cells)], names=["k", "x", "counts", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        for batch in batches:
            parts.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            if sum(len(p[0]) for p in parts) >= BLOCK_ROWS:
                yield block(parts)
                parts = []
        if any(len(p[0]) for p in parts):
            yield block(parts)

    packed = rows.mapInArrow(run, "k int, x binary, counts binary, y binary").repartition(tasks)
    return materialize(packed.select(F.monotonically_increasing_id().alias("block"), "*"), "sampler-rows")


def sample_curves(df: DataFrame, keys: Sequence[str], x: str, y: str, priors: Priors | None = None, chains: int = 4, warmup: int = 30,
                  draws: int = 240, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Posterior draws (chain, iter, param, k, value) and the groups (keys, k) they belong to.

    Parameters of group k: pmax, alpha, rd, sigma; with k = 0: mu_pmax, mu_alpha, mu_rd and sigma_pmax, sigma_alpha, sigma_rd.
    Rows without light, value or key are left out, so are groups without a curve of their own (see polish_curves),
    which have no k. One row of parameters per group and chain travels to the driver and back in each sweep.
    """
    keys, spark = list(keys), df.sparkSession
    fits = polish_curves(df.dropna(subset=keys), keys, x, y).filter("pmax > 0 AND alpha > 0").select(*keys, "n", "pmax", "alpha", "rd", "sse", "v00", "v01", "v11")
    known = fits.collect()
    known.sort(key=lambda r: tuple(str(r[c]) for c in keys))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fits.schema if f.name in keys) + ", k int"
    groups = spark.createDataFrame([(*[r[c] for c in keys], i + 1) for i, r in enumerate(known)], schema)
    if not known:
        return spark.createDataFrame([], SCHEMA), groups
    start = np.array([(r["pmax"], r["alpha"], r["rd"], max(np.sqrt(r["sse"] / r["n"]), 1e-6)) for r in known])
    scale = start[:, 3] ** 2
    variance = [(r["v11"] / r["alpha"]**2 + r["v00"] / r["pmax"]**2 - 2 * r["v01"] / (r["alpha"] * r["pmax"])) for r in known]
    steps = np.clip(STEP * np.sqrt(np.maximum(variance, 1e-12) * scale), 1e-6, 1.0)
    usable = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).filter(
        "_x IS NOT NULL AND _y IS NOT NULL AND NOT isnan(_x) AND NOT isnan(_y)")
    tasks = spark.sparkContext.defaultParallelism
    packed = _pack(usable.join(groups, keys).select("k", "_x", "_y"), tasks).coalesce(tasks)  # one row of sums per task, chain and group
    state = Chains(start, steps, np.array([r["n"] for r in known], dtype=float), priors or Priors(), chains, seed)
    size = 3 + 3 * (2 * WINDOW + 1)

    def sweep(number: int, grid: np.ndarray) -> np.ndarray:
        now = np.stack([state.pmax, state.log_ratio, state.rd, state.sigma], -1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for block, k, *cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *(batch.column(i) for i in (2, 3, 4))):
                    xs, counts, ys = (np.frombuffer(c.as_buffer(), t) for c, t in zip(cells, (np.float64, np.int32, np.float64)))
                    for c in range(len(now)):
                        rng = np.random.default_rng([seed, number, block, c])
                        slot = c * now.shape[1] + k - 1
                        total[slot] = total.get(slot, 0.0) + weighted_sums(xs, ys, grid[c, k - 1], *now[c, k - 1], rng, counts)
            yield pa.RecordBatch.from_pydict({"slot": pa.array(list(total), pa.int64()), "sums": pa.array(list(total.values()), pa.list_(pa.float64()))})

        out = np.zeros((now.shape[0] * now.shape[1], size))
        parts = packed.mapInArrow(run, "slot long, sums array<double>")
        if tasks * out.size <= DIRECT:
            found = parts.toArrow()
            np.add.at(out, found["slot"].to_numpy(), np.array(found["sums"].combine_chunks().flatten()).reshape(-1, size))
        else:
            found = parts.select("slot", F.posexplode("sums").alias("i", "v")).groupBy("slot", "i").agg(F.sum("v").alias("v")).toArrow()
            out[found["slot"].to_numpy(), found["i"].to_numpy()] = found["v"].to_numpy()
        return out.reshape(*now.shape[:2], size)

    path, held = new_path(spark, "posterior"), []
    for number in range(warmup + draws):
        grid = state.grid()
        state.update(grid, sweep(number, grid))
        if number >= warmup:
            held.append(state.rows(number - warmup))
        if held and (len(held) == WRITE_EVERY or number == warmup + draws - 1):
            spark.createDataFrame(pd.concat(held, ignore_index=True), SCHEMA).write.mode("append").parquet(path)
            held = []
    return spark.read.schema(SCHEMA).parquet(path), groups
