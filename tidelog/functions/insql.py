"""The library's curves and its smooth-and-slope step for SQL text.

``register`` defines, in a session:

- light_saturating(x, pmax, alpha, rd), light_respired(...) with rd added, light_two_site(x, site, pmax, alpha, rd, dpmax, dalpha, drd),
  light_inhibited(x, pmax, alpha, beta, rd), student2_logpdf(y, mu, sigma): SQL functions, expanded by the optimizer;
- smooth_fit(TABLE(cells), x, low, high, knots, kind): a table function. ``cells`` hold the rows of each group summed by
  distinct x: any key columns, x, n (rows), s1 (sum of values), s2 (sum of squares). It partitions the table by the keys by itself
  and gives the keys, beta (values of the smooth at the knots, less the group's mean), edf and n; beta is NULL where no smooth can be fitted.
- smooth_slope(beta, x): slope of such a smooth over (low, high) with the knots given to ``register``.

A group reaches a task as its distinct x values, summed before the shuffle, and is kept as sums of products only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .splines import Spline

CELL = ("n", "s1", "s2")

CURVES = {
    "light_saturating": ("x pmax alpha rd", "pmax * (1 - exp(-alpha / pmax * x)) - rd"),
    "light_respired": ("x pmax alpha rd", "pmax * (1 - exp(-alpha / pmax * x)) + rd"),
    "light_inhibited": ("x pmax alpha beta rd", "pmax * (1 - exp(-alpha / pmax * x)) * exp(-beta / pmax * x) - rd"),
    "light_two_site": ("x site pmax alpha rd dpmax dalpha drd", "light_respired(x, pmax + if(site = 2, dpmax, 0), alpha + if(site = 2, dalpha, 0), rd + if(site = 2, drd, 0))"),
    "student2_logpdf": ("y mu sigma", "-ln(2 * sqrt(2D) * sigma) - 1.5D * ln(1 + pow((y - mu) / sigma, 2) / 2)"),
}


@dataclass
class SmoothPlan(AnalyzeResult):
    """What the analysis of a call hands to the instances."""

    keys: tuple[str, ...] = ()
    x: str = "x"
    spline: Spline | None = None


@udtf
class SmoothFit:
    @staticmethod
    def analyze(cells: AnalyzeArgument, x: AnalyzeArgument, low: AnalyzeArgument, high: AnalyzeArgument, knots: AnalyzeArgument, kind: AnalyzeArgument) -> SmoothPlan:
        if not cells.isTable:
            raise ValueError("the first argument is a table")
        names = cells.dataType.fieldNames()
        missing = [c for c in (x.value, *CELL) if c not in names]
        if missing:
            raise ValueError(f"no column {', '.join(missing)}")
        keys = tuple(c for c in names if c not in (x.value, *CELL))
        schema = StructType([*[f for f in cells.dataType.fields if f.name in keys], StructField("beta", ArrayType(DoubleType())),
                             StructField("edf", DoubleType()), StructField("n", DoubleType())])
        return SmoothPlan(schema, withSinglePartition=not keys, partitionBy=[PartitioningColumn(f"`{k}`") for k in keys],
                          orderBy=[OrderingColumn(f"`{x.value}`")], keys=keys, x=x.value,
                          spline=Spline.even(float(low.value), float(high.value), int(knots.value), kind.value))

    def __init__(self, plan: SmoothPlan):
        self.plan, self.key = plan, None
        k = plan.spline.size
        self.g, self.c, self.r = np.zeros((k, k)), np.zeros(k), np.zeros(k)
        self.n = self.s1 = self.s2 = 0.0

    def eval(self, row: Row, *_) -> None:
        if self.key is None:
            self.key = tuple(row[k] for k in self.plan.keys)
        x, n, s1, s2 = row[self.plan.x], *[row[c] for c in CELL]
        if x is None or s1 is None or not n:
            return
        b = self.plan.spline.matrix([x])[0]
        self.g += n * np.outer(b, b)
        self.r += n * b
        self.c += s1 * b
        self.n, self.s1, self.s2 = self.n + n, self.s1 + s1, self.s2 + s2

    def terminate(self) -> Iterator[tuple]:
        from ..operators.smoothing import solve_penalised

        if self.key is None:
            return
        beta = edf = None
        if self.n:
            mean = self.s1 / self.n  # values count less their mean, so a large offset costs few digits
            found, df, *_ = solve_penalised(self.g[None], (self.c - mean * self.r)[None], np.array([max(self.s2 - self.s1 * mean, 0.0)]), np.array([self.n]), self.plan.spline.penalty)
            if np.isfinite(found).all():
                beta, edf = found[0].tolist(), float(df[0])
        yield (*self.key, beta, edf, self.n)


def register(spark: SparkSession, slope_of: Spline | None = None) -> None:
    """Define the functions in the session; ``slope_of`` are the knots that smooth_slope stands for (default: the hours of a day)."""
    for name, (arguments, body) in CURVES.items():
        typed = ", ".join(f"{a} DOUBLE" for a in arguments.split())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({typed}) RETURNS DOUBLE RETURN {body}")
    spline = slope_of or Spline.even(0.0, 24.0, 5, "cs")
    terms = " + ".join(f"get(beta, {i}) * ({t})" for i, t in enumerate(spline.sql("at", 1)))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION smooth_slope(beta ARRAY<DOUBLE>, at DOUBLE) RETURNS DOUBLE RETURN {terms}")
    spark.udtf.register("smooth_fit", SmoothFit)
