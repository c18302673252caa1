"""Thin-plate regression splines of one covariate.

Wood, Generalized Additive Models (2nd ed.), section 5.5: a radial function sits at every distinct value; the
matrix of their values is cut to its leading eigenvectors, those combinations are kept that leave straight
lines alone, and a constant and a line are added. The roughness penalty follows from the eigenvalues.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_VALUES = 2000  # distinct values that get a radial function of their own


@dataclass
class ThinPlate:
    """``knots``: the sorted distinct values; at most ``k`` basis functions, fewer if there are fewer values."""

    knots: tuple[float, ...]
    k: int = 10
    kind: str = field(init=False, default="tp")
    size: int = field(init=False)
    penalty: np.ndarray = field(init=False, repr=False)
    radial: np.ndarray = field(init=False, repr=False)  # [value, radial basis function]

    def __post_init__(self):
        x = np.asarray(self.knots, dtype=float)
        if len(x) < 3 or len(x) > MOST_VALUES or (np.diff(x) <= 0).any():
            raise ValueError(f"expected 3 to {MOST_VALUES} rising values")
        self.size = min(self.k, len(x))
        if self.size < 3:
            raise ValueError("expected at least three basis functions")
        self.centre = float(x.mean())
        self.spread = float(np.abs(x - self.centre).max())
        w, u = np.linalg.eigh(self._radials(x))
        lead = np.sort(np.argsort(-np.abs(w), kind="stable")[:self.size])
        w, u = w[lead], u[:, lead]
        u = u * np.sign(u[np.abs(u).argmax(0), np.arange(self.size)])
        line = np.column_stack([np.ones_like(x), (x - self.centre) / self.spread])
        free = np.linalg.qr((line.T @ u).T, mode="complete")[0][:, 2:]
        at_values = (u * w) @ free
        scale = np.sqrt((at_values**2).mean(0))
        self.radial = u @ free / scale
        self.penalty = np.zeros((self.size, self.size))
        self.penalty[:-2, :-2] = (free / scale).T @ (w[:, None] * (free / scale))
        self.penalty = (self.penalty + self.penalty.T) / 2

    def _radials(self, x: np.ndarray) -> np.ndarray:
        return np.abs(np.asarray(x, dtype=float)[:, None] - np.asarray(self.knots)[None, :]) ** 3 / 12

    def matrix(self, x, derivative: int = 0) -> np.ndarray:
        x = np.asarray(x, dtype=float)
        if derivative:
            gap = x[:, None] - np.asarray(self.knots)[None, :]
            return np.column_stack([np.abs(gap) * gap / 4 @ self.radial, np.zeros(len(x)), np.full(len(x), 1 / self.spread)])
        return np.column_stack([self._radials(x) @ self.radial, np.ones(len(x)), (x - self.centre) / self.spread])

    def sql(self, x: str, derivative: int = 0, double: str = "::DOUBLE") -> list[str]:
        """The basis functions, or their slopes, as SQL text."""
        def number(v: float) -> str:
            return f"({float(v)!r}){double}" if double == "::DOUBLE" else f"({float(v)!r}{double})"

        def radial(at: float) -> str:
            gap = f"({x} - {number(at)})"
            return f"abs({gap}) * {gap} / 4" if derivative else f"abs({gap}) * {gap} * {gap} / 12"

        out = [" + ".join(f"{number(self.radial[i, j])} * {radial(v)}" for i, v in enumerate(self.knots)) for j in range(self.size - 2)]
        return [*out, number(0 if derivative else 1), number(1 / self.spread) if derivative else f"({x} - {number(self.centre)}) / {number(self.spread)}"]

    def attach(self, df: DataFrame, x: str, derivative: int = 0, prefix: str = "_b") -> tuple[DataFrame, list[str]]:
        """Add one column per basis function (or its slope) of ``x``; returns the new names too."""
        names = [f"{prefix}{i}" for i in range(self.size)]
        return df.select("*", *[F.expr(t).alias(n) for n, t in zip(names, self.sql(f"`{x}`", derivative, "D"))]), names


def thin_plate(values: Sequence[float], k: int = 10) -> ThinPlate:
    return ThinPlate(tuple(sorted({float(v) for v in values})), k)


def thin_plate_of(df: DataFrame, x: str, k: int = 10) -> ThinPlate:
    """Basis on the distinct values of a column; their number is checked before they come to the driver."""
    values = df.select(F.col(x).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)").distinct().limit(MOST_VALUES + 1)
    return thin_plate([r["v"] for r in values.collect()], k)
