"""Cubic regression splines by values at knots, as numpy matrices and as column expressions.

Wood, Generalized Additive Models (2nd ed.), chapter 5: the curve is fixed by its
values at the knots, the second derivatives follow from a small linear system.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Spline:
    """``kind``: 'cr' natural, 'cs' natural with a penalised null space, 'cc' cyclic."""

    knots: tuple[float, ...]
    kind: str = "cr"
    size: int = field(init=False)
    penalty: np.ndarray = field(init=False, repr=False)
    pieces: np.ndarray = field(init=False, repr=False)  # [basis, interval, power of (x - left knot)]

    def __post_init__(self):
        x = np.asarray(self.knots, dtype=float)
        h = np.diff(x)
        k, cyclic = len(x), self.kind == "cc"
        self.size = k - 1 if cyclic else k
        second = self._second_derivatives(h)
        value = np.eye(self.size)
        if cyclic:
            value, second = (np.vstack([m, m[:1]]) for m in (value, second))
        self.pieces = np.zeros((self.size, k - 1, 4))
        for j, w in enumerate(h):
            left, right = value[j], value[j + 1]
            d_left, d_right = second[j], second[j + 1]
            self.pieces[:, j, 0] = left
            self.pieces[:, j, 1] = (right - left) / w - w * (2 * d_left + d_right) / 6
            self.pieces[:, j, 2] = d_left / 2
            self.pieces[:, j, 3] = (d_right - d_left) / (6 * w)

    def _second_derivatives(self, h: np.ndarray) -> np.ndarray:
        """Matrix from knot values to second derivatives; sets the penalty (integral of f''^2)."""
        m = self.size
        if self.kind == "cc":
            b, d = np.zeros((m, m)), np.zeros((m, m))
            for i in range(m):
                p, n = (i - 1) % m, (i + 1) % m
                b[i, i] += (h[p] + h[i]) / 3
                b[i, p] += h[p] / 6
                b[i, n] += h[i] / 6
                d[i, i] -= 1 / h[p] + 1 / h[i]
                d[i, p] += 1 / h[p]
                d[i, n] += 1 / h[i]
            second = np.linalg.solve(b, d)
            self.penalty = d.T @ second
        else:
            b, d = np.zeros((m - 2, m - 2)), np.zeros((m - 2, m))
            for i in range(m - 2):
                b[i, i] = (h[i] + h[i + 1]) / 3
                if i + 1 < m - 2:
                    b[i, i + 1] = b[i + 1, i] = h[i + 1] / 6
                d[i, i : i + 3] = 1 / h[i], -1 / h[i] - 1 / h[i + 1], 1 / h[i + 1]
            inner = np.linalg.solve(b, d)
            second = np.vstack([np.zeros(m), inner, np.zeros(m)])
            self.penalty = d.T @ inner
        self.penalty = (self.penalty + self.penalty.T) / 2
        if self.kind == "cs":
            # Flat directions get a tenth of the smallest real penalty, so a curve can shrink to zero.
            w, v = np.linalg.eigh(self.penalty)
            small = w < w[-1] * 1e-9
            w[small] = 0.1 * w[~small].min()
            self.penalty = (v * w) @ v.T
        return second

    @staticmethod
    def even(low: float, high: float, k: int, kind: str = "cr") -> "Spline":
        return Spline(tuple(float(v) for v in np.linspace(low, high, k)), kind)

    def _wrap(self, x: np.ndarray) -> np.ndarray:
        first, span = self.knots[0], self.knots[-1] - self.knots[0]
        return x - span * np.floor((x - first) / span)

    def matrix(self, x, derivative: int = 0) -> np.ndarray:
        x = np.asarray(x, dtype=float)
        if self.kind == "cc":
            x = self._wrap(x)
        knots = np.asarray(self.knots)
        j = np.clip(np.searchsorted(knots, x, side="right") - 1, 0, len(knots) - 2)
        inside = np.clip(x, knots[0], knots[-1])
        t, beyond = inside - knots[j], x - inside
        c = self.pieces[:, j, :]
        slope = c[..., 1] + t * (2 * c[..., 2] + t * 3 * c[..., 3])
        if derivative:
            return slope.T
        return (c[..., 0] + t * (c[..., 1] + t * (c[..., 2] + t * c[..., 3])) + beyond * slope).T

    def attach(self, df: DataFrame, x: str, derivative: int = 0, prefix: str = "_b") -> tuple[DataFrame, list[str]]:
        """Add one column per basis function (or its slope) of ``x``; returns the new names too.

        Three small steps (position, interval, distance from the left knot) keep each
        expression short: the interval picks the polynomial from literal arrays.
        """
        first, last = self.knots[0], self.knots[-1]
        if self.kind == "cc":
            inside = f"`{x}` - {last - first!r}D * floor((`{x}` - {first!r}D) / {last - first!r}D)"
        else:
            inside = f"least(greatest(`{x}`, {first!r}D), {last!r}D)"

        def pick(values) -> str:
            return "get(array(" + ", ".join(f"{float(v)!r}D" for v in values) + "), _j)"

        steps = df.withColumn("_in", F.expr(inside))
        interval = " + ".join(["0"] + [f"cast(_in >= {k!r}D AS int)" for k in self.knots[1:-1]])
        steps = steps.withColumn("_j", F.expr(interval)).withColumn("_t", F.expr(f"_in - {pick(self.knots[:-1])}"))
        names, out = [], []
        for i in range(self.size):
            a, b, c, d = (pick(self.pieces[i, :, p]) for p in range(4))
            slope = f"{b} + _t * (2 * {c} + _t * 3 * {d})"
            value = f"{a} + _t * ({b} + _t * ({c} + _t * {d}))"
            if self.kind != "cc":
                value = f"{value} + (`{x}` - _in) * ({slope})"
            names.append(f"{prefix}{i}")
            out.append(F.expr(slope if derivative else value).alias(names[-1]))
        return steps.select(*df.columns, *out), names

    def sql(self, x: str, derivative: int = 0) -> list[str]:
        """The basis functions inside the knot range, or their slopes, as SQL text."""
        if self.kind == "cc":
            first, span = self.knots[0], self.knots[-1] - self.knots[0]
            x = f"({x} - {span!r} * floor(({x} - {first!r}) / {span!r}))"
        out = []
        for i in range(self.size):
            cases = []
            for j in range(len(self.knots) - 1):
                a, b, c, d = (f"({float(v)!r})::DOUBLE" for v in self.pieces[i, j])
                t = f"({x} - {self.knots[j]!r})"
                poly = f"{b} + {t} * (2 * {c} + {t} * 3 * {d})" if derivative else f"{a} + {t} * ({b} + {t} * ({c} + {t} * {d}))"
                last = j == len(self.knots) - 2
                cases.append(f"ELSE {poly}" if last else f"WHEN {x} < {self.knots[j + 1]!r} THEN {poly}")
            out.append("CASE " + " ".join(cases) + " END")
        return out
