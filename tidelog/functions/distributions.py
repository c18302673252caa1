"""Tail probabilities for small result tables (a handful of tests, never data rows)."""

from __future__ import annotations

import math


def beta_regularised(x: float, a: float, b: float) -> float:
    """I_x(a, b) by Lentz's continued fraction, on the side where it converges fast."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_regularised(1.0 - x, b, a)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1), tiny)
    value = d
    for m in range(1, 2000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * value


def f_upper_tail(f: float, df1: float, df2: float) -> float | None:
    if df1 <= 0 or df2 <= 0 or not math.isfinite(f):
        return None
    return beta_regularised(df2 / (df2 + df1 * max(f, 0.0)), df2 / 2, df1 / 2)


def t_two_sided(t: float, df: float) -> float | None:
    if df <= 0 or not math.isfinite(t):
        return None
    return beta_regularised(df / (df + t * t), df / 2, 0.5)


def quadratic_upper_tail(x: float, weights: list[float], dofs: list[float] | None = None) -> float:
    """P(sum of weights x chi-squared > x): Imhof's inversion integral, below 1e-4 the saddle-point formula, exact to about a percent there."""
    import numpy as np

    w = np.asarray(weights, dtype=float)
    h = np.ones_like(w) if dofs is None else np.asarray(dofs, dtype=float)
    used = (w != 0) & (h > 0)
    w, h = w[used], h[used]
    if not len(w):
        return float(x < 0)
    if x >= 0 and (w < 0).all() or x <= 0 and (w > 0).all():
        return float(x <= 0 and (w > 0).all())
    unit = np.abs(w).max()
    w, x = w / unit, x / unit
    near = _imhof(x, w, h)
    if min(near, 1 - near) > 1e-4:
        return float(near)
    far = _saddle_point(x, w, h)
    return float(min(max(near, 0.0), 1.0)) if far is None else far


def _imhof(x: float, w, h) -> float:
    import numpy as np

    def phase(u):
        return 0.5 * (h * np.arctan(w * u[:, None])).sum(1) - 0.5 * x * u

    def decay(u):
        return np.exp(0.25 * (h * np.log1p((w * u[:, None]) ** 2)).sum(1))

    # pieces of the integral between points that double, each finer than its own oscillation, until nothing is left to add
    total, low, high = 0.0, 1e-12, 0.25
    node, weight = np.polynomial.legendre.leggauss(20)
    while low < 1e7:
        turns = abs(float(phase(np.array([high]))[0] - phase(np.array([low]))[0])) + 0.5 * abs(x) * (high - low) + 0.5 * float((h * np.abs(w)).sum()) * (high - low) / (1 + low)
        cuts = np.linspace(low, high, 2 + min(int(turns), 20_000))
        half = np.diff(cuts) / 2
        u = ((cuts[:-1] + half)[:, None] + half[:, None] * node).ravel()
        part = np.sin(phase(u)) / (u * decay(u))
        total += float((part.reshape(len(half), -1) @ weight * half).sum())
        if 1 / decay(np.array([high]))[0] < 1e-9:
            break
        low, high = high, 2 * high
    return 0.5 + total / math.pi


def _saddle_point(x: float, w, h) -> float | None:
    """Lugannani and Rice's formula; None where it breaks down (at the mean)."""
    import numpy as np

    def slope(s):
        return float((h * w / (1 - 2 * w * s)).sum())

    low = 1 / (2 * w.min()) if w.min() < 0 else -1e12
    high = 1 / (2 * w.max()) if w.max() > 0 else 1e12
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if slope(mid) < x else (low, mid)
    s = (low + high) / 2
    k = float(-0.5 * (h * np.log(1 - 2 * w * s)).sum())
    bend = float((2 * h * (w / (1 - 2 * w * s)) ** 2).sum())
    root = math.sqrt(max(2 * (s * x - k), 0.0)) * (1 if s > 0 else -1)
    if abs(root) < 1e-3:
        return None
    return 0.5 * math.erfc((root + math.log(s * math.sqrt(bend) / root) / root) / math.sqrt(2))


def smooth_tail(stat: float, rank: float, df: float) -> float | None:
    """Tail of a Wald statistic of fractional ``rank`` over an estimated scale with ``df`` degrees of freedom.

    The part above the whole number shares two chi-squares whose weights add up to 1 + that part.
    """
    if not (math.isfinite(stat) and rank > 0 and df > 0):
        return None
    whole = int(rank + 1e-9)
    part = rank - whole
    if part < 1e-6:
        return f_upper_tail(stat / whole, whole, df)
    if whole == 0:
        return f_upper_tail(stat, 1, df)
    high = (1 + part + math.sqrt((1 + part) * (1 - part))) / 2
    weights = [1.0] * (whole - 1) + [high, 1 + part - high]
    return quadratic_upper_tail(0.0, [*weights, -stat / df], [*[1.0] * len(weights), df])
