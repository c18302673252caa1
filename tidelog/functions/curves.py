"""Light-response curves, densities and quantiles as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import _c


def _n(x) -> Column:
    return F.lit(float(x)) if isinstance(x, (int, float)) else _c(x)


def saturating(x, pmax, alpha, rd, sign: int = -1) -> Column:
    """Saturating curve; ``sign`` says whether ``rd`` is subtracted (-1) or added (+1)."""
    p = _n(pmax)
    return p * (1 - F.exp(-_n(alpha) / p * _n(x))) + F.lit(float(sign)) * _n(rd)


def saturating_two_site(x, site, pmax, alpha, rd, dpmax, dalpha, drd, sign: int = 1) -> Column:
    """Saturating curve whose three parameters are shifted where ``site`` is 2."""
    def moved(base, delta):
        return _n(base) + F.when(_n(site) == 2, _n(delta)).otherwise(F.lit(0.0))

    return saturating(x, moved(pmax, dpmax), moved(alpha, dalpha), moved(rd, drd), sign)


def inhibited(x, pmax, alpha, beta, rd, sign: int = -1) -> Column:
    """Saturating curve damped by inhibition at high light."""
    p = _n(pmax)
    rise = 1 - F.exp(-_n(alpha) / p * _n(x))
    return p * rise * F.exp(-_n(beta) / p * _n(x)) + F.lit(float(sign)) * _n(rd)


def student2_logpdf(y, mu, sigma) -> Column:
    """Log density of a Student t with two degrees of freedom."""
    z = (_n(y) - _n(mu)) / _n(sigma)
    return -F.ln(F.lit(2 * math.sqrt(2.0)) * _n(sigma)) - F.lit(1.5) * F.ln(1 + z * z / 2)


def student2_quantile(u) -> Column:
    """Closed-form quantile of a Student t with two degrees of freedom, 0 < u < 1."""
    u = _n(u)
    return (2 * u - 1) / F.sqrt(2 * u * (1 - u))


def hash_uniform(*parts) -> Column:
    """Repeatable uniform number in (0, 1) from the text of ``parts``."""
    text = F.concat_ws("|", *[_c(p).cast("string") for p in parts])
    head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double")
    return (head + 0.5) / F.lit(2.0**32)


def _erfc_log_polynomial(degree: int = 24, reach: float = 26.0):
    # erfc(z) = s * exp(-z*z + P(u)), s = 2/(2+z); P is interpolated at Chebyshev points of u.
    low = 2.0 / (2.0 + reach)
    mid, half = (1.0 + low) / 2, (1.0 - low) / 2

    def target(u):
        s = mid + half * np.asarray(u)
        z = 2.0 / s - 2.0
        return np.array([math.log(math.erfc(v)) + v * v - math.log(t) for v, t in zip(z, s)])

    cheb = np.polynomial.chebyshev.chebinterpolate(target, degree)
    return np.polynomial.chebyshev.cheb2poly(cheb), mid, half, reach


_ERFC = _erfc_log_polynomial()


def erfc(z) -> Column:
    """Complementary error function for z >= 0, inside generated code (no Python worker)."""
    power, mid, half, reach = _ERFC
    z = _n(z)
    s = F.lit(2.0) / (z + 2.0)
    u = (s - mid) / half
    value = F.lit(float(power[-1]))
    for coefficient in power[-2::-1]:
        value = value * u + F.lit(float(coefficient))
    return F.when(z > reach, F.lit(0.0)).otherwise(s * F.exp(-z * z + value))


def normal_p_two_sided(z) -> Column:
    return erfc(F.abs(_n(z)) / math.sqrt(2.0))
