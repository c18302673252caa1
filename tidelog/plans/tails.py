"""Tail probabilities as SQL text: Simpson sums of a density."""

from __future__ import annotations


def simpson(density: str, t: str) -> str:
    """Two-sided tail 1 - 2 * integral of ``density`` (a function of u) over 0..t, 0 beyond 9."""
    body = density.replace("{u}", f"({t} * i / 400)")
    return (
        f"CASE WHEN {t} > 9 THEN 0.0::DOUBLE ELSE 1 - 2 * {t} / 400 / 3 * list_sum(list_transform(range(0, 401), "
        f"lambda i: (CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {body})) END"
    )


def normal_p(z: str) -> str:
    return simpson("0.3989422804014327 * exp(-{u} * {u} / 2)", f"abs({z})")


def student_p(t: str, df: str) -> str:
    return simpson(f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(3.141592653589793 * {df}) * pow(1 + {{u}} * {{u}} / {df}, -({df} + 1) / 2)", f"abs({t})")
