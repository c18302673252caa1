"""Missing-value rules, tolerances and rounding for numeric columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Square root of the double machine epsilon.
TOLERANCE = 1.4901161193847656e-8
# Rounding edge used by snap(); irrational, so means of a few decimals do not sit on it.
_EDGE = 0.41421356


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def snap(x, digits: int = 4) -> Column:
    """Put a double on a grid of 10**-digits (same formula as :func:`snap_sql`)."""
    scale = float(10**digits)
    return F.floor(_c(x) * F.lit(scale) + F.lit(_EDGE)) / F.lit(scale)


def snap_sql(x: str, digits: int = 4) -> str:
    scale = f"{10**digits}::DOUBLE"
    return f"(floor(({x}) * {scale} + {_EDGE}) / {scale})"


def _agg(fn, x, na_rm: bool) -> Column:
    """Aggregate ``x``; with ``na_rm=False`` one missing input makes the result missing."""
    x = _c(x)
    if na_rm:
        return fn(x)
    return F.when(F.count(x) == F.count(F.lit(1)), fn(x))


def mean_of(x, na_rm: bool = False) -> Column:
    return _agg(F.avg, x, na_rm)


def sum_of(x, na_rm: bool = False) -> Column:
    return _agg(F.sum, x, na_rm)


def sd_of(x, na_rm: bool = False) -> Column:
    """Sample standard deviation; missing for a single value."""
    return _agg(F.stddev_samp, x, na_rm)


def standard_error(sd, n) -> Column:
    """``sd / sqrt(n - 1)``, the band width used by the monthly summaries; NULL for n = 1."""
    return F.try_divide(_c(sd), F.sqrt((_c(n) - 1).cast("double")))


def near(a, b, tol: float = TOLERANCE) -> Column:
    b = b if isinstance(b, Column) else F.lit(b)
    return F.abs(_c(a) - b) < F.lit(tol)


def clamp_below(x, threshold: float = 0.0, to: float = 0.0) -> Column:
    """Values under ``threshold`` become ``to``; NULL stays NULL."""
    x = _c(x)
    return F.when(x < threshold, F.lit(to)).otherwise(x)


def null_where(x, condition: Column) -> Column:
    return F.when(~F.coalesce(condition, F.lit(False)), _c(x))


def log_keep_zero(x) -> Column:
    """Natural log where zero gives -Infinity instead of NULL."""
    x = _c(x)
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(F.ln(x))
