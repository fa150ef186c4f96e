"""Small numeric helpers shared by every module."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The cut sits a little off one half: means of short decimals often end exactly on a half, where the
# last bit of a sum, which depends on its order, would decide the rounding.
ROUND_CUT = 0.500317


def fixed(c: str | Column, digits: int = 6) -> Column:
    """Round with plain IEEE steps, so any engine gives the same double (and no -0.0)."""
    p = float(10**digits)
    return F.floor(col(c) * F.lit(p) + F.lit(ROUND_CUT)) / F.lit(p)


def half_even(c: str | Column, digits: int = 0) -> Column:
    """Round half to even (S5)."""
    if digits == 0:
        return F.rint(col(c))
    p = float(10**digits)
    return F.rint(col(c) * F.lit(p)) / F.lit(p)


def nan_to_null(c: str | Column) -> Column:
    """One missing-value convention: NaN never crosses a module boundary."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def sentinel_to_null(c: str | Column, limit: float = 9998.0) -> Column:
    """Values at or beyond the no-data sentinel become NULL."""
    c = col(c)
    return F.when(F.abs(c) < F.lit(limit), c)


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def bin_index(c: str | Column, lo: float, width: float, closed: str = "left") -> Column:
    """Index of a regular bin.  ``closed='left'`` is [lo, hi), ``'right'`` is (lo, hi] (S2)."""
    x = (col(c) - F.lit(lo)) / F.lit(width)
    if closed == "left":
        return F.floor(x).cast("int")
    if closed == "right":
        return (F.ceil(x) - 1).cast("int")
    raise ValueError("closed must be 'left' or 'right'")


def bin_center(index: str | Column, lo: float, width: float) -> Column:
    return F.lit(lo) + (col(index) + F.lit(0.5)) * F.lit(width)


def overlaps(a_lo, a_hi, b_lo, b_hi) -> Column:
    """Closed interval overlap (FN10)."""
    return (col(a_hi) >= col(b_lo)) & (col(a_lo) <= col(b_hi))


def gaussian_weights(sigma: float, length: int | None = None) -> list[float]:
    """Normalised Gaussian kernel; default reach is two sigma on each side (FN9)."""
    import math

    n = length if length is not None else 4 * math.ceil(sigma) + 1
    if n % 2 == 0:
        raise ValueError("kernel length must be odd")
    half = n // 2
    if sigma == 0:
        g = [1.0 if k == 0 else 0.0 for k in range(-half, half + 1)]
    else:
        g = [math.exp(-(k * k) / (2.0 * sigma * sigma)) for k in range(-half, half + 1)]
    s = sum(g)
    return [v / s for v in g]
