"""The reciprocal scale axis: 1/3, 1/2, 1, 2, 3 are evenly spaced around 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col


def scale_to_linear(c) -> Column:
    """Position on the even axis: 0 at scale 1, +1 at 2, -1 at 1/2 (FN12)."""
    s = col(c)
    return F.when(s >= 1, s - 1).otherwise(1 - 1 / s)


def linear_to_scale(c, whole: bool = False) -> Column:
    """Inverse of :func:`scale_to_linear`; NULL inside the interval [-1, 1), which the published way back leaves
    undefined, or with ``whole`` the scale of every position (FN12)."""
    x = col(c)
    if whole:
        return F.when(x >= 0, x + 1).otherwise(1 / (1 - x))
    return F.when(x >= 1, x + 1).when(x < -1, 1 / (1 - x))


def scale_distance(c) -> Column:
    """Distance of a scale factor from 1 on the reciprocal axis (CAL2)."""
    s = col(c)
    return F.when(s < 1, F.lit(1.0) / s - 1).otherwise(s - 1)


def reciprocal_grid(lo: float, hi: float, step: float = 0.05) -> list[float]:
    """Search values between two scale factors, evenly spaced on the reciprocal axis (CAL3)."""
    n = int((hi - (-1.0 / lo)) / step + 1e-9)
    raw = [-1.0 / lo + step * k for k in range(n + 1)]
    return [-1.0 / v for v in raw if v < -1 - 1e-12] + [round(v, 12) for v in raw if v >= 1 - 1e-12]
