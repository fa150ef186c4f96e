"""Evaluation of fitted models from coefficient columns (FN15)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col

TWO_PI = 2.0 * math.pi


def annual_terms(t) -> tuple[Column, Column]:
    a = col(t) * F.lit(TWO_PI)
    return F.cos(a), F.sin(a)


def phased_sine(t, phase) -> Column:
    return F.sin(F.lit(TWO_PI) * (col(t) + col(phase)))


def offset_trend(t, p) -> Column:
    return p[0] + p[1] * col(t)


def offset_trend_seasonal(t, p, acceleration: bool = False) -> Column:
    """offset, trend, [t^2], cos, sin."""
    c, s = annual_terms(t)
    t = col(t)
    head = p[0] + p[1] * t
    if acceleration:
        return head + p[2] * t * t + p[3] * c + p[4] * s
    return head + p[2] * c + p[3] * s


def surface_model(t, h, p: Column) -> Column:
    """Nine-coefficient surface: quadratic in time and height plus an annual sine whose size is
    quadratic in height.  ``p`` is an array column."""
    t, h = col(t), col(h)
    return p[0] + p[1] * t + p[2] * t * t + p[3] * h + p[4] * h * h + surface_season(t, h, p)


def surface_season(t, h, p: Column) -> Column:
    """Only the annual part of :func:`surface_model`."""
    h = col(h)
    return phased_sine(t, p[5]) * (p[6] + p[7] * h + p[8] * h * h)


def polynomial(x, coefs: list[Column]) -> Column:
    x = col(x)
    acc = coefs[-1]
    for c in reversed(coefs[:-1]):
        acc = acc * x + c
    return acc


def amplitude(p_cos, p_sin) -> Column:
    return F.sqrt(col(p_cos) * col(p_cos) + col(p_sin) * col(p_sin))


def phase_fraction(p_cos, p_sin, phase: str = "table") -> Column:
    """Fraction of the year (S7).  ``table`` and ``series`` are the two conventions of the
    published tables; ``peak`` is the time at which the fitted annual cycle is largest."""
    c, s = col(p_cos), col(p_sin)
    angle = {
        "table": F.atan2(c, s) + F.lit(math.pi / 2),
        "series": F.atan2(s, c) + F.lit(math.pi / 2),
        "peak": F.atan2(s, c),
    }[phase]
    f = angle / F.lit(TWO_PI)
    return f - F.floor(f)


def phase_day(p_cos, p_sin, phase: str = "table") -> Column:
    return F.lit(365.25) * phase_fraction(p_cos, p_sin, phase)


def phase_month(p_cos, p_sin, phase: str = "series") -> Column:
    """Calendar month of the phase in a 366-day year (year zero is a leap year)."""
    doy = F.floor(F.lit(366.0) * phase_fraction(p_cos, p_sin, phase)).cast("int")
    return F.month(F.date_add(F.lit("2000-01-01").cast("date"), doy))
