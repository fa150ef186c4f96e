"""Decimal years, day numbers and the fixed 30-day axis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col

DATE_AXIS_START = "1990-01-01"
DATE_AXIS_END = "2026-01-01"
DATE_AXIS_STEP = 30


def days_in_year(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))


def decimal_year(c: str | Column) -> Column:
    """year + day-of-year / days-in-year; the time of day is ignored (FN1)."""
    d = col(c)
    return F.year(d) + F.dayofyear(d) / days_in_year(F.year(d))


def decimal_year_day(y: str | Column) -> Column:
    """Calendar day of a decimal year.  Day 1 of a year sits at 1/ndays, so the round trip of a
    date lands on the following day, as in the inverse the project uses (FN2)."""
    y = col(y)
    y0 = F.floor(y).cast("int")
    n = days_in_year(y0)
    return F.date_add(F.make_date(y0, F.lit(1), F.lit(1)), F.floor(n * (y - y0)).cast("int"))


def decimal_year_timestamp(y: str | Column) -> Column:
    """Decimal year to timestamp, cut to whole seconds (FN2)."""
    y = col(y)
    y0 = F.floor(y).cast("int")
    start = F.unix_seconds(F.make_timestamp(y0, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return F.timestamp_seconds(start + F.floor(days_in_year(y0) * (y - y0) * F.lit(86400.0)))


def datenum_timestamp(n: str | Column) -> Column:
    """Day number counted from year 0 (719529 is 1970-01-01) to timestamp, to the millisecond (FN3)."""
    ms = F.round(col(n) * F.lit(86400000.0)).cast("long") - F.lit(719529 * 86400000)
    return F.timestamp_millis(ms)


def date_bin(c: str | Column, start: str = DATE_AXIS_START, step: int = DATE_AXIS_STEP) -> Column:
    """Index on the day axis; equal to binning in decimal years (S14)."""
    return F.floor(F.datediff(F.to_date(col(c)), F.lit(start).cast("date")) / F.lit(step)).cast("int")


def date_bin_center(index: str | Column, start: str = DATE_AXIS_START, step: int = DATE_AXIS_STEP) -> Column:
    return F.date_add(F.lit(start).cast("date"), (col(index) * F.lit(step) + F.lit(step // 2)).cast("int"))


def month_start(c: str | Column) -> Column:
    return F.trunc(col(c), "month")
