"""Report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import col, half_even

# fixed values: units by parameter; mass variables are in Gt, volume variables in km^3
PARAM_UNIT = {"trend": "{}/yr", "acceleration": "{}/yr^2", "amplitude": "{}", "phase": "day_of_max"}


def value_error_text(value, error, digits: int = 2, integer: bool | Column = False) -> Column:
    """'v ± e' with fixed digits, or as whole numbers."""
    fmt = f"%.{digits}f ± %.{digits}f"
    text = F.format_string(fmt, half_even(value, digits) + F.lit(0.0), half_even(error, digits) + F.lit(0.0))
    whole = F.format_string("%d ± %d", half_even(value).cast("long"), half_even(error).cast("long"))
    flag = integer if isinstance(integer, Column) else F.lit(integer)
    return F.when(flag, whole).otherwise(text)


def column_label(var: str, param: str) -> str:
    base = "km^3" if "dv" in var or "fac" in var else "Gt"
    return f"{var}_{param}_[{PARAM_UNIT[param].format(base)}]"


def error_bar_table(fits: DataFrame, variables: list[str], params: list[str], region: str = "region", digits: int = 2) -> DataFrame:
    """One row per region, one 'v ± e' column per variable and parameter (RPT1).  ``fits`` is long:
    region, var, parameter, value, error."""
    text = value_error_text("value", "error", digits, F.col("parameter") == "phase")
    long = fits.where(F.col("var").isin(variables) & F.col("parameter").isin(params))
    long = long.select(region, F.concat_ws("_", "var", "parameter").alias("_c"), text.alias("_t"))
    names = [(v, p) for v in variables for p in params]
    wide = long.groupBy(region).pivot("_c", [f"{v}_{p}" for v, p in names]).agg(F.first("_t"))
    return wide.select(region, *[F.col(f"{v}_{p}").alias(column_label(v, p)) for v, p in names])


def compact_table(fits: DataFrame, variables: list[str], region: str = "region", no_error: list[str] = [], no_acceleration: list[str] = [], with_amplitude: list[str] = [], digits: int = 2) -> DataFrame:
    """Trend for all variables, acceleration and amplitude for some, error optional (RPT2)."""
    want = [(v, "trend") for v in variables]
    want += [(v, "acceleration") for v in variables if v not in no_acceleration]
    want += [(v, "amplitude") for v in variables if v in with_amplitude]
    keep = F.lit(False)
    for v, p in want:
        keep = keep | ((F.col("var") == v) & (F.col("parameter") == p))
    bare = F.format_string(f"%.{digits}f", half_even("value", digits) + F.lit(0.0))
    text = F.when(F.col("var").isin(no_error), bare).otherwise(value_error_text("value", "error", digits)) if no_error else value_error_text("value", "error", digits)
    long = fits.where(keep).select(region, F.concat_ws("_", "var", "parameter").alias("_c"), text.alias("_t"))
    wide = long.groupBy(region).pivot("_c", [f"{v}_{p}" for v, p in want]).agg(F.first("_t"))
    return wide.select(region, *[F.col(f"{v}_{p}").alias(column_label(v, p)) for v, p in want])


def conversion_factors(df: DataFrame, region: str, dm: str, dv: str) -> DataFrame:
    """dm/dv per region with flags for the smallest and largest factor (RPT4)."""
    f = df.select(region, F.when(F.col(dv) != 0, F.col(dm) / F.col(dv)).alias("factor")).where(F.col("factor").isNotNull())
    ends = f.agg(F.min(F.struct("factor", region)).alias("_lo"), F.max(F.struct(F.col("factor"), (-F.col(region)).alias("_r"))).alias("_hi"), F.lit(1).alias("_k"))
    both = f.withColumn("_k", F.lit(1)).join(ends, "_k")  # one row of ends
    return both.select(region, "factor", (F.col(region) == F.col(f"_lo.{region}")).alias("is_min"), (F.col(region) == -F.col("_hi._r")).alias("is_max"))


def validity_flags(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """For each name: difference model - observation and a both-present flag (RPT5)."""
    out = {}
    for name, (obs, model) in pairs.items():
        both = F.col(obs).isNotNull() & F.col(model).isNotNull()
        out[f"{name}_error"] = F.when(both, F.col(model) - F.col(obs))
        out[f"both_{name}_valid"] = both
    return df.withColumns(out)


def min_max_scale(df: DataFrame, keys: list[str], value: str, out: str = "scaled", fill: float = 9999.0) -> DataFrame:
    """Scale finite values to 0..1 per group, non-finite ones to a fixed fill (CMP8)."""
    v = col(value)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    ends = df.where(finite).groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    scaled = F.when(finite, F.when(span > 0, (v - F.col("_lo")) / span).otherwise(F.lit(0.0))).otherwise(F.lit(fill))
    return df.join(ends, keys, "left").withColumn(out, scaled).drop("_lo", "_hi")


def scenario_table(df: DataFrame, keys: list[str], scenarios: DataFrame, on: list[str], value: str, names: list[str]) -> DataFrame:
    """Threshold combinations to named columns low/mid/high, rows without any value dropped (CMP7)."""
    j = df.join(scenarios, on).groupBy(*keys).pivot("scenario", names).agg(F.sum(value))
    some = F.greatest(*[F.coalesce(F.col(n), F.lit(0.0)) for n in names]) > 0
    return j.where(some)
