"""Unit conversions and derived budget terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import col

ICE_DENSITY = 910.0
OCEAN_AREA_KM2 = 362.5e6
SECONDS_PER_YEAR = 365.25 * 86400.0


def gt_per_year_to_m3_per_s(c) -> Column:
    return col(c) * F.lit(1e9) / F.lit(365.25) / F.lit(24.0) / F.lit(60.0) / F.lit(60.0)


def km3_to_gt(c) -> Column:
    return col(c) * F.lit(ICE_DENSITY / 1000.0)


def gt_to_km3(c) -> Column:
    return col(c) * F.lit(1000.0 / ICE_DENSITY)


def gt_to_kg_per_m2(c, area_km2) -> Column:
    """Gt over an area in km2 to kg per m2 (FN19)."""
    return F.when(col(area_km2) > 0, col(c) * F.lit(1e12) / (col(area_km2) * F.lit(1e6)))


def km3_to_m(c, area_km2) -> Column:
    """km3 over an area in km2 to metres (FN19)."""
    return F.when(col(area_km2) > 0, col(c) / (col(area_km2) / F.lit(1000.0)))


def add_budget_terms(df: DataFrame) -> DataFrame:
    """runoff, smb and volume change from acc, melt, refreeze, ec, fac (FN17)."""
    return (
        df.withColumn("runoff", F.col("melt") - F.col("refreeze"))
        .withColumn("smb", F.col("acc") - F.col("melt") + F.col("refreeze") - F.col("ec"))
        .withColumn("dv", F.col("smb") / F.lit(ICE_DENSITY / 1000.0) + F.col("fac"))
        .withColumn("net_acc", F.col("acc") - F.col("ec"))
    )


def mass_change(dv, fac) -> Column:
    """(dv - fac) * 0.91 (FN17)."""
    return (col(dv) - col(fac)) * F.lit(ICE_DENSITY / 1000.0)


def state_index(runoff, discharge, net_acc) -> Column:
    """(runoff + discharge) / net accumulation, NULL for a zero divisor (FN17)."""
    n = col(net_acc)
    return F.when(n != 0, (col(runoff) + col(discharge)) / n)


def constrain_rates(df: DataFrame) -> DataFrame:
    """Rates are not negative, refreeze stays within melt, runoff and smb follow (FN18)."""
    def floor0(c: str) -> Column:  # keeps NULL, which greatest() would not
        return F.when(F.col(c) < 0, F.lit(0.0)).otherwise(F.col(c))

    df = df.withColumns({c: floor0(c) for c in ("acc", "rain", "melt", "refreeze") if c in df.columns})
    df = df.withColumn("refreeze", F.when(F.col("refreeze") > F.col("melt"), F.col("melt")).otherwise(F.col("refreeze")))
    return df.withColumn("runoff", F.col("melt") - F.col("refreeze")).withColumn(
        "smb", F.col("acc") - F.col("runoff") - F.col("ec")
    )


def subtract_discharge(dv, years_since_start, discharge) -> Column:
    """dv - (t - t0) * discharge (FN20)."""
    return col(dv) - col(years_since_start) * F.coalesce(col(discharge), F.lit(0.0))
