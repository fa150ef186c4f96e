"""Row-wise quality control and group-size filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import col
from ..session import cut_lineage
from .robust import group_median


def valid_points(df: DataFrame, value: str = "dh", height: str = "height", reference: str | None = None, mask: str | None = None) -> DataFrame:
    """Non-missing difference, non-zero heights, inside the mask (FLT2)."""
    ok = F.col(value).isNotNull() & ~F.isnan(value) & (F.col(height) != 0)
    if reference:
        ok = ok & (F.col(reference) != 0)
    if mask:
        ok = ok & F.col(mask)
    return df.where(ok)


def min_support(df: DataFrame, keys: list[str], at_least: int = 100) -> DataFrame:
    """Rows of groups with enough members (FLT3).  Counting is map-side combined and joined back, so
    no group is gathered in one task."""
    ok = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= at_least).select(*keys)
    return df.join(ok, keys, "left_semi")


def robust_range(df: DataFrame, keys: list[str], value: str = "dh", dh_max: float = 200.0) -> DataFrame:
    """abs(x - median) < dh_max and abs(x) < 2 dh_max (FLT4)."""
    med = group_median(df, keys, value, "_med")
    v = F.col(value)
    return (
        df.where(F.abs(v) < 2 * dh_max)
        .join(med, keys)
        .where(F.abs(v - F.col("_med")) < dh_max)
        .drop("_med")
    )


def canopy_filter(df: DataFrame, canopy: DataFrame, max_height: float = 1.0, key: str = "point_id", lat: str = "lat", south: float = -54.0, north: float = 66.0) -> DataFrame:
    """Land points under low canopy; no record, or a latitude outside the canopy map, counts as zero (FLT5)."""
    j = df.join(canopy.select(key, "canopyh"), key, "left")
    h = F.when(F.col(lat).between(south, north), F.coalesce("canopyh", F.lit(0.0))).otherwise(F.lit(0.0))
    return j.withColumn("canopyh", h).where(F.col("canopyh") <= max_height)


def quality_filter(df: DataFrame, missions: DataFrame, unfiltered_missions: tuple[str, ...] = ()) -> DataFrame:
    """Apply the quality flag where the product asks for it or the source variant is unfiltered (FLT6).  The few
    missions are written, so the planner knows their size and no row is shuffled to them."""
    j = df.join(cut_lineage(missions.select("mission", "apply_quality_filter")), "mission", "left")
    need = F.coalesce("apply_quality_filter", F.lit(False))
    if unfiltered_missions:
        need = need | F.col("mission").isin(*unfiltered_missions)
    return j.where(~need | F.col("quality")).drop("apply_quality_filter")


def domain_tiles(tiles: DataFrame, fraction: str = "glacier_frac") -> DataFrame:
    """Tiles with a positive domain fraction (FLT7)."""
    return tiles.where(F.col(fraction) > 0)


def audit_row_counts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Groups whose row counts differ between two tables (FLT8)."""
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_left"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_right"))
    j = a.join(b, keys, "full_outer")
    nl, nr = F.coalesce("n_left", F.lit(0)), F.coalesce("n_right", F.lit(0))
    return j.select(*keys, nl.cast("long").alias("n_left"), nr.cast("long").alias("n_right")).where(F.col("n_left") != F.col("n_right"))


def missing_variables(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Groups in which the value is missing everywhere (FLT9)."""
    ok = F.sum((F.col(value).isNotNull() & ~F.isnan(value)).cast("long")).alias("n_valid")
    return df.groupBy(*keys).agg(ok, F.count(F.lit(1)).alias("n")).where(F.col("n_valid") == 0)


def assert_not_all_missing(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Fail at run time when a group has no valid value (FLT9)."""
    bad = missing_variables(df, keys, value)
    if bad.limit(1).count():
        raise ValueError(f"{value} is missing everywhere for at least one of {keys}")
    return df


def monotone_violations(df: DataFrame, keys: list[str], order: str, value: str, tol: float = 1e-9) -> DataFrame:
    """Negative increments of a cumulative series (FLT10)."""
    d = F.col(value) - F.lag(value).over(W.partitionBy(*keys).orderBy(order))
    return df.withColumn("increment", d).where(F.col("increment") < -tol)


def refreeze_violations(df: DataFrame, keys: list[str], order: str, melt: str = "melt", refreeze: str = "refreeze", tol: float = 1e-9) -> DataFrame:
    """Steps in which refreeze grows faster than melt (FLT10)."""
    w = W.partitionBy(*keys).orderBy(order)
    dm, dr = F.col(melt) - F.lag(melt).over(w), F.col(refreeze) - F.lag(refreeze).over(w)
    return df.withColumn("d_melt", dm).withColumn("d_refreeze", dr).where(F.col("d_refreeze") > F.col("d_melt") + tol)


def keep_ids(df: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose id is listed (FLT11)."""
    return df.join(ids.select(*on), on, "left_semi")


def in_extent(df: DataFrame, lon: str | Column, lat: str | Column, extent: tuple[float, float, float, float], closed: str = "left") -> DataFrame:
    """Rows inside one literal box (FLT1); the comparison is pushed to the scan."""
    x0, y0, x1, y1 = extent
    x, y = col(lon), col(lat)
    if closed == "both":
        return df.where((x >= x0) & (x <= x1) & (y >= y0) & (y <= y1))
    return df.where((x >= x0) & (x < x1) & (y >= y0) & (y < y1))
