"""Time-by-height binning, area averages, volumes and histograms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import bin_center, bin_index, col
from .robust import group_mad, reduce_bins


def with_height_bin(df: DataFrame, height: str, width: float = 100.0, lo: float = 0.0, hi: float = 10000.0, closed: str = "left", out: str = "height_bin") -> DataFrame:
    """Append the bin centre and drop rows outside [lo, hi)."""
    idx = bin_index(height, lo, width, closed)
    n = int(round((hi - lo) / width))
    return df.withColumn(out, idx).where(F.col(out).between(0, n - 1)).withColumn(out, bin_center(out, lo, width))


def bin_2d(
    df: DataFrame, keys: list[str], value: str, time_bin: Column, height_bin: Column,
    method: str = "nmad5",
) -> DataFrame:
    """Binned statistic and count per (keys, time_bin, height_bin); sparse, a missing cell has no row (AGG1)."""
    d = df.select(*keys, time_bin.alias("time_bin"), height_bin.alias("height_bin"), F.col(value))
    return reduce_bins(d, [*keys, "time_bin", "height_bin"], value, method)


def bin_with(df: DataFrame, keys: list[str], value: str, reducer: Callable[[Column], Column], out: str | None = None) -> DataFrame:
    """Binned statistic with a caller's aggregate, e.g. ``F.stddev_samp`` (user reducer hook)."""
    return df.groupBy(*keys).agg(reducer(F.col(value)).alias(out or value), F.count(value).alias("nobs"))


def densify(df: DataFrame, keys: list[str], axes: dict[str, Column]) -> DataFrame:
    """Every combination of the axes for each key, with NULL where there was no row (SET3).
    ``axes`` maps an existing column to an array column of its axis values."""
    grid = df.select(*keys).distinct()
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(values))
    return grid.join(df, [*keys, *axes], "left")


def bin_1d(df: DataFrame, keys: list[str], x: str, value: str, lo: float, width: float, method: str = "median") -> DataFrame:
    """Binned statistic along one axis (AGG4)."""
    d = df.withColumn("bin", bin_index(x, lo, width))
    return reduce_bins(d, [*keys, "bin"], value, method)


def monthly_median(df: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """Median per calendar month (AGG5)."""
    d = df.withColumn("month", F.trunc(F.col(ts), "month"))
    return reduce_bins(d, [*keys, "month"], value, "median")


def area_average(binned: DataFrame, hyps: DataFrame, keys: list[str], value: str = "dh", tile: str = "tile_id", height: str = "height_bin", area: str = "area_km2") -> DataFrame:
    """Area-weighted mean over elevation ignoring missing cells (AGG11, AGG29)."""
    j = binned.where(F.col(value).isNotNull()).join(hyps.select(tile, height, area), [tile, height])
    return j.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * F.col(area)), F.sum(area)).alias(value))


def volume_series(
    binned: DataFrame, hyps: DataFrame, keys: list[str], time: str = "time_bin", value: str = "dh",
    tile: str = "tile_id", height: str = "height_bin", area: str = "area_km2",
) -> DataFrame:
    """Volume per date as the sum of value * area / 1000 over bins with area.  A date counts only
    when every bin with area has a value; a tile without area gives zero (AGG12)."""
    pos = hyps.where(F.col(area) > 0)
    need = hyps.groupBy(tile).agg(F.sum((F.col(area) > 0).cast("int")).alias("_need"))
    dates = binned.select(*keys, time).distinct()
    have = (
        binned.where(F.col(value).isNotNull())
        .join(pos.select(tile, height, area), [tile, height])
        .groupBy(*keys, time)
        .agg(F.sum(F.col(value) * F.col(area) / 1000.0).alias("_dv"), F.count(F.lit(1)).alias("_have"))
    )
    j = dates.join(need, tile).join(have, [*keys, time], "left")
    dv = F.when(F.col("_need") == 0, F.lit(0.0)).when(F.col("_have") == F.col("_need"), F.col("_dv"))
    return j.select(*keys, time, dv.alias("dv"))


def mission_mad(binned: DataFrame, value: str = "dh", mission: str = "mission") -> DataFrame:
    """MAD of all binned values of a mission, the error floor (AGG13)."""
    return group_mad(binned, [mission], value).select(mission, F.col("mad").alias("floor"))


def histogram(df: DataFrame, keys: list[str], bins: dict[str, Column], weight: str | Column | None = None) -> DataFrame:
    """Counts (or weights) per joint bin; rows with a NULL bin are outside the edges (AGG24, AGG25)."""
    d = df.select(*[F.col(k) for k in keys], *[e.alias(n) for n, e in bins.items()], *([col(weight).alias("_w")] if weight is not None else []))
    for n in bins:
        d = d.where(F.col(n).isNotNull())
    agg = F.count(F.lit(1)).alias("n") if weight is None else F.sum("_w").alias("n")
    return d.groupBy(*keys, *bins).agg(agg)


def edge_bin(c: str | Column, edges: list[float]) -> Column:
    """Index of an irregular [lo, hi) bin, NULL outside the edges."""
    c = col(c)
    out = F.when(c < edges[0], None)
    for i in range(len(edges) - 1):
        out = out.when(c < edges[i + 1], F.lit(i))
    return out.otherwise(None).cast("int")
