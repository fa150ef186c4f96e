"""Regional totals, composites, downscaling and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

PROFILE_SPLIT = 8  # partitions of child profiles per shuffle partition


def region_rollup(df: DataFrame, members: DataFrame, keys: list[str], values: list[str], code: str = "code") -> DataFrame:
    """Sums per region and composite (AGG16, RPT3, AGG34).  The first aggregate reduces the rows to
    one per base region, so the bridge join multiplies totals and not rows."""
    base = df.groupBy(*keys, code).agg(*[F.sum(v).alias(v) for v in values])
    j = base.join(members, base[code] == members["member"]).drop(code, "member")
    return j.groupBy(*keys, "region").agg(*[F.sum(v).alias(v) for v in values])


def region_quadrature(df: DataFrame, members: DataFrame, keys: list[str], value: str, error: str, code: str = "code") -> DataFrame:
    """Composite value and root-sum-square error (SRC12)."""
    sq = F.sum(F.col(error) * F.col(error))
    base = df.groupBy(*keys, code).agg(F.sum(value).alias(value), sq.alias("_sq"))
    j = base.join(members, base[code] == members["member"]).drop(code, "member")
    return j.groupBy(*keys, "region").agg(F.sum(value).alias(value), F.sqrt(F.sum("_sq")).alias(error))


def region_discharge(points: DataFrame, members: DataFrame, value: str, code: str = "code", fractional_error: float = 0.15) -> DataFrame:
    """Region totals with a fixed fractional error (AGG17)."""
    r = region_rollup(points, members, [], [value], code)
    return r.withColumn("error", F.abs(F.col(value)) * fractional_error)


def group_share(df: DataFrame, group: list[str], time: str, value: str, area: str, out: str = "shared") -> DataFrame:
    """Group total per unit area, handed back in proportion to each member's area (AGG19).  The group
    total is a combined aggregate joined back, not a window over the group."""
    tot = df.groupBy(*group, time).agg(F.sum(value).alias("_v"), F.sum(area).alias("_a"))
    share = F.when(F.col("_a") > 0, F.col("_v") / F.col("_a") * F.col(area)).otherwise(F.lit(0.0))
    return df.join(tot, [*group, time]).withColumn(out, share).drop("_v", "_a")


def dominant_parent(children: DataFrame, key: list[str], parent: str, size: str) -> DataFrame:
    """Total size and the parent holding most of it (DOWN3)."""
    g = children.groupBy(*key, parent).agg(F.sum(size).alias("_s"))
    return g.groupBy(*key).agg(F.sum("_s").alias(size), F.max_by(parent, F.struct(F.col("_s"), -F.col(parent))).alias(parent))


def exclusive_region(tiles: DataFrame, key: str, fractions: str = "region_frac") -> DataFrame:
    """The region of largest overlap, smallest code on ties (AGG31, S6)."""
    e = tiles.select(key, F.explode(fractions).alias("region", "frac"))
    return e.groupBy(key).agg(F.max_by("region", F.struct("frac", -F.col("region"))).alias("region"), F.max("frac").alias("frac"))


def last_positive_region(tiles: DataFrame, key: str, fractions: str = "region_frac") -> DataFrame:
    """The last region with any overlap, 0 for none (AGG31)."""
    e = tiles.select(key, F.explode_outer(fractions).alias("region", "frac"))
    return e.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("frac") > 0, F.col("region"))), F.lit(0)).alias("region"))


def downscale_profile(tile_series: DataFrame, child_hyps: DataFrame, child: str, time: str, value: str, tile: str = "tile_id", height: str = "height_bin", area: str = "area_km2", by: list[str] = []) -> DataFrame:
    """Child series as the area-weighted mean over elevation of its tile's series (DOWN1), for each value
    of the series' columns ``by``.  Children are dealt out by key before a row meets every date, in partitions small
    enough that a task holds few of the results; the series is written as a table, so that its size is known."""
    n = PROFILE_SPLIT * int(child_hyps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    h = child_hyps.where(F.col(area) > 0).select(child, tile, height, area).repartition(n, child)
    j = h.join(cut_lineage(tile_series.where(F.col(value).isNotNull())), [tile, height])
    return j.groupBy(*by, child, time).agg(F.try_divide(F.sum(F.col(value) * F.col(area)), F.sum(area)).alias(value))


def downscale_by_area(tile_series: DataFrame, children: DataFrame, tile: str, value: str, area: str, out: str) -> DataFrame:
    """Tile rate per area times the child's area (DOWN2, DOWN4)."""
    return children.join(tile_series, tile).withColumn(out, F.col(value) * F.col(area))


def reconcile(detail: DataFrame, whole: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Totals of two levels side by side with their relative difference and verdict (AGG35)."""
    a = detail.groupBy(*keys).agg(F.sum(value).alias("detail"))
    b = whole.groupBy(*keys).agg(F.sum(value).alias("whole"))
    rel = F.when(F.col("whole") != 0, F.abs(F.col("detail") / F.col("whole") - 1)).otherwise(F.abs("detail"))
    return a.join(b, keys, "full_outer").withColumn("rel_diff", rel).withColumn("ok", F.col("rel_diff") <= tolerance)


def closed_basin_fraction(trends: DataFrame, terminal: DataFrame, members: DataFrame, id_col: str = "id", code: str = "code", value: str = "trend") -> DataFrame:
    """Region trend of all bodies and of those draining to inland sinks, and the ratio (AGG18).
    ``terminal`` has id and ocean_terminating."""
    j = trends.join(terminal.select(id_col, "ocean_terminating"), id_col, "left")
    inland = F.when(~F.coalesce("ocean_terminating", F.lit(True)), F.col(value)).otherwise(F.lit(0.0))
    r = region_rollup(j.withColumn("inland", inland), members, [], [value, "inland"], code)
    return r.withColumn("fraction", F.when(F.col(value) != 0, F.col("inland") / F.col(value)))


def monthly_climatology(df: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    return df.groupBy(*keys, F.month(date).alias("month")).agg(F.avg(value).alias(value))


def annual_totals(df: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """Yearly sums of complete twelve-month years (AGG33)."""
    g = df.groupBy(*keys, F.year(date).alias("year")).agg(F.sum(value).alias(value), F.countDistinct(F.month(date)).alias("_m"))
    return g.where(F.col("_m") == 12).drop("_m")


def compare_models(own: DataFrame, others: DataFrame, keys: list[str], year: str, value: str) -> DataFrame:
    """Own yearly series against the per-year median over models: means, trends, % difference (AGG33)."""
    med = others.groupBy(*keys, year).agg(F.median(value).alias("_other"))
    j = own.join(med, [*keys, year])
    g = j.groupBy(*keys).agg(
        F.avg(value).alias("own_mean"), F.avg("_other").alias("other_mean"),
        F.regr_slope(F.col(value), F.col(year)).alias("own_trend"), F.regr_slope(F.col("_other"), F.col(year)).alias("other_trend"),
        F.count(F.lit(1)).alias("n_years"),
    )
    return g.withColumn("percent_diff", F.when(F.col("other_mean") != 0, (F.col("own_mean") / F.col("other_mean") - 1) * 100))


def ranked(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """Rows numbered from 1 in the given order.  A range sort and the counts of its partitions number
    them, so no task holds more than its range; only the counts pass through one window."""
    ranged = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    place = F.col("_before") + F.col("_m").bitwiseAND((1 << 33) - 1) + 1
    return ranged.withColumn("_part", part).join(starts, "_part").withColumn(out, place.cast("int")).drop("_m", "_part", "_before")
