"""Peak contribution of an upstream source to river flow, sinks and exposure tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_even
from .windows import arg_best


def contribution_percent(g: DataFrame, r: DataFrame, id_col: str = "comid", date: str = "month", window: int = 2) -> DataFrame:
    """Whole-percent share g/(g+r) per reach and month, g set to zero outside ``window`` months around
    the climatological peak of g; a zero total gives 0 (GR7, S5, S12).  ``g`` has column ``g``, ``r`` column ``r``."""
    peak = g.groupBy(id_col, F.month(date).alias("m")).agg(F.avg("g").alias("c"))
    peak = arg_best(peak, [id_col], "c", "m").select(id_col, F.col("m").alias("peak"))
    j = g.select(id_col, date, "g").join(peak, id_col).join(r.select(id_col, date, "r"), [id_col, date])
    off = F.pmod(F.month(date) - F.col("peak"), F.lit(12))
    near = (off <= window) | (off >= 12 - window)
    gg = F.when(near, F.col("g")).otherwise(F.lit(0.0))
    whole = gg + F.col("r")
    pct = F.when(whole != 0, half_even(gg / whole * 100.0)).otherwise(F.lit(0.0))
    return j.select(id_col, date, pct.cast("int").alias("percent"))


def peak_contribution(percent: DataFrame, id_col: str = "comid", date: str = "month") -> DataFrame:
    """gmax per reach: largest rounded monthly mean share, its month, and the extremes of that month (GR7, CMP5)."""
    m = percent.groupBy(id_col, F.month(date).alias("m")).agg(
        half_even(F.avg("percent")).cast("int").alias("mean"), F.max("percent").alias("hi"), F.min("percent").alias("lo")
    )
    b = arg_best(m, [id_col], "mean", "m")
    return b.select(
        id_col, F.col("mean").alias("gmax_avg"), F.col("m").alias("gmax_month"),
        F.col("lo").alias("gmax_min"), F.col("hi").alias("gmax_max"), (F.col("hi") - F.col("lo")).alias("gmax_range"),
    )


def yearly_length_over(percent: DataFrame, reaches: DataFrame, cutoff: int = 50, id_col: str = "comid", date: str = "month", length: str = "length_km") -> DataFrame:
    """Per year: summed length and number of reaches with any month at or above the cutoff (GR8)."""
    hit = percent.where(F.col("percent") >= cutoff).select(id_col, F.year(date).alias("year")).distinct()
    return hit.join(reaches.select(id_col, length), id_col).groupBy("year").agg(F.sum(length).alias("length_km"), F.count(F.lit(1)).alias("n_reaches"))


def years_over(percent: DataFrame, cutoff: int = 50, id_col: str = "comid", date: str = "month") -> DataFrame:
    """Number of years in which a reach passes the cutoff (GR8)."""
    y = percent.groupBy(id_col, F.year(date).alias("year")).agg(F.max("percent").alias("p"))
    return y.groupBy(id_col).agg(F.sum((F.col("p") >= cutoff).cast("long")).alias("n_years"))


def classify_sinks(reaches: DataFrame, discharge: DataFrame, id_col: str = "comid", next_col: str = "next_comid") -> DataFrame:
    """Terminal reaches and point discharges with marker type (1 ocean, 2 inland, 3 point) and size log(x + 1) (GR9).

    ``reaches`` has runoff_max_avg and ocean_terminating, ``discharge`` has runoff_max_avg."""
    a = reaches.where(F.col(next_col) == 0).select(F.col(id_col), "runoff_max_avg", "ocean_terminating", F.lit(False).alias("discharge"))
    b = discharge.select(F.lit(0).cast("long").alias(id_col), "runoff_max_avg", F.lit(True).alias("ocean_terminating"), F.lit(True).alias("discharge"))
    u = a.unionByName(b).withColumn("runoff_max_avg", F.coalesce("runoff_max_avg", F.lit(0.0)))
    kind = F.when(~F.col("ocean_terminating"), 2).when(F.col("discharge"), 3).otherwise(1)
    return u.withColumn("size", F.log1p("runoff_max_avg")).withColumn("type", kind.cast("int"))


def length_by_attribute(reaches: DataFrame, keys: list[str], gmax: str = "gmax_avg", cutoff: float = 50, length: str = "length_km") -> DataFrame:
    """River length with gmax at or above the cutoff per continent or country (AGG27)."""
    return reaches.where(F.col(gmax) >= cutoff).groupBy(*keys).agg(F.sum(length).alias(length))


def reaches_receiving(reaches: DataFrame, trace: DataFrame, id_col: str = "comid") -> DataFrame:
    """Only reaches on some trace (GR5)."""
    return reaches.join(trace.select(id_col).distinct(), id_col, "left_semi")


def mean_of_models(flux: DataFrame, keys: list[str], value: str = "flux") -> DataFrame:
    """Mean over land-surface models with missing values as zero (GR6)."""
    return flux.groupBy(*keys).agg(F.avg(F.coalesce(value, F.lit(0.0))).alias(value))
