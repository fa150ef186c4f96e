"""Bodies to rivers: lowest point, basin, nearest reach, downstream path, flux, peak share, exposure (GR4-GR7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import nan_to_null
from ..operators import graph, raster, routing, spatial, windows
from ..session import cut_lineage


def attach_rivers(bodies: DataFrame, pixels: DataFrame, basins: DataFrame, vertices: DataFrame, cell: float, to_ocean: list[int] = [], body: str = "body_id", region: str = "region_code") -> DataFrame:
    """Each body with its lowest point, drainage basin and nearest reach; bodies of the listed regions drain to the
    ocean (comid 0).  vertices: vertex_id, comid, lon, lat."""
    low = raster.lowest_pixel(pixels, bodies.select(body, "ring"), body, cell)
    b = bodies.drop("ring").join(low, body).withColumnRenamed("min_x", "lon").withColumnRenamed("min_y", "lat")
    b = spatial.first_zone(b, basins, body, "basin_id", "basin_id", cell)
    near = spatial.nearest(b.where(F.col("lon").isNotNull()), vertices, 1, body, "vertex_id")
    near = near.join(vertices.select("vertex_id", "comid"), "vertex_id").select(body, "comid", "meters")
    b = b.join(near, body, "left")
    ocean = F.col(region).isin(to_ocean) if to_ocean else F.lit(False)
    return cut_lineage(b.withColumn("comid", F.when(ocean, F.lit(0).cast("long")).otherwise(F.col("comid"))))


def body_flux(cumulative: DataFrame, body: str = "body_id", date: str = "date", value: str = "runoff") -> DataFrame:
    """Monthly rate per body from its cumulative series: difference, linear resampling to month starts, negatives
    clamped (WIN1, WIN10)."""
    r = windows.rate_from_cumulative(cumulative, [body], date, value, "rate").where(F.col("rate").isNotNull())
    r = r.select(body, F.datediff(date, F.lit("1970-01-01").cast("date")).alias("_day"), "rate")
    span = r.groupBy(body).agg(F.min("_day").alias("_a"), F.max("_day").alias("_b"))
    day0 = F.lit("1970-01-01").cast("date")
    months = F.sequence(F.trunc(F.date_add(day0, F.col("_a")), "month"), F.date_add(day0, F.col("_b")), F.expr("interval 1 month"))
    axis = span.select(body, "_a", F.explode(months).alias("month"))
    axis = axis.withColumn("_day", F.datediff("month", day0)).where(F.col("_day") >= F.col("_a")).select(body, "_day")
    m = windows.resample(r, axis, [body], "_day", "rate", outside="none")
    return m.select(body, F.date_add(day0, F.col("_day")).alias("month"), F.greatest(nan_to_null("rate"), F.lit(0.0)).alias("flux"))


def route(flux: DataFrame, bodies: DataFrame, reaches: DataFrame, body: str = "body_id") -> tuple[DataFrame, DataFrame]:
    """(accumulated flux per reach and month, reaches that receive any of it with body count and sink)."""
    inp = flux.join(bodies.select(body, "comid"), body).where(F.col("comid") > 0).groupBy("comid", "month").agg(F.sum("flux").alias("flux"))
    inp = cut_lineage(inp)
    # bodies with flux, accumulated: reaches with any are those that receive flux, at one row a reach
    own = bodies.join(inp.select("comid").distinct(), "comid", "left_semi").groupBy("comid").agg(F.count(F.lit(1)).alias("n_bodies"))
    keep = cut_lineage(reaches.join(graph.accumulate_sum(own, reaches, "n_bodies", time=[]), "comid"))
    acc = graph.accumulate_sum(inp, keep)
    return acc, keep.join(graph.downstream_sink(keep), "comid", "left")


def land_flux(models: DataFrame, reaches: DataFrame, weights: list[float]) -> DataFrame:
    """Land-surface runoff per reach: mean of the models, reservoir response, accumulation (GR6).
    models: comid, month, model, flux."""
    m = routing.mean_of_models(models, ["comid", "month"])
    m = windows.convolve(m, ["comid"], "month", "flux", weights).select("comid", "month", F.col("response").alias("flux"))
    return graph.accumulate_sum(m, reaches)


def peak_shares(body_acc: DataFrame, land_acc: DataFrame, reaches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reach table with gmax statistics and largest mean monthly runoff, yearly length above 50 %) (GR7, GR8)."""
    g = body_acc.select("comid", "month", F.col("flux").alias("g"))
    r = land_acc.select("comid", "month", F.col("flux").alias("r"))
    pct = routing.contribution_percent(g, r)
    top = body_acc.groupBy("comid", F.month("month").alias("m")).agg(F.avg("flux").alias("f")).groupBy("comid").agg(F.max("f").alias("runoff_max_avg"))
    table = reaches.join(routing.peak_contribution(pct), "comid").join(top, "comid", "left")
    return table, routing.yearly_length_over(pct, reaches)
