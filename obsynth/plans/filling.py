"""Binned cubes to filled, normalised and aligned cubes (FIT11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import DATE_AXIS_START, DATE_AXIS_STEP
from ..operators import fill, windows
from ..session import cut_lineage


def fill_cubes(
    cube: DataFrame, hyps: DataFrame, tiles: DataFrame, settings: DataFrame, trends: DataFrame, run: list[str] = ["run_id"],
    reference: str = "icesat2", align_to: list[str] = ["icesat2", "icesat"], amplitude_correct: bool = True,
    replace: tuple[DataFrame, str] | None = None, visible: DataFrame | None = None, height_width: float = 100.0,
    axis_start: str = DATE_AXIS_START, axis_step: int = DATE_AXIS_STEP,
) -> tuple[DataFrame, DataFrame]:
    """(filled cube, offsets) of every run at once; order: land trend, surface fit, amplitude, empty tiles,
    profile ends, alignment, model replacement.

    cube: run + mission, tile_id, date_index, height_index, dh, nobs.  hyps: tile_id, height_index, area_km2.
    tiles: tile_id, lon, lat.  ``visible``: (tile_id, mission) pairs a sensor can see."""
    keys = [*run, "mission", "tile_id"]
    day = F.date_add(F.lit(axis_start).cast("date"), (F.col("date_index") * axis_step + axis_step // 2).cast("int"))
    d = cube.withColumn("_day", day)
    d = windows.remove_trend(d, trends, "_day", step_days=axis_step).select(*cube.columns)

    # the fits are the costly part and feed every later step: stored once
    filled = cut_lineage(fill.surface_model_fill(d, keys, settings, height_width, [*run, "mission"], axis_start, axis_step))
    c, par = fill.split_params(filled, keys)
    if amplitude_correct:
        ref = par.where(F.col("mission") == reference)
        t = fill.with_axis_time(c, "date_index", axis_start, axis_step).withColumn("_h", (F.col("height_index") + 0.5) * height_width)
        # the reference sensor meets its own season and is unchanged
        by_mission = ref.drop("mission").join(par.select(*keys), [*run, "tile_id"])
        c = fill.amplitude_normalize(t, par, by_mission, keys, "t", "_h").select(*c.columns)

    # empty tiles with area inside the sensor's extent
    dims = [*run, "mission"]
    level = par.select(*keys, (F.col("param")[0] + F.col("dh0")).alias("level"))
    have = c.select(*keys).distinct()
    whole = have.select(*dims).distinct()
    pairs = visible if visible is not None else tiles.select("tile_id").withColumn("mission", F.explode(F.array(*[F.lit(m) for m in _missions(settings)])))
    want = whole.join(pairs.select("tile_id", "mission"), "mission").select(*keys)
    empty = want.join(have, keys, "left_anti")
    made = fill.fill_empty_tiles(c, level, empty, tiles, hyps, dims)
    c = cut_lineage(c.unionByName(made.withColumn("nobs", F.lit(0).cast("long"))))

    # carry the profile ends over the has-area range of every date
    band = hyps.where(F.col("area_km2") > 0).groupBy("tile_id").agg(F.min("height_index").alias("_h0"), F.max("height_index").alias("_h1"))
    dates = c.select(*keys, "date_index").distinct().join(band, "tile_id")
    grid = dates.withColumn("height_index", F.explode(F.sequence("_h0", "_h1"))).drop("_h0", "_h1")
    full = grid.join(c, [*keys, "date_index", "height_index"], "full_outer")
    full = windows.extend_ends(full, [*keys, "date_index"], "height_index", "dh").where(F.col("dh").isNotNull())
    c = cut_lineage(full.withColumn("nobs", F.coalesce("nobs", F.lit(0).cast("long"))))

    off = fill.mission_offsets(c, hyps, [*run, "tile_id"], "date_index", align_to, height="height_index")
    c = fill.align(c, off, [*run, "tile_id"])
    if replace is not None:
        tile_list, target = replace
        c = fill.replace_with_model(c, tile_list, target, align_to, run, height_width, axis_start, axis_step)
    return c, off


def _missions(settings: DataFrame) -> list[str]:
    """Sensor names of the settings dimension (a handful of rows)."""
    return [r["mission"] for r in settings.select("mission").distinct().collect()]
