"""Merged cubes and a model stack to calibrated tile series (CAL4, CAL6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import decimal_year
from ..functions.units import mass_change, subtract_discharge
from ..operators import binning, calibrate, rollup


def tile_volumes(cube: DataFrame, hyps: DataFrame, run: list[str] = ["run_id"]) -> DataFrame:
    """run, tile_id, date_index, dv: km3 per tile and date (AGG12)."""
    return binning.volume_series(cube, hyps, [*run, "tile_id"], "date_index", height="height_index").withColumnRenamed("dv", "value")


def adjust_for_discharge(stack: DataFrame, discharge: DataFrame, date: str = "date", value: str = "value") -> DataFrame:
    """Model volumes less the discharge accumulated since the first date (FN20)."""
    first = stack.groupBy("tile_id").agg(F.min(date).alias("_d0"))
    j = stack.join(first, "tile_id").join(discharge.select("tile_id", "discharge"), "tile_id", "left")
    age = decimal_year(date) - decimal_year("_d0")
    return j.withColumn(value, subtract_discharge(value, age, "discharge")).drop("_d0", "discharge")


def calibrate_runs(volumes: DataFrame, stack: DataFrame, groups: DataFrame, p_axis: list[float], m_axis: list[float], p_grid: list[float], m_grid: list[float], run: list[str] = ["run_id"], **options) -> DataFrame:
    """Best (pscale, mscale) of every run and tile group (CAL4): all runs in one job.  The model stack is
    summed once per group and met by the observed series of every run."""
    ob = volumes.where(F.col("value").isNotNull()).join(groups.select("tile_id", "group"), "tile_id").groupBy(*run, "group", "date").agg(F.sum("value").alias("value"))
    st = calibrate.group_series(stack, groups, ["value"], ["pscale", "mscale"])
    return calibrate.grid_search(ob, st, [*run, "group"], p_axis, m_axis, p_grid, m_grid, stack_keys=["group"], **options)


def calibrated_series(best: DataFrame, groups: DataFrame, stack: DataFrame, p_axis: list[float], m_axis: list[float], values: list[str], areas: DataFrame, run: list[str] = ["run_id"]) -> DataFrame:
    """Tile series of the model at the calibrated scales, with group totals handed back by area (CAL6, AGG19)
    and mass change where dv and fac are present."""
    params = best.select(*run, "group", "pscale", "mscale").join(groups.select("tile_id", "group"), "group")
    s = calibrate.sample_stack(stack, params, ["tile_id"], p_axis, m_axis, values)
    s = s.join(areas.select("tile_id", "area_km2"), "tile_id")
    for v in values:
        s = rollup.group_share(s, [*run, "group"], "date", v, "area_km2", out=f"{v}_shared")
    if {"dv", "fac"} <= set(values):
        s = s.withColumn("dm", mass_change("dv_shared", "fac_shared"))
    return s
