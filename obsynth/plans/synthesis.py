"""Filled cubes of all runs to one merged cube per run (AGG13-AGG15)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import binning, ensemble

CELL = ["tile_id", "date_index", "height_index"]


def ensemble_error(cube: DataFrame, land_cube: DataFrame | None = None) -> DataFrame:
    """Spread over runs per mission and cell plus the mission's error floor over land."""
    floors = binning.mission_mad(land_cube if land_cube is not None else cube)
    return ensemble.spread_error(cube, floors, ["mission", *CELL])


def merge_runs(cube: DataFrame, errors: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """run_id, tile_id, date_index, height_index, dh, err."""
    return ensemble.inverse_variance_merge(cube, errors, CELL, visible=visible)
