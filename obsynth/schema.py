"""Declared table schemas, fixed axes and dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.dates import DATE_AXIS_END, DATE_AXIS_START, DATE_AXIS_STEP

POINTS = "tile_id string, mission string, point_id long, ts timestamp, lon double, lat double, height double, quality boolean, height_error double, granule_id string"
POINT_DEM = "point_id long, dem_id string, height double, dhdx double, dhdy double, dhddx double, dhddy double"
POINT_MASK = "point_id long, mask string, inside boolean"
POINT_CANOPY = "point_id long, canopyh double"
TILES = "tile_id string, min_x double, min_y double, max_x double, max_y double, glacier_frac double, region_frac map<int,double>"
HYPS = "tile_id string, height_bin double, area_km2 double"
BINNED = "run_id int, mission string, tile_id string, date_bin date, height_bin double, dh double, nobs long"
FIT_PARAMS = "run_id int, mission string, tile_id string, t0 double, h0 double, dh0 double, param_m1 array<double>, offset double"
MODEL_POINTS = "lat double, lon double, height double, date date, precipitation_scale double, elevation_delta double, acc double, melt double, refreeze double, rain double, ec double, fac double"
MODEL_DV = "tile_id string, date date, pscale double, mscale double, var string, value double"
REACHES = "comid long, next_comid long, up1 long, length_km double"
REACH_FLUX = "comid long, month date, flux double"
PIXELS = "row long, col long, x double, y double, value double, cell_area double"
RING = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))

SEASONALITY_WEIGHT = 0.85
ORIGIN_PENALTY = 0.20
MELT_TO_PRECIP_WEIGHT = 0.5

# fixed values: sensor specifications (name, product, sigma, half width, latitude limits, land trend m/yr)
MISSIONS = [
    ("icesat2", "ATL06", 0.1, 2.75, -88, 88, 0.0),
    ("icesat", "GLAH06", 0.1, 8.75, -86, 86, 0.0),
    ("gedi", "GEDI02_A", 0.1, 5.5, -52, 52, -0.144),
    ("hugonnet", "HSTACK", 5.0, 50.0, -90, 90, 0.0),
]

# fixed values: minimum bin counts and smoothing neighbours of the fill parameter sets
FILL_PARAMETERS = {
    1: {"bincount_min": {"hugonnet": 51}, "bincount_default": 9, "smooth_n": {"hugonnet": 21}, "smooth_default": 5, "length_scale": 800.0, "nmad_max": 5.0},
    2: {"bincount_min": {"hugonnet": 51}, "bincount_default": 9, "smooth_n": {"hugonnet": 21}, "smooth_default": 5, "length_scale": 400.0, "nmad_max": 10.0},
}
FILL_PARAMETERS[3] = FILL_PARAMETERS[1]
FILL_PARAMETERS[4] = FILL_PARAMETERS[2]

# fixed values: region names; 98 = regions 13 to 15, 99 = regions 1 to 19
REGION_LABELS = {
    1: "Alaska", 2: "Western Canada", 3: "Arctic Canada N.", 4: "Arctic Canada S.", 5: "Greenland Periphery",
    6: "Iceland", 7: "Svalbard", 8: "Scandinavia", 9: "Russian Arctic", 10: "North Asia",
    11: "Central Europe", 12: "Caucasus", 13: "Central Asia", 14: "South Asia W.", 15: "South Asia E.",
    16: "Low Latitudes", 17: "Southern Andes", 18: "New Zealand", 19: "Antarctic", 98: "HMA", 99: "Global",
}
COMPOSITES = {98: list(range(13, 16)), 99: list(range(1, 20))}

# fixed values: centres and edges of the melt-scale axis
MSCALE_EDGES = [1 / 6, 1 / 4, 1 / 2, 2.0, 4.0, 6.0]
MSCALE_CENTERS = [1 / 5, 1 / 3, 1.0, 3.0, 5.0]


def missions(spark: SparkSession) -> DataFrame:
    """Sensor dimension (DIM1)."""
    return spark.createDataFrame(
        [(m, p, s, w, float(a), float(b), -180.0, 180.0, False, t) for m, p, s, w, a, b, t in MISSIONS],
        "mission string, product string, error_sigma double, half_width double, lat_min double, lat_max double, "
        "lon_min double, lon_max double, apply_quality_filter boolean, land_trend double",
    )


def region_members(spark: SparkSession, composites: dict[int, list[int]] | None = None, codes=range(1, 20)) -> DataFrame:
    """Bridge (region, member): every code stands for itself, composites for their members."""
    comp = COMPOSITES if composites is None else composites
    rows = [(c, c) for c in codes] + [(k, m) for k, v in comp.items() for m in v]
    return spark.createDataFrame(rows, "region int, member int")


def region_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(REGION_LABELS.items()), "region int, region_name string")


def date_axis(spark: SparkSession, start: str = DATE_AXIS_START, end: str = DATE_AXIS_END, step: int = DATE_AXIS_STEP) -> DataFrame:
    """Bins of ``step`` days labelled by their centre (DIM2)."""
    n = F.floor(F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) / step).cast("int")
    axis = spark.range(1).select(F.explode(F.sequence(F.lit(0), n - 1)).alias("date_index"))
    lo = F.date_add(F.lit(start).cast("date"), F.col("date_index") * step)
    return axis.select("date_index", lo.alias("date_lo"), F.date_add(lo, step // 2).alias("date_bin"))


def height_axis(spark: SparkSession, top: int = 10000, step: int = 100) -> DataFrame:
    """Elevation bins labelled by their centre (DIM2)."""
    axis = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(top // step - 1))).alias("height_index"))
    return axis.select("height_index", (F.col("height_index") * float(step) + step / 2.0).alias("height_bin"))


def mscale_axis(spark: SparkSession) -> DataFrame:
    rows = [(i, MSCALE_EDGES[i], MSCALE_EDGES[i + 1], c) for i, c in enumerate(MSCALE_CENTERS)]
    return spark.createDataFrame(rows, "mscale_index int, edge_lo double, edge_hi double, mscale double")
