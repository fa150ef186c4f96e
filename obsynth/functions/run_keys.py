"""Run keys: the parameter choices of one ensemble member, as text and as columns (FN13, DIM7)."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .numeric import col

FIELDS = ["surface_mask", "dem_id", "curvature_correct", "binning_method", "project_id", "amplitude_correct", "fill_param"]

# fixed values: the parameter grid of the published ensemble
ENSEMBLE_GRID = {
    "source_variant": ["binned", "binned_unfiltered"],
    "surface_mask": ["glacier", "glacier_rgi7"],
    "dem_id": ["best", "cop30_v2"],
    "curvature_correct": [False, True],
    "binning_method": ["median", "nmad3", "nmad5"],
    "project_id": ["v01"],
    "amplitude_correct": [True],
    "fill_param": [1, 2, 3, 4],
}

_PATTERN = r"^(.+)_dh_(.+?)_(cc_)?(median|mean|nmad3|nmad5|nmad10)_([^_]+)(?:_filled_(ac_)?p(\d+)(?:_aligned)?)?(?:_synthesized)?(?:\.\w+)?$"


def binned_key(surface_mask, dem_id, curvature_correct, binning_method, project_id) -> Column:
    return F.concat(
        col(surface_mask), F.lit("_dh_"), col(dem_id),
        F.when(col(curvature_correct), F.lit("_cc_")).otherwise(F.lit("_")),
        col(binning_method), F.lit("_"), col(project_id),
    )


def filled_key(surface_mask, dem_id, curvature_correct, binning_method, project_id, amplitude_correct, fill_param) -> Column:
    return F.concat(
        binned_key(surface_mask, dem_id, curvature_correct, binning_method, project_id),
        F.when(col(amplitude_correct), F.lit("_filled_ac_p")).otherwise(F.lit("_filled_p")),
        col(fill_param).cast("string"), F.lit("_aligned"),
    )


def binned_to_filled(key, amplitude_correct, fill_param) -> Column:
    return F.concat(
        col(key), F.when(col(amplitude_correct), F.lit("_filled_ac_p")).otherwise(F.lit("_filled_p")),
        col(fill_param).cast("string"), F.lit("_aligned"),
    )


def filled_to_synthesized(key) -> Column:
    return F.regexp_replace(col(key), "aligned$", "synthesized")


def parse_run_key(key) -> Column:
    """struct of :data:`FIELDS` from a run key or file name."""
    k = F.regexp_extract(col(key), r"([^/]+)$", 1)

    def g(i: int) -> Column:
        return F.regexp_extract(k, _PATTERN, i)

    return F.struct(
        g(1).alias("surface_mask"), g(2).alias("dem_id"), (g(3) != "").alias("curvature_correct"),
        g(4).alias("binning_method"), g(5).alias("project_id"), (g(6) != "").alias("amplitude_correct"),
        F.when(g(7) != "", g(7)).cast("int").alias("fill_param"),
    )


def run_table(spark: SparkSession, grid: dict[str, list] | None = None) -> DataFrame:
    """Cartesian product of the parameter lists as a small dimension table with ``run_id``."""
    grid = grid or ENSEMBLE_GRID
    names = list(grid)
    rows = [(i, *combo) for i, combo in enumerate(product(*grid.values()))]
    df = spark.createDataFrame(rows, ["run_id", *names])
    return df.withColumn("run_id", F.col("run_id").cast("short"))


def distinct_runs(runs: DataFrame, equal_fill: dict[int, int] = {3: 1, 4: 2}) -> DataFrame:
    """Drop members whose fill parameter set repeats an earlier one (S10)."""
    same = F.col("fill_param")
    for k, v in equal_fill.items():
        same = F.when(F.col("fill_param") == k, F.lit(v)).otherwise(same)
    rest = [c for c in runs.columns if c not in ("run_id", "fill_param")]
    return runs.groupBy(*rest, same.alias("fill_param")).agg(F.min("run_id").alias("run_id"))
