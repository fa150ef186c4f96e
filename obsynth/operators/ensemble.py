"""Ensemble statistics: spread over runs, reference and error, inverse-variance merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import MISSIONS


def spread_error(binned: DataFrame, floors: DataFrame, cell: list[str], value: str = "dh", mission: str = "mission") -> DataFrame:
    """Sample deviation over runs where at least two agree to exist, plus the mission floor (AGG14)."""
    g = binned.groupBy(*cell).agg(F.stddev_samp(value).alias("_sd"), F.count(value).alias("n_runs"))
    g = g.where(F.col("n_runs") > 1).join(floors, mission, "left")
    return g.select(*cell, "n_runs", (F.col("_sd") + F.coalesce("floor", F.lit(0.0))).alias("err"))


def mission_sees_tile(tiles: DataFrame, specs: list[tuple] = MISSIONS) -> DataFrame:
    """(tile_id, mission) pairs whose boxes touch; the sensor list is a literal array on each tile row."""
    seen = F.array(*[
        F.struct(F.lit(m).alias("mission"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
        for m, _, _, _, lo, hi, _ in specs
    ])
    t = tiles.select("tile_id", "min_y", "max_y", F.explode(seen).alias("_s"))
    return t.where((F.col("max_y") >= F.col("_s.lo")) & (F.col("min_y") <= F.col("_s.hi"))).select("tile_id", F.col("_s.mission").alias("mission"))


def inverse_variance_merge(
    values: DataFrame, errors: DataFrame, cell: list[str], run: list[str] = ["run_id"],
    value: str = "dh", mission: str = "mission", visible: DataFrame | None = None, tile: str = "tile_id",
    small_weight: float = 0.001,
) -> DataFrame:
    """Weighted mean over missions, weight 1/err^2; weight 0 outside a mission's extent or without an
    error; 0.001 where a value exists but its weight is 0; err = sqrt(1/sum w) (AGG15)."""
    v = values.where(F.col(value).isNotNull())
    j = v.join(errors.select(*cell, mission, "err"), [*cell, mission], "left")
    w = F.when(F.col("err") > 0, 1.0 / (F.col("err") * F.col("err"))).otherwise(F.lit(0.0))
    if visible is not None:
        j = j.join(visible.select(tile, mission, F.lit(True).alias("_seen")), [tile, mission], "left")
        w = F.when(F.col("_seen"), w).otherwise(F.lit(0.0))
    j = j.withColumn("_w", w).withColumn("_w", F.when(F.col("_w") == 0, F.lit(small_weight)).otherwise(F.col("_w")))
    g = j.groupBy(*run, *cell).agg(F.sum(F.col(value) * F.col("_w")).alias("_s"), F.sum("_w").alias("_sw"))
    return g.select(*run, *cell, (F.col("_s") / F.col("_sw")).alias(value), F.sqrt(1.0 / F.col("_sw")).alias("err"))


def area_average_spread(series: DataFrame, keys: list[str], value: str = "dh", sigma: float = 2.0) -> DataFrame:
    """Median and ``sigma`` times the deviation over simulated runs (AGG28)."""
    return series.groupBy(*keys).agg(F.median(value).alias("median"), (F.stddev_samp(value) * sigma).alias("err"), F.count(value).alias("n"))


def delta_from_reference(runs: DataFrame, reference, keys: list[str], value: str = "value", run: str = "run_id", out: str = "delta") -> DataFrame:
    """Every run minus the reference run (ENS2)."""
    ref = runs.where(F.col(run) == reference).select(*keys, F.col(value).alias("_ref"))
    return runs.join(ref, keys).withColumn(out, F.col(value) - F.col("_ref")).drop("_ref")


def quantile_over_runs(runs: DataFrame, keys: list[str], p: float, value: str = "value", on_abs: bool = True, out: str = "quantile") -> DataFrame:
    """Quantile over runs; a missing run makes the cell missing (ENS3).  A group has one row per run."""
    v = F.abs(value) if on_abs else F.col(value)
    g = runs.groupBy(*keys).agg(F.percentile(v, p).alias("_q"), F.count(F.lit(1)).alias("_n"), F.count(value).alias("_ok"))
    return g.select(*keys, F.when(F.col("_n") == F.col("_ok"), F.col("_q")).alias(out))


def reference_and_error(runs: DataFrame, reference, keys: list[str], quantile: float = 0.95, scaling: float = 1.0, value: str = "value", run: str = "run_id") -> DataFrame:
    """Value of the reference run with the quantile of abs(run - reference) as error (ENS1, ENS4, ENS8, ENS9)."""
    # the runs of a key meet once: reference, differences and their quantile share one shuffle
    cell, own = W.partitionBy(*keys), F.col(run) == reference
    d = runs.select(*keys, run, value).withColumn("_ref", F.max(F.when(own, F.col(value))).over(cell)).withColumn("_has", F.max(own).over(cell)).where("_has")
    delta = F.abs(F.col(value) - F.col("_ref"))
    g = d.groupBy(*keys).agg(F.max("_ref").alias(value), F.percentile(delta, quantile).alias("_q"), F.count(F.lit(1)).alias("_n"), F.count(delta).alias("_ok"))
    return g.select(*keys, value, F.when(F.col("_n") == F.col("_ok"), F.col("_q") * scaling).alias("error"))


def error_floor(df: DataFrame, fraction: float, value: str = "value", error: str = "error", compat: bool = False) -> DataFrame:
    """Error not below a fraction of the value; ``compat`` replaces the error by that fraction (ENS5, S9)."""
    frac = F.abs(F.col(value) * fraction)
    return df.withColumn(error, frac if compat else F.greatest(F.col(error), frac))


def state_index_error(fits: DataFrame, discharge: DataFrame, region: str = "region") -> DataFrame:
    """Error of (runoff + discharge)/net accumulation by propagation (ENS1).  ``fits`` is wide per
    region: runoff, runoff_error, net_acc, net_acc_error, gsi_error; ``discharge`` has discharge, discharge_error."""
    j = fits.join(discharge, region)
    a = F.col("runoff") + F.col("discharge")
    sa = F.sqrt(F.col("runoff_error") * F.col("runoff_error") + F.col("discharge_error") * F.col("discharge_error"))
    b, sb = F.col("net_acc"), F.col("net_acc_error")
    ra, rb = F.try_divide(sa, a), F.try_divide(sb, b)
    rel = F.sqrt(ra * ra + rb * rb)
    return j.withColumn("gsi_error", F.abs("gsi_error") * rel)


def run_rmse(runs: DataFrame, external: DataFrame, on: list[str], scale: float = 1.0, run: str = "run_id", value: str = "value", other: str = "other") -> DataFrame:
    """Root mean square difference of each run to an external table (ENS10)."""
    d = F.col(value) - F.col(other) * scale
    return runs.join(external.select(*on, other), on).groupBy(run).agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.count(F.lit(1)).alias("n"))
