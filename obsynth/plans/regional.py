"""Calibrated series of all runs to regional results (ENS6, ENS7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.units import state_index
from ..operators import ensemble, fit, reports, rollup
from ..session import cut_lineage


def region_sums(series: DataFrame, members: DataFrame, run: str = "run_id", code: str = "region_code") -> DataFrame:
    """run, var, date, region, value (AGG16)."""
    return rollup.region_rollup(series, members, [run, "var", "date"], ["value"], code)


def region_fits(sums: DataFrame, window: tuple[str, str], run: str = "run_id") -> DataFrame:
    """Long table run, var, region, parameter, value for one date window (FIT3); net accumulation is acc - ec."""
    wide = sums.where(F.col("var").isin("acc", "ec")).groupBy(run, "region", "date").pivot("var", ["acc", "ec"]).agg(F.first("value"))
    net = wide.where("acc is not null and ec is not null").select(run, F.lit("net_acc").alias("var"), "date", "region", (F.col("acc") - F.col("ec")).alias("value"))
    f = fit.region_trends(sums.unionByName(net), [run, "var", "region"], "date", "value", window)
    return f.select(run, "var", "region", *["trend", "acceleration", "amplitude", "phase"]).unpivot([run, "var", "region"], ["trend", "acceleration", "amplitude", "phase"], "parameter", "value")


def add_state_index(fits: DataFrame, discharge: DataFrame, run: str = "run_id") -> DataFrame:
    """gsi = (runoff + discharge) / net accumulation for trend, and without discharge for acceleration (FIT3)."""
    w = fits.where(F.col("var").isin("runoff", "net_acc") & F.col("parameter").isin("trend", "acceleration"))
    w = w.groupBy(run, "region", "parameter").pivot("var", ["runoff", "net_acc"]).agg(F.first("value"))
    w = w.join(discharge.select("region", F.col("value").alias("_d")), "region", "left")
    d = F.when(F.col("parameter") == "trend", F.coalesce("_d", F.lit(0.0))).otherwise(F.lit(0.0))
    g = w.select(run, F.lit("gsi").alias("var"), "region", "parameter", state_index("runoff", d, "net_acc").alias("value"))
    return fits.unionByName(g)


def regional_results(series: DataFrame, members: DataFrame, discharge: DataFrame, reference, windows: dict[str, tuple[str, str]], run: str = "run_id", quantile: float = 0.95, scaling: float = 1.0, floor: float | None = 0.2) -> DataFrame:
    """window, region, var, parameter, value, error: reference run with ensemble error for several date windows (ENS6, ENS7)."""
    sums = cut_lineage(region_sums(series, members, run))  # small: regions x dates x runs; read by every window
    out = None
    for name, win in windows.items():
        f = add_state_index(region_fits(sums, win, run), discharge, run)
        e = ensemble.reference_and_error(f, reference, ["var", "region", "parameter"], quantile, scaling, "value", run)
        if floor is not None:
            e = ensemble.error_floor(e, floor)
        e = e.withColumn("window", F.lit(name))
        out = e if out is None else out.unionByName(e)
    return out


def results_table(results: DataFrame, labels: DataFrame, variables: list[str], params: list[str] = ["trend", "acceleration", "amplitude", "phase"]) -> DataFrame:
    """Report with region names (RPT1)."""
    t = reports.error_bar_table(results, variables, params)
    return labels.join(t, "region")
