"""Validation against independent records: intervals, yearly statistics, matched differences."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def interval_change(obs: DataFrame, series: DataFrame, on: list[str], obs_id: str, begin: str, end: str, values: list[str], date: str = "date", step_days: int = 30, divide_by: str | None = None) -> DataFrame:
    """Accumulated change of each variable over an observation period (JN15, DIM9).

    ``series`` holds increments labelled by the centre of their step; a step belongs to the period when it
    overlaps it, and the first overlapping step is the starting level.  Both sides meet on the cell key and
    the month of the step, so a long series is not paired whole with every observation.  The series is written
    as a table at once."""
    half = step_days // 2
    area = [] if divide_by is None else [F.col(divide_by).alias("_area")]
    o = obs.where(F.col(begin).isNotNull() & F.col(end).isNotNull()).select(*on, obs_id, begin, end, *area)
    months = F.sequence(F.trunc(F.date_sub(begin, half), "month"), F.trunc(F.date_add(end, half), "month"), F.expr("interval 1 month"))
    o = o.withColumn("_mon", F.explode(months))
    # as a table the series has a known size; the planner takes the observations times months for no more than the
    # observations' file, and would send them to every task
    s = cut_lineage(series.select(*on, date, *values)).withColumn("_mon", F.trunc(date, "month"))
    j = o.join(s, [*on, "_mon"])
    j = j.where((F.date_add(date, half) >= F.col(begin)) & (F.date_sub(date, half) <= F.col(end)))
    aggs = [(F.sum(v) - F.min_by(v, date)).alias(v) for v in values]
    if divide_by is None:
        return j.groupBy(obs_id).agg(*aggs, F.count(F.lit(1)).alias("n_steps"))
    g = j.groupBy(obs_id).agg(*aggs, F.count(F.lit(1)).alias("n_steps"), F.max("_area").alias("_area"))
    return g.select(obs_id, "n_steps", *[(F.try_divide(F.col(v), F.col("_area")) / 1000.0).alias(v) for v in values])


def annual_statistics(df: DataFrame, year: str, area: str, balance: str, site: str) -> DataFrame:
    """Observed area, spread of balances and distinct sites per year (AGG22)."""
    return df.groupBy(year).agg(F.sum(area).alias("area_sum"), F.stddev_samp(balance).alias("balance_std"), F.countDistinct(site).alias("n_sites"))


def annual_coverage(stats: DataFrame, whole: DataFrame, area: str) -> DataFrame:
    """Share of the total area seen each year, in percent (AGG22)."""
    tot = whole.agg(F.sum(area).alias("_whole")).withColumn("_k", F.lit(1))
    return stats.withColumn("_k", F.lit(1)).join(F.broadcast(tot), "_k").withColumn("coverage", F.try_divide(F.col("area_sum"), F.col("_whole")) * 100).drop("_k", "_whole")


def cell_misfit(df: DataFrame, cell: list[str], misfit: str, area: str) -> DataFrame:
    """Mean and spread of the misfit per cell, and the radius of a circle of the cell's area (AGG22)."""
    g = df.groupBy(*cell).agg(F.avg(misfit).alias("mean_misfit"), F.stddev_samp(misfit).alias("std_misfit"), F.count(misfit).alias("n"), F.sum(area).alias("_a"))
    return g.withColumn("radius", F.sqrt(F.col("_a") / math.pi)).drop("_a")


def external_annual(df: DataFrame, period: str, value: str, factor: float = 0.85) -> DataFrame:
    """Rows whose period text 'a_b' spans one year, with year = end and the scaled value (CMP1)."""
    parts = F.split(F.col(period), "_")
    a, b = F.to_date(parts[0]), F.to_date(parts[1])
    d = df.withColumn("_a", a).withColumn("_b", b).where(F.year("_b") - F.year("_a") == 1)
    return d.withColumn("year", F.year("_b")).withColumn(value, F.col(value) * factor).drop("_a", "_b")


def matched_difference(a: DataFrame, b: DataFrame, on: list[str], left: str, right: str) -> DataFrame:
    """Difference of two records of the same key (CMP1)."""
    return a.join(b, on).withColumn("delta", F.col(left) - F.col(right))


def first_per_name(df: DataFrame, name: str, order: str, columns: list[str]) -> DataFrame:
    """First record and number of records per name (CMP4)."""
    return df.groupBy(name).agg(F.min_by(F.struct(*columns), order).alias("_f"), F.count(F.lit(1)).alias("n")).select(name, "_f.*", "n")


def running_totals(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Cumulative sums along each site's record (CMP12)."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({f"cum_{v}": F.sum(v).over(w) for v in values})


def parse_triplet(df: DataFrame, key: str, names: list[str], models: list[str], value: str = "runoff") -> DataFrame:
    """Split a 'GCM_SSP_Basin' key and turn the model columns into rows (SRC10)."""
    p = F.split(F.col(key), "_", len(names))
    d = df.select(*[p[i].alias(n) for i, n in enumerate(names)], *[c for c in df.columns if c != key])
    rest = [c for c in d.columns if c not in models]
    return d.unpivot(rest, models, "model", value)


def amplitude_difference(a: DataFrame, b: DataFrame, on: list[str], by: list[str] = []) -> DataFrame:
    """Percent difference of two fitted amplitudes (CMP9), for each value of the columns ``by`` of ``b``."""
    j = a.select(*on, F.col("amplitude").alias("_a")).join(b.select(*on, *by, F.col("amplitude").alias("_b")), on)
    return j.select(*on, *by, F.col("_a").alias("observed"), F.col("_b").alias("modelled"), F.when(F.col("_a") != 0, (F.col("_b") / F.col("_a") - 1) * 100).alias("percent"))
