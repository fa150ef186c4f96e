"""External comparison tables and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import datenum_timestamp, decimal_year
from ..functions.units import km3_to_gt
from ..operators.fit import seasonal_fit
from ..operators.rollup import region_quadrature


def clean_name(c: str | Column) -> Column:
    """Names compared without case, marks and repeated blanks (SRC9)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9 ]", " "), r"\s+", " "))


def locate_by_name_or_id(records: DataFrame, places: DataFrame, name: str = "name", key: str = "place_id") -> DataFrame:
    """Coordinates by name, or by id where the name is unknown (SRC9): two equi-joins and a coalesce, so no
    OR condition forces a nested loop.  Names and ids are unique per place after the reduction."""
    by_name = places.groupBy(clean_name(name).alias("_nm")).agg(F.min_by(F.struct("lon", "lat"), key).alias("_a"))
    by_id = places.select(F.col(key).alias("_id"), F.struct("lon", "lat").alias("_b"))
    r = records.withColumn("_nm", clean_name(name)).withColumn("_id", F.col(key))
    j = r.join(by_name, "_nm", "left").join(by_id, "_id", "left")
    return j.withColumn("lon", F.coalesce("_a.lon", "_b.lon")).withColumn("lat", F.coalesce("_a.lat", "_b.lat")).drop("_nm", "_id", "_a", "_b")


def recode(df: DataFrame, c: str, mapping: dict[str, int], out: str) -> DataFrame:
    """Recode keys with a literal map, NULL for unknown ones (SRC11)."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(out, F.try_element_at(m, F.col(c)))


def mass_change_table(df: DataFrame, datenum: str = "datenum", sigma: str = "sigma") -> DataFrame:
    """Day numbers to dates and two-sigma errors (SRC11)."""
    return df.withColumn("date", F.to_date(datenum_timestamp(datenum))).withColumn("error", 2.0 * F.col(sigma)).drop(datenum, sigma)


def triplets_to_long(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Columns <name>, <name>_error of each variable to (var, value, error) rows (SRC12)."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("var"), F.col(n).alias("value"), F.col(f"{n}_error").alias("error")) for n in names]))
    return df.select(*keys, rows.alias("_r")).select(*keys, "_r.*")


def composite(df: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Composite regions with root-sum-square errors (SRC12)."""
    return region_quadrature(df, members, keys, "value", "error", "region_code")


def fill_linear(df: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """Missing values from the straight line through the known ones (SRC12)."""
    t = decimal_year(date)
    fit = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.regr_slope(F.col(value), t).alias("_b"), F.regr_intercept(F.col(value), t).alias("_a"))
    return df.join(fit, keys, "left").withColumn(value, F.coalesce(value, F.col("_a") + F.col("_b") * t)).drop("_a", "_b")


def balances_with_sites(balances: DataFrame, sites: DataFrame, on: str = "glacier_id") -> DataFrame:
    """Mass-balance records with coordinates (SRC13)."""
    return balances.join(sites, on)


def read_reaches(spark: SparkSession, paths: list[str], columns: list[str] | None = None) -> DataFrame:
    """All river files as one table (SRC14); order is a matter of the consumer, not of the table."""
    df = spark.read.parquet(*paths)
    return df.select(*columns) if columns else df


def write_labelled(df: DataFrame, path: str, units: dict[str, str], by: list[str] = [], mode: str = "overwrite") -> None:
    """Long table to partitioned Parquet with units kept as column metadata (SNK1)."""
    out = df
    for c, u in units.items():
        out = out.withMetadata(c, {"unit": u})
    w = out.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def read_labelled(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """Table and its units (SNK2)."""
    df = spark.read.parquet(path)
    return df, {f.name: f.metadata["unit"] for f in df.schema if "unit" in f.metadata}


def wide_to_long(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return df.unpivot(keys, names, "var", "value")


def rate_tables(series: DataFrame, keys: list[str], area: str, date: str = "date", interval=None) -> tuple[DataFrame, DataFrame]:
    """Published tile tables (SNK3): rename the observed variable, drop rain, fit every series; volume
    rates, and the same per area (value / area * 1000)."""
    s = series.where(F.col("var") != "rain").withColumn("var", F.regexp_replace("var", "_altim$", "_synthesis"))
    f = seasonal_fit(s, [*keys, "var"], date, "value", interval=interval).select(*keys, "var", "offset", "trend", "amplitude", "phase_day")
    a = series.groupBy(*keys).agg(F.first(area).alias(area))
    per = f.join(a, keys)
    for c in ("offset", "trend", "amplitude"):
        per = per.withColumn(c, F.when(F.col(area) > 0, F.col(c) / (F.col(area) / 1000.0)))
    return f, per


def summary_rows(tile_series: DataFrame, bodies: DataFrame, tile: str = "tile_id", area: str = "area_km2") -> DataFrame:
    """One row per body, date and variable: tile value and error per area times the body's area (SNK4, DOWN2)."""
    j = bodies.join(tile_series, tile)
    return j.withColumn("value", F.col("value") * F.col(area)).withColumn("error", F.col("error") * F.col(area))


def to_mass(df: DataFrame, value: str = "value") -> DataFrame:
    return df.withColumn(value, km3_to_gt(value))


def write_csv(df: DataFrame, path: str) -> None:
    """Report table as CSV with a header (SNK5)."""
    df.write.mode("overwrite").option("header", True).csv(path)
