"""Point archive: scans, sampling, catalogues, gridded stacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_points(spark: SparkSession, path: str, columns: list[str], mission: str | None = None, tiles: list[str] | None = None) -> DataFrame:
    """Pruned scan: partition filters first, then only the asked columns (SRC1)."""
    df = spark.read.parquet(path)
    if mission is not None:
        df = df.where(F.col("mission") == mission)
    if tiles is not None:
        df = df.where(F.col("tile_id").isin(tiles))
    return df.select(*columns)


def explode_vectors(df: DataFrame, vectors: list[str]) -> DataFrame:
    """One row per element of parallel vector cells, scalars repeated along them (SRC2)."""
    rest = [c for c in df.columns if c not in vectors]
    d = df.select(*rest, F.explode(F.arrays_zip(*vectors)).alias("_z"))
    return d.select(*rest, *[F.col(f"_z.{v}").alias(v) for v in vectors])


def subsample(df: DataFrame, fraction: float, seed: int = 0, replace: bool = False) -> DataFrame:
    """Bernoulli sample, or one with replacement (SRC2, CMP2)."""
    return df if fraction >= 1 else df.sample(withReplacement=replace, fraction=fraction, seed=seed)


def repeated_draws(df: DataFrame, draws: int, keep: float, key: list[str], seed: int = 0) -> DataFrame:
    """``draws`` random subsets that keep each cell with probability ``keep`` (CMP11).  The choice hashes the
    cell key and the draw, so a re-run or a lost executor gives the same subsets."""
    d = df.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u = F.pmod(F.xxhash64(*key, "draw", F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    return d.where(u <= keep)


def granule_catalogue(catalogue: DataFrame, tiles: DataFrame) -> DataFrame:
    """Catalogue rows of the requested tiles (SRC3)."""
    return catalogue.join(tiles.select("tile_id"), "tile_id", "left_semi")


def stack_catalogue(pixels: DataFrame, file: str = "file") -> DataFrame:
    """Extent, time range and layer count of every gridded stack (SRC4)."""
    return pixels.groupBy(file).agg(
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"),
        F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.countDistinct("t").alias("n_layers"))


def unpack_stack(df: DataFrame, heights: str = "heights", times: str = "times") -> DataFrame:
    """Array-packed pixel series to one row per time, missing layers dropped (SRC5)."""
    d = df.select(*[c for c in df.columns if c not in (heights, times)], F.posexplode(heights).alias("layer", "height"), F.col(times).alias("_t"))
    d = d.where(F.col("height").isNotNull() & ~F.isnan("height"))
    return d.withColumn("ts", F.get("_t", F.col("layer"))).drop("_t")


def stack_points(pixels: DataFrame, width: float, corr_min: float = 70.0, quality_min: float = 70.0) -> DataFrame:
    """Points of gridded stacks with their tile, kept where the correlation is high enough (SRC5, SRC8)."""
    d = pixels.where((F.col("corr") > corr_min) & F.col("height").isNotNull())
    d = d.withColumn("quality", F.col("corr") > quality_min)
    return d.withColumn("tile_x", F.floor(F.col("x") / width).cast("int")).withColumn("tile_y", F.floor(F.col("y") / width).cast("int"))


def stack_variants(filtered: DataFrame, unfiltered: DataFrame) -> DataFrame:
    """Both stack products in one table (SRC8)."""
    return filtered.withColumn("source_variant", F.lit("binned")).unionByName(unfiltered.withColumn("source_variant", F.lit("binned_unfiltered")))


def running_model(points: DataFrame, keys: list[str], ts: str, values: list[str]) -> DataFrame:
    """Cumulative sums / 1000 of model increments per point and wrapped longitude (AGG21)."""
    from pyspark.sql import Window as W

    from ..functions.geo import wrap_longitude

    w = W.partitionBy(*keys).orderBy(ts).rowsBetween(W.unboundedPreceding, 0)  # the steps of one model point
    d = points.withColumns({v: F.sum(v).over(w) / 1000.0 for v in values})
    return d.withColumn("lon", wrap_longitude("lon")) if "lon" in points.columns else d


def bin_model(points: DataFrame, keys: list[str], date_index, values: list[str]) -> DataFrame:
    """Mean of each variable per point and time bin (AGG21)."""
    return points.groupBy(*keys, date_index.alias("date_index")).agg(*[F.avg(v).alias(v) for v in values])
