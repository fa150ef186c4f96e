"""Append-only ingestion, stale-stage ledger and partition updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import right_merge


def unseen_granules(incoming: DataFrame, ledger: DataFrame, on: list[str] = ["tile_id", "granule_id"]) -> DataFrame:
    """Rows of granules not processed before (SRC6).  The ledger lists every processed granule, also the
    empty ones, so an empty granule is not read again."""
    return incoming.join(ledger.select(*on), on, "left_anti")


def append_granules(points: DataFrame, incoming: DataFrame, ledger: DataFrame, extent: DataFrame | None = None, on: list[str] = ["tile_id", "granule_id"]) -> tuple[DataFrame, DataFrame]:
    """(points after the append, ledger after the append); new points outside their tile are clipped."""
    new = unseen_granules(incoming, ledger, on)
    done = ledger.select(*on).unionByName(new.select(*on).distinct())
    if extent is not None:
        new = new.join(extent.select("tile_id", "min_x", "min_y", "max_x", "max_y"), "tile_id")
        new = new.where((F.col("lon") >= F.col("min_x")) & (F.col("lon") < F.col("max_x")) & (F.col("lat") >= F.col("min_y")) & (F.col("lat") < F.col("max_y")))
    return points.unionByName(new.select(*points.columns)), done


def stale_keys(inputs: DataFrame, ledger: DataFrame, stage: str, key: str = "key") -> DataFrame:
    """Keys whose input version is newer than the one the stage last used, or was never used (STR2)."""
    seen = ledger.where(F.col("stage") == stage).groupBy(key).agg(F.max("input_version").alias("_v"))
    j = inputs.select(key, "input_version").join(seen, key, "left")
    return j.where(F.col("_v").isNull() | (F.col("input_version") > F.col("_v"))).select(key, "input_version")


def record_stage(ledger: DataFrame, done: DataFrame, stage: str, key: str = "key") -> DataFrame:
    """Ledger with the processed keys of a stage upserted (STR2)."""
    rows = done.select(F.lit(stage).alias("stage"), key, "input_version")
    return right_merge(ledger.select("stage", key, "input_version"), rows, ["stage", key])


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions present in ``df`` and keep the rest (STR3).  Rows are first spread by the
    partition columns and a hash of the row, so one large partition is written by many tasks."""
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c not in by]), F.lit(16))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartition(n, *by, salt)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a path in its store; errors of the store are errors here too."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def build_archive(spark: SparkSession, incoming: DataFrame, points_path: str, ledger_path: str, domain: DataFrame | None = None) -> int:
    """Ingest one delivery into the point archive (SRC7): only tiles of the domain, only unseen granules.
    Returns the number of granules added.  Points are written before the ledger, so a job that dies in between
    leaves its granules unlisted, and the next run with them replaces what it wrote."""
    on = ["tile_id", "granule_id"]
    if domain is not None:
        incoming = incoming.join(domain.where("glacier_frac > 0").select("tile_id"), "tile_id", "left_semi")
    if _exists(spark, ledger_path):
        ledger = spark.read.parquet(ledger_path).select(*on)
    else:  # first delivery
        ledger = incoming.select(*on).where("false")
    new = unseen_granules(incoming, ledger, on)
    fresh = new.select(*on).distinct()
    n = fresh.count()
    if n:
        # granule partitions make the write idempotent: a second attempt replaces the same folders
        overwrite_partitions(new, points_path, ["mission", "tile_id", "granule_id"])
        fresh.write.mode("append").parquet(ledger_path)
    return n
