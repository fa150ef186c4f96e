"""Merges, prioritised lookups and set operations on keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def left_merge(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left rows, plus right rows with unseen ids (JN1)."""
    return left.unionByName(right.join(left.select(*on), on, "left_anti"))


def right_merge(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Right rows replace left rows of the same id and add new ones (JN2)."""
    return right.unionByName(left.join(right.select(*on), on, "left_anti"))


def attach(points: DataFrame, side: DataFrame, on: str = "point_id", columns: list[str] | None = None) -> DataFrame:
    """Ancillary columns by point id (JN3, JN4)."""
    cols = columns or [c for c in side.columns if c != on]
    return points.join(side.select(on, *cols), on, "left")


def reference_height(points: DataFrame, layers: list[DataFrame], on: str = "point_id", limit: float = 9998.0) -> DataFrame:
    """Reference height and curvature from several surfaces; the last listed valid one wins, then
    ``dh = height - height_ref`` (JN5).  A layer has columns (on, height, curvature)."""
    out = points
    for i, layer in enumerate(layers):
        ok = F.col("curvature").isNotNull() & ~F.isnan("curvature") & (F.abs("height") < limit)
        out = out.join(
            layer.where(ok).select(on, F.col("height").alias(f"_h{i}"), F.col("curvature").alias(f"_c{i}")), on, "left"
        )
    order = range(len(layers) - 1, -1, -1)
    out = out.withColumn("height_ref", F.coalesce(*[F.col(f"_h{i}") for i in order]))
    out = out.withColumn("curvature", F.coalesce(*[F.col(f"_c{i}") for i in order]))
    out = out.drop(*[f"_{k}{i}" for i in order for k in "hc"])
    return out.withColumn("dh", F.col("height") - F.col("height_ref"))


def union_all(*tables: DataFrame) -> DataFrame:
    """Append tables by column name (SET1)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def difference(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.select(*on).distinct().join(b.select(*on), on, "left_anti")


def intersection(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.select(*on).distinct().join(b.select(*on), on, "left_semi")


def largest_match(df: DataFrame, key: list[str], size: str, tie: str) -> DataFrame:
    """One row per key: the match with the largest size (JN13).  ``max_by`` is map-side combined, so a
    key with very many matches is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(F.col(size), -F.col(tie)))
    return df.groupBy(*key).agg(best.alias("_m")).select(*key, "_m.*")


def nearest_key(left: DataFrame, right: DataFrame, on: list[str], left_key: str, right_key: str, right_cols: list[str]) -> DataFrame:
    """First right key at or after each left key (JN16), by one union and one ordered window; groups
    are series on a bounded axis."""
    probe = left.select(*on, F.col(left_key).alias("_k"), F.lit(1).alias("_p"), F.struct(*left.columns).alias("_l"))
    base = right.select(*on, F.col(right_key).alias("_k"), F.lit(0).alias("_p"), F.struct(right_key, *right_cols).alias("_r"))
    u = probe.unionByName(base, allowMissingColumns=True)
    # descending order: a base row at the same key comes before the probe
    w = W.partitionBy(*on).orderBy(F.col("_k").desc(), F.col("_p")).rowsBetween(W.unboundedPreceding, 0)
    u = u.withColumn("_next", F.last("_r", ignorenulls=True).over(w))
    return u.where("_p = 1").select("_l.*", *[F.col(f"_next.{c}").alias(c if c != right_key else f"next_{right_key}") for c in [right_key, *right_cols]])


def widen(df: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """Long to wide with a declared list of names, so no extra pass finds them (SET4)."""
    return df.groupBy(*keys).pivot(name, names).agg(F.first(value))


def lengthen(df: DataFrame, keys: list[str], columns: list[str], name: str = "var", value: str = "value") -> DataFrame:
    """Wide to long (SET4)."""
    return df.unpivot(keys, columns, name, value)
