"""Rasters as long pixel tables (row, col, value): sampling, stencils, zonal statistics, line integrals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import bin_center, bin_index, gaussian_weights
from .spatial import points_in_zones

Offsets = list[tuple[int, int, float]]  # (row offset, col offset, weight)


def stencil(pixels: DataFrame, kernels: dict[str, Offsets], value: str = "value", keys: list[str] = []) -> DataFrame:
    """Weighted sums over neighbouring cells for several kernels at once; NULL where a neighbour is missing.

    Every pixel sends its weighted value to the cells it touches and the sums are combined before the
    shuffle; no self-join."""
    cells = sorted({(r, c) for k in kernels.values() for r, c, _ in k})
    names = list(kernels)
    weights = {n: {(r, c): w for r, c, w in kernels[n]} for n in names}
    targets = F.array(*[
        F.struct(
            (F.col("row") - r).alias("row"), (F.col("col") - c).alias("col"),
            *[F.lit(weights[n].get((r, c))).cast("double").alias(f"w_{n}") for n in names],
        )
        for r, c in cells
    ])
    d = pixels.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), F.explode(targets).alias("_t"))
    aggs = []
    for n in names:
        w = F.col(f"_t.w_{n}")
        aggs += [F.sum(w * F.col("_v")).alias(f"_s_{n}"), F.count(w).alias(f"_n_{n}")]
    g = d.groupBy(*keys, F.col("_t.row").alias("row"), F.col("_t.col").alias("col")).agg(*aggs)
    out = [F.when(F.col(f"_n_{n}") == len(kernels[n]), F.col(f"_s_{n}")).alias(n) for n in names]
    g = g.select(*keys, "row", "col", *out)
    return g.join(pixels.select(*keys, "row", "col"), [*keys, "row", "col"], "left_semi")


def derivative_kernels(dx: float, dy: float) -> dict[str, Offsets]:
    """Horn slopes and half second differences of a 3x3 window; x along columns, y along rows (FN8)."""
    sm = {-1: 1.0, 0: 2.0, 1: 1.0}
    return {
        "dhdx": [(r, c, c * sm[r] / (8 * dx)) for r in (-1, 0, 1) for c in (-1, 1)],
        "dhdy": [(r, c, r * sm[c] / (8 * dy)) for r in (-1, 1) for c in (-1, 0, 1)],
        "dhddx": [(0, -1, 0.5 / dx**2), (0, 0, -1.0 / dx**2), (0, 1, 0.5 / dx**2)],
        "dhddy": [(-1, 0, 0.5 / dy**2), (0, 0, -1.0 / dy**2), (1, 0, 0.5 / dy**2)],
    }


def smoothing_kernel(kind: str, half: int = 1, sigma: float = 1.0) -> Offsets:
    """Gaussian or average footprint weights (FN9, RAS3)."""
    n = 2 * half + 1
    one = gaussian_weights(sigma, n) if kind == "gaussian" else [1.0 / n] * n
    return [(r, c, one[r + half] * one[c + half]) for r in range(-half, half + 1) for c in range(-half, half + 1)]


def corner_table(pixels: DataFrame, values: list[str], keys: list[str] = []) -> DataFrame:
    """Per cell the values of the cell and its right, upper and diagonal neighbours (v00, v01, v10, v11),
    so that a bilinear sample is one equi-join and the points are not multiplied."""
    shifts = [(0, 0), (0, 1), (1, 0), (1, 1)]
    targets = F.array(*[F.struct((F.col("row") - r).alias("row"), (F.col("col") - c).alias("col"), F.lit(i).alias("k")) for i, (r, c) in enumerate(shifts)])
    d = pixels.select(*keys, *values, F.explode(targets).alias("_t"))
    aggs = [F.max(F.when(F.col("_t.k") == i, F.col(v))).alias(f"{v}_{r}{c}") for v in values for i, (r, c) in enumerate(shifts)]
    return d.groupBy(*keys, F.col("_t.row").alias("row"), F.col("_t.col").alias("col")).agg(*aggs)


def sample(
    points: DataFrame, pixels: DataFrame, values: list[str], grid: tuple[float, float, float, float],
    method: str = "nearest", x: str = "x", y: str = "y", keys: list[str] = [],
) -> DataFrame:
    """Raster values at points (RAS1, RAS2, JN14).  ``grid`` is (x0, y0, dx, dy): the outer corner of cell
    (0, 0) and the cell size.  Bilinear needs all four corners; a corner of zero weight may be missing."""
    x0, y0, dx, dy = grid
    fx, fy = (F.col(x) - x0) / dx, (F.col(y) - y0) / dy
    if method == "nearest":
        p = points.withColumn("col", F.floor(fx).cast("long")).withColumn("row", F.floor(fy).cast("long"))
        return p.join(pixels.select(*keys, "row", "col", *values), [*keys, "row", "col"], "left").drop("row", "col")
    if method != "bilinear":
        raise ValueError("method must be 'nearest' or 'bilinear'")
    cx, cy = fx - 0.5, fy - 0.5
    p = points.withColumn("col", F.floor(cx).cast("long")).withColumn("row", F.floor(cy).cast("long"))
    p = p.withColumn("_fx", cx - F.col("col")).withColumn("_fy", cy - F.col("row"))
    j = p.join(corner_table(pixels, values, keys), [*keys, "row", "col"], "left")
    u, v = F.col("_fx"), F.col("_fy")

    def term(w: Column, c: Column) -> Column:
        return F.when(w == 0, F.lit(0.0)).otherwise(w * c)

    made = {
        n: term((1 - u) * (1 - v), F.col(f"{n}_00")) + term(u * (1 - v), F.col(f"{n}_01"))
        + term((1 - u) * v, F.col(f"{n}_10")) + term(u * v, F.col(f"{n}_11"))
        for n in values
    }
    return j.withColumns(made).select(*points.columns, *values)


def dem_at_points(points: DataFrame, pixels: DataFrame, grid, smooth: Offsets | None = None, offsets: DataFrame | None = None, offset_grid=None, method: str = "bilinear", x: str = "x", y: str = "y") -> DataFrame:
    """Footprint-smoothed height with slope and second-derivative bands at points; an optional datum raster
    is added to the height only (RAS3)."""
    kernels = derivative_kernels(grid[2], grid[3])
    kernels["height"] = smooth or [(0, 0, 1.0)]
    bands = stencil(pixels, kernels)
    out = sample(points, bands, ["height", "dhdx", "dhdy", "dhddx", "dhddy"], grid, method, x, y)
    if offsets is not None:
        out = sample(out, offsets.withColumnRenamed("value", "_datum"), ["_datum"], offset_grid or grid, "bilinear", x, y)
        out = out.withColumn("height", F.col("height") + F.coalesce("_datum", F.lit(0.0))).drop("_datum")
    return out


def flags_at_points(points: DataFrame, layers: DataFrame, grid, names: list[str], x: str = "x", y: str = "y", zone: list[str] = []) -> DataFrame:
    """Several boolean layers per point, false off the grid (RAS4).  ``layers`` is long: (zone, row, col, layer, value)."""
    wide = layers.groupBy(*zone, "row", "col").pivot("layer", names).agg(F.max(F.col("value") == 1))
    out = sample(points, wide, names, grid, "nearest", x, y, keys=zone)
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(False)) for n in names})


def zonal(pixels: DataFrame, zones: DataFrame, zone: str, cell: float, reducers: dict[str, Column], operator: Callable[[DataFrame], DataFrame] | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """Map then reduce over the pixels of each polygon; zones without pixels keep NULLs (AGG9, AGG10)."""
    hit = points_in_zones(pixels, zones, cell, x, y)
    if operator is not None:
        hit = operator(hit)
    g = hit.groupBy(zone).agg(*[c.alias(n) for n, c in reducers.items()])
    return zones.select(zone).join(g, zone, "left")


def lowest_pixel(pixels: DataFrame, zones: DataFrame, zone: str, cell: float, value: str = "value", x: str = "x", y: str = "y") -> DataFrame:
    """Position and value of the lowest pixel of each polygon, first in (row, col) order on ties (AGG10)."""
    pick = F.min_by(F.struct(F.col(x).alias("min_x"), F.col(y).alias("min_y"), F.col(value).alias("min_value")), F.struct(value, "row", "col"))
    return zonal(pixels, zones, zone, cell, {"_m": pick}, x=x, y=y).select(zone, "_m.*")


def zonal_area_profile(pixels: DataFrame, zones: DataFrame, keys: list[str], cell: float, lo: float, width: float, n: int, value: str = "value", area: str = "cell_area", closed: str = "right", x: str = "x", y: str = "y", extra: list[str] = []) -> DataFrame:
    """Area per elevation bin of each polygon, out-of-range dropped (AGG6, AGG7); (lo, hi] bins by default.
    ``extra`` are pixel columns such as the tile."""
    hit = points_in_zones(pixels, zones, cell, x, y).withColumn("bin", bin_index(value, lo, width, closed))
    hit = hit.where(F.col("bin").between(0, n - 1))
    g = hit.groupBy(*keys, *extra, "bin").agg(F.sum(area).alias("area"))
    return g.withColumn("height_bin", bin_center("bin", lo, width))


def dense_profile(profile: DataFrame, keys: list[str], n: int, area: str = "area") -> DataFrame:
    """Zeros for empty bins (AGG8)."""
    grid = profile.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return grid.join(profile.select(*keys, "bin", area), [*keys, "bin"], "left").fillna(0.0, subset=[area])


def month_of_maximum(series: DataFrame, keys: list[str], month: str = "month", value: str = "value") -> DataFrame:
    """Month with the largest value per pixel, first on ties (RAS7)."""
    return series.groupBy(*keys).agg(F.min_by(month, F.struct(-F.col(value), F.col(month))).alias("max_month"))


def gate_flux(zones: DataFrame, fields: DataFrame, zone: str, grid, ring: str = "ring") -> DataFrame:
    """Closed line integral of thickness times velocity around each polygon, / 1e9 (RAS8).  ``fields`` is a
    pixel table with vx, vy, thickness sampled at the nearest cell of each edge's first vertex."""
    from pyspark.sql import Window as W

    v = zones.select(zone, F.posexplode(ring).alias("i", "p")).select(zone, "i", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    w = W.partitionBy(zone).orderBy("i")  # the vertices of one polygon
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    v = v.withColumn("_dx", F.coalesce(F.lead("x").over(w), F.first("x").over(whole)) - F.col("x"))
    v = v.withColumn("_dy", F.coalesce(F.lead("y").over(w), F.first("y").over(whole)) - F.col("y"))
    s = sample(v, fields, ["vx", "vy", "thickness"], grid, "nearest")
    term = (F.col("vx") * F.col("_dy") - F.col("vy") * F.col("_dx")) * F.col("thickness")
    return s.groupBy(zone).agg((F.sum(term) / 1e9).alias("flux"))


def clean_velocity(df: DataFrame, v: str = "v", terminus: str | None = None, limit: float = 20000.0) -> DataFrame:
    """Velocities beyond the limit and off the terminus become zero (RAS9)."""
    bad = F.abs(F.col(v)) > limit
    if terminus:
        bad = bad | ~F.coalesce(F.col(terminus), F.lit(False))
    return df.withColumn(v, F.when(bad, F.lit(0.0)).otherwise(F.col(v)))


def lowest_fraction(df: DataFrame, keys: list[str], value: str, p: float = 0.02) -> DataFrame:
    """Rows at or below the p quantile of their group (WIN18)."""
    from .robust import group_quantiles

    q = group_quantiles(df, keys, value, {"_q": p})
    return df.join(q, keys).where(F.col(value) <= F.col("_q")).drop("_q")


def ring_profile(
    points: DataFrame, tiles: DataFrame, hyps: DataFrame, values: list[str], scale: list[str], step_m: float,
    max_rings: int, height_width: float, cell: float, min_coverage: float = 0.75, x: str = "lon", y: str = "lat",
) -> DataFrame:
    """Mean model values per (tile, elevation bin, scale) from all points in the tile's box, which grows
    by ``step_m`` on every side until the bins with points cover ``min_coverage`` of the tile's area
    (AGG20): tile_id, height_index, scale, ring, coverage, covered, values.

    A tile whose bins do not reach the coverage within ``max_rings`` comes with all it has found and
    ``covered`` false; one without any point in reach has a row with null bin and values; a tile
    without area has zeros in all its bins.  Rings are searched in doubling reach, each time for the
    tiles that still want coverage; sums per ring are combined before the shuffle."""
    from pyspark.sql import Window as W

    from ..functions.geo import degrees_lat, degrees_lon
    from ..session import cut_lineage
    from .spatial import cover_cells

    h = hyps.select("tile_id", "height_index", F.col("area_km2").alias("_area"))
    whole = h.groupBy("tile_id").agg(F.sum("_area").alias("_whole"))
    mid = (F.col("min_y") + F.col("max_y")) / 2
    t = tiles.select("tile_id", "min_x", "max_x", "min_y", "max_y").withColumn("_kx", degrees_lon(1.0, mid)).withColumn("_ky", degrees_lat(1.0))
    t = cut_lineage(t.join(whole, "tile_id", "left").withColumn("_whole", F.coalesce("_whole", F.lit(0.0))))
    p = points.select(F.col(x).alias("_x"), F.col(y).alias("_y"), bin_index("height", 0.0, height_width).alias("height_index"), *scale, *values)
    p = cut_lineage(p.withColumn("_cx", F.floor(F.col("_x") / cell)).withColumn("_cy", F.floor(F.col("_y") / cell)))

    def sums_within(want: DataFrame, rings: int) -> DataFrame:
        """Sums per (tile, bin, ring, scale) of the points at most ``rings`` rings away."""
        grow = F.lit(step_m * rings)
        box = F.struct(
            (F.col("min_x") - grow * F.col("_kx")).alias("min_x"), (F.col("min_y") - grow * F.col("_ky")).alias("min_y"),
            (F.col("max_x") + grow * F.col("_kx")).alias("max_x"), (F.col("max_y") + grow * F.col("_ky")).alias("max_y"),
        )
        j = p.join(cover_cells(want, box, cell).drop("_bb"), ["_cx", "_cy"])
        out_x = F.greatest(F.col("min_x") - F.col("_x"), F.col("_x") - F.col("max_x"), F.lit(0.0)) / F.col("_kx")
        out_y = F.greatest(F.col("min_y") - F.col("_y"), F.col("_y") - F.col("max_y"), F.lit(0.0)) / F.col("_ky")
        j = j.withColumn("_ring", F.ceil(F.greatest(out_x, out_y) / step_m).cast("int")).where(F.col("_ring") <= rings)
        return j.groupBy("tile_id", "height_index", "_ring", *scale).agg(*[F.sum(v).alias(v) for v in values], *[F.count(v).alias(f"_n_{v}") for v in values])

    want, rings, parts = t.where("_whole > 0"), 1, []
    while True:
        g = cut_lineage(sums_within(want, rings))
        first = g.groupBy("tile_id", "height_index").agg(F.min("_ring").alias("_ring")).join(h, ["tile_id", "height_index"])
        by_ring = first.groupBy("tile_id", "_ring").agg(F.sum("_area").alias("_a"))
        w = W.partitionBy("tile_id").orderBy("_ring").rowsBetween(W.unboundedPreceding, 0)  # at most ``rings`` + 1 rows
        reached = by_ring.join(want.select("tile_id", "_whole"), "tile_id").withColumn("coverage", F.sum("_a").over(w) / F.col("_whole"))
        stop = reached.where(F.col("coverage") >= min_coverage).groupBy("tile_id").agg(F.min(F.struct("_ring", "coverage")).alias("_s"))
        stop = cut_lineage(stop.select("tile_id", F.col("_s._ring").alias("ring"), F.col("_s.coverage").alias("coverage"), F.lit(True).alias("covered")))
        last = rings >= max_rings
        rest = cut_lineage(want.join(stop, "tile_id", "left_anti"))
        if last:
            most = reached.groupBy("tile_id").agg(F.max("coverage").alias("coverage"))
            left = rest.join(most, "tile_id", "left").select("tile_id", F.lit(max_rings).alias("ring"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.lit(False).alias("covered"))
            stop = stop.unionByName(left)
        inside = stop.join(g, "tile_id", "left").where("_ring is null or _ring <= ring")
        parts.append(inside.groupBy("tile_id", "height_index", *scale, "ring", "coverage", "covered").agg(*[(F.sum(v) / F.sum(f"_n_{v}")).alias(v) for v in values]))
        if last or rest.isEmpty():
            break
        want, rings = rest, min(2 * rings, max_rings)

    empty = t.where("_whole = 0").select("tile_id").join(h.select("tile_id", "height_index"), "tile_id")
    for s in scale:
        empty = empty.join(p.select(s).distinct())  # the few steps of a scale axis
    zeros = empty.select("tile_id", "height_index", *scale, F.lit(0).alias("ring"), F.lit(0.0).alias("coverage"), F.lit(True).alias("covered"), *[F.lit(0.0).alias(v) for v in values])
    for part in parts:
        zeros = zeros.unionByName(part)
    return zeros
