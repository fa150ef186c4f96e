"""Polygons by their edges: a grid index for containment, and exact relations and overlap areas.

A zone is one ring (array of x, y) or several (array of rings): parts and holes by crossing parity, so
the order and direction of rings do not matter for containment; for areas, holes run against
their outer ring, as file formats have it.  Rings may repeat their first corner at the end.

No joined row holds a ring.  Edges become rows of the grid cells they touch; the grid of a zone is as
fine as its edges are short, so a cell holds a few.  A cell also knows, from the crossings of the
grid line below it, the parity at its lower right corner, and a point needs only its own cell: the
parity changes with the edges that pass the cell's right side below the point, and with those that
pass between the point and that side.  Cells that no edge touches are marked once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

PER_CELL = 16  # lengths of a mean edge that a cell is wide, at most
FINEST = 24  # halvings of the given cell
PAD = 1e-9  # of a cell: an edge that ends on a cell's side belongs to both cells

EDGE = ("x1", "y1", "x2", "y2")


def _rings(zones: DataFrame, ring: str) -> Column:
    nested = isinstance(zones.schema[ring].dataType.elementType, ArrayType)
    return F.col(ring) if nested else F.array(F.col(ring))


def _pairs(ring: Column) -> Column:
    """Consecutive corners of a ring, the last with the first."""
    n = F.size(ring)
    at = lambda i: F.get(ring, F.pmod(i, n))
    sides = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(at(i)["x"].alias("x1"), at(i)["y"].alias("y1"), at(i + 1)["x"].alias("x2"), at(i + 1)["y"].alias("y2")))
    return F.when(n > 1, sides)


def edges_of(zones: DataFrame, keys: list[str], ring: str = "ring") -> DataFrame:
    """keys, x1, y1, x2, y2: a row for each side of each ring that is not a point."""
    one = zones.select(*keys, F.explode(_rings(zones, ring)).alias("_r"))
    e = one.select(*keys, F.explode(_pairs(F.col("_r"))).alias("_e")).select(*keys, *(F.col(f"_e.{c}").cast("double").alias(c) for c in EDGE))
    return e.where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def _level(zones: DataFrame, ring: str, cell: float) -> Column:
    """Halvings of ``cell`` that make it as wide as PER_CELL mean edges of the zone."""
    def length(r: Column) -> Column:
        return F.aggregate(F.coalesce(_pairs(r), F.array()), F.lit(0.0), lambda s, e: s + F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]))

    rings = _rings(zones, ring)
    around = F.aggregate(rings, F.lit(0.0), lambda s, r: s + length(r))
    count = F.aggregate(rings, F.lit(0), lambda s, r: s + F.size(r))
    wanted = F.ceil(F.log2(F.lit(float(cell)) * count / (around * PER_CELL)))
    return F.when((around > 0) & (count > 0), F.greatest(F.lit(0), F.least(wanted, F.lit(FINEST)))).otherwise(0).cast("int")


def _strips(e: DataFrame) -> DataFrame:
    """Edges (with ``_size``) once for each grid row ``_cy`` they touch, with the cells from ``_from`` to ``_to``."""
    low, high, size = F.least("y1", "y2"), F.greatest("y1", "y2"), F.col("_size")
    e = e.withColumn("_cy", F.explode(F.sequence(F.floor(low / size - PAD), F.floor(high / size + PAD))))
    bottom, top = F.greatest(low, F.least(high, F.col("_cy") * size)), F.least(high, F.greatest(low, (F.col("_cy") + 1) * size))
    x = lambda y: F.when(F.col("y1") == F.col("y2"), F.lit(None)).otherwise(F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)))
    a, b = F.coalesce(x(bottom), F.col("x1")), F.coalesce(x(top), F.col("x2"))
    return e.withColumns({"_from": F.floor(F.least(a, b) / size - PAD), "_to": F.floor(F.greatest(a, b) / size + PAD)})


def zone_cells(zones: DataFrame, cell: float, ring: str = "ring") -> DataFrame:
    """(_zone, _level, _cx, _cy, _size, _parity, _edges): the cells of all zones that hold an edge or lie wholly inside.
    ``_zone`` is a hash of the rings; equal rings are one."""
    shapes = zones.select(F.xxhash64(ring).alias("_zone"), ring).where(F.col(ring).isNotNull()).dropDuplicates(["_zone"])
    e = edges_of(shapes.withColumn("_level", _level(shapes, ring, cell)), ["_zone", "_level"], ring)
    e = e.withColumn("_size", F.lit(float(cell)) / F.pow(F.lit(2.0), F.col("_level")))
    strip = ["_zone", "_level", "_cy"]

    touched = _strips(e).withColumn("_cx", F.explode(F.sequence("_from", "_to")))
    border = touched.groupBy(*strip, "_cx").agg(F.collect_list(F.struct(*EDGE)).alias("_edges"), F.max("_size").alias("_size"))

    # crossings of the grid lines, and the sides of border cells, along each line from the right
    size, y = F.col("_size"), F.col("_cy") * F.col("_size")
    lines = e.withColumn("_cy", F.explode(F.sequence(F.floor(F.least("y1", "y2") / size), F.floor(F.greatest("y1", "y2") / size) + 1)))
    lines = lines.where((F.col("y1") > y) != (F.col("y2") > y))
    cross = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1")
    events = lines.select(*strip, cross.alias("_x"), F.lit(1).alias("_n"), F.lit(None).cast("long").alias("_cx"), F.lit(0).alias("_side"))
    sides = border.select(*strip, F.explode(F.array(F.struct(((F.col("_cx") + 1) * size).alias("_x"), F.lit(1).alias("_side")), F.struct((F.col("_cx") * size).alias("_x"), F.lit(2).alias("_side")))).alias("_s"), "_cx")
    sides = sides.select(*strip, "_s._x", F.lit(0).alias("_n"), "_cx", "_s._side")
    from_right = W.partitionBy(*strip).orderBy(F.col("_x").desc(), "_n").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = events.union(sides).withColumn("_count", F.sum("_n").over(from_right)).where("_side > 0")
    at = lambda s: F.max(F.when(F.col("_side") == s, F.col("_count") % 2)).cast("int")
    parity = counted.groupBy(*strip, "_cx").agg(at(1).alias("_parity"), at(2).alias("_before"))

    cells = border.join(parity, [*strip, "_cx"])
    held = cells.select("_zone", "_level", "_cx", "_cy", "_size", "_parity", "_edges")
    gap = cells.withColumn("_last", F.lag("_cx").over(W.partitionBy(*strip).orderBy("_cx"))).where((F.col("_before") == 1) & (F.col("_cx") - F.col("_last") > 1))
    whole = gap.select("_zone", "_level", F.explode(F.sequence(F.col("_last") + 1, F.col("_cx") - 1)).alias("_cx"), "_cy", "_size", F.lit(1).alias("_parity"), F.slice("_edges", 1, 0).alias("_edges"))
    return held.union(whole)


def _odd(px: Column, py: Column) -> Column:
    """Whether the point is inside, by the cell it lies in.

    Whether an edge passes a corner of the cell, or the cell's side at the point's height, on the right is asked
    in two ways (along the row and along the side); one signed area answers both, so that
    rounding cannot make them disagree."""
    right, below = (F.col("_cx") + 1) * F.col("_size"), F.col("_cy") * F.col("_size")

    def passes(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        beyond = lambda y: (dx * (y - e["y1"]) - (right - e["x1"]) * dy) * F.signum(dy) > 0
        spans = lambda y: (e["y1"] > y) != (e["y2"] > y)
        ray = lambda y: dx * (y - e["y1"]) / dy + e["x1"]
        side = F.when(dy == 0, (e["y1"] > below) & (e["y1"] <= py)).otherwise(beyond(below) != beyond(py)) & ((e["x1"] > right) != (e["x2"] > right))
        hit = F.when(spans(py), (ray(py) > px) & ~beyond(py)).otherwise(False)
        counted = F.when(spans(below), (ray(below) > right) != beyond(below)).otherwise(False)  # in _parity the other way
        return side.cast("int") + hit.cast("int") + counted.cast("int")

    return F.aggregate("_edges", F.col("_parity"), lambda n, e: n + passes(e)) % 2 == 1


def points_in_zones(points: DataFrame, zones: DataFrame, cell: float, x: str = "lon", y: str = "lat", ring: str = "ring", how: str = "inner") -> DataFrame:
    """Point-in-polygon join (JN8, RAS5) on the cells of the zones' edge index; ``how`` is inner, left_semi or
    left_anti.  Points on an edge belong to the zone on their right (above them, for level edges).

    The grids in use (a few numbers) are looked up first; points meet each of them.  A hot cell
    lengthens only the side of the points, which AQE splits."""
    levels = sorted(r[0] for r in zones.where(F.col(ring).isNotNull()).select(_level(zones, ring, cell).alias("_level")).distinct().collect())
    index = zone_cells(zones, cell, ring)

    def met(p: DataFrame, level: int, how: str) -> DataFrame:
        size = float(cell) / 2.0**level
        p = p.withColumns({"_px": F.floor(F.col(x) / size), "_py": F.floor(F.col(y) / size)})
        on = (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy")) & _odd(F.col(x).cast("double"), F.col(y).cast("double"))
        return p.join(index.where(F.col("_level") == level), on, how)

    names = [f"`{c}`" for c in points.columns]
    if how == "left_anti":
        return reduce(lambda p, k: met(p, k, how).select(*names), levels, points)
    if how == "left_semi":
        rest, out = points, points.where("false")
        for k in levels:
            out, rest = out.union(met(rest, k, "left_semi").select(*names)), met(rest, k, "left_anti").select(*names)
        return out
    more = [c for c in zones.columns if c not in points.columns and c != ring]
    hits = reduce(DataFrame.union, [met(points, k, "inner").select(*names, "_zone") for k in levels], points.withColumn("_zone", F.lit(None).cast("long")).where("false"))
    return hits.join(zones.select(*more, F.xxhash64(ring).alias("_zone")), "_zone").select(*names, *more)


# -- relations between polygons ----------------------------------------------------------------


def _box(zones: DataFrame, ring: str) -> Column:
    flat = F.flatten(_rings(zones, ring))
    of = lambda c, f: f(F.transform(flat, lambda p: p[c])).cast("double")
    return F.struct(of("x", F.array_min).alias("min_x"), of("y", F.array_min).alias("min_y"), of("x", F.array_max).alias("max_x"), of("y", F.array_max).alias("max_y"))


def _turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def _segments_meet(p: list[Column], q: list[Column]) -> Column:
    """Closed segments with a common point: each lies on both sides of the other's line, and boxes meet."""
    boxes = F.lit(True)
    for i in (0, 1):
        boxes = boxes & (F.greatest(p[i], p[i + 2]) >= F.least(q[i], q[i + 2])) & (F.greatest(q[i], q[i + 2]) >= F.least(p[i], p[i + 2]))
    return boxes & (_turn(*p, q[0], q[1]) * _turn(*p, q[2], q[3]) <= 0) & (_turn(*q, p[0], p[1]) * _turn(*q, p[2], p[3]) <= 0)


def zones_meeting(a: DataFrame, b: DataFrame, a_key: str, b_key: str, cell: float, a_ring: str = "ring", b_ring: str = "ring") -> DataFrame:
    """Distinct (a_key, b_key) of polygons with a common point (JN9): a pair of their edges meets, on grid
    cells, or a ring of one begins inside the other."""
    def cells(d: DataFrame, key: str, ring: str, end: str) -> DataFrame:
        e = edges_of(d.select(F.col(key).alias(f"_k{end}"), F.col(ring).alias("_ring")), [f"_k{end}"], "_ring").withColumn("_size", F.lit(float(cell)))
        e = _strips(e).withColumn("_cx", F.explode(F.sequence("_from", "_to")))
        return e.select(f"_k{end}", "_cx", "_cy", *(F.col(c).alias(f"{c}{end}") for c in EDGE))

    def starts(d: DataFrame, key: str, ring: str) -> DataFrame:
        first = F.get(F.col("_r"), F.lit(0))
        return d.select(F.col(key).alias("_p"), F.explode(_rings(d, ring)).alias("_r")).where(F.size("_r") > 0).select("_p", first["x"].alias("_x"), first["y"].alias("_y"))

    j = cells(a, a_key, a_ring, "a").join(cells(b, b_key, b_ring, "b"), ["_cx", "_cy"])
    crossing = j.where(_segments_meet([F.col(f"{c}a") for c in EDGE], [F.col(f"{c}b") for c in EDGE])).select("_ka", "_kb")
    in_b = points_in_zones(starts(a, a_key, a_ring), b.select(F.col(b_key).alias("_z"), F.col(b_ring).alias("_ring")), cell, "_x", "_y", "_ring").select(F.col("_p").alias("_ka"), F.col("_z").alias("_kb"))
    in_a = points_in_zones(starts(b, b_key, b_ring), a.select(F.col(a_key).alias("_z"), F.col(a_ring).alias("_ring")), cell, "_x", "_y", "_ring").select(F.col("_z").alias("_ka"), F.col("_p").alias("_kb"))
    out = crossing.union(in_b).union(in_a).distinct()
    return out.select(F.col("_ka").alias(a_key), F.col("_kb").alias(b_key if b_key != a_key else f"{b_key}_2"))


def _shared(p: list[Column], q: list[Column]) -> Column:
    """Signed integral, over the common range of x, of the lower of two edges."""
    left = F.greatest(F.least(p[0], p[2]), F.least(q[0], q[2]))
    right = F.least(F.greatest(p[0], p[2]), F.greatest(q[0], q[2]))
    at = lambda e, x: e[1] + (x - e[0]) * (e[3] - e[1]) / (e[2] - e[0])
    p0, p1, q0, q1 = at(p, left), at(p, right), at(q, left), at(q, right)
    d0, d1 = p0 - q0, p1 - q1
    apart = F.when(d0 * d1 >= 0, F.abs(d0 + d1) / 2).otherwise((d0 * d0 + d1 * d1) / (2 * (F.abs(d0) + F.abs(d1))))
    lower = ((p0 + p1 + q0 + q1) / 2 - apart) / 2
    return F.signum(p[2] - p[0]) * F.signum(q[2] - q[0]) * (right - left) * lower


def overlap_areas(a: DataFrame, b: DataFrame, a_key: str, b_key: str, cell: float, a_ring: str = "ring", b_ring: str = "ring") -> DataFrame:
    """(a_key, b_key, overlap) of polygons whose bodies share an area (JN9, JN13).

    A polygon is the signed sum of the strips below its edges, so the shared area of two is the signed
    sum, over pairs of edges, of the strip below both: no corners of the intersection are looked for.
    Edges meet on columns of the grid, for pairs whose boxes meet."""
    def columns(d: DataFrame, key: str, ring: str, end: str) -> DataFrame:
        e = edges_of(d.select(F.col(key).alias(f"_k{end}"), F.col(ring).alias("_ring")), [f"_k{end}"], "_ring").where(F.col("x1") != F.col("x2"))
        span = F.sequence(F.floor(F.least("x1", "x2") / cell), F.floor(F.greatest("x1", "x2") / cell))
        e = e.withColumn("_cx", F.explode(span))
        # the part of the edge that lies in the column, so that a pair counts each stretch once
        lo, hi = F.col("_cx") * F.lit(float(cell)), (F.col("_cx") + 1) * F.lit(float(cell))
        clip = lambda x: F.greatest(lo, F.least(hi, x))
        y = lambda x: F.when(x == F.col("x1"), F.col("y1")).when(x == F.col("x2"), F.col("y2")).otherwise(F.col("y1") + (x - F.col("x1")) * (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1")))
        u, w = clip(F.col("x1")), clip(F.col("x2"))
        e = e.select(f"_k{end}", "_cx", u.alias(f"x1{end}"), y(u).alias(f"y1{end}"), w.alias(f"x2{end}"), y(w).alias(f"y2{end}"))
        return e.where(F.col(f"x1{end}") != F.col(f"x2{end}"))

    def sign(d: DataFrame, key: str, ring: str, end: str) -> DataFrame:
        e = edges_of(d.select(F.col(key).alias(f"_k{end}"), F.col(ring).alias("_ring")), [f"_k{end}"], "_ring")
        return e.groupBy(f"_k{end}").agg(F.signum(F.sum((F.col("x1") - F.col("x2")) * (F.col("y1") + F.col("y2")))).alias(f"_s{end}"))

    from .spatial import boxes_touching

    boxes = [d.select(F.col(k).alias(n), _box(d, r).alias("bbox")) for d, k, r, n in ((a, a_key, a_ring, "_ka"), (b, b_key, b_ring, "_kb"))]
    pairs = boxes_touching(*boxes, "_ka", "_kb", cell).select("_ka", "_kb")
    j = columns(a, a_key, a_ring, "a").join(pairs, "_ka").join(columns(b, b_key, b_ring, "b"), ["_kb", "_cx"])
    p, q = [F.col(f"{c}a") for c in EDGE], [F.col(f"{c}b") for c in EDGE]
    j = j.where((F.greatest(p[0], p[2]) > F.least(q[0], q[2])) & (F.greatest(q[0], q[2]) > F.least(p[0], p[2])))
    area = j.groupBy("_ka", "_kb").agg(F.sum(_shared(p, q)).alias("_area"), F.sum(F.abs(_shared(p, q))).alias("_whole"))
    area = area.join(sign(a, a_key, a_ring, "a"), "_ka").join(sign(b, b_key, b_ring, "b"), "_kb")
    out = area.where(F.abs("_area") > 1e-12 * F.col("_whole"))  # what cancels to rounding is no area
    return out.select(F.col("_ka").alias(a_key), F.col("_kb").alias(b_key if b_key != a_key else f"{b_key}_2"), (F.col("_area") * F.col("_sa") * F.col("_sb")).alias("overlap"))
