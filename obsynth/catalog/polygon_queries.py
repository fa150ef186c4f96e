"""Polygons with holes and parts, large rings, exact relations and overlap areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import fixed
from ..operators import merge, polygons, raster, spatial
from . import views as v
from .registry import query, r, with_


@query("points_in_shapes", with_(v.SITES, v.SHAPE_EDGES, f"hit as ({v.sql_inside('sites', 'site_id', 'shape_edges', 'shape')})") + "select site_id, shape from hit")
def points_in_shapes(spark, d):
    """Rings with holes, islands in them and parts beside."""
    return polygons.points_in_zones(v.sites(spark, d), v.shapes(spark, d), 10.0, ring="rings").select("site_id", "shape")


@query(
    "points_off_shapes",
    with_(v.SITES, v.SHAPE_EDGES, f"hit as ({v.sql_inside('sites', 'site_id', 'shape_edges', 'shape')})") + "select site_id from sites where site_id not in (select site_id from hit)",
)
def points_off_shapes(spark, d):
    return spatial.mask_points(v.sites(spark, d), v.shapes(spark, d), 10.0, invert=True, ring="rings").select("site_id")


@query("points_in_large_rings", with_(v.SITES, v.WAVE_EDGES, f"hit as ({v.sql_inside('sites', 'site_id', 'wave_edges', 'region')})") + "select region, count(*) as n, sum(site_id)::bigint as ids from hit group by region")
def points_in_large_rings(spark, d):
    """A ring of 100,000 corners among smaller ones."""
    hit = polygons.points_in_zones(v.sites(spark, d).select("site_id", "lon", "lat"), v.waves(spark, d), 20.0)
    return hit.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("site_id").alias("ids"))


@query(
    "zonal_shapes",
    with_(v.PIXELS, v.SHAPE_EDGES, f"hit as ({v.sql_inside('pixels', 'row, col, value, cell_area', 'shape_edges', 'shape', 'x', 'y')})",
          "g as (select shape, count(*) as n, max(value) as top, sum(cell_area) as area from hit group by shape)")
    + f"select n_nationkey as shape, n, {r('top', 3)} as top, {r('area', 3)} as area from nation left join g on shape = n_nationkey",
)
def zonal_shapes(spark, d):
    reducers = {"n": F.count(F.lit(1)), "top": F.max("value"), "area": F.sum("cell_area")}
    g = raster.zonal(v.pixels(spark, d), v.shapes(spark, d).withColumnRenamed("rings", "ring"), "shape", 10.0, reducers)
    return g.select("shape", "n", fixed("top", 3).alias("top"), fixed("area", 3).alias("area"))


def _side(p: str, q: str, at: str) -> str:
    return f"sign(({p}.x2 - {p}.x1) * ({q}.y{at} - {p}.y1) - ({p}.y2 - {p}.y1) * ({q}.x{at} - {p}.x1))"


# pairs with sides that cross or touch, or a first corner inside the other
MEETING = [
    v.TILES, v.SHAPE_EDGES, v.ARROW_EDGES,
    "crossed as (select distinct p.arrow, q.shape from arrow_edges p join shape_edges q on greatest(p.x1, p.x2) >= least(q.x1, q.x2) and greatest(q.x1, q.x2) >= least(p.x1, p.x2) "
    f"and greatest(p.y1, p.y2) >= least(q.y1, q.y2) and greatest(q.y1, q.y2) >= least(p.y1, p.y2) and {_side('p', 'q', '1')} * {_side('p', 'q', '2')} <= 0 and {_side('q', 'p', '1')} * {_side('q', 'p', '2')} <= 0)",
    f"tips as (select tile_id as arrow, lon as x, lat as y from tiles where tile_id % 2 = 0), tip_in as ({v.sql_inside('tips', 'arrow', 'shape_edges', 'shape', 'x', 'y')})",
    "corners as (select shape, part, arg_min(x1, i) as x, arg_min(y1, i) as y from (select shape, part, x1, y1, row_number() over () as i from shape_edges) group by all), "
    "inner_edges as (select arrow, x1, y1, x2, y2 from arrow_edges), "
    f"corner_in as (select distinct shape, arrow from ({v.sql_inside('corners', 'shape, part', 'inner_edges', 'arrow', 'x', 'y')}))",
    "meeting as (select arrow, shape from crossed union select arrow, shape from tip_in union select arrow, shape from corner_in)",
]


@query("polygons_meeting", with_(*MEETING) + "select arrow, shape from meeting")
def polygons_meeting(spark, d):
    """Non-convex bodies: many boxes meet whose bodies do not."""
    return polygons.zones_meeting(v.arrows(spark, d), v.shapes(spark, d), "arrow", "shape", 10.0, "ring", "rings")


@query("tiles_touching_shapes", with_(v.TILES, v.SHAPE_EDGES, "sides(a, b, c, e) as (values (0, 0, 4, 0), (4, 0, 4, 4), (4, 4, 0, 4), (0, 4, 0, 0))",
    "box_edges as (select tile_id, lon + a as x1, lat + b as y1, lon + c as x2, lat + e as y2 from tiles cross join sides)",
    "crossed as (select distinct p.tile_id from box_edges p join shape_edges q on greatest(p.x1, p.x2) >= least(q.x1, q.x2) and greatest(q.x1, q.x2) >= least(p.x1, p.x2) "
    f"and greatest(p.y1, p.y2) >= least(q.y1, q.y2) and greatest(q.y1, q.y2) >= least(p.y1, p.y2) and {_side('p', 'q', '1')} * {_side('p', 'q', '2')} <= 0 and {_side('q', 'p', '1')} * {_side('q', 'p', '2')} <= 0)",
    f"corner_in as ({v.sql_inside('tiles', 'tile_id', 'shape_edges', 'shape')})",
    "around as (select distinct tile_id from tiles join shape_edges on x1 between lon and lon + 4 and y1 between lat and lat + 4)")
    + "select tile_id from crossed union select tile_id from corner_in union select tile_id from around")
def tiles_touching_shapes(spark, d):
    t = v.tiles(spark, d).select("tile_id", F.struct(F.col("lon").alias("min_x"), F.col("lat").alias("min_y"), (F.col("lon") + 4).alias("max_x"), (F.col("lat") + 4).alias("max_y")).alias("bbox"))
    return spatial.tiles_touching_zones(t, v.shapes(spark, d), "tile_id", "shape", 10.0, "rings").select("tile_id")


# areas slab by slab: between neighbouring corners and crossings both cross-sections are linear, so their
# common length in the middle times the width is exact
SLABS = [
    v.TILES, v.SHAPE_EDGES, v.ARROW_EDGES,
    "ab as (select arrow, min(x1) as l, max(x1) as h, min(y1) as b, max(y1) as t from arrow_edges group by arrow), sb as (select shape, min(x1) as l, max(x1) as h, min(y1) as b, max(y1) as t from shape_edges group by shape)",
    "near as (select arrow, shape, greatest(ab.l, sb.l) as lo, least(ab.h, sb.h) as hi from ab join sb on ab.l < sb.h and sb.l < ab.h and ab.b < sb.t and sb.b < ab.t)",
    "cross_x as (select n.arrow, n.shape, p.x1 + (p.x2 - p.x1) * ((q.x1 - p.x1) * (q.y2 - q.y1) - (q.y1 - p.y1) * (q.x2 - q.x1)) / ((p.x2 - p.x1) * (q.y2 - q.y1) - (p.y2 - p.y1) * (q.x2 - q.x1)) as x "
    "from near n join arrow_edges p on p.arrow = n.arrow join shape_edges q on q.shape = n.shape where (p.x2 - p.x1) * (q.y2 - q.y1) - (p.y2 - p.y1) * (q.x2 - q.x1) <> 0)",
    "breaks as (select arrow, shape, lo as x from near union select arrow, shape, hi from near union select n.arrow, shape, x1 from near n join arrow_edges using (arrow) "
    "union select arrow, n.shape, x1 from near n join shape_edges using (shape) union select arrow, shape, x from cross_x)",
    "slabs as (select b.arrow, b.shape, x as u, lead(x) over (partition by b.arrow, b.shape order by x) as w from breaks b join near n on n.arrow = b.arrow and n.shape = b.shape where x between lo and hi)",
    "mids as (select arrow, shape, u, w, (u + w) / 2 as m from slabs where w > u)",
    "cut_a as (select arrow, shape, u, y, row_number() over (partition by arrow, shape, u order by y) as k from (select s.arrow, shape, u, y1 + (m - x1) * (y2 - y1) / (x2 - x1) as y from mids s join arrow_edges e on e.arrow = s.arrow where (x1 > m) <> (x2 > m)))",
    "cut_b as (select arrow, shape, u, y, row_number() over (partition by arrow, shape, u order by y) as k from (select arrow, s.shape, u, y1 + (m - x1) * (y2 - y1) / (x2 - x1) as y from mids s join shape_edges e on e.shape = s.shape where (x1 > m) <> (x2 > m)))",
    "in_a as (select p.arrow, p.shape, p.u, p.y as b, q.y as t from cut_a p join cut_a q on p.arrow = q.arrow and p.shape = q.shape and p.u = q.u and q.k = p.k + 1 where p.k % 2 = 1)",
    "in_b as (select p.arrow, p.shape, p.u, p.y as b, q.y as t from cut_b p join cut_b q on p.arrow = q.arrow and p.shape = q.shape and p.u = q.u and q.k = p.k + 1 where p.k % 2 = 1)",
    "common as (select arrow, shape, sum(greatest(0.0, least(a.t, b.t) - greatest(a.b, b.b)) * (w - u)) as overlap from in_a a join in_b b using (arrow, shape, u) join mids using (arrow, shape, u) group by all having overlap > 1e-9)",
]


@query("polygon_overlap_area", with_(*SLABS) + f"select arrow, shape, {r('overlap', 4)} as overlap from common")
def polygon_overlap_area(spark, d):
    o = polygons.overlap_areas(v.arrows(spark, d), v.shapes(spark, d), "arrow", "shape", 10.0, "ring", "rings")
    return o.where("overlap > 1e-9").select("arrow", "shape", fixed("overlap", 4).alias("overlap"))


@query(
    "largest_polygon_overlap",
    with_(*SLABS, "k as (select *, row_number() over (partition by arrow order by overlap desc, shape) as rn from common)") + f"select arrow, shape, {r('overlap', 4)} as overlap from k where rn = 1",
)
def largest_polygon_overlap(spark, d):
    o = polygons.overlap_areas(v.arrows(spark, d), v.shapes(spark, d), "arrow", "shape", 10.0, "ring", "rings").where("overlap > 1e-9")
    return merge.largest_match(o, ["arrow"], "overlap", "shape").select("arrow", "shape", fixed("overlap", 4).alias("overlap"))
