"""Tile assignment, zones, nearest sites, rasters and exposure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions.numeric import fixed, gaussian_weights
from ..operators import raster, spatial
from . import views as v
from .registry import query, r, sql_haversine, with_


@query(
    "tile_assign",
    with_(v.SITES)
    + """select site_id, printf('lat[%+03d%+03d]lon[%+04d%+04d]', y0, y0 + 2, x0, x0 + 2) as tile_id, x0::double as min_x, (y0 + 2)::double as max_y
    from (select site_id, cast(floor(lon / 2) * 2 as int) as x0, cast(floor(lat / 2) * 2 as int) as y0 from sites)""",
)
def tile_assign(spark, d):
    s = v.sites(spark, d).select("site_id", geo.tile_id("lon", "lat").alias("tile_id"))
    e = geo.tile_extent("tile_id")
    return s.select("site_id", "tile_id", e["min_x"].alias("min_x"), e["max_y"].alias("max_y"))


@query(
    "projection_zone",
    with_(
        v.SITES,
        "strips as (select zone, 6.0 * zone - 186 as west, 6.0 * zone - 180 as east from range(1, 61) t(zone))",
        # cells of the grid that belong to another strip; the last band ends at 84 degrees, included
        "special(south, north, west, east, zone) as (values (56, 64, 3, 12, 32), (72, 84.5, 0, 9, 31), (72, 84.5, 9, 21, 33), (72, 84.5, 21, 33, 35), (72, 84.5, 33, 42, 37))",
        "placed as (select site_id, lat, strips.zone as strip, coalesce(special.zone, strips.zone) as zone from sites join strips on lon >= strips.west and lon < strips.east "
        "left join special on lat >= south and lat < north and lat <= 84 and lon >= special.west and lon < special.east)",
    )
    + """select site_id, printf('EPSG:%d', case when lat > 84 then 3413 when lat < -80 then 3031 when lat < 0 then 32700 + zone else 32600 + zone end) as epsg,
    cast(case when lat between -56 and 55 then strip else 0 end as int) as zone, lat >= 0 as is_north from placed""",
)
def projection_zone(spark, d):
    z = geo.polar_zone("lon", "lat")
    return v.sites(spark, d).select("site_id", geo.utm_epsg("lon", "lat").alias("epsg"), z["zone"].alias("zone"), z["is_north"].alias("is_north"))


@query(
    "points_to_tiles_sum",
    with_(v.TILES, v.SITES, "tg as (select distinct cast(floor(lon / 30) as int) as tile_x, cast(floor(lat / 30) as int) as tile_y from tiles)",
          "p as (select cast(floor(lon / 30) as int) as tile_x, cast(floor(lat / 30) as int) as tile_y, sum(value) as v, sum(1.0::double) as c from sites group by all)")
    + f"select tile_x, tile_y, {r('coalesce(v, 0.0) * (1000.0 / 910.0)', 4)} as value, coalesce(c * (1000.0 / 910.0), 0.0) as c from tg left join p using (tile_x, tile_y)".replace(" as c from tg", " as cnt from tg"),
)
def points_to_tiles_sum(spark, d):
    t = spatial.tile_of(v.tiles(spark, d), 30).select("tile_x", "tile_y").distinct()
    o = spatial.sum_points_in_tiles(v.sites(spark, d).withColumn("cnt", F.lit(1.0)), t, ["value", "cnt"], 30, mass_to_volume=True)
    return o.select("tile_x", "tile_y", fixed("value", 4).alias("value"), "cnt")


@query("point_in_polygon", with_(v.SITES, v.ZONE_EDGES, f"hit as ({v.sql_in_zone('sites', 'site_id')})") + "select site_id, zone from hit")
def point_in_polygon(spark, d):
    return spatial.points_in_zones(v.sites(spark, d).select("site_id", "lon", "lat"), v.zones(spark, d), 10.0).select("site_id", "zone")


@query(
    "first_and_last_zone",
    with_(v.SITES, v.ZONE_EDGES, f"hit as ({v.sql_in_zone('sites', 'site_id')})")
    + "select s.site_id, min(zone) as zone, max(zone) as last_zone from sites s left join hit h on s.site_id = h.site_id group by s.site_id",
)
def first_and_last_zone(spark, d):
    s, z = v.sites(spark, d).select("site_id", "lon", "lat"), v.zones(spark, d)
    a = spatial.first_zone(s, z, "site_id", "zone", "zone", 10.0)
    b = spatial.first_zone(s, z, "site_id", "zone", "zone", 10.0, last=True).select("site_id", F.col("zone").alias("last_zone"))
    return a.join(b, "site_id").select("site_id", "zone", "last_zone")


@query(
    "mask_points",
    with_(v.SITES, v.ZONE_EDGES, f"hit as ({v.sql_in_zone('sites', 'site_id, n_regionkey')})")
    + "select site_id, 'in' as kind from hit where n_regionkey < 3 and site_id not in (select site_id from hit where n_regionkey >= 3) group by site_id union all select site_id, 'out' from sites where site_id not in (select site_id from hit where n_regionkey < 3)",
)
def mask_points(spark, d):
    s, z = v.sites(spark, d).select("site_id", "lon", "lat"), v.zones(spark, d)
    a = spatial.mask_points(s, z.where("n_regionkey < 3"), 10.0, exclude=z.where("n_regionkey >= 3"))
    b = spatial.mask_points(s, z.where("n_regionkey < 3"), 10.0, invert=True)
    return a.select("site_id", F.lit("in").alias("kind")).unionByName(b.select("site_id", F.lit("out").alias("kind")))


DIST = sql_haversine("s.lon", "s.lat", "t.lon", "t.lat")


@query(
    "nearest_site",
    with_(v.SITES, v.TILES, f"dd as (select site_id, tile_id, {DIST} as m from sites s cross join tiles t)",
          "k as (select *, row_number() over (partition by site_id order by m, tile_id) as rn from dd)")
    + f"select site_id, tile_id, {r('m', 3)} as meters from k where rn = 1",
)
def nearest_site(spark, d):
    n = spatial.nearest(v.sites(spark, d), v.tiles(spark, d), 1, "site_id", "tile_id")
    return n.select("site_id", "tile_id", fixed("meters", 3).alias("meters"))


@query(
    "nearest_five_tiles",
    with_(v.TILES, f"dd as (select s.tile_id, t.tile_id as tile_id_2, {DIST} as m from tiles s cross join tiles t where s.tile_id != t.tile_id)",
          "k as (select *, row_number() over (partition by tile_id order by m, tile_id_2) as rank from dd)")
    + f"select tile_id, tile_id_2, {r('m', 3)} as meters, cast(rank as int) as rank from k where rank <= 5",
)
def nearest_five_tiles(spark, d):
    t = v.tiles(spark, d)
    n = spatial.nearest(t, t, 5, "tile_id", "tile_id", exclude_self=True)
    return n.select("tile_id", "tile_id_2", fixed("meters", 3).alias("meters"), "rank")


@query(
    "nearest_line_distance",
    with_(v.SITES, "lines as (select n_nationkey as line, (n_nationkey * 67 % 320) - 160.0::double as x, (n_nationkey * 31 % 140) - 70.0::double as y from nation)",
          "vx as (select line, x + k * 2.5::double as x, y + k * 1.5::double as y from lines cross join (values (0), (1), (2), (3)) q(k))",
          f"dd as (select s.site_id, t.line, min({sql_haversine('s.lon', 's.lat', 't.x', 't.y')}) as m from sites s join vx t on t.line = s.nation group by all)")
    + f"select site_id, line, {r('m', 3)} as meters from dd",
)
def nearest_line_distance(spark, d):
    n = v.table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"))
    x, y = (F.col("nation") * 67 % 320) - 160.0, (F.col("nation") * 31 % 140) - 70.0
    lines = n.select("nation", F.array(*[F.struct((x + k * 2.5).alias("x"), (y + k * 1.5).alias("y")) for k in range(4)]).alias("line_geom"))
    j = v.sites(spark, d).join(lines, "nation")
    return j.select("site_id", F.col("nation").alias("line"), fixed(geo.haversine_to_line("lon", "lat", "line_geom"), 3).alias("meters"))


BOX_A = "ba as (select tile_id as a, lon - 4 as x0, lat - 3 as y0, lon + 4 as x1, lat + 3 as y1 from tiles)"
BOX_B = "bb as (select c_custkey as b, (c_custkey * 53 % 36000) / 100.0::double - 180.0::double as x0, (c_custkey * 29 % 17000) / 100.0::double - 85.0::double as y0, abs(c_acctbal) / 1500 as w from customer)"
OVER = "ov as (select a, b, (least(x1, q.x0 + w) - greatest(p.x0, q.x0)) * (least(y1, q.y0 + w) - greatest(p.y0, q.y0)) as overlap from ba p join bb q on p.x1 >= q.x0 and p.x0 <= q.x0 + w and p.y1 >= q.y0 and p.y0 <= q.y0 + w)"


def _boxes(spark, d):
    t = v.tiles(spark, d)
    a = t.select(F.col("tile_id").alias("a"), F.struct((F.col("lon") - 4).alias("min_x"), (F.col("lat") - 3).alias("min_y"), (F.col("lon") + 4).alias("max_x"), (F.col("lat") + 3).alias("max_y")).alias("bbox"))
    c = v.table(spark, d, "customer").select(F.col("c_custkey").alias("b"), ((F.col("c_custkey") * 53 % 36000) / 100.0 - 180.0).alias("x"), ((F.col("c_custkey") * 29 % 17000) / 100.0 - 85.0).alias("y"), (F.abs("c_acctbal") / 1500).alias("w"))
    b = c.select("b", F.struct(F.col("x").alias("min_x"), F.col("y").alias("min_y"), (F.col("x") + F.col("w")).alias("max_x"), (F.col("y") + F.col("w")).alias("max_y")).alias("bbox"))
    return a, b


@query("boxes_touching", with_(v.TILES, BOX_A, BOX_B, OVER) + f"select a, b, {r('overlap')} as overlap from ov")
def boxes_touching(spark, d):
    a, b = _boxes(spark, d)
    return spatial.boxes_touching(a, b, "a", "b", 10.0).select("a", "b", fixed("overlap").alias("overlap"))


@query(
    "largest_overlap",
    with_(v.TILES, BOX_A, BOX_B, OVER, "k as (select *, row_number() over (partition by b order by overlap desc, a) as rn from ov)") + f"select b, a, {r('overlap')} as overlap from k where rn = 1",
)
def largest_overlap(spark, d):
    a, b = _boxes(spark, d)
    m = spatial.largest_box_overlap(a, b, "a", "b", 10.0)
    return m.select("b", "a", fixed("overlap").alias("overlap"))


@query("tiles_touching_zones", with_(v.TILES, BOX_A, BOX_B, OVER) + "select distinct a from ov")
def tiles_touching_zones(spark, d):
    a, b = _boxes(spark, d)
    return spatial.tiles_touching_zones(a, b, "a", "b", 10.0).select("a")


PIXHIT = f"hit as ({v.sql_in_zone('pixels', 'row, col, value, cell_area', 'x', 'y')})"


@query(
    "zonal_histogram",
    with_(v.PIXELS, v.ZONE_EDGES, PIXHIT)
    + f"select zone, cast(ceil((value - 900) / 200.0) - 1 as int) as bin, {r('sum(cell_area)', 3)} as area from hit where ceil((value - 900) / 200.0) - 1 between 0 and 9 group by all",
)
def zonal_histogram(spark, d):
    g = raster.zonal_area_profile(v.pixels(spark, d), v.zones(spark, d), ["zone"], 10.0, 900.0, 200.0, 10)
    return g.select("zone", "bin", fixed("area", 3).alias("area"))


@query(
    "zonal_histogram_dense",
    with_(v.PIXELS, v.ZONE_EDGES, PIXHIT,
          "h as (select zone, cast(ceil((value - 900) / 200.0) - 1 as int) as bin, sum(cell_area) as area from hit where ceil((value - 900) / 200.0) - 1 between 0 and 9 group by all)")
    + f"select z.zone, b.bin, {r('coalesce(area, 0.0)', 3)} as area from (select distinct zone from h) z cross join (select cast(i as int) as bin from range(10) x(i)) b left join h on h.zone = z.zone and h.bin = b.bin",
)
def zonal_histogram_dense(spark, d):
    g = raster.zonal_area_profile(v.pixels(spark, d), v.zones(spark, d), ["zone"], 10.0, 900.0, 200.0, 10)
    return raster.dense_profile(g, ["zone"], 10).select("zone", "bin", fixed("area", 3).alias("area"))


@query(
    "zonal_reduce",
    with_(v.PIXELS, v.ZONE_EDGES, PIXHIT)
    + f"select n_nationkey as zone, {r('sum(sqrt(value) * cell_area)', 3)} as s, count(h.value) as n, {r('max(value)', 3)} as top from nation left join hit h on h.zone = n_nationkey group by 1",
)
def zonal_reduce(spark, d):
    o = raster.zonal(v.pixels(spark, d), v.zones(spark, d), "zone", 10.0,
                     {"s": F.sum("w"), "n": F.count(F.lit(1)), "top": F.max("value")}, operator=lambda p: p.withColumn("w", F.sqrt("value") * F.col("cell_area")))
    return o.select("zone", fixed("s", 3).alias("s"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), fixed("top", 3).alias("top"))


@query(
    "zonal_min_location",
    with_(v.PIXELS, v.ZONE_EDGES, PIXHIT, "k as (select h.zone, p.x, p.y, h.value, row_number() over (partition by h.zone order by h.value, h.row, h.col) as rn from hit h join pixels p on p.row = h.row and p.col = h.col)")
    + f"select n_nationkey as zone, {r('x')} as min_x, {r('y')} as min_y, {r('value', 4)} as min_value from nation left join k on zone = n_nationkey and rn = 1",
)
def zonal_min_location(spark, d):
    o = raster.lowest_pixel(v.pixels(spark, d), v.zones(spark, d), "zone", 10.0)
    return o.select("zone", fixed("min_x").alias("min_x"), fixed("min_y").alias("min_y"), fixed("min_value", 4).alias("min_value"))


CX, CY = "((lon + 180.0::double) / 3.6::double)", "((lat + 85.0::double) / 0.85::double)"


@query(
    "pixel_sample_nearest",
    with_(v.SITES, v.PIXELS) + f"select site_id, {r('p.value', 4)} as value from sites left join pixels p on p.col = cast(floor({CX}) as bigint) and p.row = cast(floor({CY}) as bigint)",
)
def pixel_sample_nearest(spark, d):
    s = v.sites(spark, d).select("site_id", "lon", "lat")
    o = raster.sample(s, v.pixels(spark, d).select("row", "col", F.col("value").alias("pv")), ["pv"], v.PIXEL_GRID, "nearest", "lon", "lat")
    return o.select("site_id", fixed("pv", 4).alias("value"))


@query(
    "pixel_sample_bilinear",
    with_(v.SITES, v.PIXELS, f"q as (select site_id, {CX} - 0.5 as cx, {CY} - 0.5 as cy from sites)",
          "f as (select site_id, cast(floor(cx) as bigint) as c, cast(floor(cy) as bigint) as rw, cx - floor(cx) as u, cy - floor(cy) as w from q)")
    + f"""select site_id, {r('(1 - u) * (1 - w) * a.value + u * (1 - w) * b.value + (1 - u) * w * c2.value + u * w * d.value', 4)} as value from f
    left join pixels a on a.row = rw and a.col = f.c left join pixels b on b.row = rw and b.col = f.c + 1
    left join pixels c2 on c2.row = rw + 1 and c2.col = f.c left join pixels d on d.row = rw + 1 and d.col = f.c + 1""",
)
def pixel_sample_bilinear(spark, d):
    s = v.sites(spark, d).select("site_id", "lon", "lat")
    o = raster.sample(s, v.pixels(spark, d).select("row", "col", F.col("value").alias("pv")), ["pv"], v.PIXEL_GRID, "bilinear", "lon", "lat")
    return o.select("site_id", fixed("pv", 4).alias("value"))


NEIGH = "n as (select p.row, p.col, p.value as v5, " + ", ".join(
    f"max(case when q.row = p.row + {a} and q.col = p.col + {b} then q.value end) as v{(b + 1) + 3 * (a + 1) + 1}" for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)
) + " from pixels p join pixels q on q.row between p.row - 1 and p.row + 1 and q.col between p.col - 1 and p.col + 1 group by p.row, p.col, p.value)"


@query(
    "stencil_slope_curvature",
    with_(v.PIXELS, NEIGH)
    + f"""select row, col, {r('(-v1 + v3 - 2 * v4 + 2 * v6 - v7 + v9) / (8 * 2.0)', 4)} as dhdx, {r('(-v1 - 2 * v2 - v3 + v7 + 2 * v8 + v9) / (8 * 4.0)', 4)} as dhdy,
    {r('((v4 + v6) / 2 - v5) / (2.0 * 2.0)', 4)} as dhddx, {r('((v2 + v8) / 2 - v5) / (4.0 * 4.0)', 4)} as dhddy,
    {r('-2.0 * (((v4 + v6) / 2 - v5) / 4.0 + ((v2 + v8) / 2 - v5) / 16.0) * 100.0', 3)} as curvature from n""",
)
def stencil_slope_curvature(spark, d):
    s = raster.stencil(v.pixels(spark, d), raster.derivative_kernels(2.0, 4.0))
    c = geo.curvature("dhddx", "dhddy", F.lit(0.0), geographic=False)
    return s.select("row", "col", *[fixed(x, 4).alias(x) for x in ("dhdx", "dhdy", "dhddx", "dhddy")], fixed(c, 3).alias("curvature"))


G3 = gaussian_weights(1.0, 3)


@query(
    "footprint_smoothing",
    with_(v.PIXELS, NEIGH)
    + "select row, col, " + r(" + ".join(f"v{(b + 1) + 3 * (a + 1) + 1} * {G3[a + 1]!r}::double * {G3[b + 1]!r}::double" for a in (-1, 0, 1) for b in (-1, 0, 1)), 4) + " as height from n",
)
def footprint_smoothing(spark, d):
    s = raster.stencil(v.pixels(spark, d), {"height": raster.smoothing_kernel("gaussian", 1, 1.0)})
    return s.select("row", "col", fixed("height", 4).alias("height"))


@query(
    "dem_at_points",
    with_(v.SITES, v.PIXELS, NEIGH, "g as (select row, col, (-v1 + v3 - 2 * v4 + 2 * v6 - v7 + v9) / (8 * 3.6::double) as dhdx, v5 as height from n)")
    + f"select site_id, {r('g.height + 10.5', 4)} as height, {r('g.dhdx', 4)} as dhdx from sites left join g on g.col = cast(floor({CX}) as bigint) and g.row = cast(floor({CY}) as bigint)",
)
def dem_at_points(spark, d):
    s = v.sites(spark, d).select("site_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    px = v.pixels(spark, d)
    # a flat datum raster over the same grid, extended so that every corner exists
    flat = spark.range(0, 202).select((F.col("id") - 1).alias("row")).withColumn("col", F.explode(F.sequence(F.lit(-1), F.lit(101)))).select("row", F.col("col").cast("long").alias("col"), F.lit(10.5).alias("value"))
    o = raster.dem_at_points(s, px, v.PIXEL_GRID, offsets=flat, method="nearest")
    return o.select("site_id", fixed("height", 4).alias("height"), fixed("dhdx", 4).alias("dhdx"))


@query(
    "mask_layers_at_points",
    with_(v.SITES, v.PIXELS)
    + f"select site_id, coalesce(cell_area > 10, false) as ice, coalesce(cell_area > 40, false) as land from sites left join pixels p on p.col = cast(floor({CX}) as bigint) and p.row = cast(floor({CY}) as bigint)",
)
def mask_layers_at_points(spark, d):
    px = v.pixels(spark, d)
    lay = px.select("row", "col", F.lit("ice").alias("layer"), (F.col("cell_area") > 10).cast("int").alias("value")).unionByName(
        px.select("row", "col", F.lit("land").alias("layer"), (F.col("cell_area") > 40).cast("int").alias("value")))
    s = v.sites(spark, d).select("site_id", "lon", "lat")
    return raster.flags_at_points(s, lay, v.PIXEL_GRID, ["ice", "land"], "lon", "lat").select("site_id", "ice", "land")


@query(
    "gate_flux",
    with_(v.PIXELS, v.ZONE_EDGES, "f as (select row, col, value * 10 as vx, 500 - cell_area * 8 as vy, value / 3 as th from pixels)",
          "allv as (select zone, i, x, y, lead(x, 1, x) over (partition by zone order by i) - x as dx, lead(y, 1, y) over (partition by zone order by i) - y as dy from zv)")
    + f"""select zone, {r('sum((vx * dy - vy * dx) * th) / 1e9')} as flux from allv left join f on f.col = cast(floor((x + 180.0) / 3.6::double) as bigint) and f.row = cast(floor((y + 85.0) / 0.85::double) as bigint) group by zone""",
)
def gate_flux(spark, d):
    px = v.pixels(spark, d)
    f = px.select("row", "col", (F.col("value") * 10).alias("vx"), (500 - F.col("cell_area") * 8).alias("vy"), (F.col("value") / 3).alias("thickness"))
    g = raster.gate_flux(v.zones(spark, d).select("zone", "ring"), f, "zone", v.PIXEL_GRID)
    return g.select("zone", fixed("flux").alias("flux"))


@query(
    "velocity_cleanup",
    with_(v.PIXELS) + f"select row, {r('sum(case when abs(value * 20) > 30000 or cell_area < 10 then 0.0 else value * 20 end)', 3)} as v from pixels group by row",
)
def velocity_cleanup(spark, d):
    px = v.pixels(spark, d).select("row", (F.col("value") * 20).alias("v"), (F.col("cell_area") >= 10).alias("terminus"))
    return raster.clean_velocity(px, "v", "terminus", 30000.0).groupBy("row").agg(fixed(F.sum("v"), 3).alias("v"))


@query(
    "lowest_fraction",
    with_("q as (select c_nationkey, quantile_cont(c_acctbal, 0.02) as q from customer group by all)")
    + f"select c.c_nationkey, count(*) as n, {r('max(c_acctbal)', 4)} as top from customer c join q on c.c_nationkey = q.c_nationkey where c_acctbal <= q group by all",
)
def lowest_fraction(spark, d):
    c = v.table(spark, d, "customer").select("c_nationkey", "c_acctbal")
    return raster.lowest_fraction(c, ["c_nationkey"], "c_acctbal").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), fixed(F.max("c_acctbal"), 4).alias("top"))


@query(
    "month_of_maximum",
    with_("m as (select o_custkey % 100 as px, month(o_orderdate) as month, sum(o_totalprice) as v from orders group by all)", "k as (select *, row_number() over (partition by px order by v desc, month) as rn from m)")
    + "select px, cast(month as int) as max_month from k where rn = 1",
)
def month_of_maximum(spark, d):
    o = v.table(spark, d, "orders").groupBy((F.col("o_custkey") % 100).alias("px"), F.month("o_orderdate").alias("month")).agg(F.sum("o_totalprice").alias("value"))
    return raster.month_of_maximum(o, ["px"])


POP = [
    v.SITES, v.PIXELS,
    "sc(scenario_id, mg, mr) as (values (1, 10, 5.0), (2, 30, 5.0), (3, 30, 8.0))",
    "vert as (select site_id, lon, lat, nation % 5 as country, site_id % 50 as gmax, abs(value) / 1000 as runoff from sites)",
    f"dd as (select p.row, p.col, p.value as pop, p.cell_area::int % 5 as country, scenario_id, min({sql_haversine('p.x', 'p.y', 't.lon', 't.lat')}) as m from pixels p join vert t on p.cell_area::int % 5 = t.country join sc on t.gmax >= mg and t.runoff >= mr group by all)",
]


@query(
    "population_within_buffers",
    with_(*POP, "near as (select * from dd where m <= 1200000)")
    + " union all ".join(
        f"select country, scenario_id, {b}.0::double as buffer_m, {r(f'sum(case when m <= {b} then pop else 0.0 end)', 3)} as population from near group by country, scenario_id" for b in (300000, 600000, 1200000)),
)
def population_within_buffers(spark, d):
    px = v.pixels(spark, d).select((F.col("row") * 100 + F.col("col")).alias("pixel_id"), F.col("x").alias("lon"), F.col("y").alias("lat"), (F.col("cell_area").cast("int") % 5).alias("country"), F.col("value").alias("population"))
    ve = v.sites(spark, d).select(F.col("site_id").alias("vertex_id"), "lon", "lat", (F.col("nation") % 5).alias("country"), (F.col("site_id") % 50).alias("gmax"), (F.abs("value") / 1000).alias("runoff"))
    sc = spark.createDataFrame([(1, 10, 5.0), (2, 30, 5.0), (3, 30, 8.0)], "scenario_id int, min_gmax int, min_runoff double")
    o = spatial.population_near(px, ve, sc, [300000.0, 600000.0, 1200000.0])
    return o.select("country", "scenario_id", "buffer_m", fixed("population", 3).alias("population"))


EDGES = [0.0, 1000000.0, 2000000.0, 4000000.0]


@query(
    "variogram",
    with_(v.SITES, "s as (select site_id, lon, lat, nation % 3 as year, value from sites)",
          f"pr as (select s.site_id, s.year, {sql_haversine('s.lon', 's.lat', 't.lon', 't.lat')} as m, abs(s.value - t.value) as df from s join s t on s.year = t.year and s.site_id != t.site_id)",
          "bd as (select *, case when m > 0 and m <= 1000000 then 0 when m > 1000000 and m <= 2000000 then 1 when m > 2000000 and m <= 4000000 then 2 end as band from pr)",
          "pt as (select year, site_id, band, count(*) as n, avg(df) filter (df != 0) as a from bd where band is not null group by all)",
          "yr as (select year, band, avg(a) as a, count(*) as n from pt where n > 3 and a is not null group by all)")
    + f"select band, {r('avg(a)', 4)} as mean_abs_diff, cast(sum(n) as bigint) as n_points from yr group by band",
)
def variogram(spark, d):
    s = v.sites(spark, d).withColumn("year", F.col("nation") % 3)
    o = spatial.variogram(s, "year", "site_id", "value", EDGES, 20.0, 3)
    return o.select("band", fixed("mean_abs_diff", 4).alias("mean_abs_diff"), "n_points")


@query(
    "coverage_fraction",
    with_(v.PIXELS, "p as (select cast(floor(x / 30) as int) as tile_x, cast(floor(y / 30) as int) as tile_y, cast(floor(value) as bigint) % 3 as layer, cell_area from pixels)",
          "ta as (select tile_x, tile_y, sum(cell_area) as a from p group by all)")
    + f"select p.tile_x, p.tile_y, layer, {r('sum(cell_area) / any_value(a)')} as fraction from p join ta on p.tile_x = ta.tile_x and p.tile_y = ta.tile_y group by all",
)
def coverage_fraction(spark, d):
    p = v.pixels(spark, d).withColumn("layer", F.floor("value") % 3)
    t = spatial.tile_of(p, 30, "x", "y").groupBy("tile_x", "tile_y").agg(F.sum("cell_area").alias("tile_area"))
    return spatial.coverage_fraction(p, t, "layer", 30, x="x", y="y").withColumn("fraction", fixed("fraction"))


@query(
    "cap_membership",
    with_(v.SITES, v.TILES, f"dd as (select s.site_id, {DIST} as m from sites s join tiles t on s.nation = t.s_nationkey)")
    + "select site_id, count(*) filter (m <= 3000000) as n_inside from dd group by site_id",
)
def cap_membership(spark, d):
    t = v.tiles(spark, d).select(F.col("s_nationkey").alias("nation"), "lon", "lat")
    s = v.sites(spark, d).join(t.select("nation").distinct(), "nation", "left_semi")
    return spatial.count_in_caps(s, t, 3000000.0, "site_id", ["nation"]).withColumnRenamed("n", "n_inside")


@query(
    "point_series_extract",
    with_(v.OBS, v.NATION_SERIES, v.SITES, "s as (select tile, month, avg(value) as value from series group by all)")
    + f"select site_id, month, {r('s.value * (910.0 / (1 + site_id % 9))', 4)} as value from sites join s on s.tile = cast(floor((lon + 180) / 14.5) as int)",
)
def point_series_extract(spark, d):
    s = v.nation_series(spark, d).groupBy("tile", "month").agg(F.avg("value").alias("value"))
    p = v.sites(spark, d).select("site_id", F.floor((F.col("lon") + 180) / 14.5).cast("int").alias("tile"))
    return p.join(s, "tile").select("site_id", "month", fixed(F.col("value") * (910.0 / (1 + F.col("site_id") % 9)), 4).alias("value"))


RING_AREA = "case when {t} % 7 = 0 then 0.0 else 1.0 + ({t} * ({i} + 3)) % 7 end"


@query(
    "ring_profile",
    with_(
        v.TILES, v.SITES, f"hy as (select tile_id, cast(i as int) as height_index, {RING_AREA.format(t='tile_id', i='i')} as area from tiles cross join range(0, 4) z(i))",
        "wh as (select tile_id, sum(area) as w from hy group by all)",
        "kk as (select tile_id, lon - 2 as x0, lon + 2 as x1, lat - 2 as y0, lat + 2 as y1, 1.0 / 6371000.0 * (180.0 / pi()) / cos(radians(((lat - 2) + (lat + 2)) / 2)) as kx, 1.0 / 111139.0 as ky from tiles)",
        "pt as (select lon, lat, cast(floor(abs(value) / 2500) as int) as height_index, value from sites)",
        "dd as (select tile_id, height_index, value, cast(ceil(greatest(greatest(x0 - lon, lon - x1, 0.0) / kx, greatest(y0 - lat, lat - y1, 0.0) / ky) / 200000) as int) as ring from kk cross join pt)",
        "cv as (select n.i as ring, wh.tile_id, coalesce(sum(area) filter (exists (select 1 from dd where dd.tile_id = hy.tile_id and dd.height_index = hy.height_index and dd.ring <= n.i)), 0) / any_value(w) as c "
        "from range(0, 31) n(i) cross join hy join wh using (tile_id) where w > 0 group by n.i, wh.tile_id)",
        "st as (select tile_id, coalesce(min(ring) filter (c >= 0.75), 30) as ring, coalesce(min(c) filter (c >= 0.75), max(c)) as coverage, max(c) >= 0.75 as covered from cv group by tile_id)",
        "g as (select st.tile_id, dd.height_index, st.ring, coverage, covered, avg(value) as value from st left join dd on dd.tile_id = st.tile_id and dd.ring <= st.ring group by all)",
        "al as (select * from g union all select tile_id, height_index, 0, 0.0, true, 0.0 from hy join wh using (tile_id) where w = 0)",
    )
    + f"select tile_id, height_index, cast(ring as int) as ring, {r('coverage')} as coverage, covered, {r('value', 4)} as value from al",
)
def ring_profile(spark, d):
    t = v.tiles(spark, d)
    boxes = t.select("tile_id", (F.col("lon") - 2).alias("min_x"), (F.col("lon") + 2).alias("max_x"), (F.col("lat") - 2).alias("min_y"), (F.col("lat") + 2).alias("max_y"))
    hy = t.select("tile_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("height_index"))
    hy = hy.withColumn("area_km2", F.when(F.col("tile_id") % 7 == 0, 0.0).otherwise(1.0 + (F.col("tile_id") * (F.col("height_index") + 3)) % 7))
    p = v.sites(spark, d).withColumn("height", F.abs("value"))
    o = raster.ring_profile(p, boxes, hy, ["value"], [], 200000.0, 30, 2500.0, 10.0, 0.75)
    return o.select("tile_id", "height_index", "ring", fixed("coverage").alias("coverage"), "covered", fixed("value", 4).alias("value"))
