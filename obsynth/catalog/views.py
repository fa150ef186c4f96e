"""Deterministic domain views of the given tables; every view exists as a DataFrame and as a SQL CTE."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.binning import bin_2d
from ..operators.robust import reduce_bins_methods
from ..functions.numeric import bin_index

YEAR_BIN_START = "1990-01-01"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- obs: irregular point observations ----------------------------------------------------------


def obs(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_shipdate", "l_quantity", "l_extendedprice", "l_linestatus")
    su = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(su, li["l_suppkey"] == su["s_suppkey"])
    return j.select(
        F.col("s_nationkey").alias("tile"), F.col("l_returnflag").alias("mission"), F.to_date("l_shipdate").alias("ts"),
        F.col("l_quantity").alias("height"), ((F.col("l_extendedprice") / F.col("l_quantity") - 1500) / 100).alias("dh"),
        (F.col("l_linestatus") == "F").alias("quality"),
    )


OBS = (
    "obs as (select s_nationkey as tile, l_returnflag as mission, cast(l_shipdate as date) as ts, l_quantity as height, "
    "(l_extendedprice / l_quantity - 1500) / 100 as dh, (l_linestatus = 'F') as quality "
    "from lineitem join supplier on l_suppkey = s_suppkey)"
)


def year_bin(c="ts"):
    return F.floor(F.datediff(F.col(c), F.lit(YEAR_BIN_START).cast("date")) / F.lit(365)).cast("int")


def sql_bin(days: int, c: str = "ts") -> str:
    return f"cast(floor(date_diff('day', date '1990-01-01', {c}) / {days}) as int)"


def day_bin(days: int, c="ts"):
    return F.floor(F.datediff(F.col(c), F.lit(YEAR_BIN_START).cast("date")) / F.lit(days)).cast("int")


def height10(c="height"):
    return bin_index(c, 0.0, 10.0)


SQL_H10 = "cast(floor(height / 10.0) as int)"

OBS_CELLS = f"cells as (select tile, mission, {sql_bin(365)} as time_bin, {SQL_H10} as height_bin, dh from obs)"


def obs_binned(spark: SparkSession, d: str, method: str = "median", days: int = 365) -> DataFrame:
    """tile, mission, time_bin, height_bin, dh, nobs."""
    return bin_2d(obs(spark, d), ["tile", "mission"], "dh", day_bin(days), height10(), method)


def sql_obs_binned(days: int = 365, name: str = "binned") -> list[str]:
    """Median bins of obs."""
    return [
        OBS,
        f"{name} as (select tile, mission, {sql_bin(days)} as time_bin, {SQL_H10} as height_bin, median(dh) as dh, count(*) as nobs from obs group by all)",
    ]


# -- obs_run: an ensemble of binning methods ----------------------------------------------------

RUN_METHODS = {1: "median", 2: "nmad3", 3: "nmad5", 4: "mean"}


def obs_run(spark: SparkSession, d: str) -> DataFrame:
    """run_id, tile, mission, time_bin, height_bin, dh, nobs: every binning method over the same cells."""
    base = obs(spark, d).select("tile", "mission", year_bin().alias("time_bin"), height10().alias("height_bin"), "dh")
    keys = ["tile", "mission", "time_bin", "height_bin"]
    r = reduce_bins_methods(base, keys, "dh", list(RUN_METHODS.values()))
    ids = F.create_map(*[F.lit(x) for i, m in RUN_METHODS.items() for x in (m, i)])
    return r.withColumn("run_id", ids[F.col("method")]).drop("method")


def sql_obs_run() -> list[str]:
    from .registry import sql_nmad_ctes

    keys = ["tile", "mission", "time_bin", "height_bin"]
    ks = ", ".join(keys)
    return [
        OBS, OBS_CELLS,
        *sql_nmad_ctes("n3", "cells", keys, "dh", 3), *sql_nmad_ctes("n5", "cells", keys, "dh", 5),
        f"""obs_run as (
  select 1 as run_id, {ks}, median(dh) as dh, count(*) as nobs from cells group by {ks}
  union all select 2, {ks}, v, nobs from n3_bins union all select 3, {ks}, v, nobs from n5_bins
  union all select 4, {ks}, avg(dh), count(*) from cells group by {ks})""",
    ]


# -- hyps: area per tile and height bin ---------------------------------------------------------


def hyps(spark: SparkSession, d: str) -> DataFrame:
    """tile (0..24), height_bin (0..5), area; tile 7 has no area and bin 3 of tile 11 is a hole."""
    p = table(spark, d, "part").select(
        (F.col("p_partkey") % 25).cast("int").alias("tile"), F.floor(F.col("p_size") / 10).cast("int").alias("height_bin"), "p_retailprice")
    g = p.groupBy("tile", "height_bin").agg((F.sum("p_retailprice") / 1000).alias("area"))
    hole = (F.col("tile") == 7) | ((F.col("tile") == 11) & (F.col("height_bin") == 3))
    return g.withColumn("area", F.when(hole, F.lit(0.0)).otherwise(F.col("area")))


HYPS = (
    "hyps as (select cast(p_partkey % 25 as int) as tile, cast(floor(p_size / 10) as int) as height_bin, "
    "case when p_partkey % 25 = 7 or (p_partkey % 25 = 11 and floor(p_size / 10) = 3) then 0.0 else sum(p_retailprice) / 1000 end as area "
    "from part group by p_partkey % 25, floor(p_size / 10))"
)


# -- tiles and sites ----------------------------------------------------------------------------


def tiles(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select(
        F.col("s_suppkey").alias("tile_id"),
        (F.pmod(F.col("s_suppkey") * 37, F.lit(360)) - 180 + 0.5).alias("lon"), (F.pmod(F.col("s_suppkey") * 17, F.lit(170)) - 85 + 0.5).alias("lat"),
        "s_acctbal", "s_nationkey",
    )


TILES = (
    "tiles as (select s_suppkey as tile_id, cast((s_suppkey * 37) % 360 as double) - 180 + 0.5 as lon, "
    "cast((s_suppkey * 17) % 170 as double) - 85 + 0.5 as lat, s_acctbal, s_nationkey from supplier)"
)


def sites(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("site_id"),
        ((F.col("c_custkey") * 53 % 36000) / 100.0 - 180.0).alias("lon"), ((F.col("c_custkey") * 29 % 17000) / 100.0 - 85.0).alias("lat"),
        F.col("c_acctbal").alias("value"), F.col("c_nationkey").alias("nation"),
    )


SITES = (
    "sites as (select c_custkey as site_id, (c_custkey * 53 % 36000) / 100.0::double - 180.0::double as lon, "
    "(c_custkey * 29 % 17000) / 100.0::double - 85.0::double as lat, c_acctbal as value, c_nationkey as nation from customer)"
)


# -- zones: octagons around nation centres ------------------------------------------------------

# fixed values: corners of a unit octagon, first corner repeated
OCTAGON = [(2, 1), (1, 2), (-1, 2), (-2, 1), (-2, -1), (-1, -2), (1, -2), (2, -1), (2, 1)]
ZONE_SCALE = 7.25


def zones(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("zone"), "n_regionkey")
    cx = (F.col("zone") * 67 % 320) - 160.0 + 0.125
    cy = (F.col("zone") * 31 % 140) - 70.0 + 0.375
    ring = F.array(*[F.struct((cx + a * ZONE_SCALE).alias("x"), (cy + b * ZONE_SCALE).alias("y")) for a, b in OCTAGON])
    return n.select("zone", "n_regionkey", ring.alias("ring"))


# one row per octagon edge; a point is inside when an odd number of edges cross its ray
ZONE_EDGES = (
    "oct(i, a, b) as (values " + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(OCTAGON)) + "), "
    "zc as (select n_nationkey as zone, n_regionkey, (n_nationkey * 67 % 320) - 160.0::double + 0.125::double as cx, "
    "(n_nationkey * 31 % 140) - 70.0::double + 0.375::double as cy from nation), "
    f"zv as (select zone, n_regionkey, i, cx + a * {ZONE_SCALE}::double as x, cy + b * {ZONE_SCALE}::double as y from zc cross join oct), "
    "edges as (select p.zone, p.n_regionkey, p.x as x1, p.y as y1, q.x as x2, q.y as y2 from zv p join zv q on p.zone = q.zone and q.i = p.i + 1)"
)


def sql_in_zone(points: str, keys: str, x: str = "lon", y: str = "lat") -> str:
    """CTE body: keys + zone of every containing octagon."""
    return (
        f"select {keys}, zone from {points} cross join edges where (y1 > {y}) <> (y2 > {y}) and {x} < (x2 - x1) * ({y} - y1) / (y2 - y1) + x1 "
        f"group by {keys}, zone having count(*) % 2 = 1"
    )


# -- reaches and flux ---------------------------------------------------------------------------


def reaches(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    comid = F.col("c_custkey") + 1
    nxt = F.when(comid <= 8, F.lit(0)).otherwise(F.floor(comid / 2)).cast("long")
    return c.select(comid.alias("comid"), nxt.alias("next_comid"), (1 + F.abs("c_acctbal") / 1000).alias("length_km"), F.col("c_nationkey").alias("nation"))


REACHES = (
    "reaches as (select c_custkey + 1 as comid, case when c_custkey + 1 <= 8 then 0 else (c_custkey + 1) // 2 end as next_comid, "
    "1 + abs(c_acctbal) / 1000 as length_km, c_nationkey as nation from customer)"
)


def flux(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    g = o.groupBy((F.col("o_custkey") + 1).alias("comid"), F.trunc("o_orderdate", "month").alias("month"))
    return g.agg((F.sum("o_totalprice") / 1e6).alias("flux"))


FLUX = (
    "flux as (select o_custkey + 1 as comid, cast(date_trunc('month', o_orderdate) as date) as month, "
    "sum(o_totalprice) / 1e6 as flux from orders group by 1, 2)"
)


# -- dense monthly series per nation -------------------------------------------------------------


def nation_series(spark: SparkSession, d: str) -> DataFrame:
    """tile, mission, month, value: monthly mean of obs."""
    o = obs(spark, d)
    return o.groupBy("tile", "mission", F.trunc("ts", "month").alias("month")).agg(F.avg("dh").alias("value"))


NATION_SERIES = (
    "series as (select tile, mission, cast(date_trunc('month', ts) as date) as month, avg(dh) as value from obs group by 1, 2, 3)"
)


# -- pixels -------------------------------------------------------------------------------------

PIXEL_COLS = 100


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """One pixel per part key on a 100-column grid over lon/lat; value from the price, area from the size."""
    p = table(spark, d, "part")
    row, c = F.floor(F.col("p_partkey") / PIXEL_COLS).cast("long"), F.col("p_partkey") % PIXEL_COLS
    return p.select(
        row.alias("row"), c.alias("col"), ((c + 0.5) * 3.6 - 180.0).alias("x"), ((row + 0.5) * PIXEL_DY - 85.0).alias("y"),
        (F.col("p_retailprice") + (F.col("p_partkey") * 7919 % 1000)).alias("value"), F.col("p_size").cast("double").alias("cell_area"),
    )


PIXEL_DY = 0.85
PIXEL_GRID = (-180.0, -85.0, 3.6, PIXEL_DY)
PIXELS = (
    f"pixels as (select p_partkey // {PIXEL_COLS} as row, p_partkey % {PIXEL_COLS} as col, (p_partkey % {PIXEL_COLS} + 0.5::double) * 3.6::double - 180.0::double as x, "
    f"(p_partkey // {PIXEL_COLS} + 0.5::double) * {PIXEL_DY}::double - 85.0::double as y, p_retailprice + (p_partkey * 7919 % 1000) as value, "
    "cast(p_size as double) as cell_area from part)"
)


# -- model stack --------------------------------------------------------------------------------

P_AXIS = [0.5, 1.0, 1.5, 2.0]
M_AXIS = [1 / 5, 1 / 3, 1.0, 3.0, 5.0]


def model_dv(spark: SparkSession, d: str) -> DataFrame:
    """tile, date, pscale, mscale, value: a stack derived from the monthly means of obs."""
    o = obs(spark, d)
    g = o.groupBy("tile", F.trunc("ts", "month").alias("date")).agg(F.avg("dh").alias("base"), F.avg("height").alias("melt"))
    g = g.withColumn("pscale", F.explode(F.array(*[F.lit(v) for v in P_AXIS])))
    g = g.withColumn("mscale", F.explode(F.array(*[F.lit(v) for v in M_AXIS])))
    return g.select("tile", "date", "pscale", "mscale", (F.col("base") * F.col("pscale") - F.col("mscale") * F.col("melt") / 10.0).alias("value"))


def _vals(name: str, axis: list[float]) -> str:
    return f"{name}(i, v) as (values " + ", ".join(f"({i}, {v!r}::double)" for i, v in enumerate(axis)) + ")"


MODEL_DV = (
    _vals("pax", P_AXIS) + ", " + _vals("maxis", M_AXIS) + ", "
    "mbase as (select tile, cast(date_trunc('month', ts) as date) as date, avg(dh) as base, avg(height) as melt from obs group by 1, 2), "
    "model_dv as (select tile, date, pax.v as pscale, maxis.v as mscale, base * pax.v - maxis.v * melt / 10.0::double as value, pax.i as ip, maxis.i as im "
    "from mbase cross join pax cross join maxis)"
)


# -- shapes: polygons with holes and parts, and non-convex ones ----------------------------------

# fixed values: corners (ring, a, b) of a shape; ring 1 is a hole, ring 2 an island in it, ring 3 a part beside
SHAPE = [
    (0, -2, -1), (0, 1, -2), (0, 3, 0), (0, 1, 2), (0, -1, 1.5), (0, -0.5, 0.25), (0, -2.5, 1),
    (1, -0.25, -0.75), (1, 0, 0.5), (1, 1.25, 0.75), (1, 1, -0.5),
    (2, 0.25, -0.25), (2, 0.75, -0.25), (2, 0.5, 0.25),
    (3, 4, -1), (3, 5, -1), (3, 5, 2), (3, 4.5, 2), (3, 4.5, 0), (3, 4, 0),
]
SHAPE_SCALE = 5.5


def shapes(spark: SparkSession, d: str) -> DataFrame:
    """A shape around each nation's centre."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("shape"), "n_regionkey")
    cx, cy = (F.col("shape") * 67 % 320) - 160.0 + 0.125, (F.col("shape") * 31 % 140) - 70.0 + 0.375
    rings = [F.array(*(F.struct((cx + a * SHAPE_SCALE).alias("x"), (cy + b * SHAPE_SCALE).alias("y")) for r, a, b in SHAPE if r == k)) for k in range(4)]
    return n.select("shape", "n_regionkey", F.array(*rings).alias("rings"))


def _sides(rows: list[tuple[int, float, float]]) -> str:
    out = []
    for r in sorted({x[0] for x in rows}):
        own = [(a, b) for k, a, b in rows if k == r]
        out += [f"({r}, {a}, {b}, {c}, {e})" for (a, b), (c, e) in zip(own, own[1:] + own[:1], strict=True)]
    return ", ".join(out)


# one row for each side of each shape
SHAPE_EDGES = (
    f"unit(part, a, b, c, e) as (values {_sides(SHAPE)}), "
    f"shape_edges as (select n_nationkey as shape, part, (n_nationkey * 67 % 320) - 160.0::double + 0.125 + a * {SHAPE_SCALE}::double as x1, (n_nationkey * 31 % 140) - 70.0::double + 0.375 + b * {SHAPE_SCALE}::double as y1, "
    f"(n_nationkey * 67 % 320) - 160.0::double + 0.125 + c * {SHAPE_SCALE}::double as x2, (n_nationkey * 31 % 140) - 70.0::double + 0.375 + e * {SHAPE_SCALE}::double as y2 from nation cross join unit)"
)

ARROW = [(0, 0), (9, 3), (0, 6), (3, 3)]  # fixed values: corners of a non-convex tile


def arrows(spark: SparkSession, d: str) -> DataFrame:
    """A non-convex polygon at every second tile."""
    t = tiles(spark, d).where("tile_id % 2 = 0")
    return t.select(F.col("tile_id").alias("arrow"), F.array(*(F.struct((F.col("lon") + a).alias("x"), (F.col("lat") + b).alias("y")) for a, b in ARROW)).alias("ring"))


ARROW_EDGES = (
    f"head(part, a, b, c, e) as (values {_sides([(0, a, b) for a, b in ARROW])}), "
    "arrow_edges as (select tile_id as arrow, part, lon + a as x1, lat + b as y1, lon + c as x2, lat + e as y2 from tiles cross join head where tile_id % 2 = 0)"
)

WAVES = 100_000  # corners of the largest ring


def waves(spark: SparkSession, d: str) -> DataFrame:
    """A wavy ring of a region; that of region 0 has 100,000 corners, the others a hundredth."""
    n = F.when(F.col("r_regionkey") == 0, WAVES).otherwise(WAVES // 100)
    turn = lambda i: i * (2 * math.pi) / n
    out = lambda i: 20 + F.col("r_regionkey") * 8 + F.sin(turn(i) * 40)
    ring = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((out(i) * F.cos(turn(i)) * 2).alias("x"), (out(i) * F.sin(turn(i))).alias("y")))
    return table(spark, d, "region").select(F.col("r_regionkey").alias("region"), ring.alias("ring"))


WAVE_EDGES = (
    f"wave_n as (select r_regionkey as region, case when r_regionkey = 0 then {WAVES} else {WAVES // 100} end as n from region), "
    "wave_i as (select region, n, unnest(range(n)) as i from wave_n), "
    "wave_p as (select region, n, i, (20 + region * 8 + sin(i * (2 * pi()) / n * 40)) * cos(i * (2 * pi()) / n) * 2 as x, (20 + region * 8 + sin(i * (2 * pi()) / n * 40)) * sin(i * (2 * pi()) / n) as y from wave_i), "
    "wave_edges as (select p.region, p.x as x1, p.y as y1, q.x as x2, q.y as y2 from wave_p p join wave_p q on p.region = q.region and q.i = (p.i + 1) % p.n)"
)


def sql_inside(points: str, keys: str, edges: str, zone: str, x: str = "lon", y: str = "lat") -> str:
    """CTE body: keys + zone wherever an odd number of edges crosses the point's ray."""
    return (
        f"select {keys}, {zone} from {points} cross join {edges} where (y1 > {y}) <> (y2 > {y}) and {x} < (x2 - x1) * ({y} - y1) / (y2 - y1) + x1 "
        f"group by {keys}, {zone} having count(*) % 2 = 1"
    )
