"""Profiles, gaps, interpolation, bias correction, empty tiles, non-linear fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import bin_index, fixed
from ..operators import binning, fill, fit, windows
from ..operators.robust import reduce_bins
from . import views as v
from .registry import query, r, sql_haversine, sql_ols_ctes, with_

PK = ["tile", "mission", "time_bin"]
H5 = "cast(floor(height / 5.0) as int)"
PROFILE = [
    v.OBS,
    f"cells5 as (select tile, mission, {v.sql_bin(90)} as time_bin, {H5} as h, median(dh) as dh from obs group by all having count(*) >= 3)",
    "keys5 as (select distinct tile, mission, time_bin from cells5)",
    "prof as (select k.tile, k.mission, k.time_bin, a.h, c.dh from keys5 k cross join (select cast(i as int) as h from range(0, 11) z(i)) a left join cells5 c on c.tile = k.tile and c.mission = k.mission and c.time_bin = k.time_bin and c.h = a.h)",
]
PART = "partition by tile, mission, time_bin"
RNG = f"rng as (select *, min(case when dh is not null then h end) over ({PART}) as f, max(case when dh is not null then h end) over ({PART}) as l from prof)"


def profile(spark, d):
    o = v.obs(spark, d).select("tile", "mission", v.day_bin(90).alias("time_bin"), bin_index("height", 0.0, 5.0).alias("h"), "dh")
    c = reduce_bins(o, [*PK, "h"], "dh", "median").where("nobs >= 3").drop("nobs")
    return binning.densify(c, PK, {"h": F.sequence(F.lit(0), F.lit(10))})


@query("valid_range", with_(*PROFILE, RNG) + "select distinct tile, mission, time_bin, f as first_valid, l as last_valid from rng")
def valid_range(spark, d):
    return windows.valid_range(profile(spark, d), PK, "h", "dh")


@query("valid_gaps", with_(*PROFILE, RNG) + "select tile, mission, time_bin, h, dh is null and h > f and h < l as gap from rng")
def valid_gaps(spark, d):
    return windows.valid_gaps(profile(spark, d), PK, "h", "dh").select(*PK, "h", "gap")


@query(
    "dilate_mask",
    with_(*PROFILE)
    + f"select tile, mission, time_bin, h, bool_or(dh is not null) over ({PART} order by h rows between 1 preceding and 1 following) as grown, bool_and(dh is not null) over ({PART} order by h rows between 2 preceding and 2 following) as shrunk from prof",
)
def dilate_mask(spark, d):
    p = profile(spark, d).withColumn("ok", F.col("dh").isNotNull())
    return p.select(*PK, "h", windows.dilate("ok", PK, "h", 1).alias("grown"), windows.dilate("ok", PK, "h", -2).alias("shrunk"))


@query(
    "true_run_length",
    with_(*PROFILE, f"b as (select *, sum(case when dh is null then 1 else 0 end) over ({PART} order by h) as blk from prof)")
    + f"select tile, mission, time_bin, h, cast(case when dh is null then 0 else count(dh) over (partition by tile, mission, time_bin, blk) end as int) as run_length from b",
)
def true_run_length(spark, d):
    p = profile(spark, d).withColumn("ok", F.col("dh").isNotNull())
    return windows.true_run_length(p, PK, "h", "ok").select(*PK, "h", "run_length")


@query(
    "extend_ends",
    with_(*PROFILE, RNG, f"fl as (select *, max(case when h = f then dh end) over ({PART}) as fv, max(case when h = l then dh end) over ({PART}) as lv from rng)")
    + f"select tile, mission, time_bin, h, {r('case when h < f and h >= 1 then fv when h > l and h <= 9 then lv else dh end')} as dh from fl",
)
def extend_ends(spark, d):
    p = windows.extend_ends(profile(spark, d), PK, "h", "dh", inside=F.col("h").between(1, 9))
    return p.select(*PK, "h", fixed("dh").alias("dh"))


KNOWN = [
    f"kn as (select *, max(case when dh is not null then h end) over ({PART} order by h) as lo, min(case when dh is not null then h end) over ({PART} order by h rows between current row and unbounded following) as hi, "
    f"list(h order by h) filter (dh is not null) over ({PART}) as hs from prof)",
    "kp as (select *, case when lo is null then hs[1] when hi is null then hs[-2] else lo end as a, case when lo is null then hs[2] when hi is null then hs[-1] else hi end as b from kn)",
    "itp as (select k.tile, k.mission, k.time_bin, k.h, k.dh, k.lo, k.hi, len(hs) as m, p.dh as ya, q.dh as yb, k.a, k.b from kp k left join prof p on p.tile = k.tile and p.mission = k.mission and p.time_bin = k.time_bin and p.h = k.a "
    "left join prof q on q.tile = k.tile and q.mission = k.mission and q.time_bin = k.time_bin and q.h = k.b)",
]


@query(
    "interpolate_profile",
    with_(*PROFILE, *KNOWN)
    + f"select tile, mission, time_bin, h, {r('case when dh is not null then dh when m = 1 then coalesce(ya, yb) when a = b then ya else ya + (yb - ya) * (h - a) / (b - a) end')} as dh from itp",
)
def interpolate_profile(spark, d):
    p = windows.interpolate(profile(spark, d), PK, "h", "dh", outside="linear")
    return p.select(*PK, "h", fixed("dh").alias("dh"))


@query(
    "interpolate_profile_inner",
    with_(*PROFILE, *KNOWN)
    + f"select tile, mission, time_bin, h, {r('case when dh is not null then dh when lo is null or hi is null then null else ya + (yb - ya) * (h - a) / (b - a) end')} as dh from itp",
)
def interpolate_profile_inner(spark, d):
    p = windows.interpolate(profile(spark, d), PK, "h", "dh", outside="none")
    return p.select(*PK, "h", fixed("dh").alias("dh"))


@query(
    "resample_axis",
    with_(v.FLUX, "s as (select comid, date_diff('day', date '1995-01-01', month) as day, flux from flux)",
          "ax as (select comid, i * 45 as day from (select distinct comid from s) cross join range(0, 54) z(i))",
          "j as (select a.comid, a.day, (select max(day) from s where s.comid = a.comid and s.day <= a.day) as lo, (select min(day) from s where s.comid = a.comid and s.day >= a.day) as hi from ax a)")
    + f"""select j.comid, cast(j.day as bigint) as day, {r('case when lo is null then q.flux when hi is null or lo = hi then p.flux else p.flux + (q.flux - p.flux) * (j.day - lo) / (hi - lo) end')} as flux
    from j left join s p on p.comid = j.comid and p.day = j.lo left join s q on q.comid = j.comid and q.day = j.hi""",
)
def resample_axis(spark, d):
    s = v.flux(spark, d).select("comid", F.datediff("month", F.lit("1995-01-01").cast("date")).cast("long").alias("day"), "flux")
    ax = s.select("comid").distinct().withColumn("day", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(53 * 45).cast("long"), F.lit(45).cast("long"))))
    return windows.resample(s, ax, ["comid"], "day", "flux").select("comid", "day", fixed("flux").alias("flux"))


FULL7 = [
    *v.sql_obs_binned(),
    "full7 as (select tile, mission, time_bin, height_bin as h, avg(dh) as dh, count(*) over (partition by tile, mission, time_bin) as n from binned where height_bin < 5 group by all)",
]


@query(
    "shift_profile",
    with_(*v.sql_obs_binned(), "pr as (select tile, mission, time_bin, height_bin as h, dh, row_number() over w as pos, count(*) over (partition by tile, mission, time_bin) as n, lead(dh, 2) over w as m from binned window w as (partition by tile, mission, time_bin order by height_bin))",
          "ft as (select tile, mission, time_bin, regr_slope(m, pos) as s, avg(pos) as mx, avg(m) as my from pr where pos <= n - 2 and pos > n - 5 group by all)")
    + f"select p.tile, p.mission, p.time_bin, h, {r('case when pos <= n - 2 then m else coalesce(my + coalesce(case when isnan(s) then 0.0 else s end, 0.0) * (pos - mx), 0.0) end')} as shifted from pr p left join ft f on f.tile = p.tile and f.mission = p.mission and f.time_bin = p.time_bin",
)
def shift_profile(spark, d):
    b = v.obs_binned(spark, d).select("tile", "mission", "time_bin", F.col("height_bin").alias("h"), "dh")
    return windows.shift_profile(b, PK, "h", "dh", 2, n_fit=3).select(*PK, "h", fixed("shifted").alias("shifted"))


OBS_C = (
    "obs_c as (select s_nationkey as tile, l_returnflag as mission, l_linestatus = 'F' as ice, l_discount * 10 + l_tax * 4 - 0.73::double as curv, "
    "(l_extendedprice / l_quantity - 1500) / 100 as dh from lineitem join supplier on l_suppkey = s_suppkey)"
)


def obs_c(spark, d):
    li = v.table(spark, d, "lineitem")
    j = li.join(v.table(spark, d, "supplier"), li["l_suppkey"] == F.col("s_suppkey"))
    return j.select(
        F.col("s_nationkey").alias("tile"), F.col("l_returnflag").alias("mission"), (F.col("l_linestatus") == "F").alias("ice"),
        (F.col("l_discount") * 10 + F.col("l_tax") * 4 - F.lit(0.73)).alias("curv"), ((F.col("l_extendedprice") / F.col("l_quantity") - 1500) / 100).alias("dh"))


CURV = [
    OBS_C,
    "cb as (select tile, mission, cast(floor((curv + 1.0) / 0.1::double) as int) as bin, median(dh) as m, count(*) as n from obs_c where not ice and abs(dh) < 10 group by all)",
    "cw as (select tile, mission, sqrt(n) as w, -1.0::double + (bin + 0.5) * 0.1::double as c, m from cb)",
    "cx as (select tile, mission, w as x_0, w * c as x_1, w * pow(c, 2) as x_2, w * pow(c, 3) as x_3, w * pow(c, 4) as x_4, w * m as yy from cw)",
    *sql_ols_ctes("q", "cx", ["tile", "mission"], ["x_0", "x_1", "x_2", "x_3", "x_4"], "yy"),
]


@query(
    "polynomial_bias_correct",
    with_(*CURV, "cor as (select o.tile, o.mission, o.dh - case when n > 5 then b0 + curv * (b1 + curv * (b2 + curv * (b3 + curv * b4))) else 0.0 end as dh from obs_c o left join q_fit f on o.tile = f.tile and o.mission = f.mission)")
    + f"select tile, mission, count(*) as n, {r('sum(dh)', 3)} as sum_dh, {r('max(dh)', 4)} as max_dh from cor group by all",
)
def polynomial_bias_correct(spark, d):
    o = obs_c(spark, d)
    c = fit.curvature_correct(o, o.where(~F.col("ice") & (F.abs("dh") < 10)), ["tile", "mission"], "curv", "dh")
    return c.groupBy("tile", "mission").agg(F.count(F.lit(1)).alias("n"), fixed(F.sum("dh"), 3).alias("sum_dh"), fixed(F.max("dh"), 4).alias("max_dh"))


TLL = "tll as (select n_nationkey as tile, (n_nationkey * 67 % 320) - 160.0::double as lon, (n_nationkey * 31 % 140) - 70.0::double as lat from nation)"
# sensor R does not cover the tiles of the last region: those are empty and take their neighbours' values
CUBE_R = "cube as (select b.tile, b.mission, time_bin, height_bin as h, dh from binned b join nation on n_nationkey = b.tile where not (mission = 'R' and n_regionkey = 4))"


@query(
    "knn_tile_fill",
    with_(
        *v.sql_obs_binned(), v.HYPS, TLL, CUBE_R,
        "lev as (select mission, tile, median(dh) as level from cube group by all)",
        "band as (select tile, min(height_bin) as h0, max(height_bin) as h1 from hyps where area > 0 group by tile)",
        "tg as (select 'R' as mission, n_nationkey as tile, h0, h1, lon, lat from nation join band on band.tile = n_nationkey join tll on tll.tile = n_nationkey where n_regionkey = 4)",
        f"dd as (select distinct g.mission, g.tile as target, c.tile, {sql_haversine('g.lon', 'g.lat', 't.lon', 't.lat')} as m from tg g join cube c on c.mission = g.mission and c.h between g.h0 and g.h1 join tll t on t.tile = c.tile)",
        "nr as (select mission, target, tile from (select *, row_number() over (partition by mission, target order by m, tile) as rn from dd) where rn <= 5)",
        "med as (select nr.mission, nr.target, time_bin, c.h, median(dh - level) as dh from nr join lev on lev.mission = nr.mission and lev.tile = nr.tile join cube c on c.mission = nr.mission and c.tile = nr.tile join tg on tg.tile = nr.target where c.h between h0 and h1 group by all)",
        "lv as (select nr.mission, nr.target, median(level) as level from nr join lev on lev.mission = nr.mission and lev.tile = nr.tile group by all)",
    )
    + f"select med.mission, med.target as tile, time_bin, h, {r('dh + level')} as dh from med join lv on lv.mission = med.mission and lv.target = med.target",
)
def knn_tile_fill(spark, d):
    n = v.table(spark, d, "nation").select(F.col("n_nationkey").alias("tile"), "n_regionkey")
    b = v.obs_binned(spark, d).withColumnRenamed("height_bin", "h").join(n, "tile")
    cube = b.where(~((F.col("mission") == "R") & (F.col("n_regionkey") == 4))).select("mission", "tile", "time_bin", "h", "dh")
    lev = reduce_bins(cube, ["mission", "tile"], "dh", "median", out="level").drop("nobs")
    ll = n.select("tile", ((F.col("tile") * 67 % 320) - 160.0).alias("lon"), ((F.col("tile") * 31 % 140) - 70.0).alias("lat"))
    tg = n.where("n_regionkey = 4").select(F.lit("R").alias("mission"), "tile")
    hy = v.hyps(spark, d).select("tile", F.col("height_bin").alias("h"), F.col("area").alias("area_km2"))
    f = fill.fill_empty_tiles(cube, lev, tg, ll, hy, ["mission"], "tile", "time_bin", "h")
    return f.select("mission", "tile", "time_bin", "h", fixed("dh").alias("dh"))


@query(
    "scale_classes",
    with_(v.OBS, v.MODEL_DV,
          "b as (select tile, date, mscale, pscale as x, value as y from model_dv)",
          "g as (select tile, date, mscale, list(struct_pack(x := x, y := y) order by x) as p, coalesce(list(struct_pack(x := x, y := y) order by x) filter (y >= 0), []) as ok from b group by all)",
          "nw(x) as (values (0.25::double), (0.75::double), (1.25::double), (2.5::double))",
          "e as (select tile, date, mscale, nw.x as x, p, ok, len(ok) as n, case when len(ok) <= 3 then ok when nw.x < 0.5 then ok[1:3] else ok[-3:] end as q from g cross join nw)",
          "f as (select tile, date, mscale, x, p, n, (select regr_slope(u.e.y, u.e.x) from (select unnest(q) as e) u) as s, (select avg(u.e.x) from (select unnest(q) as e) u) as mx, (select avg(u.e.y) from (select unnest(q) as e) u) as my from e)")
    + f"""select tile, date, mscale, x as pscale, {r('greatest(0.0, case when n < 2 then 0.0 when x = 0.75 then (p[1].y + p[2].y) / 2 when x = 1.25 then (p[2].y + p[3].y) / 2 else my + s * (x - mx) end)', 5)} as value from f""",
)
def scale_classes(spark, d):
    o = fit.scale_classes(v.model_dv(spark, d), ["tile", "date", "mscale"], "pscale", "value", [0.25, 0.75, 1.25, 2.5])
    return o.select("tile", "date", "mscale", "pscale", fixed("value", 5).alias("value"))


# -- per-cube non-linear work: rows-only queries, checked by property tests ------------------------

SETTINGS = [("A", 3, 5, 5.0, 8.0), ("N", 3, 5, 5.0, 8.0), ("R", 3, 5, 5.0, 8.0)]
SETTINGS_SCHEMA = "mission string, bincount_min int, smooth_n int, nmad_max double, length_scale double"


def cube30(spark, d):
    """tile, mission, date_index (90-day steps), height_index, dh, nobs."""
    o = v.obs(spark, d)
    b = binning.bin_2d(o, ["tile", "mission"], "dh", v.day_bin(90), v.height10(), "median")
    return b.select("tile", "mission", F.col("time_bin").alias("date_index"), F.col("height_bin").alias("height_index"), "dh", "nobs")


def surface_fill(spark, d):
    st = spark.createDataFrame(SETTINGS, SETTINGS_SCHEMA)
    return fill.surface_model_fill(cube30(spark, d), ["tile", "mission"], st, height_width=10.0, axis_step=90)


@query("surface_model_fill")
def surface_model_fill(spark, d):
    f, _ = fill.split_params(surface_fill(spark, d), ["tile", "mission"])
    return f.select("tile", "mission", "date_index", "height_index", fixed("dh", 3).alias("dh"), "nobs")


@query("surface_model_params")
def surface_model_params(spark, d):
    _, p = fill.split_params(surface_fill(spark, d), ["tile", "mission"])
    return p.select("tile", "mission", "t0", "h0", fixed("dh0", 4).alias("dh0"), F.size("param").alias("n_param"), fixed(F.col("param")[1], 3).alias("trend"), "nobs_final")


@query("replace_with_model")
def replace_with_model(spark, d):
    tl = v.table(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("tile"))
    o = fill.replace_with_model(cube30(spark, d), tl, "R", ["N", "A"], height_width=10.0, axis_step=90, tile="tile")
    return o.select("tile", "mission", "date_index", "height_index", fixed("dh", 3).alias("dh"), "nobs")


@query("profile_fill")
def profile_fill(spark, d):
    h = v.hyps(spark, d).select("tile", F.col("height_bin").alias("h"), "area")
    o = v.obs(spark, d).select("tile", v.day_bin(90).alias("time_bin"), v.height10().alias("h"), "dh", "mission")
    c = reduce_bins(o, ["tile", "mission", "time_bin", "h"], "dh", "median").where("nobs >= 8").drop("nobs")
    p = binning.densify(c, PK, {"h": F.sequence(F.lit(0), F.lit(5))}).join(h, ["tile", "h"], "left").fillna(0.0, subset=["area"])
    f = fill.profile_fill(p, ["tile"], ["mission", "time_bin"], "h", "dh", "area", 1, 0.3)
    return fill.profile_volume(f, PK, "dh", "area").select(*PK, fixed("dh", 5).alias("dv"))


@query("monthly_spline")
def monthly_spline(spark, d):
    o = v.obs(spark, d)
    s = o.groupBy("tile", v.day_bin(30).alias("i")).agg(F.avg("dh").alias("value"))
    s = s.select("tile", F.date_add(F.lit("1990-01-01").cast("date"), F.col("i") * 30 + 15).alias("date"), "value")
    return fill.monthly_spline(s, ["tile"], "date", "value").withColumn("value", fixed("value", 4))
