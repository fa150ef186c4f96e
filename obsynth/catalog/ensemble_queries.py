"""Ensemble spread, merging, alignment, reference errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import decimal_year
from ..functions.numeric import fixed
from ..operators import binning, ensemble, fill, windows
from ..session import cut_lineage
from . import views as v
from .registry import query, r, sql_decyear, with_

CELL = ["tile", "time_bin", "height_bin"]
RUN = v.sql_obs_run()
REF = 3  # the nmad5 run

FLOORS = [
    "fm as (select mission, median(dh) as med from binned where dh is not null group by mission)",
    "floors as (select b.mission, median(abs(b.dh - fm.med)) as flr from binned b join fm on b.mission = fm.mission group by b.mission)",
]


@query("mission_mad_floor", with_(*v.sql_obs_binned(), *FLOORS) + f"select mission, {r('flr')} as flr from floors")
def mission_mad_floor(spark, d):
    return binning.mission_mad(v.obs_binned(spark, d)).select("mission", fixed("floor").alias("flr"))


SPREAD = "spread as (select o.mission, tile, time_bin, height_bin, stddev_samp(dh) + any_value(flr) as err, count(dh) as n_runs from obs_run o join floors f on o.mission = f.mission group by o.mission, tile, time_bin, height_bin having count(dh) > 1)"
MEDIAN_BINNED = "binned as (select * from obs_run where run_id = 1)"


def _spread(spark, d):
    runs = cut_lineage(v.obs_run(spark, d))  # read for floors, spread and merge
    floors = binning.mission_mad(runs.where("run_id = 1"))
    return runs, ensemble.spread_error(runs, floors, ["mission", *CELL])


@query(
    "ensemble_std_error",
    with_(*RUN, MEDIAN_BINNED, *FLOORS, SPREAD) + f"select mission, tile, time_bin, height_bin, n_runs, {r('err', 5)} as err from spread",
)
def ensemble_std_error(spark, d):
    _, s = _spread(spark, d)
    return s.select("mission", *CELL, "n_runs", fixed("err", 5).alias("err"))


@query(
    "inverse_variance_merge",
    with_(
        *RUN, MEDIAN_BINNED, *FLOORS, SPREAD,
        "w0 as (select o.run_id, o.mission, o.tile, o.time_bin, o.height_bin, o.dh, case when s.err > 0 and not (o.mission = 'R' and o.tile >= 20) then 1.0 / (s.err * s.err) else 0.0 end as w "
        "from obs_run o left join spread s on o.mission = s.mission and o.tile = s.tile and o.time_bin = s.time_bin and o.height_bin = s.height_bin)",
        "w1 as (select *, case when w = 0 then 0.001 else w end as ww from w0)",
    )
    + f"select run_id, tile, time_bin, height_bin, {r('sum(dh * ww) / sum(ww)', 5)} as dh, {r('sqrt(1.0 / sum(ww))', 5)} as err from w1 group by all",
)
def inverse_variance_merge(spark, d):
    runs, err = _spread(spark, d)
    # sensor R does not see tiles 20 and up
    pairs = runs.select("tile", "mission").distinct().where(~((F.col("mission") == "R") & (F.col("tile") >= 20)))
    m = ensemble.inverse_variance_merge(runs, err, CELL, visible=pairs, tile="tile")
    return m.select("run_id", *CELL, fixed("dh", 5).alias("dh"), fixed("err", 5).alias("err"))


@query(
    "area_average_runs",
    with_(*RUN, v.HYPS) + f"select run_id, tile, mission, time_bin, {r('sum(dh * area) / sum(area)')} as dh from obs_run join hyps using (tile, height_bin) where area > 0 group by all",
)
def area_average_runs(spark, d):
    a = binning.area_average(v.obs_run(spark, d), v.hyps(spark, d).where("area > 0"), ["run_id", "tile", "mission", "time_bin"], "dh", "tile", "height_bin", "area")
    return a.withColumn("dh", fixed("dh"))


@query(
    "area_average_spread",
    with_(*RUN, v.HYPS, "s as (select run_id, tile, mission, time_bin, sum(dh * area) / sum(area) as dh from obs_run join hyps using (tile, height_bin) where area > 0 group by all)")
    + f"select mission, time_bin, tile, {r('median(dh)')} as median, {r('2.0 * stddev_samp(dh)')} as err, count(dh) as n from s group by all",
)
def area_average_spread(spark, d):
    a = binning.area_average(v.obs_run(spark, d), v.hyps(spark, d).where("area > 0"), ["run_id", "tile", "mission", "time_bin"], "dh", "tile", "height_bin", "area")
    s = ensemble.area_average_spread(a, ["mission", "time_bin", "tile"])
    return s.select("mission", "time_bin", "tile", fixed("median").alias("median"), fixed("err").alias("err"), "n")


OFFS = [
    *v.sql_obs_binned(), v.HYPS,
    "avg_s as (select tile, mission, time_bin, sum(dh * area) / sum(area) as dh from binned join hyps using (tile, height_bin) where area > 0 group by all)",
    "nn as (select tile, mission, sum(nobs)::double as n from binned group by all)",
    "dif as (select a.tile, a.mission, b.mission as ref, a.time_bin, a.dh - b.dh as df from avg_s a join avg_s b on a.tile = b.tile and a.time_bin = b.time_bin where a.mission = 'R' and b.mission in ('A', 'N'))",
    "med as (select tile, mission, ref, median(df) as m from dif group by all)",
    "offs as (select med.tile, med.mission, sum(m * sqrt(n)) / sum(sqrt(n)) as off, count(*) as n_refs from med join nn on med.tile = nn.tile and med.mission = nn.mission group by all)",
]


def _offsets(spark, d):
    b = cut_lineage(v.obs_binned(spark, d))  # read for offsets and alignment
    h = v.hyps(spark, d).where("area > 0")
    return b, fill.mission_offsets(b, h, ["tile"], "time_bin", ["A", "N"], tile="tile", height="height_bin", area="area")


@query("offset_align", with_(*OFFS) + f"select b.tile, b.mission, b.time_bin, b.height_bin, {r('b.dh - coalesce(o.off, 0.0)')} as dh from binned b left join offs o on b.tile = o.tile and b.mission = o.mission")
def offset_align(spark, d):
    b, off = _offsets(spark, d)
    a = fill.align(b, off, ["tile"])
    return a.select("tile", "mission", "time_bin", "height_bin", fixed("dh").alias("dh"))


@query("mission_offsets", with_(*OFFS) + f"select tile, mission, {r('off')} as off, n_refs from offs")
def mission_offsets(spark, d):
    _, off = _offsets(spark, d)
    return off.select("tile", "mission", fixed("offset").alias("off"), "n_refs")


@query(
    "remove_mission_trend",
    with_(
        *v.sql_obs_binned(30), "c as (select *, date '1990-01-01' + time_bin * 30 + 15 as day from binned)",
        "span as (select mission, min(time_bin) as a, max(time_bin) as b from c group by mission)",
        "ax as (select mission, unnest(range(a, b + 1)) as i from span)",
        f"mid as (select mission, avg({sql_decyear('dd')}) as mid from (select mission, cast(date '1990-01-01' + cast(i as int) * 30 + 15 as date) as dd from ax) group by mission)",
    )
    + f"select tile, c.mission, time_bin, height_bin, {r('dh - (' + sql_decyear('day') + ' - mid) * case when c.mission = ' + chr(39) + 'R' + chr(39) + ' then -0.144 else 0.0 end')} as dh from c join mid on c.mission = mid.mission",
)
def remove_mission_trend(spark, d):
    b = v.obs_binned(spark, d, days=30)
    b = b.withColumn("day", F.date_add(F.lit("1990-01-01").cast("date"), F.col("time_bin") * 30 + 15))
    trends = spark.createDataFrame([("A", 0.0), ("N", 0.0), ("R", -0.144)], "mission string, land_trend double")
    o = windows.remove_trend(b, trends, "day")
    return o.select("tile", "mission", "time_bin", "height_bin", fixed("dh").alias("dh"))


@query(
    "center_on_period",
    with_(v.OBS, v.NATION_SERIES, "ref as (select tile, mission, avg(value) as ref from series where month between date '1996-01-01' and date '1998-12-31' group by all)")
    + f"select s.tile, s.mission, s.month, {r('value - ref')} as value from series s left join ref on s.tile = ref.tile and s.mission = ref.mission",
)
def center_on_period(spark, d):
    s = v.nation_series(spark, d)
    period = F.col("month").between(F.lit("1996-01-01").cast("date"), F.lit("1998-12-31").cast("date"))
    return windows.center_on(s, ["tile", "mission"], "value", period).select("tile", "mission", "month", fixed("value").alias("value"))


@query(
    "center_on_first_year",
    with_(v.OBS, v.NATION_SERIES, "d0 as (select tile, min(month) as d0 from series group by tile)",
          "ref as (select s.tile, avg(value) as ref from series s join d0 on s.tile = d0.tile where month < d0 + interval 12 month group by s.tile)")
    + f"select s.tile, s.mission, s.month, {r('value - ref')} as value from series s join ref on s.tile = ref.tile",
)
def center_on_first_year(spark, d):
    s = windows.center_on_first_year(v.nation_series(spark, d), ["tile"], "month", "value")
    return s.select("tile", "mission", "month", fixed("value").alias("value"))


@query(
    "ref_run_delta_quantile",
    with_(*RUN, f"dl as (select a.tile, a.mission, a.time_bin, a.height_bin, a.run_id, a.dh - b.dh as delta from obs_run a join obs_run b on b.run_id = {REF} and a.tile = b.tile and a.mission = b.mission and a.time_bin = b.time_bin and a.height_bin = b.height_bin)")
    + f"select tile, mission, time_bin, height_bin, {r('quantile_cont(abs(delta), 0.95)')} as q95, {r('quantile_cont(delta, 0.5)')} as q50 from dl group by all",
)
def ref_run_delta_quantile(spark, d):
    keys = ["tile", "mission", "time_bin", "height_bin"]
    dl = ensemble.delta_from_reference(v.obs_run(spark, d), REF, keys, "dh")
    a = ensemble.quantile_over_runs(dl, keys, 0.95, "delta", True, "q95")
    b = ensemble.quantile_over_runs(dl, keys, 0.5, "delta", False, "q50")
    j = a.join(b, keys)
    return j.select(*keys, fixed("q95").alias("q95"), fixed("q50").alias("q50"))


REGION_RUN = "rr as (select run_id, tile, time_bin, sum(dh * nobs) as value from obs_run group by all)"


def _region_run(spark, d):
    return v.obs_run(spark, d).groupBy("run_id", "tile", "time_bin").agg(F.sum(F.col("dh") * F.col("nobs")).alias("value"))


@query(
    "ref_and_error",
    with_(*RUN, REGION_RUN, f"ref as (select tile, time_bin, value as rv from rr where run_id = {REF})")
    + f"select rr.tile, rr.time_bin, {r('any_value(rv)', 4)} as value, {r('1.5 * quantile_cont(abs(value - rv), 0.95)', 4)} as error from rr join ref on rr.tile = ref.tile and rr.time_bin = ref.time_bin group by all",
)
def ref_and_error(spark, d):
    e = ensemble.reference_and_error(_region_run(spark, d), REF, ["tile", "time_bin"], 0.95, 1.5)
    return e.select("tile", "time_bin", fixed("value", 4).alias("value"), fixed("error", 4).alias("error"))


@query(
    "error_floor",
    with_(*RUN, REGION_RUN, f"ref as (select tile, time_bin, value as rv from rr where run_id = {REF})",
          "e as (select rr.tile, rr.time_bin, any_value(rv) as value, quantile_cont(abs(value - rv), 0.95) as error from rr join ref on rr.tile = ref.tile and rr.time_bin = ref.time_bin group by all)")
    + f"select tile, time_bin, {r('value', 4)} as value, {r('greatest(error, abs(value * 0.2))', 4)} as error, {r('abs(value * 0.2)', 4)} as compat_error from e",
)
def error_floor(spark, d):
    e = ensemble.reference_and_error(_region_run(spark, d), REF, ["tile", "time_bin"], 0.95)
    e = ensemble.error_floor(e.withColumn("compat_error", F.col("error")), 0.2)
    e = ensemble.error_floor(e, 0.2, error="compat_error", compat=True)
    return e.select("tile", "time_bin", *[fixed(c, 4).alias(c) for c in ("value", "error", "compat_error")])


@query(
    "run_rmse",
    with_(*RUN, REGION_RUN, v.OBS.replace("obs as", "obs2 as"), f"ext as (select tile, {v.sql_bin(365)} as time_bin, sum(dh) as other from obs2 group by all)")
    + f"select run_id, {r('sqrt(avg((value - other * 0.9) * (value - other * 0.9)))', 3)} as rmse, count(*) as n from rr join ext using (tile, time_bin) group by run_id",
)
def run_rmse(spark, d):
    ext = v.obs(spark, d).groupBy("tile", v.year_bin().alias("time_bin")).agg(F.sum("dh").alias("other"))
    g = ensemble.run_rmse(_region_run(spark, d), ext, ["tile", "time_bin"], 0.9)
    return g.select("run_id", fixed("rmse", 3).alias("rmse"), "n")


@query(
    "amplitude_normalize",
    with_(
        v.OBS, v.NATION_SERIES,
        # toy coefficient rows: phase and seasonal terms from the tile number
        "cube as (select tile, mission, month, avg(value) as dh, 5 + (tile % 4) * 10.0 as h from series group by all)",
    )
    + "select tile, mission, month, "
    + r(
        "dh + case when tile % 5 = 0 then 0.0 else "
        f"sin(2 * pi() * ({sql_decyear('month')} - 1999.0 + 0.125)) * (0.5 + 0.01 * (h - 20.0) + 0.001 * (h - 20.0) * (h - 20.0)) - "
        f"sin(2 * pi() * ({sql_decyear('month')} - 1998.0 + (tile % 10) / 20.0)) * (0.25 + 0.02 * (h - 15.0)) end"
    )
    + " as dh from cube",
)
def amplitude_normalize(spark, d):
    s = v.nation_series(spark, d).groupBy("tile", "mission", "month").agg(F.avg("value").alias("dh"))
    s = s.withColumn("h", 5 + (F.col("tile") % 4) * 10.0).withColumn("t", decimal_year("month"))
    t = s.select("tile").distinct().where("tile % 5 <> 0")
    z = F.lit(0.0)
    own = t.select("tile", F.lit(1998.0).alias("t0"), F.lit(15.0).alias("h0"), F.array(z, z, z, z, z, (F.col("tile") % 10) / 20.0, F.lit(0.25), F.lit(0.02), z).alias("param"))
    ref = t.select("tile", F.lit(1999.0).alias("t0"), F.lit(20.0).alias("h0"), F.array(z, z, z, z, z, F.lit(0.125), F.lit(0.5), F.lit(0.01), F.lit(0.001)).alias("param"))
    o = fill.amplitude_normalize(s, own, ref, ["tile"], "t", "h")
    return o.select("tile", "mission", "month", fixed("dh").alias("dh"))
