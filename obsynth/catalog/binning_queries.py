"""Filters, robust binning, area averages and seasonal fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import date_bin, date_bin_center, datenum_timestamp, decimal_year, decimal_year_day
from ..functions.models import phase_day
from ..functions.numeric import fixed
from ..operators import binning, filters, fit, robust, windows
from . import views as v
from .registry import query, r, sql_decyear, sql_nmad_ctes, sql_ols_ctes, sql_phase_fraction, sql_season, with_

BK = ["tile", "mission", "time_bin", "height_bin"]


@query(
    "decimal_year_roundtrip",
    with_("d as (select distinct cast(o_orderdate as date) as day from orders)", f"y as (select day, {sql_decyear('day')} as y from d)")
    + f"""select day, {r('y')} as decimal_year,
      cast(make_date(cast(floor(y) as bigint), 1, 1) + cast(floor(dayofyear(make_date(cast(floor(y) as bigint), 12, 31)) * (y - floor(y))) as int) as date) as back,
      cast(floor(date_diff('day', date '1990-01-01', day) / 30) as int) as date_bin,
      cast(date '1990-01-01' + cast(floor(date_diff('day', date '1990-01-01', day) / 30) * 30 + 15 as int) as date) as bin_center from y""",
)
def decimal_year_roundtrip(spark, d):
    o = v.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    o = o.withColumn("y", decimal_year("day")).withColumn("date_bin", date_bin("day"))
    return o.select("day", fixed("y").alias("decimal_year"), decimal_year_day("y").alias("back"), "date_bin", date_bin_center("date_bin").alias("bin_center"))


@query(
    "datenum_to_date",
    "select o_orderkey, cast(date '1970-01-01' + cast(floor(730000 + o_orderkey % 5000 + (o_custkey % 24) / 24.0 - 719529) as int) as date) as day, "
    "cast(o_custkey % 24 as bigint) as hour from orders",
)
def datenum_to_date(spark, d):
    o = v.table(spark, d, "orders")
    ts = datenum_timestamp(F.lit(730000) + F.col("o_orderkey") % 5000 + (F.col("o_custkey") % 24) / 24.0)
    return o.select("o_orderkey", F.to_date(ts).alias("day"), F.hour(ts).cast("long").alias("hour"))


MED = "m as (select tile, mission, median(dh) as med from obs where quality group by all)"


@query(
    "robust_range_filter",
    with_(v.OBS, "ok as (select * from obs where height != 0 and quality)", "m as (select tile, mission, median(dh) as med from ok where abs(dh) < 400 group by all)")
    + f"""select o.tile, o.mission, count(*) as n, {r('sum(dh)')} as sum_dh, {r('max(dh)')} as max_dh from ok o join m on o.tile = m.tile and o.mission = m.mission
    where abs(dh) < 400 and abs(dh - med) < 200 group by o.tile, o.mission""",
)
def robust_range_filter(spark, d):
    o = filters.valid_points(v.obs(spark, d)).where("quality")
    f = filters.robust_range(o.where(F.abs("dh") < 400), ["tile", "mission"], "dh", 200.0)
    return f.groupBy("tile", "mission").agg(F.count(F.lit(1)).alias("n"), fixed(F.sum("dh")).alias("sum_dh"), fixed(F.max("dh")).alias("max_dh"))


@query(
    "min_support_filter",
    with_(v.OBS, "c as (select tile, mission, count(*) as n from obs group by all)", "avgn as (select cast(floor(avg(n)) as bigint) as a from c)")
    + f"select o.tile, o.mission, count(*) as n, {r('avg(dh)')} as mean_dh from obs o join c on o.tile = c.tile and o.mission = c.mission where c.n >= 500 group by o.tile, o.mission",
)
def min_support_filter(spark, d):
    f = filters.min_support(v.obs(spark, d), ["tile", "mission"], 500)
    return f.groupBy("tile", "mission").agg(F.count(F.lit(1)).alias("n"), fixed(F.avg("dh")).alias("mean_dh"))


@query(
    "bin2d_median",
    with_(*v.sql_obs_binned()) + f"select tile, mission, time_bin, height_bin, {r('dh')} as dh, nobs from binned",
)
def bin2d_median(spark, d):
    return v.obs_binned(spark, d).select(*BK, fixed("dh").alias("dh"), "nobs")


def _nmad(name: str, k: int, days: int = 365):
    cells = f"cells as (select tile, mission, {v.sql_bin(days)} as time_bin, {v.SQL_H10} as height_bin, dh from obs)"
    sql = with_(v.OBS, cells, *sql_nmad_ctes("n", "cells", BK, "dh", k)) + f"select tile, mission, time_bin, height_bin, {r('v')} as dh, nobs from n_bins"

    @query(name, sql)
    def run(spark, d):
        return v.obs_binned(spark, d, f"nmad{k}", days).select(*BK, fixed("dh").alias("dh"), "nobs")

    return run


_nmad("bin2d_nmad3", 3)
_nmad("bin2d_nmad5", 5)
_nmad("bin2d_nmad10", 10)
_nmad("bin2d_nmad5_zero_mad", 5, days=90)


@query(
    "bin2d_mean_user_reducer",
    with_(v.OBS, v.OBS_CELLS) + f"select tile, mission, time_bin, height_bin, {r('stddev_samp(dh)')} as dh, count(dh) as nobs from cells group by all",
)
def bin2d_mean_user_reducer(spark, d):
    c = v.obs(spark, d).select("tile", "mission", v.year_bin().alias("time_bin"), v.height10().alias("height_bin"), "dh")
    b = binning.bin_with(c, BK, "dh", F.stddev_samp)
    return b.withColumn("dh", fixed("dh"))


@query(
    "bin2d_dense",
    with_(*v.sql_obs_binned(), "tm as (select distinct tile, mission from binned)")
    + f"""select a.tile, a.mission, a.time_bin, a.height_bin, {r('b.dh')} as dh, coalesce(b.nobs, 0) as nobs
    from (select tile, mission, cast(t as int) as time_bin, cast(h as int) as height_bin from tm cross join range(5, 13) x(t) cross join range(0, 7) z(h)) a
    left join binned b on a.tile = b.tile and a.mission = b.mission and a.time_bin = b.time_bin and a.height_bin = b.height_bin""",
)
def bin2d_dense(spark, d):
    axes = {"time_bin": F.sequence(F.lit(5), F.lit(12)), "height_bin": F.sequence(F.lit(0), F.lit(6))}
    g = binning.densify(v.obs_binned(spark, d), ["tile", "mission"], axes)
    return g.select(*BK, fixed("dh").alias("dh"), F.coalesce("nobs", F.lit(0)).cast("long").alias("nobs"))


@query(
    "bin1d_median_weighted",
    with_(v.OBS) + f"select tile, cast(floor(height / 5.0) as int) as bin, {r('median(dh)')} as dh, count(*) as nobs from obs group by all",
)
def bin1d_median_weighted(spark, d):
    return binning.bin_1d(v.obs(spark, d), ["tile"], "height", "dh", 0.0, 5.0).select("tile", "bin", fixed("dh").alias("dh"), "nobs")


@query(
    "monthly_median",
    with_(v.OBS) + f"select mission, cast(date_trunc('month', ts) as date) as month, {r('median(dh)')} as dh, count(*) as nobs from obs group by all",
)
def monthly_median(spark, d):
    return binning.monthly_median(v.obs(spark, d), ["mission"], "ts", "dh").select("mission", "month", fixed("dh").alias("dh"), "nobs")


@query(
    "nmad_outlier_score",
    with_(v.OBS, *sql_nmad_ctes("n", "obs", ["tile", "mission"], "dh", 5))
    + f"""select a.tile, a.mission, count(*) as n, sum(cast(a.d / (b.mad * 1.4826) > 3 as bigint))::bigint as n_outliers, {r('max(a.d / (b.mad * 1.4826))', 4)} as worst
    from n_d a join n_s b on a.tile = b.tile and a.mission = b.mission group by a.tile, a.mission""",
)
def nmad_outlier_score(spark, d):
    s = robust.with_nmad(v.obs(spark, d), ["tile", "mission"], "dh")
    return s.groupBy("tile", "mission").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("nmad") > 3).cast("long")).alias("n_outliers"), fixed(F.max("nmad"), 4).alias("worst"))


AREA_AVG = "area_avg as (select tile, mission, time_bin, sum(dh * area) / sum(area) as dh from binned join hyps using (tile, height_bin) group by all having sum(area) > 0)"


def _pos_area(spark, d):
    return v.hyps(spark, d)


@query(
    "area_average_series",
    with_(*v.sql_obs_binned(), v.HYPS, AREA_AVG) + f"select tile, mission, time_bin, {r('dh')} as dh from area_avg",
)
def area_average_series(spark, d):
    a = _area_avg(v.obs_binned(spark, d), v.hyps(spark, d))
    return a.select("tile", "mission", "time_bin", fixed("dh").alias("dh"))


def _area_avg(b, h):
    return binning.area_average(b, h.where("area > 0"), ["tile", "mission", "time_bin"], "dh", "tile", "height_bin", "area")


@query(
    "volume_series",
    with_(*v.sql_obs_binned(), v.HYPS,
          "need as (select tile, count(*) filter (area > 0) as need from hyps group by tile)",
          "dates as (select distinct tile, mission, time_bin from binned)",
          "have as (select tile, mission, time_bin, sum(dh * area / 1000.0) as dv, count(*) as have from binned join hyps using (tile, height_bin) where area > 0 group by all)")
    + f"""select a.tile, a.mission, a.time_bin, case when need = 0 then 0.0 when have = need then {r('dv')} end as dv
    from dates a join need using (tile) left join have h on a.tile = h.tile and a.mission = h.mission and a.time_bin = h.time_bin""",
)
def volume_series(spark, d):
    s = binning.volume_series(v.obs_binned(spark, d), v.hyps(spark, d), ["tile", "mission"], "time_bin", "dh", "tile", "height_bin", "area")
    return s.select("tile", "mission", "time_bin", fixed("dv").alias("dv"))


@query(
    "trend_slope",
    with_(v.OBS) + f"select tile, mission, {r('regr_slope(dh, ' + sql_decyear('ts') + ')')} as slope, count(*) as n from obs group by all",
)
def trend_slope(spark, d):
    s = windows.slope_per_year(v.obs(spark, d), ["tile", "mission"], decimal_year("ts"), "dh")
    return s.select("tile", "mission", fixed("slope").alias("slope"), "n")


T, C, S = sql_season("month")
T_ = "({0} - 2000.0)".format(sql_decyear("month"))


def _sql_fit(name: str, src: str, keys: list[str], accel: bool = False, phase: str = "table") -> list[str]:
    xs = ["1.0", T] + ([f"{T} * {T}"] if accel else []) + [C, S]
    i = 3 if accel else 2
    ks = ", ".join(keys)
    on = " and ".join(f"a.{k} = b.{k}" for k in keys)
    c2 = "a.b2" if accel else "0.0"
    return [
        *sql_ols_ctes(name, src, keys, xs, "value"),
        f"{name}_mean as (select {ks}, ceil(round(avg({T}), 9)) as s from {src} group by {ks})",
        f"{name}_out as (select {', '.join('a.' + k for k in keys)}, a.n, a.b0 + a.b1 * b.s + {c2} * b.s * b.s as off, a.b1 + 2 * {c2} * b.s as trend, "
        + ("a.b2 as accel, " if accel else "")
        + f"sqrt(a.b{i} * a.b{i} + a.b{i + 1} * a.b{i + 1}) as amplitude, 365.25 * {sql_phase_fraction(f'a.b{i}', f'a.b{i + 1}', phase)} as phase_day, "
        + f"a.b{i} as p_cos, a.b{i + 1} as p_sin from {name}_fit a join {name}_mean b on {on})",
    ]


@query(
    "seasonal_fit",
    with_(v.OBS, v.NATION_SERIES, *_sql_fit("f", "series", ["tile", "mission"]))
    + f"select tile, mission, n, {r('off', 5)} as off, {r('trend', 5)} as trend, {r('amplitude', 5)} as amplitude, {r('phase_day', 3)} as phase_day from f_out",
)
def seasonal_fit(spark, d):
    f = fit.seasonal_fit(v.nation_series(spark, d), ["tile", "mission"], "month", "value")
    return f.select("tile", "mission", "n", fixed("offset", 5).alias("off"), fixed("trend", 5).alias("trend"), fixed("amplitude", 5).alias("amplitude"), fixed("phase_day", 3).alias("phase_day"))


@query(
    "seasonal_fit_window",
    with_(v.OBS, v.NATION_SERIES, "cut as (select * from series where month > date '1996-01-01' and month < date '2001-01-01')", *_sql_fit("f", "cut", ["tile"], phase="peak"))
    + f"select tile, n, {r('trend', 5)} as trend, {r('amplitude', 5)} as amplitude, {r('phase_day', 3)} as peak_day from f_out",
)
def seasonal_fit_window(spark, d):
    f = fit.seasonal_fit(v.nation_series(spark, d), ["tile"], "month", "value", phase="peak", interval=("1996-01-01", "2001-01-01"))
    return f.select("tile", "n", fixed("trend", 5).alias("trend"), fixed("amplitude", 5).alias("amplitude"), fixed("phase_day", 3).alias("peak_day"))


@query(
    "seasonal_fit_accel",
    with_(v.OBS, v.NATION_SERIES, *_sql_fit("f", "series", ["tile"], accel=True))
    + f"select tile, n, {r('off', 5)} as off, {r('trend', 5)} as trend, {r('accel', 5)} as accel, {r('amplitude', 5)} as amplitude, {r('phase_day', 3)} as phase_day from f_out",
)
def seasonal_fit_accel(spark, d):
    f = fit.seasonal_fit(v.nation_series(spark, d), ["tile"], "month", "value", acceleration=True)
    return f.select(
        "tile", "n", fixed("offset", 5).alias("off"), fixed("trend", 5).alias("trend"), fixed("acceleration", 5).alias("accel"),
        fixed("amplitude", 5).alias("amplitude"), fixed("phase_day", 3).alias("phase_day"))


@query(
    "region_trends",
    with_(v.OBS, v.NATION_SERIES, "cut as (select tile, month, value from series where month between date '1996-01-01' and date '2000-12-31')",
          *_sql_fit("a", "cut", ["tile"]), *_sql_fit("b", "cut", ["tile"], accel=True))
    + f"""select a.tile, a.n, {r('a.trend', 5)} as trend, {r('b.accel', 5)} as acceleration, {r('b.amplitude', 5)} as amplitude, {r('b.phase_day', 3)} as phase
    from a_out a join b_out b on a.tile = b.tile""",
)
def region_trends(spark, d):
    f = fit.region_trends(v.nation_series(spark, d), ["tile"], "month", "value", ("1996-01-01", "2000-12-31"))
    return f.select("tile", "n", *[fixed(c, 5).alias(c) for c in ("trend", "acceleration", "amplitude")], fixed("phase", 3).alias("phase"))


@query(
    "tile_series_fit",
    with_(
        v.OBS, "ok as (select * from obs where height != 0 and abs(dh) < 400)",
        "m as (select tile, mission, median(dh) as med from ok group by all)",
        f"kept as (select o.tile, o.mission, {v.sql_bin(30)} as time_bin, {v.SQL_H10} as height_bin, dh from ok o join m on o.tile = m.tile and o.mission = m.mission where abs(dh - med) < 200)",
        *sql_nmad_ctes("n", "kept", BK, "dh", 5), v.HYPS,
        "series as (select tile, date '1990-01-01' + time_bin * 30 + 15 as month, sum(v * area) / sum(area) as value from n_bins join hyps using (tile, height_bin) where area > 0 group by tile, time_bin)",
        *_sql_fit("f", "series", ["tile"]),
    )
    + f"select tile, n, {r('trend', 5)} as trend, {r('amplitude', 5)} as amplitude, {r('phase_day', 3)} as phase_day from f_out",
)
def tile_series_fit(spark, d):
    """Flagship: robust filter -> nmad5 cells -> area-weighted 30-day series -> trend, amplitude, phase."""
    o = filters.valid_points(v.obs(spark, d)).where(F.abs("dh") < 400)
    o = filters.robust_range(o, ["tile", "mission"], "dh", 200.0)
    b = binning.bin_2d(o, ["tile", "mission"], "dh", date_bin("ts"), v.height10(), "nmad5")
    s = binning.area_average(b, v.hyps(spark, d).where("area > 0"), ["tile", "time_bin"], "dh", "tile", "height_bin", "area")
    s = s.withColumn("month", date_bin_center("time_bin"))
    f = fit.seasonal_fit(s, ["tile"], "month", "dh")
    return f.select("tile", "n", fixed("trend", 5).alias("trend"), fixed("amplitude", 5).alias("amplitude"), fixed("phase_day", 3).alias("phase_day"))
