"""Sampling the model stack and calibrating it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import fixed
from ..functions.scales import reciprocal_grid
from ..operators import calibrate, compare, fit
from . import views as v
from .registry import query, r, sql_decyear, sql_ols_ctes, sql_phase_fraction, sql_season, with_

SERIES = "ob as (select tile, cast(date_trunc('month', ts) as date) as date, avg(dh) * 1.2 + cos(year(ts)) as value from obs group by tile, 2, year(ts))"


def observed(spark, d):
    o = v.obs(spark, d)
    g = o.groupBy("tile", F.trunc("ts", "month").alias("date")).agg(F.avg("dh").alias("m"))
    return g.select("tile", "date", (F.col("m") * 1.2 + F.cos(F.year("date").cast("double"))).alias("value"))


def params(spark, d):
    n = v.table(spark, d, "nation")
    k = F.col("n_nationkey")
    return n.select(k.alias("tile"), (0.5 + (k * 7 % 31) * 0.05).alias("pscale"), (0.2 + (k * 11 % 49) * 0.1).alias("mscale"))


PARAMS = "pr as (select n_nationkey as tile, 0.5::double + (n_nationkey * 7 % 31) * 0.05::double as p, 0.2::double + (n_nationkey * 11 % 49) * 0.1::double as m from nation)"


def _corner_sql(p: str, m: str) -> list[str]:
    """CTE brk(.., ip, im, fp, fm) from a relation cand(tile, p, m)."""
    return [
        f"brk as (select cand.*, (select max(i) from pax where v <= {p} and i < {len(v.P_AXIS) - 1}) as ip, (select max(i) from maxis where v <= {m} and i < {len(v.M_AXIS) - 1}) as im from cand)",
        f"wgt as (select b.*, (b.{p} - p0.v) / (p1.v - p0.v) as fp, (b.{m} - m0.v) / (m1.v - m0.v) as fm from brk b join pax p0 on p0.i = ip join pax p1 on p1.i = ip + 1 join maxis m0 on m0.i = im join maxis m1 on m1.i = im + 1)",
        f"smp as (select w.tile, w.{p}, w.{m}, s.date, sum(s.value * (case when s.ip = w.ip then 1 - fp else fp end) * (case when s.im = w.im then 1 - fm else fm end)) as value "
        f"from wgt w join model_dv s on s.tile = w.tile and s.ip in (w.ip, w.ip + 1) and s.im in (w.im, w.im + 1) group by w.tile, w.{p}, w.{m}, s.date)",
    ]


@query(
    "bracket_interpolate",
    with_(v.OBS, v.MODEL_DV, PARAMS, "cand as (select * from pr)", *_corner_sql("p", "m")) + f"select tile, date, {r('value', 5)} as value from smp",
)
def bracket_interpolate(spark, d):
    o = calibrate.sample_stack(v.model_dv(spark, d), params(spark, d), ["tile"], v.P_AXIS, v.M_AXIS, ["value"])
    return o.select("tile", "date", fixed("value", 5).alias("value"))


P_GRID, M_GRID = reciprocal_grid(0.5, 2.0, 0.25), reciprocal_grid(0.2, 5.0, 0.25)


def _grid(name: str, vals: list[float]) -> str:
    return f"{name}(v) as (values " + ", ".join(f"({x!r}::double)" for x in vals) + ")"


T, C, S = sql_season("date")
FACTOR = "(1.0 + sqrt(pow((case when m < 1 then 1.0 / m - 1 else m - 1 end) * 0.5, 2) + pow((case when p < 1 then 1.0 / p - 1 else p - 1 end) * 0.5, 2)) * 0.2)"
RESID = [
    "rs as (select s.tile, s.p, s.m, s.date, o.value - s.value as raw from smp s join ob o on o.tile = s.tile and o.date = s.date)",
    "res as (select *, raw - avg(raw) over (partition by tile, p, m) as value from rs)",
    *sql_ols_ctes("c", "res", ["tile", "p", "m"], ["1.0", T, C, S], "value"),
    "rm as (select tile, p, m, sqrt(avg(value * value)) as rmse from res group by all)",
    f"cost as (select c.tile, c.p, c.m, rmse, b1, sqrt(b2 * b2 + b3 * b3) as amp, (0.15 * rmse + 0.85 * sqrt(b2 * b2 + b3 * b3)) * {FACTOR.replace('m <', 'c.m <').replace('/ m', '/ c.m').replace('else m', 'else c.m').replace('p <', 'c.p <').replace('/ p', '/ c.p').replace('else p', 'else c.p')} as cost from c_fit c join rm on rm.tile = c.tile and rm.p = c.p and rm.m = c.m)",
]
GRID = [v.OBS, v.MODEL_DV, SERIES, _grid("pg", P_GRID), _grid("mg", M_GRID), "cand as (select n_nationkey as tile, pg.v as p, mg.v as m from nation cross join pg cross join mg)", *_corner_sql("p", "m"), *RESID]


@query(
    "grid_search_costs",
    with_(*GRID) + f"select tile, {r('p')} as pscale, {r('m')} as mscale, {r('cost', 4)} as cost, {r('rmse', 4)} as rmse, {r('amp', 4)} as amplitude from cost",
)
def grid_search_costs(spark, d):
    o = calibrate.grid_search(observed(spark, d), v.model_dv(spark, d), ["tile"], v.P_AXIS, v.M_AXIS, P_GRID, M_GRID, all_costs=True)
    return o.select("tile", fixed("pscale").alias("pscale"), fixed("mscale").alias("mscale"), *[fixed(c, 4).alias(c) for c in ("cost", "rmse", "amplitude")])


@query(
    "grid_search_calibrate",
    with_(*GRID, "k as (select *, row_number() over (partition by tile order by round(cost, 9), p, m) as rn from cost)") + f"select tile, {r('p')} as pscale, {r('m')} as mscale, {r('cost', 4)} as cost from k where rn = 1",
)
def grid_search_calibrate(spark, d):
    o = calibrate.grid_search(observed(spark, d), v.model_dv(spark, d), ["tile"], v.P_AXIS, v.M_AXIS, P_GRID, M_GRID)
    return o.select("tile", fixed("pscale").alias("pscale"), fixed("mscale").alias("mscale"), fixed("cost", 4).alias("cost"))


@query(
    "grid_search_groups",
    with_(v.OBS, v.MODEL_DV.replace("model_dv as", "mdv0 as"), SERIES.replace("ob as", "ob0 as"), "grp as (select n_nationkey as tile, n_regionkey as g from nation)",
          "ob as (select g as tile, date, sum(value) as value from ob0 join grp using (tile) group by all)",
          "model_dv as (select g as tile, date, ip, im, sum(value) as value from mdv0 join grp using (tile) group by all)",
          _grid("pg", P_GRID), _grid("mg", M_GRID), "cand as (select r_regionkey as tile, pg.v as p, mg.v as m from region cross join pg cross join mg)", *_corner_sql("p", "m"), *RESID,
          "tc as (select tile, p, m, 0.15 * abs(b1) * (1.0 + sqrt(pow((case when m < 1 then 1.0 / m - 1 else m - 1 end) * 0.5, 2) + pow((case when p < 1 then 1.0 / p - 1 else p - 1 end) * 0.5, 2)) * 0.2) as cost from cost)",
          "k as (select *, row_number() over (partition by tile order by round(cost, 9), p, m) as rn from tc)")
    + f"select tile as grp, {r('p')} as pscale, {r('m')} as mscale, {r('cost', 4)} as cost from k where rn = 1",
)
def grid_search_groups(spark, d):
    g = v.table(spark, d, "nation").select(F.col("n_nationkey").alias("tile"), F.col("n_regionkey").alias("group"))
    ob = calibrate.group_series(observed(spark, d), g, ["value"], tile="tile")
    st = calibrate.group_series(v.model_dv(spark, d), g, ["value"], ["pscale", "mscale"], tile="tile")
    o = calibrate.grid_search(ob, st, ["group"], v.P_AXIS, v.M_AXIS, P_GRID, M_GRID, calibrate_to="trend")
    return o.select(F.col("group").alias("grp"), fixed("pscale").alias("pscale"), fixed("mscale").alias("mscale"), fixed("cost", 4).alias("cost"))


NODES = [v.OBS, v.MODEL_DV, SERIES, "smp as (select tile, pscale as p, mscale as m, date, value from model_dv)", *RESID]


def residuals(spark, d):
    ob = observed(spark, d).withColumnRenamed("value", "obs")
    j = v.model_dv(spark, d).join(ob, ["tile", "date"])
    return j.select("tile", "pscale", "mscale", "date", (F.col("obs") - F.col("value")).alias("residual"))


def _cost(spark, d, target):
    c = calibrate.cost_from_residuals(residuals(spark, d), ["tile", "pscale", "mscale"], calibrate_to=target)
    return c.select("tile", fixed("pscale").alias("pscale"), fixed("mscale").alias("mscale"), fixed("cost", 4).alias("cost"))


@query("cost_all", with_(*NODES) + f"select tile, {r('p')} as pscale, {r('m')} as mscale, {r('cost', 4)} as cost from cost")
def cost_all(spark, d):
    return _cost(spark, d, "all")


@query("cost_trend", with_(*NODES) + f"select tile, {r('p')} as pscale, {r('m')} as mscale, {r('0.15 * abs(b1) * ' + FACTOR, 4)} as cost from cost")
def cost_trend(spark, d):
    return _cost(spark, d, "trend")


@query(
    "cost_five_year",
    with_(*NODES, "r5 as (select tile, p, m, cast(floor(year(date) / 5) as int) as five, date, value from res)", *sql_ols_ctes("w", "r5", ["tile", "p", "m", "five"], ["1.0", T, C, S], "value"),
          "w5 as (select tile, p, m, sqrt(avg(b1 * b1)) as t from w_fit group by all)")
    + f"select tile, {r('p')} as pscale, {r('m')} as mscale, {r('0.15 * t * ' + FACTOR, 4)} as cost from w5",
)
def cost_five_year(spark, d):
    return _cost(spark, d, "five_year")


@query(
    "cost_annual",
    with_(*NODES,
          f"mo as (select tile, p, m, month(date '2000-01-01' + cast(floor(366.0 * {sql_phase_fraction('b2', 'b3', 'series')}) as int)) as pm from c_fit)",
          "lo as (select tile, p, m, (pm + 5) % 12 + 1 as mm from mo)",
          "sp as (select tile, p, m, min(year(date)) as y0, max(year(date)) as y1 from res group by all)",
          "yy as (select sp.tile, sp.p, sp.m, unnest(range(y0, y1 + 1)) as y, mm from sp join lo on lo.tile = sp.tile and lo.p = sp.p and lo.m = sp.m)",
          "nr as (select yy.tile, yy.p, yy.m, y, res.value, row_number() over (partition by yy.tile, yy.p, yy.m, y order by abs(date_diff('day', make_date(y, mm, 15), date)), date) as rn from yy join res on res.tile = yy.tile and res.p = yy.p and res.m = yy.m and abs(year(date) - y) <= 1)",
          "an as (select tile, p, m, sqrt(avg(value * value)) as t from nr where rn = 1 group by all)")
    + f"select tile, {r('p')} as pscale, {r('m')} as mscale, {r('0.15 * t * ' + FACTOR, 4)} as cost from an",
)
def cost_annual(spark, d):
    return _cost(spark, d, "annual")


@query(
    "amplitude_comparison",
    with_(v.OBS, v.MODEL_DV, SERIES, "mm as (select tile, pscale, mscale, date, value from model_dv)",
          *sql_ols_ctes("a", "ob", ["tile"], ["1.0", T, C, S], "value"), *sql_ols_ctes("b", "mm", ["tile", "pscale", "mscale"], ["1.0", T, C, S], "value"))
    + f"select a.tile, pscale, mscale, {r('sqrt(a.b2 * a.b2 + a.b3 * a.b3)', 4)} as observed, {r('sqrt(b.b2 * b.b2 + b.b3 * b.b3)', 4)} as modelled, {r('(sqrt(b.b2 * b.b2 + b.b3 * b.b3) / sqrt(a.b2 * a.b2 + a.b3 * a.b3) - 1) * 100', 2)} as percent from a_fit a join b_fit b on a.tile = b.tile",
)
def amplitude_comparison(spark, d):
    a = fit.seasonal_fit(observed(spark, d), ["tile"], "date", "value")
    b = fit.seasonal_fit(v.model_dv(spark, d), ["tile", "pscale", "mscale"], "date", "value")
    o = compare.amplitude_difference(a, b, ["tile"], by=["pscale", "mscale"])
    return o.select("tile", "pscale", "mscale", fixed("observed", 4).alias("observed"), fixed("modelled", 4).alias("modelled"), fixed("percent", 2).alias("percent"))


@query(
    "discharge_adjusted_volume",
    with_(v.OBS, SERIES, "d0 as (select min(date) as d0 from ob)", "q as (select n_nationkey as tile, n_nationkey * 0.01 as q from nation where n_regionkey < 3)")
    + f"select ob.tile, date, {r('value - (' + sql_decyear('date') + ' - ' + sql_decyear('d0') + ') * coalesce(q, 0.0)', 5)} as value from ob cross join d0 left join q on q.tile = ob.tile",
)
def discharge_adjusted_volume(spark, d):
    from ..functions.dates import decimal_year
    from ..functions.units import subtract_discharge

    ob = observed(spark, d)
    t0 = ob.agg(F.min("date")).scalar()  # the start of the axis, a scalar subquery
    q = v.table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("tile"), (F.col("n_nationkey") * 0.01).alias("q"))
    j = ob.join(q, "tile", "left")
    age = decimal_year("date") - decimal_year(t0)
    return j.select("tile", "date", fixed(subtract_discharge("value", age, "q"), 5).alias("value"))
