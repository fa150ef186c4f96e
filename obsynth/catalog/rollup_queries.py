"""Regions, budgets, downscaling, reports, comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scales, units
from ..functions.numeric import fixed
from ..functions.run_keys import binned_to_filled, filled_key, filled_to_synthesized, parse_run_key
from ..operators import binning, fit, merge, reports, rollup, windows
from ..schema import region_members
from . import views as v
from .registry import query, r, sql_decyear, with_

MEMBERS = (
    "members as (select cast(i as int) as region, cast(i as int) as member from range(0, 25) x(i) union all "
    "select 98, cast(i as int) from range(13, 16) x(i) union all select 99, cast(i as int) from range(1, 20) x(i))"
)


def members(spark):
    return region_members(spark, codes=range(0, 25))


MASS = "mass as (select s_nationkey as code, cast(date_trunc('month', l_shipdate) as date) as month, sum(l_extendedprice) / 1e6 as dm, sum(l_quantity) as area from lineitem join supplier on l_suppkey = s_suppkey group by all)"


def mass(spark, d):
    li = v.table(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    su = v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("code"))
    j = li.join(su, "l_suppkey")
    return j.groupBy("code", F.trunc("l_shipdate", "month").alias("month")).agg((F.sum("l_extendedprice") / 1e6).alias("dm"), F.sum("l_quantity").alias("area"))


@query(
    "region_rollup_composites",
    with_(MASS, MEMBERS) + f"select region, month, {r('sum(dm)')} as dm, {r('sum(area)', 2)} as area from mass join members on code = member group by all",
)
def region_rollup_composites(spark, d):
    g = rollup.region_rollup(mass(spark, d), members(spark), ["month"], ["dm", "area"])
    return g.select("region", "month", fixed("dm").alias("dm"), fixed("area", 2).alias("area"))


@query(
    "region_area_totals",
    with_("a as (select s_nationkey as code, sum(s_acctbal) / 100 as area from supplier group by all)", MEMBERS)
    + f"select region, {r('sum(area)', 4)} as area from a join members on code = member group by all",
)
def region_area_totals(spark, d):
    a = v.table(spark, d, "supplier").select(F.col("s_nationkey").alias("code"), (F.col("s_acctbal") / 100).alias("area"))
    return rollup.region_rollup(a, members(spark), [], ["area"]).select("region", fixed("area", 4).alias("area"))


@query(
    "region_quadrature_error",
    with_("a as (select s_nationkey as code, s_acctbal as value, 1 + s_suppkey % 7 as err from supplier)", MEMBERS)
    + f"select region, {r('sum(value)', 4)} as value, {r('sqrt(sum(err * err))')} as err from a join members on code = member group by all",
)
def region_quadrature_error(spark, d):
    a = v.table(spark, d, "supplier").select(F.col("s_nationkey").alias("code"), F.col("s_acctbal").alias("value"), (1 + F.col("s_suppkey") % 7).cast("double").alias("err"))
    g = rollup.region_quadrature(a, members(spark), [], "value", "err")
    return g.select("region", fixed("value", 4).alias("value"), fixed("err").alias("err"))


@query(
    "region_discharge",
    with_(v.SITES, v.ZONE_EDGES, f"hit as ({v.sql_in_zone('sites', 'site_id, value')})", MEMBERS)
    + f"select region, {r('sum(value)', 4)} as value, {r('abs(sum(value)) * 0.15', 4)} as error from hit join members on zone = member group by region",
)
def region_discharge(spark, d):
    from ..operators.spatial import points_in_zones

    hit = points_in_zones(v.sites(spark, d), v.zones(spark, d), 10.0)
    g = rollup.region_discharge(hit.withColumnRenamed("zone", "code"), members(spark), "value")
    return g.select("region", fixed("value", 4).alias("value"), fixed("error", 4).alias("error"))


@query(
    "group_share_average",
    with_(MASS, "t as (select code % 5 as grp, month, sum(dm) as s, sum(area) as a from mass group by all)")
    + f"select code, mass.month, {r('s / a * area')} as shared from mass join t on code % 5 = grp and mass.month = t.month",
)
def group_share_average(spark, d):
    m = mass(spark, d).withColumn("grp", F.col("code") % 5)
    return rollup.group_share(m, ["grp"], "month", "dm", "area").select("code", "month", fixed("shared").alias("shared"))


BUDGET = (
    "b as (select l_orderkey, l_linenumber, l_quantity - 5 as acc, l_extendedprice / 5000 - 1 as melt, l_quantity * l_discount * 4 - 1 as refreeze, l_tax * 10 as ec, "
    "l_discount * 3 as fac, l_quantity / 10 - 1 as rain from lineitem)"
)


def budget(spark, d):
    li = v.table(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") - 5).alias("acc"), (F.col("l_extendedprice") / 5000 - 1).alias("melt"),
        (F.col("l_quantity") * F.col("l_discount") * 4 - 1).alias("refreeze"), (F.col("l_tax") * 10).alias("ec"),
        (F.col("l_discount") * 3).alias("fac"), (F.col("l_quantity") / 10 - 1).alias("rain"))


@query(
    "derived_budget_terms",
    with_(BUDGET)
    + f"""select l_linenumber, count(*) as n, {r('sum(melt - refreeze)', 3)} as runoff, {r('sum(acc - melt + refreeze - ec)', 3)} as smb,
    {r('sum((acc - melt + refreeze - ec) / 0.91 + fac)', 3)} as dv, {r('sum(acc - ec)', 3)} as net_acc,
    {r('(sum(melt - refreeze) + 5.0) / sum(acc - ec)')} as gsi, {r('sum((((acc - melt + refreeze - ec) / 0.91 + fac) - fac) * 0.91)', 3)} as dm from b group by all""",
)
def derived_budget_terms(spark, d):
    b = units.add_budget_terms(budget(spark, d)).withColumn("dm", units.mass_change("dv", "fac"))
    g = b.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("runoff", "smb", "dv", "net_acc", "dm")])
    g = g.withColumn("gsi", units.state_index("runoff", F.lit(5.0), "net_acc"))
    return g.select("l_linenumber", "n", *[fixed(c, 3).alias(c) for c in ("runoff", "smb", "dv", "net_acc", "dm")], fixed("gsi").alias("gsi"))


@query(
    "physical_constraints",
    with_(
        BUDGET,
        "c as (select l_linenumber, greatest(acc, 0.0) as acc, greatest(rain, 0.0) as rain, greatest(melt, 0.0) as melt, least(greatest(refreeze, 0.0), greatest(melt, 0.0)) as refreeze, ec from b)",
    )
    + f"select l_linenumber, {r('sum(acc)', 3)} as acc, {r('sum(rain)', 3)} as rain, {r('sum(refreeze)', 3)} as refreeze, {r('sum(melt - refreeze)', 3)} as runoff, {r('sum(acc - (melt - refreeze) - ec)', 3)} as smb from c group by all",
)
def physical_constraints(spark, d):
    c = units.constrain_rates(budget(spark, d))
    return c.groupBy("l_linenumber").agg(*[fixed(F.sum(x), 3).alias(x) for x in ("acc", "rain", "refreeze", "runoff", "smb")])


@query(
    "unit_conversions",
    f"""select c_custkey, {r('c_acctbal * 1e9 / 365.25 / 24 / 60 / 60')} as m3s, {r('c_acctbal * 0.91')} as gt, {r('c_acctbal * (1000.0 / 910.0)')} as km3,
    {r('c_acctbal * 1e12 / ((c_custkey % 13) * 1e6)', 3)} as kgm2, {r('c_acctbal / ((c_custkey % 13) / 1000.0)', 3)} as m from customer where c_custkey % 13 > 0
    union all select c_custkey, {r('c_acctbal * 1e9 / 365.25 / 24 / 60 / 60')}, {r('c_acctbal * 0.91')}, {r('c_acctbal * (1000.0 / 910.0)')}, null, null from customer where c_custkey % 13 = 0""",
)
def unit_conversions(spark, d):
    c = v.table(spark, d, "customer")
    a = (F.col("c_custkey") % 13).cast("double")
    return c.select(
        "c_custkey", fixed(units.gt_per_year_to_m3_per_s("c_acctbal")).alias("m3s"), fixed(units.km3_to_gt("c_acctbal")).alias("gt"),
        fixed(units.gt_to_km3("c_acctbal")).alias("km3"), fixed(units.gt_to_kg_per_m2("c_acctbal", a), 3).alias("kgm2"), fixed(units.km3_to_m("c_acctbal", a), 3).alias("m"))


@query(
    "scale_axis_histogram",
    "select s_nationkey as region, cast(floor(if(s >= 1, s - 1, 1 - 1 / s) / 0.5) as int) as bin, count(*) as n from (select s_nationkey, 0.2 + (s_suppkey % 47) / 10.0 as s from supplier) group by all",
)
def scale_axis_histogram(spark, d):
    s = v.table(spark, d, "supplier").select(F.col("s_nationkey").alias("region"), (0.2 + (F.col("s_suppkey") % 47) / 10.0).alias("s"))
    return binning.histogram(s, ["region"], {"bin": F.floor(scales.scale_to_linear("s") / 0.5).cast("int")})


@query(
    "scale_axis_inverse",
    f"select s_suppkey, {r('0.2 + (s_suppkey % 47) / 10.0')} as s from supplier",
)
def scale_axis_inverse(spark, d):
    s = v.table(spark, d, "supplier").select("s_suppkey", scales.scale_to_linear(0.2 + (F.col("s_suppkey") % 47) / 10.0).alias("x"))
    return s.select("s_suppkey", fixed(scales.linear_to_scale("x", whole=True)).alias("s"))


@query(
    "dominant_parent",
    with_("g as (select c_mktsegment, c_nationkey, sum(abs(c_acctbal)) as s from customer group by all)",
          "k as (select *, row_number() over (partition by c_mktsegment order by s desc, c_nationkey) as rn, sum(s) over (partition by c_mktsegment) as tot from g)")
    + f"select c_mktsegment, {r('tot', 4)} as area, c_nationkey as tile from k where rn = 1",
)
def dominant_parent(spark, d):
    c = v.table(spark, d, "customer").select("c_mktsegment", F.col("c_nationkey").alias("tile"), F.abs("c_acctbal").alias("area"))
    return rollup.dominant_parent(c, ["c_mktsegment"], "tile", "area").select("c_mktsegment", fixed("area", 4).alias("area"), "tile")


@query(
    "exclusive_region",
    with_("f as (select s_nationkey as tile, s_suppkey % 6 as region, round(sum(s_acctbal)) as frac from supplier group by all)",
          "k as (select *, row_number() over (partition by tile order by frac desc, region) as rn from f)", "l as (select tile, max(region) filter (frac > 0) as last_region from f group by tile)")
    + "select k.tile, k.region, k.frac, cast(coalesce(l.last_region, 0) as bigint) as last_region from k join l on k.tile = l.tile where rn = 1",
)
def exclusive_region(spark, d):
    s = v.table(spark, d, "supplier")
    f = s.groupBy(F.col("s_nationkey").alias("tile"), (F.col("s_suppkey") % 6).alias("region")).agg(F.rint(F.sum("s_acctbal")).alias("frac"))
    m = f.groupBy("tile").agg(F.map_from_entries(F.collect_list(F.struct("region", "frac"))).alias("region_frac"))
    return rollup.exclusive_region(m, "tile").join(rollup.last_positive_region(m, "tile").withColumnRenamed("region", "last_region"), "tile")


CHILD = "child as (select c_custkey as cid, c_nationkey as tile, cast(abs(hash_bin) as int) as height_bin, area from (select c_custkey, c_nationkey, c_custkey % 6 as hash_bin, abs(c_acctbal) / 100 as area from customer union all select c_custkey, c_nationkey, (c_custkey + 1) % 6, 1.5 from customer))"


def child_hyps(spark, d):
    c = v.table(spark, d, "customer")
    a = c.select(F.col("c_custkey").alias("cid"), F.col("c_nationkey").alias("tile"), (F.col("c_custkey") % 6).cast("int").alias("height_bin"), (F.abs("c_acctbal") / 100).alias("area"))
    b = c.select(F.col("c_custkey").alias("cid"), F.col("c_nationkey").alias("tile"), ((F.col("c_custkey") + 1) % 6).cast("int").alias("height_bin"), F.lit(1.5).alias("area"))
    return a.unionByName(b)


@query(
    "downscale_to_children",
    with_(*v.sql_obs_binned(), CHILD)
    + f"select mission, cid, time_bin, {r('sum(dh * area) / sum(area)')} as dh from child c join binned b on c.tile = b.tile and c.height_bin = b.height_bin where area > 0 group by all",
)
def downscale_to_children(spark, d):
    b = v.obs_binned(spark, d).select("mission", "tile", "time_bin", "height_bin", "dh")
    g = rollup.downscale_profile(b, child_hyps(spark, d), "cid", "time_bin", "dh", "tile", "height_bin", "area", by=["mission"])
    return g.withColumn("dh", fixed("dh"))


@query(
    "disaggregate_conserves",
    with_(MASS, "tot as (select code, sum(area) as ta from (select c_nationkey as code, abs(c_acctbal) + 1 as area from customer) group by code)",
          "cells as (select c_custkey, c_nationkey as code, abs(c_acctbal) + 1 as area from customer)",
          "detail as (select cells.code, month, sum(dm / ta * cells.area) as detail from cells join tot on cells.code = tot.code join mass on mass.code = cells.code group by all)")
    + f"select d.code, {r('sum(detail)', 4)} as detail, {r('sum(dm)', 4)} as whole, true as ok from detail d join mass m on d.code = m.code and d.month = m.month group by d.code",
)
def disaggregate_conserves(spark, d):
    m = mass(spark, d)
    cells = v.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("code"), (F.abs("c_acctbal") + 1).alias("cell_area"))
    tot = cells.groupBy("code").agg(F.sum("cell_area").alias("ta"))
    rate = m.join(tot, "code").select("code", "month", (F.col("dm") / F.col("ta")).alias("rate"))
    fine = rollup.downscale_by_area(rate, cells, "code", "rate", "cell_area", "dm")
    out = rollup.reconcile(fine, m, ["code"], "dm", 0.0015)
    return out.where("detail is not null").select("code", fixed("detail", 4).alias("detail"), fixed("whole", 4).alias("whole"), "ok")


@query(
    "reconcile_totals",
    with_(v.FLUX, "a as (select month, sum(flux) as detail from flux group by month)",
          "b as (select cast(date_trunc('month', o_orderdate) as date) as month, sum(o_totalprice) / 1e6 as whole from orders group by 1)")
    + f"select a.month, {r('detail')} as detail, {r('whole')} as whole, abs(detail / whole - 1) <= 0.0015 as ok from a join b on a.month = b.month",
)
def reconcile_totals(spark, d):
    whole = v.table(spark, d, "orders").select(F.trunc("o_orderdate", "month").alias("month"), (F.col("o_totalprice") / 1e6).alias("flux"))
    o = rollup.reconcile(v.flux(spark, d), whole, ["month"], "flux", 0.0015)
    return o.select("month", fixed("detail").alias("detail"), fixed("whole").alias("whole"), "ok")


FITS = (
    "fits as (select s_nationkey as region, 'dm' as var, 'trend' as parameter, sum(s_acctbal) / 1000 as value, stddev_pop(s_acctbal) / 1000 as error from supplier group by 1 "
    "union all select s_nationkey, 'dm', 'phase', 100 + s_nationkey + 0.25, 3.75 from supplier group by 1, 4 "
    "union all select s_nationkey, 'dv', 'trend', sum(s_acctbal) / 500, 1.125 from supplier group by 1)"
)


def fits(spark, d):
    s = v.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("region")).agg((F.sum("s_acctbal") / 1000).alias("t"), (F.stddev_pop("s_acctbal") / 1000).alias("e"))
    row = lambda var, par, val, err: F.struct(F.lit(var).alias("var"), F.lit(par).alias("parameter"), val.alias("value"), err.alias("error"))
    return s.select("region", F.explode(F.array(
        row("dm", "trend", F.col("t"), F.col("e")), row("dm", "phase", 100 + F.col("region") + 0.25, F.lit(3.75)), row("dv", "trend", F.col("t") * 2, F.lit(1.125)))).alias("x")).select("region", "x.*")


@query(
    "value_error_table",
    with_(FITS)
    + """select region, max(case when var = 'dm' and parameter = 'trend' then printf('%.2f ± %.2f', round_even(value, 2), round_even(error, 2)) end) as "dm_trend_[Gt/yr]",
    max(case when var = 'dm' and parameter = 'phase' then printf('%d ± %d', cast(round_even(value, 0) as bigint), cast(round_even(error, 0) as bigint)) end) as "dm_phase_[day_of_max]",
    max(case when var = 'dv' and parameter = 'trend' then printf('%.2f ± %.2f', round_even(value, 2), round_even(error, 2)) end) as "dv_trend_[km^3/yr]" from fits group by region""",
)
def value_error_table(spark, d):
    t = reports.error_bar_table(fits(spark, d), ["dm", "dv"], ["trend", "phase"])
    return t.drop("dv_phase_[day_of_max]").select("region", "dm_trend_[Gt/yr]", "dm_phase_[day_of_max]", "dv_trend_[km^3/yr]")


@query(
    "compact_fit_table",
    with_(FITS)
    + """select region, max(case when var = 'dm' then printf('%.2f ± %.2f', round_even(value, 2), round_even(error, 2)) end) as "dm_trend_[Gt/yr]",
    max(case when var = 'dv' then printf('%.2f', round_even(value, 2)) end) as "dv_trend_[km^3/yr]" from fits where parameter = 'trend' group by region""",
)
def compact_fit_table(spark, d):
    return reports.compact_table(fits(spark, d), ["dm", "dv"], no_error=["dv"], no_acceleration=["dm", "dv"])


@query(
    "conversion_factors",
    with_("f as (select n_regionkey as region, sum(s_acctbal) / sum(s_suppkey + 1) as factor from supplier join nation on s_nationkey = n_nationkey group by 1)")
    + f"select region, {r('factor')} as factor, factor = min(factor) over () as is_min, factor = max(factor) over () as is_max from f",
)
def conversion_factors(spark, d):
    j = v.table(spark, d, "supplier").join(v.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    g = j.groupBy(F.col("n_regionkey").alias("region")).agg(F.sum("s_acctbal").alias("dm"), F.sum((F.col("s_suppkey") + 1).cast("double")).alias("dv"))
    return reports.conversion_factors(g, "region", "dm", "dv").withColumn("factor", fixed("factor"))


@query(
    "net_change_ranking",
    with_(v.OBS, v.NATION_SERIES, "s as (select tile, month, avg(value) as value from series group by all)",
          "c as (select tile, arg_max(value, month) - arg_min(value, month) as change from s group by tile)")
    + f"select tile, {r('change')} as change, cast(row_number() over (order by change, tile) as int) as rank from c",
)
def net_change_ranking(spark, d):
    s = v.nation_series(spark, d).groupBy("tile", "month").agg(F.avg("value").alias("value"))
    c = rollup.ranked(windows.net_change(s, ["tile"], "month", "value"), [F.col("change"), F.col("tile")])
    return c.select("tile", fixed("change").alias("change"), "rank")


@query(
    "region_list_sums",
    with_(FITS, "lists(name, region) as (values ('low', 0), ('low', 1), ('low', 2), ('mixed', 2), ('mixed', 13), ('mixed', 24))")
    + f"select name, {r('sum(value)')} as value, {r('sum(error)')} as error from fits f join lists l on f.region = l.region where var = 'dm' and parameter = 'trend' group by name",
)
def region_list_sums(spark, d):
    lists = spark.createDataFrame([("low", 0), ("low", 1), ("low", 2), ("mixed", 2), ("mixed", 13), ("mixed", 24)], "name string, region int")
    f = fits(spark, d).where("var = 'dm' and parameter = 'trend'")
    return f.join(lists, "region").groupBy("name").agg(fixed(F.sum("value")).alias("value"), fixed(F.sum("error")).alias("error"))


@query(
    "model_compare",
    with_("own as (select o_custkey % 10 as basin, year(o_orderdate) as yr, month(o_orderdate) as mo, sum(o_totalprice) / 1e6 as v from orders group by all)",
          "ownyr as (select basin, yr, sum(v) as v from own group by all having count(distinct mo) = 12)",
          "oth as (select o_custkey % 10 as basin, o_orderkey % 5 as gcm, year(o_orderdate) as yr, sum(o_totalprice) / 2e5 as v from orders group by all)",
          "med as (select basin, yr, median(v) as o from oth group by all)")
    + f"""select basin, {r('avg(v)', 5)} as own_mean, {r('avg(o)', 5)} as other_mean, {r('case when count(*) > 1 then regr_slope(v, yr) end', 5)} as own_trend, {r('case when count(*) > 1 then regr_slope(o, yr) end', 5)} as other_trend,
    count(*) as n_years, {r('(avg(v) / avg(o) - 1) * 100', 4)} as percent_diff from ownyr join med using (basin, yr) group by basin""",
)
def model_compare(spark, d):
    o = v.table(spark, d, "orders").select((F.col("o_custkey") % 10).alias("basin"), F.to_date("o_orderdate").alias("day"), "o_totalprice", (F.col("o_orderkey") % 5).alias("gcm"))
    own = rollup.annual_totals(o.withColumn("v", F.col("o_totalprice") / 1e6), ["basin"], "day", "v")
    oth = o.groupBy("basin", "gcm", F.year("day").alias("year")).agg((F.sum("o_totalprice") / 2e5).alias("v"))
    c = rollup.compare_models(own, oth, ["basin"], "year", "v")
    return c.select("basin", *[fixed(x, 5).alias(x) for x in ("own_mean", "other_mean", "own_trend", "other_trend")], "n_years", fixed("percent_diff", 4).alias("percent_diff"))


@query(
    "monthly_climatology",
    with_(v.FLUX) + f"select comid % 20 as basin, cast(month(month) as int) as mo, {r('avg(flux)')} as flux from flux group by 1, 2",
)
def monthly_climatology(spark, d):
    f = v.flux(spark, d).withColumn("basin", F.col("comid") % 20)
    c = rollup.monthly_climatology(f, ["basin"], "month", "flux")
    return c.select("basin", F.col("month").alias("mo"), fixed("flux").alias("flux"))


@query(
    "wide_to_long",
    f"""select p_partkey, 'p_retailprice' as var, {r('p_retailprice', 4)} as value from part union all select p_partkey, 'p_size', {r('p_size::double', 4)} from part""",
)
def wide_to_long(spark, d):
    p = v.table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return merge.lengthen(p, ["p_partkey"], ["p_size", "p_retailprice"]).withColumn("value", fixed("value", 4))


@query(
    "long_to_wide",
    with_(v.OBS) + f"""select tile, {r("avg(dh) filter (mission = 'A')")} as "A", {r("avg(dh) filter (mission = 'N')")} as "N", {r("avg(dh) filter (mission = 'R')")} as "R" from obs group by tile""",
)
def long_to_wide(spark, d):
    g = v.obs(spark, d).groupBy("tile", "mission").agg(fixed(F.avg("dh")).alias("dh"))
    return merge.widen(g, ["tile"], "mission", "dh", ["A", "N", "R"])


@query(
    "parse_run_key",
    """with k as (select p_partkey, concat(case when p_partkey % 2 = 0 then 'glacier' else 'glacier_rgi7' end, '_dh_', case when p_partkey % 3 = 0 then 'best' else 'cop30_v2' end,
      case when p_partkey % 5 = 0 then '_cc_' else '_' end, (['median', 'nmad3', 'nmad5'])[cast(p_size % 3 + 1 as int)], '_v01', case when p_partkey % 7 = 0 then '_filled_ac_p' else '_filled_p' end, p_size % 4 + 1, '_aligned') as key from part)
    select p_partkey, key, replace(key, 'aligned', 'synthesized') as synth_key, case when p_partkey % 2 = 0 then 'glacier' else 'glacier_rgi7' end as surface_mask,
      case when p_partkey % 3 = 0 then 'best' else 'cop30_v2' end as dem_id, p_partkey % 5 = 0 as curvature_correct, (['median', 'nmad3', 'nmad5'])[cast(p_size % 3 + 1 as int)] as binning_method,
      'v01' as project_id, p_partkey % 7 = 0 as amplitude_correct, cast(p_size % 4 + 1 as int) as fill_param from k join part using (p_partkey)""",
)
def parse_run_key_query(spark, d):
    p = v.table(spark, d, "part").select("p_partkey", "p_size")
    p = p.withColumns({
        "m": F.when(F.col("p_partkey") % 2 == 0, "glacier").otherwise("glacier_rgi7"), "dem": F.when(F.col("p_partkey") % 3 == 0, "best").otherwise("cop30_v2"),
        "cc": F.col("p_partkey") % 5 == 0, "meth": F.element_at(F.array(F.lit("median"), F.lit("nmad3"), F.lit("nmad5")), F.col("p_size") % 3 + 1),
        "ac": F.col("p_partkey") % 7 == 0, "fp": F.col("p_size") % 4 + 1})
    k = p.withColumn("key", filled_key("m", "dem", "cc", "meth", F.lit("v01"), "ac", "fp"))
    return k.select("p_partkey", "key", filled_to_synthesized("key").alias("synth_key"), parse_run_key(F.concat(F.lit("a/b/"), F.col("key"), F.lit(".jld2"))).alias("s")).select("p_partkey", "key", "synth_key", "s.*")


@query(
    "binned_to_filled_key",
    "select s_suppkey, concat('glacier_dh_best_nmad3_v01', case when s_suppkey % 2 = 0 then '_filled_ac_p' else '_filled_p' end, s_suppkey % 4 + 1, '_aligned') as key from supplier",
)
def binned_to_filled_key(spark, d):
    s = v.table(spark, d, "supplier")
    return s.select("s_suppkey", binned_to_filled(F.lit("glacier_dh_best_nmad3_v01"), F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") % 4 + 1).alias("key"))


@query(
    "joint_histogram",
    "select cast(floor(l_quantity / 5) as int) as qb, cast(floor(l_discount * 50) as int) as db, count(*) as n from lineitem where l_quantity < 50 group by all",
)
def joint_histogram(spark, d):
    li = v.table(spark, d, "lineitem")
    qb = F.when(F.col("l_quantity") < 50, F.floor(F.col("l_quantity") / 5).cast("int"))
    return binning.histogram(li, [], {"qb": qb, "db": F.floor(F.col("l_discount") * 50).cast("int")})


@query(
    "cost_surface_scaled",
    with_("c as (select p_brand, p_size, case when p_partkey % 11 = 0 then 'inf'::double else p_retailprice end as cost, p_partkey from part)",
          "e as (select p_brand, min(cost) as lo, max(cost) as hi from c where cost < 'inf'::double group by all)")
    + f"select c.p_brand, c.p_partkey, case when cost < 'inf'::double then {r('case when hi > lo then (cost - lo) / (hi - lo) else 0.0 end')} else 9999.0 end as scaled from c join e on c.p_brand = e.p_brand",
)
def cost_surface_scaled(spark, d):
    c = v.table(spark, d, "part").select("p_brand", "p_partkey", F.when(F.col("p_partkey") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("p_retailprice")).alias("cost"))
    s = reports.min_max_scale(c, ["p_brand"], "cost")
    return s.select("p_brand", "p_partkey", F.when(F.col("scaled") == 9999.0, F.col("scaled")).otherwise(fixed("scaled")).alias("scaled"))


@query(
    "annual_site_stats",
    f"""select cast(year(o_orderdate) as int) as year, {r('sum(o_totalprice) / 1e6')} as area_sum, {r('stddev_samp(o_totalprice)', 3)} as balance_std, count(distinct o_custkey) as n_sites,
    {r('sum(o_totalprice) / (select sum(o_totalprice) from orders) * 100')} as coverage from orders group by 1""",
)
def annual_site_stats(spark, d):
    from ..operators.compare import annual_coverage, annual_statistics

    o = v.table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), (F.col("o_totalprice") / 1e6).alias("area"), F.col("o_totalprice").alias("annual_balance"), F.col("o_custkey").alias("site"))
    a = annual_coverage(annual_statistics(o, "year", "area", "annual_balance", "site"), o, "area")
    return a.select("year", fixed("area_sum").alias("area_sum"), fixed("balance_std", 3).alias("balance_std"), "n_sites", fixed("coverage").alias("coverage"))


@query(
    "misfit_per_cell",
    with_(v.TILES, "m as (select s_nationkey as cell, avg(s_acctbal) as m, stddev_samp(s_acctbal) as s, count(*) as n, sum(abs(lat)) as a from tiles group by all)")
    + f"select cell, {r('m', 4)} as mean_misfit, {r('s', 4)} as std_misfit, n, {r('sqrt(a / pi())')} as radius from m",
)
def misfit_per_cell(spark, d):
    from ..operators.compare import cell_misfit

    t = v.tiles(spark, d).select(F.col("s_nationkey").alias("cell"), F.col("s_acctbal").alias("misfit"), F.abs("lat").alias("area"))
    m = cell_misfit(t, ["cell"], "misfit", "area")
    return m.select("cell", fixed("mean_misfit", 4).alias("mean_misfit"), fixed("std_misfit", 4).alias("std_misfit"), "n", fixed("radius").alias("radius"))


DISCHARGE = [
    "s as (select o_custkey as id, cast(date_trunc('month', o_orderdate) as date) as day, sum(o_totalprice) / 1e4 as smb from orders group by 1, 2)",
    f"g as (select id, regr_slope(smb, {sql_decyear('day')}) * (id % 40 + 1) / 1000.0 as q from s where (id % 180) - 90 < -60 and day between date '1979-01-01' and date '2000-01-01' group by id)",
    "o as (select c_custkey as id, c_acctbal / 1000 as q from customer where c_mktsegment = 'BUILDING')",
    "u as (select id, greatest(0.0, q) as q, kind from (select id, q, 'observed' as kind from o union all select id, q, 'modelled' from g) where q is not null and not isnan(q))",
]


def _discharge(spark, d):
    o = v.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id"), F.trunc("o_orderdate", "month").alias("day")).agg((F.sum("o_totalprice") / 1e4).alias("smb"))
    o = o.withColumn("lat", (F.col("id") % 180 - 90).cast("double")).withColumn("area", (F.col("id") % 40 + 1).cast("double"))
    m = fit.steady_discharge(o, ["id"], "day", "smb", "area", "lat", -60.0).withColumn("kind", F.lit("modelled"))
    seen = v.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000).alias("discharge_gtyr"), F.lit("observed").alias("kind"))
    return fit.fill_discharge(seen, m).where("discharge_gtyr is not null")


@query("steady_discharge_filled", with_(*DISCHARGE) + f"select id, kind, {r('q')} as q from u")
def steady_discharge_filled(spark, d):
    return _discharge(spark, d).select("id", "kind", fixed("discharge_gtyr").alias("q"))


@query("discharge_total_range", with_(*DISCHARGE) + f"select {r('sum(q)', 3)} as total, sum(q) between 100 and 1e6 as sane from u")
def discharge_total_range(spark, d):
    t = fit.total_between(_discharge(spark, d), "discharge_gtyr", 100.0, 1e6)
    return t.select(fixed("total", 3).alias("total"), "sane")


@query(
    "allocate_by_area",
    with_(v.HYPS, "w as (select c_nationkey as tile, sum(abs(c_acctbal)) as w from customer group by all)", "t as (select tile, sum(area) as smb from hyps group by tile)")
    + f"select c_custkey as id, {r('smb * abs(c_acctbal) / w')} as smb from customer join w on c_nationkey = w.tile join t on t.tile = w.tile",
)
def allocate_by_area(spark, d):
    t = v.hyps(spark, d).groupBy("tile").agg(F.sum("area").alias("smb"))
    c = v.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("tile"), F.abs("c_acctbal").alias("area"))
    return fit.allocate_by_area(t, c, "tile", "smb", "area").select("id", fixed("smb").alias("smb"))
