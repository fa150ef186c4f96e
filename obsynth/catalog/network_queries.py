"""River networks, ordered series on reaches, peak contribution, tile groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import fixed
from ..operators import graph, rollup, routing, windows
from . import views as v
from .registry import query, r, with_
from .rollup_queries import MEMBERS, members

TRACE = "trace(start, step, comid) as (select comid, 0::bigint, comid from reaches union all select t.start, t.step + 1, r.next_comid from trace t join reaches r on t.comid = r.comid where r.next_comid > 0)"


def _trace(spark, d):
    rc = v.reaches(spark, d)
    return graph.trace_downstream(rc.select(F.col("comid").alias("start")), rc)


@query("trace_downstream", with_(v.REACHES, TRACE) + "select start, step, comid from trace")
def trace_downstream(spark, d):
    return _trace(spark, d)


@query(
    "trace_upstream",
    with_(v.REACHES, TRACE) + "select comid as node, count(distinct start) as n_sources, min(start) as first_source, max(start) as last_source from trace group by comid",
)
def trace_upstream(spark, d):
    t = graph.trace_upstream(_trace(spark, d))
    return t.groupBy("node").agg(F.countDistinct("source").alias("n_sources"), F.min("source").alias("first_source"), F.max("source").alias("last_source"))


@query(
    "downstream_sink",
    with_(v.REACHES, TRACE) + "select start as comid, arg_max(comid, step) as sink from trace group by start",
)
def downstream_sink(spark, d):
    return graph.downstream_sink(v.reaches(spark, d))


ACC = "acc as (select t.comid, f.month, sum(f.flux) as flux from trace t join flux f on f.comid = t.start group by all)"


@query("accumulate_sum", with_(v.REACHES, TRACE, v.FLUX, ACC) + f"select comid, month, {r('flux', 5)} as flux from acc")
def accumulate_sum(spark, d):
    a = graph.accumulate_sum(v.flux(spark, d), v.reaches(spark, d))
    return a.select("comid", "month", fixed("flux", 5).alias("flux"))


@query(
    "accumulate_longest",
    with_(v.REACHES, "up(comid, len, src) as (select comid, length_km, comid from reaches union all select r.next_comid, u.len + n.length_km, u.src from up u join reaches r on u.comid = r.comid join reaches n on n.comid = r.next_comid where r.next_comid > 0)")
    + f"select comid, {r('max(len)', 5)} as longest_km from up group by comid",
)
def accumulate_longest(spark, d):
    return graph.accumulate_longest(v.reaches(spark, d)).select("comid", fixed("longest_km", 5).alias("longest_km"))


@query(
    "network_flags",
    with_(v.REACHES) + "select comid, cast(floor(comid / 1000000) as int) as basin02, comid not in (select next_comid from reaches) as is_head from reaches",
)
def network_flags(spark, d):
    return graph.add_network_flags(v.reaches(spark, d)).select("comid", "basin02", "is_head")


@query(
    "accumulation_conserves",
    with_(v.FLUX) + f"select {r('sum(flux)', 3)} as at_sinks, {r('sum(flux)', 3)} as given, true as ok from flux",
)
def accumulation_conserves(spark, d):
    rc, f = v.reaches(spark, d), v.flux(spark, d)
    c = graph.check_conservation(graph.accumulate_sum(f, rc), f, rc)
    return c.select(fixed("at_sinks", 3).alias("at_sinks"), fixed("given", 3).alias("given"), (F.col("gap") < 1e-9).alias("ok"))


MONTHLY = "cum as (select comid, month, sum(flux) over (partition by comid order by month) - 0.4 * row_number() over (partition by comid order by month) as cum from flux)"


def _cumulative(spark, d):
    from pyspark.sql import Window as W

    f = v.flux(spark, d)
    w = W.partitionBy("comid").orderBy("month")
    return f.withColumn("cum", F.sum("flux").over(w.rowsBetween(W.unboundedPreceding, 0)) - 0.4 * F.row_number().over(w)).drop("flux")


@query(
    "cumulative_to_rate",
    with_(v.FLUX, MONTHLY) + f"select comid, month, {r('(cum - lag(cum) over w) / (date_diff(' + chr(39) + 'day' + chr(39) + ', lag(month) over w, month) * 86400.0) * 1e6', 5)} as rate from cum window w as (partition by comid order by month)",
)
def cumulative_to_rate(spark, d):
    o = windows.rate_from_cumulative(_cumulative(spark, d), ["comid"], "month", "cum")
    return o.select("comid", "month", fixed(F.col("rate") * 1e6, 5).alias("rate"))


@query(
    "gridded_difference",
    with_(v.FLUX, MONTHLY, "dd as (select comid, month, cum - lag(cum) over (partition by comid order by month) as x from cum)")
    + f"select comid, month, {r('coalesce(x, lead(x) over (partition by comid order by month))', 5)} as step from dd",
)
def gridded_difference(spark, d):
    o = windows.rate_from_cumulative(_cumulative(spark, d), ["comid"], "month", "cum", "step", per_second=False, repeat_first=True)
    return o.select("comid", "month", fixed("step", 5).alias("step"))


@query(
    "monotone_repair",
    with_(v.FLUX, MONTHLY, "st as (select comid, month, cum, coalesce(case when cum - lag(cum) over w < 0 then 0.0 else cum - lag(cum) over w end, cum) as s from cum window w as (partition by comid order by month))")
    + f"select comid, month, {r('sum(s) over (partition by comid order by month)', 5)} as repaired from st",
)
def monotone_repair(spark, d):
    o = windows.monotone_repair(_cumulative(spark, d), ["comid"], "month", "cum")
    return o.select("comid", "month", fixed("repaired", 5).alias("repaired"))


@query(
    "monotone_violations",
    with_(v.FLUX, MONTHLY, "st as (select comid, month, cum - lag(cum) over (partition by comid order by month) as s from cum)")
    + f"select comid, month, {r('s')} as increment from st where s < -1e-9",
)
def monotone_violations(spark, d):
    from ..operators.filters import monotone_violations as mv

    return mv(_cumulative(spark, d), ["comid"], "month", "cum").select("comid", "month", fixed("increment").alias("increment"))


WEIGHTS = windows.reservoir_weights(45.0)


@query(
    "reservoir_response",
    with_(v.FLUX, v.REACHES, "nat as (select r.nation as basin, month, sum(flux) as flux from flux f join reaches r on f.comid = r.comid group by all)")
    + "select basin, month, "
    + r(" + ".join(f"coalesce(lag(flux, {k}) over w, 0.0) * {c!r}::double" for k, c in enumerate(WEIGHTS)))
    + " as response from nat window w as (partition by basin order by month)",
)
def reservoir_response(spark, d):
    f = v.flux(spark, d).join(v.reaches(spark, d).select("comid", "nation"), "comid")
    n = f.groupBy(F.col("nation").alias("basin"), "month").agg(F.sum("flux").alias("flux"))
    o = windows.convolve(n, ["basin"], "month", "flux", WEIGHTS)
    return o.select("basin", "month", fixed("response").alias("response"))


# g: accumulated flux of small customers' months; r: accumulated flux of all, both on upper reaches
GR = [
    v.REACHES, TRACE, v.FLUX, ACC,
    "gr as (select comid, month, flux * (0.2 + (comid % 7) / 10.0) as g, flux * (0.3137 + (month(month) % 5) / 5.0) as r from acc)",
    "clim as (select comid, month(month) as m, avg(g) as c from gr group by all)",
    "peak as (select comid, arg_min(m, struct_pack(a := -c, b := m)) as peak from clim group by comid)",
    "pct as (select gr.comid, gr.month, cast(round_even(case when gg + r != 0 then gg / (gg + r) * 100.0 else 0.0 end, 0) as int) as percent from "
    "(select gr.*, case when ((month(month) - peak + 12) % 12) <= 2 or ((month(month) - peak + 12) % 12) >= 10 then g else 0.0 end as gg from gr join peak on gr.comid = peak.comid) gr)",
]


def _percent(spark, d):
    a = graph.accumulate_sum(v.flux(spark, d), v.reaches(spark, d))
    g = a.select("comid", "month", (F.col("flux") * (0.2 + (F.col("comid") % 7) / 10.0)).alias("g"))
    rr = a.select("comid", "month", (F.col("flux") * (0.3137 + (F.month("month") % 5) / 5.0)).alias("r"))
    return routing.contribution_percent(g, rr)


@query("contribution_percent", with_(*GR) + "select comid, month, percent from pct")
def contribution_percent(spark, d):
    return _percent(spark, d)


@query(
    "peak_contribution",
    with_(*GR, "mm as (select comid, cast(month(month) as int) as m, cast(round_even(avg(percent), 0) as int) as mean, max(percent) as hi, min(percent) as lo from pct group by 1, 2)",
          "k as (select *, row_number() over (partition by comid order by mean desc, m) as rn from mm)")
    + "select comid, mean as gmax_avg, m as gmax_month, lo as gmax_min, hi as gmax_max, hi - lo as gmax_range from k where rn = 1",
)
def peak_contribution(spark, d):
    return routing.peak_contribution(_percent(spark, d))


@query(
    "yearly_length_over_cutoff",
    with_(*GR, "hit as (select distinct comid, cast(year(month) as int) as year from pct where percent >= 50)")
    + f"select year, {r('sum(length_km)', 4)} as length_km, count(*) as n_reaches from hit join reaches using (comid) group by year",
)
def yearly_length_over_cutoff(spark, d):
    o = routing.yearly_length_over(_percent(spark, d), v.reaches(spark, d))
    return o.select("year", fixed("length_km", 4).alias("length_km"), "n_reaches")


@query(
    "years_over_cutoff",
    with_(*GR, "y as (select comid, year(month) as yr, max(percent) as p from pct group by all)") + "select comid, count(*) filter (p >= 50) as n_years from y group by comid",
)
def years_over_cutoff(spark, d):
    return routing.years_over(_percent(spark, d))


@query(
    "length_by_attribute",
    with_(v.REACHES) + f"select nation, {r('sum(length_km)', 4)} as length_km from reaches where length_km * 9 >= 50 group by nation",
)
def length_by_attribute(spark, d):
    rc = v.reaches(spark, d).withColumn("gmax_avg", F.col("length_km") * 9)
    return routing.length_by_attribute(rc, ["nation"]).withColumn("length_km", fixed("length_km", 4))


@query(
    "sinks_classified",
    with_(v.REACHES)
    + f"""select comid, {r('x')} as runoff_max_avg, {r('ln(x + 1)')} as size, cast(case when not oc then 2 when dis then 3 else 1 end as int) as type from (
    select comid, length_km as x, comid % 3 > 0 as oc, false as dis from reaches where next_comid = 0
    union all select 0, greatest(s_acctbal, 0.0) * 1e9 / 365.25 / 24 / 60 / 60, true, true from supplier)""",
)
def sinks_classified(spark, d):
    from ..functions.units import gt_per_year_to_m3_per_s

    rc = v.reaches(spark, d).withColumn("runoff_max_avg", F.col("length_km")).withColumn("ocean_terminating", F.col("comid") % 3 > 0)
    q = v.table(spark, d, "supplier").select(gt_per_year_to_m3_per_s(F.greatest(F.col("s_acctbal"), F.lit(0.0))).alias("runoff_max_avg"))
    s = routing.classify_sinks(rc, q)
    return s.select("comid", fixed("runoff_max_avg").alias("runoff_max_avg"), fixed("size").alias("size"), "type")


@query(
    "closed_basin_fraction",
    with_(v.REACHES, TRACE, MEMBERS, "sink as (select start as id, arg_max(comid, step) as sink from trace group by start)",
          "t as (select comid as id, nation as code, length_km as trend from reaches)")
    + f"""select region, {r('sum(trend)', 4)} as trend, {r('sum(case when sink % 3 = 0 then trend else 0.0 end)', 4)} as inland, {r('sum(case when sink % 3 = 0 then trend else 0.0 end) / sum(trend)')} as fraction
    from t join sink using (id) join members on code = member group by region""",
)
def closed_basin_fraction(spark, d):
    rc = v.reaches(spark, d)
    s = graph.downstream_sink(rc).select(F.col("comid").alias("id"), (F.col("sink") % 3 > 0).alias("ocean_terminating"))
    t = rc.select(F.col("comid").alias("id"), F.col("nation").alias("code"), F.col("length_km").alias("trend"))
    o = rollup.closed_basin_fraction(t, s, members(spark))
    return o.select("region", fixed("trend", 4).alias("trend"), fixed("inland", 4).alias("inland"), fixed("fraction").alias("fraction"))


@query(
    "reaches_receiving",
    with_(v.REACHES, "trace(start, comid) as (select comid, comid from reaches where length_km > 10 union all select t.start, r.next_comid from trace t join reaches r on t.comid = r.comid where r.next_comid > 0)")
    + "select distinct comid from trace",
)
def reaches_receiving(spark, d):
    rc = v.reaches(spark, d)
    t = graph.trace_downstream(rc.where("length_km > 10").select(F.col("comid").alias("start")), rc)
    return routing.reaches_receiving(rc, t).select("comid")


@query(
    "mean_of_models",
    with_("m as (select o_custkey % 50 as id, cast(date_trunc('month', o_orderdate) as date) as month, o_orderkey % 3 as model, case when o_orderkey % 17 = 0 then null else o_totalprice end as f from orders)")
    + f"select id, month, {r('avg(coalesce(f, 0.0))', 4)} as flux from m group by all",
)
def mean_of_models(spark, d):
    o = v.table(spark, d, "orders").select(
        (F.col("o_custkey") % 50).alias("id"), F.trunc("o_orderdate", "month").alias("month"), F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice")).alias("flux"))
    return routing.mean_of_models(o, ["id", "month"]).withColumn("flux", fixed("flux", 4))


# tiles that share a large feature (an order with a line above the size threshold) belong together
GROUPS = (
    "touch as (select l_orderkey as feature, l_suppkey as tile from lineitem where l_extendedprice > 102500), "
    "pairs as (select distinct a.tile as a, b.tile as b from touch a join touch b on a.feature = b.feature), "
    "reach(a, b) as (select a, b from pairs union select r.a, p.b from reach r join pairs p on r.b = p.a)"
)


@query(
    "connected_groups",
    with_(GROUPS) + "select s_suppkey as tile, coalesce(g, s_suppkey) as grp from supplier left join (select a, min(b) as g from reach group by a) on a = s_suppkey",
)
def connected_groups(spark, d):
    li = v.table(spark, d, "lineitem").where("l_extendedprice > 102500").select(F.col("l_orderkey").alias("feature_id"), F.col("l_suppkey").alias("tile_id"))
    t = v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("tile_id"))
    g = graph.tile_groups(t, li)
    return g.select(F.col("tile_id").alias("tile"), F.col("group").alias("grp"))


@query(
    "connected_groups_forced",
    with_(GROUPS) + "select s_suppkey as tile, case when s_suppkey % 40 = 3 then -1 else coalesce(g, s_suppkey) end as grp from supplier left join (select a, min(b) as g from reach group by a) on a = s_suppkey",
)
def connected_groups_forced(spark, d):
    li = v.table(spark, d, "lineitem").where("l_extendedprice > 102500").select(F.col("l_orderkey").alias("feature_id"), F.col("l_suppkey").alias("tile_id"))
    t = v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("tile_id"))
    forced = t.where("tile_id % 40 = 3").withColumn("group", F.lit(-1).cast("long"))
    g = graph.tile_groups(t, li, forced=forced)
    return g.select(F.col("tile_id").alias("tile"), F.col("group").alias("grp"))


@query(
    "basin_membership_trend",
    with_(v.REACHES, TRACE, v.FLUX, "b as (select start as comid, arg_max(comid, step) as basin from trace group by start)",
          "s as (select basin, month, sum(flux) as value from flux join b using (comid) group by all)")
    + f"select basin, {r('regr_slope(value, year(month) + dayofyear(month) / dayofyear(make_date(year(month), 12, 31)))', 5)} as slope, count(*) as n from s group by basin",
)
def basin_membership_trend(spark, d):
    from ..functions.dates import decimal_year

    b = graph.downstream_sink(v.reaches(spark, d)).withColumnRenamed("sink", "basin")
    s = v.flux(spark, d).join(b, "comid").groupBy("basin", "month").agg(F.sum("flux").alias("value"))
    return windows.slope_per_year(s, ["basin"], decimal_year("month"), "value").select("basin", fixed("slope", 5).alias("slope"), "n")
