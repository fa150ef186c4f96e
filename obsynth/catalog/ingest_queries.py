"""Merges, audits, ingestion, interval comparisons, external tables, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.numeric import fixed
from ..operators import compare, filters, merge
from ..sources import points, tables
from ..streaming import bins, incremental
from . import views as v
from .registry import query, r, with_

LEFT = "l as (select o_orderkey as id, o_totalprice as value from orders where o_orderstatus <> 'F')"
RIGHT = "rr as (select o_orderkey as id, o_totalprice * 2 as value from orders where o_orderstatus <> 'O')"


def _lr(spark, d):
    o = v.table(spark, d, "orders")
    a = o.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    b = o.where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") * 2).alias("value"))
    return a, b


@query("left_merge", with_(LEFT, RIGHT) + f"select id, {r('value', 2)} as value from l union all select id, {r('value', 2)} from rr where id not in (select id from l)")
def left_merge(spark, d):
    return merge.left_merge(*_lr(spark, d), ["id"]).select("id", fixed("value", 2).alias("value"))


@query("right_merge", with_(LEFT, RIGHT) + f"select id, {r('value', 2)} as value from rr union all select id, {r('value', 2)} from l where id not in (select id from rr)")
def right_merge(spark, d):
    return merge.right_merge(*_lr(spark, d), ["id"]).select("id", fixed("value", 2).alias("value"))


@query("id_set_operations", with_(LEFT, RIGHT) + "select 'only_left' as kind, count(*) as n from (select id from l except select id from rr) union all select 'both', count(*) from (select id from l intersect select id from rr)")
def id_set_operations(spark, d):
    a, b = _lr(spark, d)
    x = merge.difference(a, b, ["id"]).agg(F.lit("only_left").alias("kind"), F.count(F.lit(1)).alias("n"))
    y = merge.intersection(a, b, ["id"]).agg(F.lit("both").alias("kind"), F.count(F.lit(1)).alias("n"))
    return x.unionByName(y)


@query(
    "append_unseen",
    "select event_type as tile_id, count(*) as n, count(*) filter (user_id % 3 = 0) as n_old from events group by 1",
)
def append_unseen(spark, d):
    e = v.table(spark, d, "events").select("event_id", F.col("event_type").alias("tile_id"), F.col("user_id").cast("string").alias("granule_id"), (F.col("user_id") % 3 == 0).alias("old"))
    have = e.where("old")
    pts, _ = incremental.append_granules(have, e, have.select("tile_id", "granule_id").distinct())
    return pts.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("old").cast("long")).alias("n_old"))


@query(
    "row_count_audit",
    """with a as (select user_id, event_type, count(*) as n from events group by all), b as (select user_id, event_type, count(*) as n from events where value > 1 group by all)
    select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.event_type, b.event_type) as event_type, coalesce(a.n, 0) as n_left, coalesce(b.n, 0) as n_right
    from a full join b on a.user_id = b.user_id and a.event_type = b.event_type where coalesce(a.n, 0) <> coalesce(b.n, 0)""",
)
def row_count_audit(spark, d):
    e = v.table(spark, d, "events").select("user_id", "event_type", "value")
    return filters.audit_row_counts(e, e.where("value > 1"), ["user_id", "event_type"])


@query(
    "stale_stage_keys",
    """with i as (select c_custkey as key, c_custkey % 10 as input_version from customer), g as (select o_custkey as key, max(o_orderkey % 10) as vv from orders group by 1)
    select i.key, i.input_version from i left join g on i.key = g.key where vv is null or input_version > vv""",
)
def stale_stage_keys(spark, d):
    i = v.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") % 10).alias("input_version"))
    g = v.table(spark, d, "orders").select(F.lit("bin").alias("stage"), F.col("o_custkey").alias("key"), (F.col("o_orderkey") % 10).alias("input_version"))
    return incremental.stale_keys(i, g, "bin")


BINS = """select cast(date_trunc('day', ts) as date) as bin_start, user_id % 20 as tile, event_type as mission, count(value) as nobs, {0} as mean from events group by 1, 2, 3"""


def _stream_view(df):
    return df.select("ts", (F.col("user_id") % 20).alias("tile"), F.col("event_type").alias("mission"), "value", "event_id")


@query("stream_bins_batch", BINS.format(r("avg(value)", 5)))
def stream_bins_batch(spark, d):
    b = bins.bin_stream(_stream_view(v.table(spark, d, "events")), ["tile", "mission"], "value", width="1 day", lateness=None)
    return b.select(F.to_date("bin_start").alias("bin_start"), "tile", "mission", "nobs", fixed("mean", 5).alias("mean"))


@query(
    "stream_bins_final",
    """select cast(floor(date_diff('day', date '1990-01-01', cast(ts as date)) / 30) as int) as time_bin, user_id % 20 as tile, event_type as mission, count(value)::bigint as nobs, """
    + r("avg(value)", 5) + " as mean from events group by 1, 2, 3",
)
def stream_bins_final(spark, d):
    """The events table read as a stream of files, folded batch by batch into per-cell sums."""
    from ..session import ensure_checkpoint_dir

    schema = v.table(spark, d, "events").schema
    work = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    s = _stream_view(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d))
    bins.upsert_bins(s, f"{work}/out", f"{work}/state", ["tile", "mission"], "value").awaitTermination()
    o = bins.read_upserts(spark, f"{work}/out", ["tile", "mission"])
    return o.select("time_bin", "tile", "mission", "nobs", fixed("mean", 5).alias("mean"))


IV = (
    "ob as (select c_custkey as obs_id, c_nationkey as cell, cast(date '1996-01-01' + cast(c_custkey * 37 % 1500 as int) as date) as b, "
    "cast(date '1996-01-01' + cast(c_custkey * 37 % 1500 + 200 + c_custkey % 300 as int) as date) as e, 1 + c_custkey % 5 as area from customer), "
    "nat as (select r.nation as cell, cast(month + 14 as date) as date, sum(flux) as runoff, sum(flux) * 0.3 - 1 as dm from flux f join reaches r on f.comid = r.comid group by all), "
    "jj as (select obs_id, area, date, runoff, dm, row_number() over (partition by obs_id order by date) as rn from ob join nat on ob.cell = nat.cell where date + 15 >= b and date - 15 <= e)"
)


@query(
    "interval_metrics",
    with_(v.REACHES, v.FLUX, IV)
    + f"select obs_id, count(*) as n_steps, {r('sum(case when rn > 1 then runoff else 0.0 end) / any_value(area) / 1000', 8)} as runoff, {r('sum(case when rn > 1 then dm else 0.0 end) / any_value(area) / 1000', 8)} as dm from jj group by obs_id",
)
def interval_metrics(spark, d):
    c = v.table(spark, d, "customer")
    b = F.date_add(F.lit("1996-01-01").cast("date"), (F.col("c_custkey") * 37 % 1500).cast("int"))
    ob = c.select(F.col("c_custkey").alias("obs_id"), F.col("c_nationkey").alias("cell"), b.alias("b"), F.date_add(b, (200 + F.col("c_custkey") % 300).cast("int")).alias("e"), (1 + F.col("c_custkey") % 5).cast("double").alias("area"))
    # reaches grow with the input: they meet the flux in a shuffle, not in every task
    f = v.flux(spark, d).join(v.reaches(spark, d).select("comid", F.col("nation").alias("cell")).hint("merge"), "comid")
    s = f.groupBy("cell", F.date_add("month", 14).alias("date")).agg(F.sum("flux").alias("runoff"), (F.sum("flux") * 0.3 - 1).alias("dm"))
    o = compare.interval_change(ob, s, ["cell"], "obs_id", "b", "e", ["runoff", "dm"], divide_by="area")
    return o.select("obs_id", "n_steps", fixed("runoff", 8).alias("runoff"), fixed("dm", 8).alias("dm"))


@query(
    "validity_flags",
    f"""select c_custkey, case when c_acctbal > 0 and c_custkey % 7 > 0 then {r('c_custkey % 7 - c_acctbal', 4)} end as annual_error, c_acctbal > 0 and c_custkey % 7 > 0 as both_annual_valid from customer""",
)
def validity_flags(spark, d):
    from ..operators.reports import validity_flags as vf

    k = F.col("c_custkey") % 7
    c = v.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("obs"), F.when(k > 0, k.cast("double")).alias("model"))
    return vf(c, {"annual": ("obs", "model")}).select("c_custkey", fixed("annual_error", 4).alias("annual_error"), "both_annual_valid")


@query(
    "external_annual_balance",
    with_("x as (select o_orderkey as id, o_custkey as site, cast(o_orderdate as date) as a, cast(o_orderdate + interval 1 day * (200 + o_orderkey % 400) as date) as b, o_totalprice as bal from orders)",
          "k as (select site, year(b) as yr, sum(bal * 0.85) as bal from x where year(b) - year(a) = 1 group by all)", "ob as (select o_custkey as site, year(o_orderdate) as yr, sum(o_totalprice) as ob from orders group by all)")
    + f"select k.site, cast(k.yr as int) as year, {r('bal - ob', 3)} as delta from k join ob on k.site = ob.site and k.yr = ob.yr",
)
def external_annual_balance(spark, d):
    o = v.table(spark, d, "orders")
    a = F.to_date("o_orderdate")
    x = o.select(F.col("o_custkey").alias("site"), F.concat_ws("_", a.cast("string"), F.date_add(a, (200 + F.col("o_orderkey") % 400).cast("int")).cast("string")).alias("period"), F.col("o_totalprice").alias("bal"))
    k = compare.external_annual(x, "period", "bal").groupBy("site", "year").agg(F.sum("bal").alias("bal"))
    ob = o.groupBy(F.col("o_custkey").alias("site"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("ob"))
    return compare.matched_difference(k, ob, ["site", "year"], "bal", "ob").select("site", "year", fixed("delta", 3).alias("delta"))


@query(
    "split_key_unpivot",
    f"""with s as (select 'GCM' || (o_orderkey % 3) as gcm, o_orderstatus as ssp, 'basin ' || (o_custkey % 5) as basin, sum(o_totalprice) / 1e6 as m1, avg(o_totalprice) / 1e3 as m2 from orders group by all)
    select gcm, ssp, basin, 'm1' as model, {r('m1')} as runoff from s union all select gcm, ssp, basin, 'm2', {r('m2')} from s""",
)
def split_key_unpivot(spark, d):
    o = v.table(spark, d, "orders")
    key = F.concat(F.lit("GCM"), (F.col("o_orderkey") % 3).cast("string"), F.lit("_"), "o_orderstatus", F.lit("_basin "), (F.col("o_custkey") % 5).cast("string"))
    s = o.groupBy(key.alias("key")).agg((F.sum("o_totalprice") / 1e6).alias("m1"), (F.avg("o_totalprice") / 1e3).alias("m2"))
    return compare.parse_triplet(s, "key", ["gcm", "ssp", "basin"], ["m1", "m2"]).withColumn("runoff", fixed("runoff"))


@query(
    "first_per_name",
    f"select p_name as name, arg_min(p_partkey, p_partkey) as first_id, {r('arg_min(p_retailprice, p_partkey)', 4)} as price, count(*) as n from part group by 1",
)
def first_per_name(spark, d):
    p = v.table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("first_id"), fixed("p_retailprice", 4).alias("price"))
    return compare.first_per_name(p, "name", "first_id", ["first_id", "price"])


@query(
    "running_totals",
    with_("y as (select o_custkey as site, year(o_orderdate) as yr, sum(o_totalprice) / 1e3 as b, count(*) as c from orders group by all)")
    + f"select site, cast(yr as int) as year, {r('sum(b) over w', 4)} as cum_b, cast(sum(c) over w as bigint) as cum_c from y window w as (partition by site order by yr)",
)
def running_totals(spark, d):
    y = v.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("site"), F.year("o_orderdate").alias("year")).agg((F.sum("o_totalprice") / 1e3).alias("b"), F.count(F.lit(1)).alias("c"))
    o = compare.running_totals(y, ["site"], "year", ["b", "c"])
    return o.select("site", "year", fixed("cum_b", 4).alias("cum_b"), "cum_c")


@query(
    "locate_by_name_or_id",
    with_(v.TILES, v.SITES)
    + f"""select c_custkey, {r('coalesce(n.lon, i.lon)')} as lon, {r('coalesce(n.lat, i.lat)')} as lat from (select c_custkey, case when c_custkey % 2 = 0 then 'supplier ' || format('{{:09d}}', c_custkey // 2) else '?' end as nm from customer) c
    left join (select *, 'supplier ' || format('{{:09d}}', tile_id) as nm from tiles) n on n.nm = c.nm left join tiles i on i.tile_id = c_custkey""",
)
def locate_by_name_or_id(spark, d):
    t = v.tiles(spark, d)
    places = t.select(F.col("tile_id").alias("place_id"), F.format_string("Supplier#%09d", "tile_id").alias("name"), "lon", "lat")
    c = v.table(spark, d, "customer")
    rec = c.select(F.col("c_custkey"), F.col("c_custkey").alias("place_id"), F.when(F.col("c_custkey") % 2 == 0, F.format_string("SUPPLIER  %09d", F.floor(F.col("c_custkey") / 2))).otherwise("?").alias("name"))
    o = tables.locate_by_name_or_id(rec, places)
    return o.select("c_custkey", fixed("lon").alias("lon"), fixed("lat").alias("lat"))


@query(
    "fill_linear_gaps",
    with_("s as (select o_custkey % 40 as id, cast(date_trunc('month', o_orderdate) as date) as day, case when count(*) >= 3 then sum(o_totalprice) / 1e5 end as val from orders group by 1, 2)",
          "f as (select id, regr_slope(val, year(day) + dayofyear(day) / dayofyear(make_date(year(day), 12, 31))) as b, regr_intercept(val, year(day) + dayofyear(day) / dayofyear(make_date(year(day), 12, 31))) as a from s where val is not null group by id)")
    + f"select s.id, day, {r('coalesce(val, a + b * (year(day) + dayofyear(day) / dayofyear(make_date(year(day), 12, 31))))', 4)} as val from s left join f on s.id = f.id",
)
def fill_linear_gaps(spark, d):
    s = v.table(spark, d, "orders").groupBy((F.col("o_custkey") % 40).alias("id"), F.trunc("o_orderdate", "month").alias("day")).agg(F.when(F.count(F.lit(1)) >= 3, F.sum("o_totalprice") / 1e5).alias("val"))
    return tables.fill_linear(s, ["id"], "day", "val").select("id", "day", fixed("val", 4).alias("val"))


@query(
    "prioritised_reference",
    with_("l1 as (select o_orderkey as id, o_totalprice / 1000 as h from orders where o_orderstatus <> 'P' and abs(o_totalprice / 1000) < 450)", "l2 as (select o_orderkey as id, o_totalprice / 900 as h from orders where o_orderpriority like '1%')")
    + f"select o_orderkey as point_id, {r('coalesce(l2.h, l1.h)', 4)} as height_ref, {r('o_custkey - coalesce(l2.h, l1.h)', 4)} as dh from orders left join l1 on l1.id = o_orderkey left join l2 on l2.id = o_orderkey",
)
def prioritised_reference(spark, d):
    o = v.table(spark, d, "orders")
    pts = o.select(F.col("o_orderkey").alias("point_id"), F.col("o_custkey").cast("double").alias("height"))
    l1 = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("point_id"), (F.col("o_totalprice") / 1000).alias("height"), F.lit(0.1).alias("curvature"))
    # a second, better surface; rows without curvature are not valid
    l2 = o.select(F.col("o_orderkey").alias("point_id"), (F.col("o_totalprice") / 900).alias("height"), F.when(F.col("o_orderpriority").startswith("1"), F.lit(0.2)).alias("curvature"))
    r_ = merge.reference_height(pts, [l1.where(F.abs("height") < 450), l2], limit=9998.0)
    return r_.select("point_id", fixed("height_ref", 4).alias("height_ref"), fixed("dh", 4).alias("dh"))


@query(
    "canopy_and_quality_filter",
    """with c as (select o_orderkey as id, (o_custkey * 29 % 17000) / 100.0 - 85.0 as lat, o_orderstatus as mission, o_orderpriority < '3' as quality, case when o_shippriority then 0.0 else (o_orderkey % 40) / 10.0 end as canopy from (select *, o_orderkey % 3 = 0 as o_shippriority from orders))
    select mission, count(*) as n from c where (case when lat between -54 and 66 then canopy else 0.0 end) <= 1.0 and (mission <> 'P' or quality) group by mission""",
)
def canopy_and_quality_filter(spark, d):
    o = v.table(spark, d, "orders")
    pts = o.select(F.col("o_orderkey").alias("point_id"), ((F.col("o_custkey") * 29 % 17000) / 100.0 - 85.0).alias("lat"), F.col("o_orderstatus").alias("mission"), (F.col("o_orderpriority") < "3").alias("quality"))
    can = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("point_id"), ((F.col("o_orderkey") % 40) / 10.0).alias("canopyh"))
    f = filters.canopy_filter(pts, can, 1.0)
    ms = spark.createDataFrame([("O", False), ("F", False), ("P", True)], "mission string, apply_quality_filter boolean")
    return filters.quality_filter(f, ms).groupBy("mission").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stack_catalogue",
    "select l_returnflag as file, min(l_quantity) as min_x, max(l_quantity) as max_x, min(l_tax) as min_y, max(l_tax) as max_y, cast(min(l_shipdate) as date) as first_t, cast(max(l_shipdate) as date) as last_t, count(distinct cast(l_shipdate as date)) as n_layers from lineitem group by 1",
)
def stack_catalogue(spark, d):
    li = v.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("file"), F.col("l_quantity").alias("x"), F.col("l_tax").alias("y"), F.to_date("l_shipdate").alias("t"))
    return points.stack_catalogue(li)


@query(
    "stack_points",
    "select cast(floor(l_quantity / 10.0) as int) as tile_x, cast(floor(l_tax / 0.03) as int) as tile_y, count(*) as n, count(*) filter (l_discount * 1000 > 70) as n_good from lineitem where l_discount * 1000 > 35 group by 1, 2",
)
def stack_points(spark, d):
    li = v.table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_tax") / 0.03 * 10.0).alias("y"), (F.col("l_discount") * 1000).alias("corr"), F.col("l_extendedprice").alias("height"))
    p = points.stack_points(li.withColumn("tax", F.col("y")), 10.0, 35.0, 70.0)
    p = p.withColumn("tile_y", F.floor(F.col("tax") / 10.0).cast("int"))
    return p.groupBy("tile_x", "tile_y").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("quality").cast("long")).alias("n_good"))


@query(
    "explode_vectors",
    "select vec_id, label, cast(u.i - 1 as int) as pos, u.x as value from embeddings, (select unnest(embedding) as x, generate_subscripts(embedding, 1) as i) u",
)
def explode_vectors(spark, d):
    e = v.table(spark, d, "embeddings").withColumn("pos", F.sequence(F.lit(0), F.size("embedding") - 1)).withColumnRenamed("embedding", "value")
    return points.explode_vectors(e, ["value", "pos"]).select("vec_id", "label", "pos", "value")


@query(
    "model_running_means",
    with_(v.FLUX, "c as (select comid, month, sum(flux) over (partition by comid order by month) / 1000.0 as f from flux)")
    + f"select comid, cast(floor(date_diff('day', date '1990-01-01', month) / 90) as int) as date_index, {r('avg(f)', 8)} as flux from c group by 1, 2",
)
def model_running_means(spark, d):
    m = points.running_model(v.flux(spark, d), ["comid"], "month", ["flux"])
    b = points.bin_model(m, ["comid"], v.day_bin(90, "month"), ["flux"])
    return b.select("comid", "date_index", fixed("flux", 8).alias("flux"))


@query(
    "key_as_of_next",
    with_("p as (select o_custkey as grp, o_orderkey as k from orders where o_orderstatus = 'P')", "b as (select o_custkey as grp, o_orderkey as bk, o_totalprice as x from orders where o_orderstatus = 'F')")
    + f"select p.grp, p.k, b.bk as next_bk, {r('b.x', 2)} as x from p asof left join b on p.grp = b.grp and p.k <= b.bk",
)
def key_as_of_next(spark, d):
    o = v.table(spark, d, "orders")
    p = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("k"))
    b = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("bk"), F.col("o_totalprice").alias("x"))
    n = merge.nearest_key(p, b, ["grp"], "k", "bk", ["x"])
    return n.select("grp", "k", "next_bk", fixed("x", 2).alias("x"))


@query("missing_variables", "select c_nationkey as tile, 0::bigint as n_valid, count(*) as n from customer group by 1 having count(*) filter (c_acctbal > 9900) = 0")
def missing_variables(spark, d):
    c = v.table(spark, d, "customer").select(F.col("c_nationkey").alias("tile"), F.when(F.col("c_acctbal") > 9900, F.col("c_acctbal")).alias("value"))
    return filters.missing_variables(c, ["tile"], "value").select("tile", "n_valid", "n")
