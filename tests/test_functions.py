import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from obsynth import schema
from obsynth.functions import dates, geo, models, numeric, run_keys, scales, units


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).collect()[0])


def test_decimal_year(spark):
    d = lambda s: F.lit(s).cast("date")
    a, b, c = one(spark, dates.decimal_year(d("2018-10-24")), dates.decimal_year(d("2020-12-31")), dates.decimal_year(d("2019-01-01")))
    assert a == pytest.approx(2018.813698630137) and b == 2021.0 and c == pytest.approx(2019 + 1 / 365)
    back = one(spark, dates.decimal_year_timestamp(F.lit(2019.5)))[0]
    assert back == dt.datetime(2019, 7, 2, 12, 0)
    assert one(spark, dates.datenum_timestamp(F.lit(719529.5)))[0] == dt.datetime(1970, 1, 1, 12, 0)


def test_date_axis(spark):
    ax = schema.date_axis(spark)
    first, n = ax.orderBy("date_index").first(), ax.count()
    assert first["date_bin"] == dt.date(1990, 1, 16) and n == 438
    assert one(spark, dates.date_bin(F.lit("1990-01-31").cast("date")))[0] == 1
    h = schema.height_axis(spark)
    assert h.count() == 100 and h.orderBy("height_index").first()["height_bin"] == 50.0
    assert schema.mscale_axis(spark).count() == 5


def test_bins_and_rounding(spark):
    assert one(spark, numeric.bin_index(F.lit(100.0), 0, 100), numeric.bin_index(F.lit(100.0), 0, 100, "right")) == (1, 0)
    assert one(spark, numeric.half_even(F.lit(2.5)), numeric.half_even(F.lit(3.5)), numeric.half_even(F.lit(0.125), 2)) == (2.0, 4.0, 0.12)
    assert one(spark, numeric.fixed(F.lit(-0.0000001))) == (0.0,)
    assert one(spark, numeric.nan_to_null(F.lit(float("nan"))), numeric.sentinel_to_null(F.lit(-9999.0))) == (None, None)
    assert sum(numeric.gaussian_weights(1.5)) == pytest.approx(1) and len(numeric.gaussian_weights(1.5)) == 9


def test_tiles(spark):
    name = one(spark, geo.tile_id(F.lit(79.3), F.lit(31.9)))[0]
    assert name == "lat[+30+32]lon[+078+080]"
    assert one(spark, geo.tile_id(F.lit(-0.5), F.lit(-0.5)))[0] == "lat[-02+00]lon[-002+000]"
    e = one(spark, geo.tile_extent(F.lit("lat[-68-66]lon[-070-068]")))[0]
    assert (e["min_x"], e["min_y"], e["max_x"], e["max_y"]) == (-70.0, -68.0, -68.0, -66.0)
    # a point on a shared edge: one tile by default, both when closed
    inside = [one(spark, geo.within(F.lit(2.0), F.lit(1.0), F.lit(a), F.lit(0.0), F.lit(a + 2.0), F.lit(2.0), closed))[0] for a in (0.0, 2.0) for closed in ("left", "both")]
    assert inside == [False, True, True, True]


def test_geometry(spark):
    assert one(spark, geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(180.0), F.lit(0.0)))[0] == pytest.approx(math.pi * 6371000)
    sq = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]])
    got = one(spark, *[geo.point_in_ring(F.lit(x), F.lit(y), sq) for x, y in [(1.0, 1.0), (3.0, 1.0), (0.0, 1.0), (2.0, 1.0)]])
    assert got == (True, False, True, False)  # left edge in, right edge out
    assert one(spark, geo.utm_epsg(F.lit(5.0), F.lit(60.0)), geo.utm_epsg(F.lit(10.0), F.lit(78.0)), geo.utm_epsg(F.lit(0.0), F.lit(85.0)), geo.utm_epsg(F.lit(0.0), F.lit(-81.0)), geo.utm_epsg(F.lit(-70.0), F.lit(-33.0))) == (
        "EPSG:32632", "EPSG:32633", "EPSG:3413", "EPSG:3031", "EPSG:32719")
    x, y, z = one(spark, *geo.unit_xyz(F.lit(90.0), F.lit(0.0)))
    assert (round(x, 12), y, z) == (0.0, 1.0, 0.0)
    ring = one(spark, geo.cap_ring(F.lit(10.0), F.lit(50.0), 1000.0, 16))[0]
    far = [math.hypot((p["x"] - 10) * math.cos(math.radians(50)), p["y"] - 50) * 111194.9 for p in ring]
    assert len(ring) == 16 and all(abs(f - 1000) < 1 for f in far)


def test_vertex_thinning(spark):
    line = F.transform(F.sequence(F.lit(1), F.lit(25)), lambda i: F.struct(i.cast("double").alias("x"), F.lit(0.0).alias("y")))
    got = one(spark, geo.every_nth_vertex(line))[0]
    assert [p["x"] for p in got] == [1.0, 11.0, 25.0]
    short = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.struct(i.cast("double").alias("x"), F.lit(1.0).alias("y")))
    assert [(p["x"], p["y"]) for p in one(spark, geo.every_nth_vertex(short))[0]] == [(2.0, 1.0)]


def test_scales(spark):
    for v in (0.2, 0.5, 1.0, 2.0, 5.0):
        lin = one(spark, scales.scale_to_linear(F.lit(v)))[0]
        want = v - 1 if v >= 1 else -1 / v + 1
        assert lin == pytest.approx(want)
    assert one(spark, scales.linear_to_scale(F.lit(-2.0)), scales.linear_to_scale(F.lit(2.0)), scales.linear_to_scale(F.lit(0.5))) == (1 / 3, 3.0, None)
    g = scales.reciprocal_grid(0.5, 2.0, 0.25)
    assert g[0] == 0.5 and 1.0 in g and g[-1] == 2.0 and all(a < b for a, b in zip(g, g[1:]))


def test_run_keys(spark):
    k = one(spark, run_keys.parse_run_key(F.lit("/a/glacier_rgi7_dh_cop30_v2_cc_nmad5_v01_filled_ac_p2_aligned.jld2")))[0]
    assert tuple(k) == ("glacier_rgi7", "cop30_v2", True, "nmad5", "v01", True, 2)
    k = one(spark, run_keys.parse_run_key(F.lit("glacier_dh_best_median_v01")))[0]
    assert tuple(k) == ("glacier", "best", False, "median", "v01", False, None)
    runs = run_keys.run_table(spark)
    assert runs.count() == 192 and run_keys.distinct_runs(runs).count() == 96


def test_phase_conventions(spark):
    # y = cos(2 pi (t - 0.25)): the peak is a quarter into the year
    c, s = F.lit(0.0), F.lit(1.0)
    peak, table, series = one(spark, *[models.phase_fraction(c, s, p) for p in ("peak", "table", "series")])
    assert (peak, table, series) == (0.25, 0.25, 0.5)


def test_units_keep_null(spark):
    df = spark.createDataFrame([(1.0, None, 2.0, 5.0, 0.0)], "acc double, rain double, melt double, refreeze double, ec double")
    r = units.constrain_rates(df).collect()[0]
    assert r["rain"] is None and r["refreeze"] == 2.0 and r["runoff"] == 0.0 and r["smb"] == 1.0
    assert one(spark, units.state_index(F.lit(1.0), F.lit(1.0), F.lit(0.0)))[0] is None


def test_region_members(spark):
    m = schema.region_members(spark)
    assert m.where("region = 98").count() == 3 and m.where("region = 99").count() == 19
    assert {r["mission"]: r["land_trend"] for r in schema.missions(spark).collect()}["gedi"] == -0.144
