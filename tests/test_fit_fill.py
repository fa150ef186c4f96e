import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from obsynth.operators import calibrate, fill, fit, windows


def series(spark, f, n=120, key=1):
    d0 = dt.date(2000, 1, 15)
    days = [d0 + dt.timedelta(days=30 * i) for i in range(n)]
    t = np.array([d.year + d.timetuple().tm_yday / (366 if d.year % 4 == 0 else 365) for d in days])
    return spark.createDataFrame(pd.DataFrame({"k": key, "date": days, "v": f(t)}))


def test_noiseless_seasonal_series_is_recovered(spark):
    df = series(spark, lambda t: 2.0 + 0.5 * (t - 2005) - 0.03 * (t - 2005) ** 2 + 1.5 * np.cos(2 * np.pi * t) + 2.0 * np.sin(2 * np.pi * t))
    r = fit.seasonal_fit(df, ["k"], "date", "v", acceleration=True, phase="peak").collect()[0]
    assert r["acceleration"] == pytest.approx(-0.03, abs=1e-8)
    assert r["trend"] == pytest.approx(0.5, abs=1e-7)
    assert r["offset"] == pytest.approx(2.0, abs=1e-7)
    assert r["amplitude"] == pytest.approx(2.5, abs=1e-7)
    assert r["phase_day"] == pytest.approx(365.25 * np.arctan2(2.0, 1.5) / (2 * np.pi), abs=1e-5)


def test_singular_fit_is_null(spark):
    df = spark.createDataFrame([(1, dt.date(2000, 1, 1), 1.0), (1, dt.date(2000, 1, 1), 2.0)], "k int, date date, v double")
    r = fit.seasonal_fit(df, ["k"], "date", "v").collect()[0]
    assert r["trend"] is None and r["n"] == 2


def test_curvature_polynomial(spark):
    rng = np.random.default_rng(0)
    c = np.repeat(np.arange(-0.95, 1.0, 0.1), 30)
    y = 1 + c - 2 * c**2 + 0.5 * c**3 + 3 * c**4
    pdf = pd.DataFrame({"k": 1, "c": c, "dh": y})
    out = fit.curvature_correct(spark.createDataFrame(pdf), spark.createDataFrame(pdf), ["k"], "c", "dh").toPandas()
    assert np.abs(out["dh"]).max() < 1e-6
    few = spark.createDataFrame(pd.DataFrame({"k": 2, "c": rng.uniform(0, 0.2, 40), "dh": 5.0}))
    assert fit.curvature_correct(few, few, ["k"], "c", "dh").agg(F.min("dh")).first()[0] == 5.0


def test_surface_fit_recovers_coefficients():
    rng = np.random.default_rng(1)
    t, h = rng.uniform(-4, 4, 400), rng.uniform(-1500, 1500, 400)
    p = np.array([1.0, 0.4, -0.05, 0.002, 1e-7, 0.1, 2.0, 0.001, 1e-7])
    got = fill.fit_surface(t, h, fill.eval_surface(t, h, p), rng.integers(1, 50, 400).astype(float))
    assert np.allclose(fill.eval_surface(t, h, got), fill.eval_surface(t, h, p), atol=1e-6)
    assert np.all(got >= np.array(fill.LOWER) - 1e-9) and np.all(got <= np.array(fill.UPPER) + 1e-9)


def test_boxed_quadratic_matches_projected_gradient():
    rng = np.random.default_rng(5)
    for _ in range(30):
        A = rng.normal(size=(20, 6))
        G, b = A.T @ A, rng.normal(size=6) * 20
        lo, hi = -rng.uniform(0.05, 1, 6), rng.uniform(0.05, 1, 6)
        x = fill._boxed_quadratic(G, b, lo, hi)
        y = np.zeros(6)
        for _ in range(3000):
            y = np.clip(y - (G @ y - b) / np.linalg.norm(G, 2), lo, hi)
        assert x @ G @ x / 2 - b @ x <= y @ G @ y / 2 - b @ y + 1e-7


def cube(spark):
    rng = np.random.default_rng(2)
    out = []
    for tile, level in (("a", 3.0), ("b", -2.0)):
        for d in range(120, 180):
            for h in range(5, 12):
                if rng.random() < 0.8:
                    t = fill.axis_decimal_year(np.array([d]))[0] - 2000
                    out.append(("icesat2", tile, d, h, float(level + 0.3 * t + 0.5 * np.sin(2 * np.pi * t)), 60))
    return spark.createDataFrame(out, "mission string, tile_id string, date_index int, height_index int, dh double, nobs long")


def test_surface_model_fill_is_complete_and_close(spark):
    c = cube(spark)
    st = spark.createDataFrame([("icesat2", 9, 5, 5.0, 800.0)], "mission string, bincount_min int, smooth_n int, nmad_max double, length_scale double")
    f, p = fill.split_params(fill.surface_model_fill(c, ["mission", "tile_id"], st), ["mission", "tile_id"])
    n = {r["tile_id"]: r["n"] for r in f.groupBy("tile_id").agg(F.count("*").alias("n")).collect()}
    assert n == {"a": 60 * 7, "b": 60 * 7}
    worst = f.join(c.withColumnRenamed("dh", "obs").drop("nobs"), ["mission", "tile_id", "date_index", "height_index"]).agg(F.max(F.abs(F.col("dh") - F.col("obs")))).first()[0]
    assert worst < 0.05
    assert p.count() == 2 and all(abs(r["param"][1] - 0.3) < 0.02 for r in p.collect())


def test_replace_with_model(spark):
    c = cube(spark)
    both = c.unionByName(c.withColumn("mission", F.lit("icesat"))).unionByName(c.where("date_index < 170").withColumn("mission", F.lit("hugonnet")).withColumn("dh", F.lit(50.0)))
    out = fill.replace_with_model(both, spark.createDataFrame([("a",)], "tile_id string"), "hugonnet", ["icesat2", "icesat"])
    a = out.where("mission = 'hugonnet' and tile_id = 'a'")
    assert a.agg(F.max(F.abs(F.col("dh") - 3.0))).first()[0] < 10 and {r["nobs"] for r in a.select("nobs").distinct().collect()} == {9999}
    assert {r["dh"] for r in out.where("mission = 'hugonnet' and tile_id = 'b'").select("dh").distinct().collect()} == {50.0}
    assert out.where("mission <> 'hugonnet'").count() == 2 * c.count()


def test_spline_passes_through_quadratic(spark):
    n = 40
    days = [dt.date(2000, 1, 1) + dt.timedelta(days=30 * i) for i in range(n)]
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "date": days, "v": [5.0 + 0.1 * i for i in range(n)]}))
    out = fill.monthly_spline(df, ["k"], "date", "v").orderBy("month").collect()
    for r in out:
        assert r["v"] == pytest.approx(5.0 + 0.1 * (r["month"] - days[0]).days / 30, abs=1e-9)
    neg = fill.monthly_spline(df.withColumn("v", -F.col("v")), ["k"], "date", "v").agg(F.max("v"), F.min("v")).first()
    assert tuple(neg) == (0.0, 0.0)


def test_profile_fill_limits(spark):
    vals = {2: 1.0, 3: 2.0, 5: 4.0, 12: 11.0}
    rows = [("t", i, vals.get(i), 0.0 if i in (0, 19) else 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "tile string, i int, v double, area double")
    got = {r["i"]: r["v"] for r in fill.profile_fill(df, ["tile"], [], "i", "v", "area", reach=1, max_fraction=0.1).collect()}
    assert got[4] == 3.0 and got[1] == 1.0 and got[13] == 11.0
    assert got[6] == 5.0 and got[11] == 10.0  # next to known bins
    assert all(got[i] is None for i in range(7, 11))  # a gap wider than three bins stays open
    assert got[15] is None and got[0] is None


def test_interpolate_single_known_point_and_modes(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, 2.0, None])] + [(2, i, v) for i, v in enumerate([1.0, None, 5.0, None])], "k int, x int, v double")
    flat = {(r["k"], r["x"]): r["v"] for r in windows.interpolate(df, ["k"], "x", "v", outside="flat").collect()}
    lin = {(r["k"], r["x"]): r["v"] for r in windows.interpolate(df, ["k"], "x", "v").collect()}
    assert flat[1, 0] == flat[1, 2] == 2.0 and flat[2, 1] == 3.0 and flat[2, 3] == 5.0
    assert lin[2, 3] == 7.0 and lin[1, 0] == 2.0


def test_monotone_repair_and_reservoir(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, 3.0, 2.0, 5.0])], "k int, i int, v double")
    assert [r["repaired"] for r in windows.monotone_repair(df, ["k"], "i", "v").orderBy("i").collect()] == [1.0, 3.0, 3.0, 6.0]
    w = windows.reservoir_weights()
    assert w[0] > w[-1] > 0 and abs(sum(w) - 1) < 0.05
    imp = spark.createDataFrame([(1, i, 1.0 if i == 0 else 0.0) for i in range(len(w))], "k int, i int, v double")
    assert [r["response"] for r in windows.convolve(imp, ["k"], "i", "v", w).orderBy("i").collect()] == w


def test_grid_search_finds_the_truth(spark):
    """Observations sampled from the stack at a grid point have zero misfit there."""
    rng = np.random.default_rng(7)
    dates = [dt.date(2001, 1, 15) + dt.timedelta(days=30 * i) for i in range(60)]
    t = np.arange(60) / 12.0
    P, M = [0.5, 1.0, 2.0], [1 / 3, 1.0, 3.0]
    rows = []
    base, melt = t + rng.normal(0, 0.1, 60), np.sin(2 * np.pi * t) + t * 0.5
    for p in P:
        for m in M:
            rows += [("x", d, p, m, float(p * base[i] - m * melt[i])) for i, d in enumerate(dates)]
    st = spark.createDataFrame(rows, "g string, date date, pscale double, mscale double, value double")
    q = spark.createDataFrame([("x", 1.5, 2.0)], "g string, pscale double, mscale double")
    ob = calibrate.sample_stack(st, q, ["g"], P, M, ["value"]).select("g", "date", "value")
    best = calibrate.grid_search(ob, st, ["g"], P, M, [0.5, 0.8, 1.0, 1.5, 2.0], [1 / 3, 1.0, 2.0, 3.0]).collect()[0]
    assert (best["pscale"], best["mscale"]) == (1.5, 2.0) and best["rmse"] < 1e-6
