import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from obsynth.functions import geo
from obsynth.operators import raster, spatial


def dist(lon1, lat1, lon2, lat2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371000 * np.arcsin(np.minimum(1, np.sqrt(h)))


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    a = rng.normal([179.9, 70.0], [0.3, 0.1], (n // 2, 2))  # a dense cluster across the date line
    b = np.column_stack([rng.uniform(-180, 180, n - n // 2), rng.uniform(-89, 89, n - n // 2)])
    p = np.vstack([a, b])
    p[:, 0] = (p[:, 0] + 180) % 360 - 180
    p[5:9] = p[4]  # several sites at one location
    return p


@pytest.mark.parametrize("levels", [None, 1, 3])
@pytest.mark.parametrize("k", [1, 5])
def test_nearest_equals_brute_force(spark, levels, k):
    s, q = clustered(300, 1), clustered(80, 2)
    sites = spark.createDataFrame(pd.DataFrame({"site_id": range(len(s)), "lon": s[:, 0], "lat": s[:, 1]}))
    qs = spark.createDataFrame(pd.DataFrame({"query_id": range(len(q)), "lon": q[:, 0], "lat": q[:, 1]}))
    got = spatial.nearest(qs, sites, k, levels=levels).toPandas()
    d = dist(q[:, None, 0], q[:, None, 1], s[None, :, 0], s[None, :, 1])
    for i, g in got.groupby("query_id"):
        order = sorted(range(len(s)), key=lambda j: (d[i, j], j))[:k]
        g = g.sort_values("rank")
        assert np.allclose(g["meters"], d[i, order], rtol=1e-9, atol=1e-3)
        assert list(g["rank"]) == list(range(1, k + 1))
    assert len(got) == k * len(q)


def test_nearest_within_groups_and_radius(spark):
    sites = spark.createDataFrame([(1, "a", 0.0, 0.0), (2, "b", 1.0, 0.0), (3, "a", 10.0, 0.0)], "site_id long, g string, lon double, lat double")
    qs = spark.createDataFrame([(1, "a", 1.0, 0.0), (2, "b", 0.0, 0.0), (3, "a", 50.0, 0.0), (4, "c", 0.0, 0.0)], "query_id long, g string, lon double, lat double")
    got = {r["query_id"]: r["site_id"] for r in spatial.nearest(qs, sites, 1, by=["g"], max_meters=500000.0).collect()}
    assert got == {1: 1, 2: 2}


def test_fewer_sites_than_k(spark):
    sites = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0)], "site_id long, lon double, lat double")
    got = spatial.nearest(sites.withColumnRenamed("site_id", "query_id"), sites, 5).count()
    assert got == 4


def test_variogram_blocks(spark, monkeypatch):
    """Hot cells are split into several blocks without changing the sums."""
    rng = np.random.default_rng(0)
    n = 240
    pdf = pd.DataFrame({"year": rng.integers(0, 2, n), "id": range(n), "lon": np.where(rng.random(n) < 0.6, rng.normal(179.8, 0.5, n), rng.uniform(-180, 180, n)), "lat": rng.normal(60, 2, n), "v": np.round(rng.normal(0, 1, n), 1)})
    pdf["lon"] = (pdf["lon"] + 180) % 360 - 180
    edges = [0.0, 50e3, 200e3, 600e3]
    want = {}
    for y, g in pdf.groupby("year"):
        d = dist(g.lon.values[:, None], g.lat.values[:, None], g.lon.values[None], g.lat.values[None])
        diff = np.abs(g.v.values[:, None] - g.v.values[None])
        for b in range(3):
            m = (d > edges[b]) & (d <= edges[b + 1]) & ~np.eye(len(g), dtype=bool)
            for i, pid in enumerate(g.id):
                if m[i].any():
                    nz = m[i] & (diff[i] != 0)
                    want[int(y), int(pid), b] = (int(m[i].sum()), float(diff[i][nz].sum()), int(nz.sum()))
    monkeypatch.setattr(spatial, "BLOCK", 16)
    got = spatial.distance_band_means(spark.createDataFrame(pdf), ["year"], "id", "v", edges, 4.0).collect()
    assert {(r["year"], r["id"], r["band"]): (r["n"], pytest.approx(r["s"]), r["c"]) for r in got} == want


def test_area_is_conserved_by_zones(spark):
    px = spark.range(400).select((F.col("id") / 20).cast("long").alias("row"), (F.col("id") % 20).alias("col"))
    px = px.select("row", "col", (F.col("col") + 0.5).alias("x"), (F.col("row") + 0.5).alias("y"), (F.col("row") * 50.0 + 50).alias("value"), F.lit(2.0).alias("cell_area"))
    ring = lambda x0, x1: F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in [(x0, 0), (x1, 0), (x1, 20), (x0, 20), (x0, 0)]])
    z = spark.createDataFrame([(1,), (2,)], "zone int").withColumn("ring", F.when(F.col("zone") == 1, ring(0, 7)).otherwise(ring(7, 20)))
    prof = raster.zonal_area_profile(px, z, ["zone"], 3.0, 0.0, 100.0, 10)
    assert prof.agg(F.sum("area")).first()[0] == 800.0
    # (lo, hi]: the value 100 belongs to the first bin
    assert prof.where("bin = 0").agg(F.sum("area")).first()[0] == 80.0


def test_stencil_on_a_plane(spark):
    px = spark.range(25).select((F.col("id") / 5).cast("long").alias("row"), (F.col("id") % 5).alias("col"))
    px = px.withColumn("value", 3.0 * F.col("col") - 2.0 * F.col("row"))
    s = raster.stencil(px, raster.derivative_kernels(1.0, 1.0)).where("dhdx is not null").collect()
    assert len(s) == 9
    assert all(abs(r["dhdx"] - 3) < 1e-12 and abs(r["dhdy"] + 2) < 1e-12 and abs(r["dhddx"]) < 1e-12 for r in s)


def test_bilinear_sample_of_a_plane(spark):
    px = spark.range(36).select((F.col("id") / 6).cast("long").alias("row"), (F.col("id") % 6).alias("col"))
    px = px.withColumn("v", (F.col("col") + 0.5) * 2.0 + (F.col("row") + 0.5) * 5.0)
    pts = spark.createDataFrame([(1, 2.25, 3.75), (2, 0.1, 3.0), (3, 5.5, 5.5)], "id int, x double, y double")
    got = {r["id"]: r["v"] for r in raster.sample(pts, px, ["v"], (0.0, 0.0, 1.0, 1.0), "bilinear").collect()}
    assert got[1] == pytest.approx(2.25 * 2 + 3.75 * 5) and got[2] is None and got[3] == pytest.approx(5.5 * 7)


def test_counts_in_caps(spark):
    """Against every pair, with centers at the poles and on the date line, and caps up to half the globe."""
    import math
    import random

    rng = random.Random(7)
    centers = [(0, "a", 0.0, 90.0), (1, "a", 179.9, 10.0), (2, "b", -180.0, -5.0), (3, "b", 20.0, -90.0), (4, "none", 1.0, 1.0)] + [(10 + i, rng.choice("ab"), rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(20)]
    points = [(rng.choice("ab"), rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(400)] + [("a", 0.0, 90.0)] * 3
    xyz = lambda lon, lat: (math.cos(math.radians(lat)) * math.cos(math.radians(lon)), math.cos(math.radians(lat)) * math.sin(math.radians(lon)), math.sin(math.radians(lat)))
    c = spark.createDataFrame(centers, "id int, g string, lon double, lat double")
    p = spark.createDataFrame(points, "g string, lon double, lat double").repartition(3)
    for meters in (5e4, 3e6, 1e7):
        least = math.cos(meters / geo.EARTH_RADIUS_M)
        want = {i: sum(sum(a * b for a, b in zip(xyz(x, y), xyz(u, w), strict=True)) >= least for h, u, w in points if h == g) for i, g, x, y in centers}
        assert {r["id"]: r["n"] for r in spatial.count_in_caps(c, p, meters, "id", ["g"]).collect()} == want
