"""Work and memory that grow no faster than the input, with results unchanged."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from obsynth.catalog import plan_queries
from obsynth.catalog.all import QUERIES
from obsynth.operators import bands, filters, robust, rollup, spatial
from obsynth.plans import binning
from plan_text import below

DATA = "/root/testdata/sf0.1"
SMALL = "/root/testdata/sf0.001"


def test_observations_are_not_broadcast(spark):
    sent = below(QUERIES["interval_metrics"](spark, DATA), "BroadcastExchange")
    assert sent and not any("Generate" in x or "c_custkey" in x for x in sent)


def test_every_scale_has_its_way_back(spark):
    got = QUERIES["scale_axis_inverse"](spark, DATA).toPandas()
    assert len(got) == 1000 and (got.s == (0.2 + got.s_suppkey % 47 / 10).round(6)).all()


def test_population_is_decided_by_cubes(spark, monkeypatch):
    def no_search(*_, **__):
        raise AssertionError("a search per pixel and scenario")

    monkeypatch.setattr(spatial, "nearest", no_search)
    rng = np.random.default_rng(3)
    turn = lambda n: (rng.uniform(-180, 180, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n))))
    px, ve = (pd.DataFrame({k: range(n), "lon": a, "lat": b, "country": rng.integers(0, 3, n)}) for k, n in (("pixel_id", 900), ("vertex_id", 250)) for a, b in [turn(n)])
    px["population"], ve["gmax"], ve["runoff"] = rng.integers(1, 50, 900).astype(float), rng.integers(0, 40, 250), rng.uniform(0, 9, 250)
    sc = [(1, 10, 1.0), (2, 30, 5.0)]
    got = spatial.population_near(spark.createDataFrame(px), spark.createDataFrame(ve), spark.createDataFrame(sc, "scenario_id int, min_gmax int, min_runoff double"), [3e5, 2e6])
    want = set()
    for s, g, r in sc:
        for c in range(3):
            a, b = px[px.country == c], ve[(ve.country == c) & (ve.gmax >= g) & (ve.runoff >= r)]
            la, lo, lb, lp = (np.radians(x.to_numpy()) for x in (a.lat, a.lon, b.lat, b.lon))
            h = np.sin((la[:, None] - lb) / 2) ** 2 + np.cos(la)[:, None] * np.cos(lb) * np.sin((lo[:, None] - lp) / 2) ** 2
            m = (2 * 6371000.0 * np.arcsin(np.sqrt(h))).min(1)
            want |= {(c, s, d, a.population[m <= d].sum()) for d in (3e5, 2e6)}
    assert {tuple(x) for x in got.select("country", "scenario_id", "buffer_m", "population").collect()} == want


def test_equal_boxes_meet_as_one(spark, monkeypatch):
    box = lambda x, w: {"min_x": x, "min_y": 0.0, "max_x": x + w, "max_y": 1.0}
    t = "{} long, bbox struct<min_x double, min_y double, max_x double, max_y double>".format
    a = spark.createDataFrame([(k, box(float(k % 2), 2.0)) for k in range(40)], t("a"))
    b = spark.createDataFrame([(7, box(0.5, 1.0)), (8, box(1.5, 1.25)), (9, box(50.0, 1.0))], t("b"))
    pairs, touching = [], spatial.boxes_touching
    monkeypatch.setattr(spatial, "boxes_touching", lambda *x: pairs.append(touching(*x)) or pairs[-1])
    got = spatial.largest_box_overlap(a, b, "a", "b", 10.0)
    assert {tuple(x) for x in got.collect()} == {(7, 0, 1.0), (8, 1, 1.25)} and pairs[0].count() == 4


def test_children_are_dealt_out_before_they_meet_dates(spark):
    h = spark.createDataFrame([(c, c % 2, k, 1.0 + k) for c in range(50) for k in range(2)], "cid long, tile long, height_bin int, area double")
    s = spark.createDataFrame([(m, t, y, k, t + y + k * 1.0) for m in "AN" for t in range(2) for y in range(3) for k in range(2)], "mission string, tile long, time_bin int, height_bin int, dh double")
    g = rollup.downscale_profile(s, h, "cid", "time_bin", "dh", "tile", "height_bin", "area", by=["mission"])
    assert g.count() == 300 and all(abs(r.dh - (r.cid % 2 + r.time_bin + 2 / 3)) < 1e-12 for r in g.collect())
    assert "REPARTITION_BY_NUM" in g._jdf.queryExecution().executedPlan().toString()


def test_stages_write_what_is_read_several_times(spark, monkeypatch):
    tables = []
    for module in (plan_queries, binning):
        monkeypatch.setattr(module, "cut_lineage", lambda df, f=module.cut_lineage: tables.append(f(df)) or tables[-1])
    QUERIES["synthesized_cube"](spark, SMALL)
    assert len(tables) == 1
    QUERIES["binning_stage"](spark, SMALL)
    assert len(tables) == 4  # the points of the query, points with surfaces, variants


def test_binning_stage_writes_points_once(spark, monkeypatch):
    """All tables together hold little more rows than there are points, and the cells take one shuffle."""
    tables = []
    for module in (plan_queries, binning, filters, robust):
        monkeypatch.setattr(module, "cut_lineage", lambda df, f=module.cut_lineage: tables.append(f(df)) or tables[-1])
    got = QUERIES["binning_stage"](spark, DATA)
    n = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert n < sum(t.count() for t in tables) < 1.1 * n
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


@pytest.mark.parametrize("together", [1 << 18, 25, 0])
def test_cells_of_dealt_rows(spark, monkeypatch, together):
    """Cells found in one place, and those of deals too large for it, are those of the plain operator."""
    monkeypatch.setattr(robust, "MOST_TOGETHER", together)
    rng, methods = np.random.default_rng(8), ["median", "mean", "nmad1", "nmad5"]
    odd = [(None, 0, 1.5), (None, 0, -9.0), ("b", 1, float("nan")), ("b", 1, None), ("c", 2, 7.0), ("d", 0, float("nan"))]
    same = [("e", 0, 2.0)] * 9 + [("e", 0, 50.0)]
    d = spark.createDataFrame([("a", int(k), float(x)) for k, x in zip(rng.integers(0, 4, 40), rng.normal(0, 9, 40).round(1))] + odd + same, "place string, k int, v double")
    spread = lambda d: d.withColumn("t", F.explode(F.array(F.lit(0), F.lit(1)))).select("place", (F.hash("place").cast("long") * 100 + F.col("k") * 2 + F.col("t")).alias("cell"), (F.col("v") * (1 + F.col("t"))).alias("v"))
    got = {(r.place, r.cell, r.method): (r.v, r.nobs) for r in robust.reduce_cells(d, ["place"], spread, "cell", "v", methods).collect()}
    want = {(r.place, r.cell, r.method): (pytest.approx(r.v, rel=1e-12), r.nobs) for r in robust.reduce_bins_methods(spread(d), ["cell", "place"], "v", methods).collect()}
    assert len(got) == 4 * 2 * 7 and got == want


def test_medians_of_few_groups_meet_rows_where_they_lie(spark):
    rng = np.random.default_rng(9)
    p = pd.DataFrame({"a": rng.choice(["x", "y"], 4000), "b": rng.integers(0, 3, 4000), "v": rng.standard_cauchy(4000).round(2)})
    d = spark.createDataFrame(p.values.tolist() + [[None, 0, 1.0], [None, 0, 2.0], ["z", 0, float("nan")]], "a string, b long, v double")
    got = {(r.a, r.b): (r.median, r.nobs) for r in robust.medians_of_many(d, ["a", "b"], "v").collect()}
    assert got == {k: (pytest.approx(g.v.median()), len(g)) for k, g in p.groupby(["a", "b"])} | {(None, 0): (1.5, 2)}


def band_rows(p, q, edges):
    """n, s, c by year, id of q and band, from all pairs of q and p."""
    out = {}
    for (y, i), g in q.groupby(["year", "id"]):
        r = p[(p.year == y) & (p.id != i)]
        for band in range(len(edges) - 1):
            n, s, c = 0, 0.0, 0
            for x in g.itertuples():
                a, b = np.radians(r.lat), np.radians(x.lat)
                m = 2 * 6371000.0 * np.arcsin(np.minimum(1, np.sqrt(np.sin((a - b) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(r.lon - x.lon) / 2) ** 2)))
                diff = (r.v - x.v).abs()[(m > edges[band]) & (m <= edges[band + 1])]
                n, s, c = n + len(diff), s + diff.sum(skipna=False), c + (diff != 0).sum()
            if n:
                out[int(y), int(i), band] = (n, pytest.approx(s, nan_ok=True), c)
    return out


def test_variogram_looks_at_few_pairs(monkeypatch):
    """The pairs that are looked at grow far slower than all pairs, and the sums are those of all."""
    rng = np.random.default_rng(5)
    edges, share = [0.0, 1e6, 2e6, 4e6], []
    for n in (10000, 160000):
        p = pd.DataFrame({"year": 0, "id": range(n), "lon": rng.uniform(-180, 180, n), "lat": np.degrees(np.arcsin(rng.uniform(-1, 1, n))), "v": rng.normal(0, 1, n).round(2)})
        u = bands.unit(p.lon.to_numpy(), p.lat.to_numpy())
        o = bands.along_curve(u)
        p, q, looked = p.iloc[o], p.iloc[o[u[o, 0] > 0.985]], []
        with monkeypatch.context() as m:
            m.setattr(bands, "tested", lambda q, d, f=bands.tested, looked=looked: looked.append(len(q) * len(d)) or f(q, d))
            sums = bands.BandSums(q.lon.to_numpy(), q.lat.to_numpy(), q.v.to_numpy(), np.array(edges))
            for part in (p[: n // 3], p[n // 3 :]):
                sums.add(part.lon.to_numpy(), part.lat.to_numpy(), part.v.to_numpy())
        share.append(sum(looked) / (len(q) * n))
        got = {(0, int(q.id.iloc[k]), int(b)): tuple(x) for k, b, *x in zip(*sums.result()[:5])}
        want = band_rows(p, q[:40], edges)
        assert {k: got[k] for k in want} == want and len(got) == 3 * len(q)
    assert share[1] < 0.4 * share[0] and share[1] < 0.25


def test_variogram_of_odd_rows(spark):
    """Repeated ids, places held by many, equal values, values and coordinates that are no numbers."""
    rng = np.random.default_rng(6)
    n, edges = 300, [0.0, 1e6, 5e6, 2.1e7]
    p = pd.DataFrame({"year": rng.integers(0, 2, n), "id": rng.integers(0, 250, n), "lon": rng.uniform(-180, 180, n), "lat": rng.uniform(-90, 90, n), "v": rng.normal(0, 1, n).round(1)})
    p.loc[:80, ["lon", "lat"]] = [179.9, 89.0]
    p.loc[90:93, "v"] = [np.inf, -np.inf, np.nan, np.inf]
    p.loc[100:102, "lon"] = np.nan
    placed = p[p.lon.notna()]
    d = spark.createDataFrame(p.astype(object).values.tolist(), "year int, id long, lon double, lat double, v double")
    got = {(r.year, r.id, r.band): (r.n, r.s, r.c) for r in spatial.distance_band_means(d, ["year"], "id", "v", edges, 20.0).collect()}
    assert got == band_rows(placed, placed, edges)
