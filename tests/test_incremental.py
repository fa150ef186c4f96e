import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from obsynth.operators import ensemble, filters, merge, rollup
from obsynth.sources import points, tables
from obsynth.streaming import bins, incremental


def test_merges_are_idempotent(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    b = spark.createDataFrame([(2, "B"), (3, "C")], "id int, v string")
    left = merge.left_merge(a, b, ["id"])
    right = merge.right_merge(a, b, ["id"])
    assert {tuple(r) for r in left.collect()} == {(1, "a"), (2, "b"), (3, "C")}
    assert {tuple(r) for r in right.collect()} == {(1, "a"), (2, "B"), (3, "C")}
    assert {tuple(r) for r in merge.left_merge(left, b, ["id"]).collect()} == {tuple(r) for r in left.collect()}
    assert {tuple(r) for r in merge.right_merge(right, b, ["id"]).collect()} == {tuple(r) for r in right.collect()}


def test_build_archive_is_incremental(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    cols = "mission string, tile_id string, granule_id string, point_id long, height double"
    one = spark.createDataFrame([("i", "t1", "g1", 1, 5.0), ("i", "t2", "g1", 2, 6.0)], cols)
    two = spark.createDataFrame([("i", "t1", "g1", 1, 5.0), ("i", "t1", "g2", 3, 7.0), ("i", "t9", "g3", 4, 8.0)], cols)
    dom = spark.createDataFrame([("t1", 0.5), ("t2", 0.1), ("t9", 0.0)], "tile_id string, glacier_frac double")
    assert incremental.build_archive(spark, one, f"{base}/p", f"{base}/l", dom) == 2
    assert incremental.build_archive(spark, two, f"{base}/p", f"{base}/l", dom) == 1
    assert incremental.build_archive(spark, two, f"{base}/p", f"{base}/l", dom) == 0
    assert sorted(r["point_id"] for r in points.scan_points(spark, f"{base}/p", ["point_id"]).collect()) == [1, 2, 3]
    plan = points.scan_points(spark, f"{base}/p", ["point_id"], "i", ["t1"])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "ReadSchema: struct<point_id:bigint>" in plan


def test_partition_overwrite_keeps_the_rest(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    incremental.overwrite_partitions(spark.createDataFrame([("a", 1), ("b", 2)], "mission string, v int"), f"{base}/x", ["mission"])
    incremental.overwrite_partitions(spark.createDataFrame([("b", 9)], "mission string, v int"), f"{base}/x", ["mission"])
    assert {(r["mission"], r["v"]) for r in spark.read.parquet(f"{base}/x").collect()} == {("a", 1), ("b", 9)}


def test_stage_ledger(spark):
    led = spark.createDataFrame([("bin", "k1", 3), ("bin", "k2", 5)], "stage string, key string, input_version int")
    inp = spark.createDataFrame([("k1", 4), ("k2", 5), ("k3", 1)], "key string, input_version int")
    stale = incremental.stale_keys(inp, led, "bin")
    assert {r["key"] for r in stale.collect()} == {"k1", "k3"}
    led2 = incremental.record_stage(led, stale, "bin")
    assert incremental.stale_keys(inp, led2, "bin").count() == 0


def test_streaming_bins_equal_batch(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(hours=7 * i), i % 3, "m", float(i)) for i in range(200)]
    schema = "id long, ts timestamp, tile int, mission string, value double"
    df = spark.createDataFrame(rows, schema)
    df.where("id < 120").coalesce(1).write.mode("append").parquet(f"{base}/in")

    def run():
        s = bins.read_granules(spark, f"{base}/in", df.schema, 1)
        bins.upsert_bins(s, f"{base}/out", f"{base}/state", ["tile", "mission"], "value").awaitTermination()

    run()
    df.where("id >= 120").coalesce(1).write.mode("append").parquet(f"{base}/in")
    # a late file: points of the first days
    df.where("id < 5").withColumn("value", F.col("value") + 1).coalesce(1).write.mode("append").parquet(f"{base}/in")
    run()
    got = {(r["time_bin"], r["tile"]): (r["nobs"], r["total"]) for r in bins.read_upserts(spark, f"{base}/out", ["tile", "mission"]).collect()}
    full = df.unionByName(df.where("id < 5").withColumn("value", F.col("value") + 1))
    idx = F.floor(F.datediff(F.to_date("ts"), F.lit("1990-01-01").cast("date")) / 30).cast("int")
    want = {(r["b"], r["tile"]): (r["n"], r["t"]) for r in full.groupBy(idx.alias("b"), "tile").agg(F.count("*").alias("n"), F.sum("value").alias("t")).collect()}
    assert got == want


def test_watermarked_bins_and_dedupe(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i % 50, t0 + dt.timedelta(days=i % 50), "t", 1.0) for i in range(100)]  # every point delivered twice
    df = spark.createDataFrame(rows, "id long, ts timestamp, tile string, value double")
    df.coalesce(1).write.parquet(f"{base}/in")
    s = bins.dedupe(bins.read_granules(spark, f"{base}/in", df.schema), ["id"], lateness="60 days")
    b = bins.bin_stream(s, ["tile"], "value", width="10 days", lateness=None)
    bins.run_bins(b, f"{base}/out", f"{base}/state").awaitTermination()
    # the watermark trails by 60 days, so nothing is final yet
    assert spark.read.schema(b.schema).parquet(f"{base}/out").count() == 0
    late = spark.createDataFrame([(999, t0 + dt.timedelta(days=500), "t", 1.0)], df.schema)
    late.coalesce(1).write.mode("append").parquet(f"{base}/in")
    s = bins.dedupe(bins.read_granules(spark, f"{base}/in", df.schema), ["id"], lateness="60 days")
    bins.run_bins(bins.bin_stream(s, ["tile"], "value", width="10 days", lateness=None), f"{base}/out", f"{base}/state").awaitTermination()
    got = spark.read.schema(b.schema).parquet(f"{base}/out")
    assert got.agg(F.sum("nobs")).first()[0] == 50


def test_labelled_tables_keep_units(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    df = spark.createDataFrame([(1, 2.0)], "region int, dm double")
    tables.write_labelled(df, f"{base}/x", {"dm": "Gt"})
    back, units = tables.read_labelled(spark, f"{base}/x")
    assert units == {"dm": "Gt"} and back.collect()[0]["dm"] == 2.0


def test_repeated_draws_are_stable(spark):
    df = spark.range(2000).withColumnRenamed("id", "cell")
    a, b = (points.repeated_draws(df, 5, 0.7, ["cell"], seed=3) for _ in range(2))
    assert a.exceptAll(b.repartition(3)).isEmpty()
    share = a.count() / (5 * 2000)
    assert 0.65 < share < 0.75


def test_merge_weights(spark):
    v = spark.createDataFrame([(1, "a", "t", 1, 2.0), (1, "b", "t", 1, 4.0), (1, "a", "t", 2, 7.0)], "run_id int, mission string, tile_id string, c int, dh double")
    e = spark.createDataFrame([("a", "t", 1, 1.0), ("b", "t", 1, 0.5)], "mission string, tile_id string, c int, err double")
    got = {r["c"]: (r["dh"], r["err"]) for r in ensemble.inverse_variance_merge(v, e, ["tile_id", "c"]).collect()}
    assert got[1] == (pytest.approx((2 + 16) / 5), pytest.approx((1 / 5) ** 0.5))
    assert got[2] == (7.0, pytest.approx((1 / 0.001) ** 0.5))  # a value without an error still counts


def test_error_floor_and_quantile_strictness(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (2, "x", None), (1, "y", 1.0), (2, "y", 3.0)], "run_id int, k string, value double")
    q = {r["k"]: r["quantile"] for r in ensemble.quantile_over_runs(df, ["k"], 0.5).collect()}
    assert q == {"x": None, "y": 2.0}
    e = spark.createDataFrame([(10.0, 1.0)], "value double, error double")
    assert ensemble.error_floor(e, 0.2).collect()[0]["error"] == 2.0
    assert ensemble.error_floor(e, 0.05).collect()[0]["error"] == 1.0
    assert ensemble.error_floor(e, 0.05, compat=True).collect()[0]["error"] == 0.5


def test_min_support_and_audit(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(2)], "k string, i int")
    assert filters.min_support(df, ["k"], 3).select("k").distinct().collect()[0]["k"] == "a"
    assert [tuple(r) for r in filters.audit_row_counts(df, df.where("i < 2"), ["k"]).collect()] == [("a", 5, 2)]


def test_composites(spark):
    from obsynth.schema import region_members

    df = spark.createDataFrame([(13, 1.0), (14, 2.0), (1, 5.0)], "code int, v double")
    got = {r["region"]: r["v"] for r in rollup.region_rollup(df, region_members(spark), [], ["v"]).collect()}
    assert got == {1: 5.0, 13: 1.0, 14: 2.0, 98: 3.0, 99: 8.0}


def test_mission_visibility(spark):
    t = spark.createDataFrame([("n", 70.0, 72.0), ("m", 10.0, 12.0)], "tile_id string, min_y double, max_y double")
    seen = {(r["tile_id"], r["mission"]) for r in ensemble.mission_sees_tile(t).collect()}
    assert ("n", "gedi") not in seen and ("m", "gedi") in seen and ("n", "icesat2") in seen


def test_all_missing_guard(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0)], "v string, x double")
    with pytest.raises(ValueError):
        filters.assert_not_all_missing(df, ["v"], "x")
