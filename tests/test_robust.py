import math

import numpy as np
import pandas as pd
import pytest

from obsynth.operators import robust


def frame(spark, seed=1, hot=4000):
    """One hot group with ties and outliers, several small ones, one constant group."""
    rng = np.random.default_rng(seed)
    parts = [pd.DataFrame({"k": "hot", "x": np.round(np.concatenate([rng.normal(5, 2, hot - 50), rng.uniform(-1e6, 1e6, 50)]), 2)})]
    for i, n in enumerate([1, 2, 5, 40]):
        parts.append(pd.DataFrame({"k": f"s{i}", "x": rng.normal(i, 1, n)}))
    parts.append(pd.DataFrame({"k": "const", "x": [3.0] * 300}))
    parts.append(pd.DataFrame({"k": "two", "x": [1.0] * 200 + [2.0] * 200}))
    pdf = pd.concat(parts, ignore_index=True)
    return pdf, spark.createDataFrame(pdf)


def test_quantiles(spark):
    pdf, df = frame(spark)
    probs = {"q05": 0.05, "q50": 0.5, "q95": 0.95, "lo": 0.0, "hi": 1.0}
    got = {r["k"]: r for r in robust.group_quantiles(df, ["k"], "x", probs).collect()}
    for k, g in pdf.groupby("k"):
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(g["x"], p), rel=1e-12, abs=1e-9), (k, name)


@pytest.mark.parametrize("method", ["nmad3", "nmad5", "median", "mean"])
def test_reduce_bins(spark, method):
    pdf, df = frame(spark, 3)
    got = {r["k"]: r for r in robust.reduce_bins(df, ["k"], "x", method).collect()}
    for k, g in pdf.groupby("k"):
        x = g["x"].to_numpy()
        m = np.median(x)
        if method == "median":
            want = m
        elif method == "mean":
            want = x.mean()
        else:
            d = np.abs(x - m)
            keep = (d < float(method[4:]) * 1.4826 * np.median(d)) | (d == 0)
            want = x[keep].mean() if keep.any() else m
        assert got[k]["x"] == pytest.approx(want, rel=1e-9), (k, method)
        assert got[k]["nobs"] == len(x)


def test_mad_and_score(spark):
    pdf, df = frame(spark, 5)
    got = {r["k"]: r for r in robust.group_mad(df, ["k"], "x").collect()}
    for k, g in pdf.groupby("k"):
        m = np.median(g["x"])
        assert got[k]["median"] == pytest.approx(m)
        assert got[k]["mad"] == pytest.approx(np.median(np.abs(g["x"] - m)))
    s = robust.with_nmad(df, ["k"], "x").where("k = 'const'").collect()
    assert {r["nmad"] for r in s} == {0.0}


def test_missing_values_are_left_out(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("a", 3.0)], "k string, x double")
    r = robust.reduce_bins(df, ["k"], "x", "median").collect()[0]
    assert (r["x"], r["nobs"]) == (2.0, 2)
    assert not math.isnan(r["x"])


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 4.0), ("a", 3.0)], "k string, x double")
    assert {tuple(r) for r in robust.group_quantiles(df, ["k"], "x", {"q": 0.5}).collect()} == {(None, 2.5), ("a", 3.0)}
    assert {tuple(r) for r in robust.reduce_bins(df, ["k"], "x", "nmad5").collect()} == {(None, 2.5, 2), ("a", 3.0, 1)}


def test_zero_mad_keeps_values_at_the_median(spark):
    df = spark.createDataFrame([("a", v) for v in [2.0, 2.0, 2.0, 9.0]], "k string, x double")
    assert robust.reduce_bins(df, ["k"], "x", "nmad5").collect()[0]["x"] == 2.0


def test_methods_in_one_pass(spark):
    _, df = frame(spark, 9)
    methods = ["median", "mean", "nmad3", "nmad5"]
    got = {(r["k"], r["method"]): (r["x"], r["nobs"]) for r in robust.reduce_bins_methods(df, ["k"], "x", methods).collect()}
    for m in methods:
        for r in robust.reduce_bins(df, ["k"], "x", m).collect():
            assert got[r["k"], m] == (pytest.approx(r["x"], rel=1e-12), r["nobs"])
