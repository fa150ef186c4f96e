"""Every named query runs at the smallest scale and equals its SQL twin."""

import functools
import os

import pytest

from obsynth.catalog.all import ORACLES, QUERIES
from tools.check import compare, connect

# fits and smoothing that SQL does not express; their parts are tested against numpy elsewhere
NO_SQL = {"surface_model_fill", "surface_model_params", "replace_with_model", "profile_fill", "monthly_spline", "filled_cube", "calibrated_runs", "regional_results", "river_routing"}
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LARGER = os.environ.get("TEST_LARGER_DIR", "/root/testdata/sf0.01")


@functools.cache
def con(d):
    return connect(d)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    for d in (DATA, LARGER):  # some results are empty at the smallest scale
        got = QUERIES[name](spark, d).toArrow()
        if got.num_rows:
            break
    if name in ORACLES:
        res = compare(got, con(d).execute(ORACLES[name]).to_arrow_table())
        assert res == "", res
    else:
        assert name in NO_SQL and got.num_rows > 0


def test_entry(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.columns == ["tile", "n", "trend", "amplitude", "phase_day"]
    assert df.count() > 0
