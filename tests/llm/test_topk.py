"""Exact top-k against all products in numpy, with ties, zeros, nulls and non-finite components."""

import math

import numpy as np
import pytest

from obsynth.llm.topk import exact_top_k


def brute(rows, k, every, scale=64):
    fine = {i: np.floor(np.array(v, float) * scale).astype(np.int64) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted(fine):
        if q % every == 0:
            best = sorted(((-int(fine[q] @ fine[i]), i) for i in fine if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def vectors(seed, n, dim, spread=1.0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim)) * rng.lognormal(0, spread, (n, 1)) * np.linspace(2, 0.1, dim)
    base[5] = base[6] = base[7]
    base[9] = 0
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)]


@pytest.mark.parametrize(("n", "dim", "k", "every", "block"), [(700, 12, 20, 20, 64), (300, 3, 5, 3, 32), (12, 4, 20, 1, 2048)])
def test_equals_brute_force(spark, n, dim, k, every, block):
    rows = vectors(n, n, dim) + [(10_000, None), (10_020, [None] * dim), (10_040, [float("nan")] * dim), (10_060, [float("inf")] * dim), (None, [1.0] * dim)]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double").repartition(5)
    got = sorted(tuple(r) for r in exact_top_k(df, k, every, block=block).collect())
    assert got == brute(rows, k, every)


def test_repeats_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], schema)
    assert sorted(tuple(r) for r in exact_top_k(df).collect()) == [(0, 1, 2, 8192), (0, 2, 1, 4096)]
    assert exact_top_k(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        exact_top_k(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], schema))
