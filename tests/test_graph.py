import random

import pytest

from obsynth.operators import graph


def forest(n, seed=0, chain=False):
    rnd = random.Random(seed)
    out = []
    for i in range(1, n + 1):
        if i <= 3:
            nxt = 0
        elif chain:
            nxt = i - 3
        else:
            nxt = rnd.randint(1, i - 1) if rnd.random() > 0.3 else rnd.randint(1, min(3, i - 1))
        out.append((i, nxt, 1.0 + (i % 7)))
    return out


def closure(edges):
    nxt = {a: b for a, b, _ in edges}
    for a in nxt:
        path, v = [], a
        while v:
            path.append(v)
            v = nxt.get(v, 0)
        yield a, path


@pytest.mark.parametrize("chain", [False, True])
def test_accumulate_and_trace(spark, chain):
    e = forest(120, 4, chain)
    r = spark.createDataFrame(e, "comid long, next_comid long, length_km double")
    f = spark.createDataFrame([(a, m, float(a * m % 11)) for a, _, _ in e for m in (1, 2)], "comid long, month int, flux double")
    want, longest, trace = {}, {}, set()
    length = {a: w for a, _, w in e}
    for a, path in closure(e):
        run = 0.0
        for s, v in enumerate(path):
            trace.add((a, s, v))
            run += length[v]
            longest[v] = max(longest.get(v, 0.0), run)
            for m in (1, 2):
                want[v, m] = want.get((v, m), 0.0) + float(a * m % 11)
    got = {(x["comid"], x["month"]): x["flux"] for x in graph.accumulate_sum(f, r).collect()}
    assert got == pytest.approx(want)
    assert {x["comid"]: x["longest_km"] for x in graph.accumulate_longest(r).collect()} == pytest.approx(longest)
    t = graph.trace_downstream(r.selectExpr("comid as start"), r)
    assert {tuple(x) for x in t.select("start", "step", "comid").collect()} == trace
    sink = {x["comid"]: x["sink"] for x in graph.downstream_sink(r).collect()}
    assert sink == {a: p[-1] for a, p in closure(e)}
    gap = graph.check_conservation(graph.accumulate_sum(f, r), f, r).collect()[0]["gap"]
    assert gap < 1e-12


def test_missing_downstream_is_a_sink_and_single_nodes_work(spark):
    r = spark.createDataFrame([(5, 99, 2.0), (6, 5, 1.0), (7, 0, 4.0)], "comid long, next_comid long, length_km double")
    f = spark.createDataFrame([(6, 1, 1.0), (5, 1, 2.0), (7, 1, 3.0), (1234, 1, 9.0)], "comid long, month int, flux double")
    assert {x["comid"]: x["flux"] for x in graph.accumulate_sum(f, r).collect()} == {5: 3.0, 6: 1.0, 7: 3.0}
    assert {x["comid"]: x["longest_km"] for x in graph.accumulate_longest(r).collect()} == {5: 3.0, 6: 1.0, 7: 4.0}


def test_star(spark):
    """A hub with very many direct tributaries."""
    n = 5000
    r = spark.range(2, n + 2).selectExpr("id as comid", "1L as next_comid", "1.0D as length_km").union(spark.createDataFrame([(1, 0, 1.0)], "comid long, next_comid long, length_km double"))
    f = r.selectExpr("comid", "1 as month", "1.0D as flux")
    assert graph.accumulate_sum(f, r).where("comid = 1").collect()[0]["flux"] == n + 1


def test_cycle_is_reported(spark, monkeypatch):
    monkeypatch.setattr(graph, "MAX_ROUNDS", 4)
    r = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "comid long, next_comid long, length_km double")
    with pytest.raises(ValueError):
        graph.accumulate_longest(r)


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100), (200, 150), (150, 300)] + [(1000 + rnd.randint(0, 300), 1000 + rnd.randint(0, 300)) for _ in range(220)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    want = {x: find(x) for x in list(parent)}
    got = {r["node"]: r["component"] for r in graph.component_labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_tile_groups_with_override(spark):
    tiles = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "tile_id string")
    touch = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c")], "feature_id long, tile_id string")
    forced = spark.createDataFrame([("d", "x")], "tile_id string, group string")
    got = {r["tile_id"]: r["group"] for r in graph.tile_groups(tiles, touch, forced=forced).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "x"}
