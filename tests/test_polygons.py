"""The edge index and the relations of polygons against plain geometry in Python."""

import math
import random

import pytest

from obsynth.operators import polygons as P
from obsynth.operators import spatial

SCHEMA = "zone int, name string, ring array<array<struct<x: double, y: double>>>"


def inside(px, py, rings):
    odd = False
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1], strict=True):
            if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def star(rng, cx, cy, size, n):
    return [(cx + size * rng.uniform(0.4, 1) * math.cos(2 * math.pi * i / n), cy + size * rng.uniform(0.4, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def square(cx, cy, h, closed=False):
    r = [(cx - h, cy - h), (cx + h, cy - h), (cx + h, cy + h), (cx - h, cy + h)]
    return r + r[:1] if closed else r


def shapes(seed):
    rng = random.Random(seed)
    zones = []
    for k in range(12):
        cx, cy = rng.uniform(-40, 40), rng.uniform(-30, 30)
        rings = [star(rng, cx, cy, rng.uniform(3, 25), rng.choice([5, 9, 400]))]
        if k % 3 == 0:
            rings += [square(cx, cy, 1.0)[::-1], square(cx, cy, 0.4)]
        if k % 4 == 1:
            rings.append(star(rng, cx + 35, cy, 4, 7))
        zones.append((k, f"z{k}", rings))
    zones.append((50, "grid", [square(0, 0, 10, True), square(5, 5, 5)[::-1]]))  # all sides on grid lines
    zones.append((52, "corners", [[(0, 5), (5, 0), (10, 5), (5, 10)], [(-20, -10), (10, 20), (-20, 20)], [(-9, -27), (21, 3), (-9, 33), (-39, 3)]]))  # sides pass the grid's corners
    zones.append((51, "copy", zones[0][2]))
    zones += [(60, "none", None), (61, "empty", []), (62, "point", [[(1.0, 1.0)]]), (63, "blank", [[]])]
    return zones


def frame(spark, zones):
    return spark.createDataFrame([(k, n, r if r is None else [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in r]) for k, n, r in zones], SCHEMA)


@pytest.mark.parametrize("cell", [10.0, 3.0])
def test_points_in_zones(spark, cell):
    zones, rng = shapes(1), random.Random(2)
    points = [(i, rng.uniform(-60, 80), rng.uniform(-50, 50)) for i in range(600)] + [(1000 + i, float(x), float(y)) for i, (x, y) in enumerate([(x, y) for x in range(-11, 12, 1) for y in range(-11, 12, 1)])]
    points += [(5000, points[0][1], points[0][2]), (5001, None, 1.0)]
    p = spark.createDataFrame(points, "site int, lon double, lat double").repartition(3)
    z = frame(spark, zones)
    want = {(i, k) for i, x, y in points if x is not None for k, _, r in zones if r and inside(x, y, r)}
    got = P.points_in_zones(p, z, cell).collect()
    assert {(r["site"], r["zone"]) for r in got} == want and len(got) == len(want)
    assert all(r["name"] == dict((k, n) for k, n, _ in zones)[r["zone"]] for r in got)
    hit = {i for i, _ in want}
    assert sorted(r["site"] for r in P.points_in_zones(p, z, cell, how="left_semi").collect()) == sorted(hit)
    assert sorted(r["site"] for r in P.points_in_zones(p, z, cell, how="left_anti").collect()) == sorted(i for i, _, _ in points if i not in hit)


def test_large_ring(spark):
    """10^5 corners: no cell holds more than a few hundred of its edges."""
    n = 100_000
    wave = [(50 * math.cos(2 * math.pi * i / n) * (1 + 0.1 * math.sin(i / 300)), 40 * math.sin(2 * math.pi * i / n) * (1 + 0.1 * math.sin(i / 300))) for i in range(n)]
    z = frame(spark, [(1, "wave", [wave])])
    rng = random.Random(3)
    points = [(i, rng.uniform(-60, 60), rng.uniform(-50, 50)) for i in range(60)]
    got = P.points_in_zones(spark.createDataFrame(points, "site int, lon double, lat double"), z, 10.0)
    assert {r["site"] for r in got.collect()} == {i for i, x, y in points if inside(x, y, [wave])}
    assert P.zone_cells(z, 10.0).selectExpr("max(size(_edges)) as m").first()["m"] < 300


def area(rings):
    return abs(sum((x1 - x2) * (y1 + y2) / 2 for r in rings for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1], strict=True)))


def clipped(rings, box):
    """Area of rings inside a convex box, by Sutherland and Hodgman on each ring (holes run the other way)."""
    total = 0.0
    for r in rings:
        out = list(r)
        for (ax, ay), (bx, by) in zip(box, box[1:] + box[:1], strict=True):
            side = lambda p, ax=ax, ay=ay, bx=bx, by=by: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)
            new = []
            for p, q in zip(out, out[1:] + out[:1], strict=True):
                sp, sq = side(p), side(q)
                if sp >= 0:
                    new.append(p)
                if (sp > 0 > sq) or (sp < 0 < sq):
                    t = sp / (sp - sq)
                    new.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            out = new
            if not out:
                break
        total += sum((x1 - x2) * (y1 + y2) / 2 for (x1, y1), (x2, y2) in zip(out, out[1:] + out[:1], strict=True)) if out else 0.0
    return abs(total)


@pytest.mark.parametrize("cell", [10.0, 2.5])
def test_overlap_areas(spark, cell):
    zones, rng = shapes(4), random.Random(5)
    boxes = [(100 + i, f"b{i}", [square(rng.uniform(-50, 50), rng.uniform(-40, 40), rng.uniform(1, 15), i % 2 == 0)]) for i in range(15)]
    boxes += [(200, "same", [square(0, 0, 10)]), (201, "turned", [square(0, 0, 10)[::-1]]), (202, "beside", [square(20, 0, 10)])]
    got = {(r["zone"], r["box"]): r["overlap"] for r in P.overlap_areas(frame(spark, zones), frame(spark, boxes).withColumnRenamed("zone", "box"), "zone", "box", cell).collect()}
    for k, _, rings in zones:
        for b, _, box in boxes:
            want = clipped(rings, box[0] if b != 201 else box[0][::-1]) if rings and max(map(len, rings)) > 2 else 0.0
            assert got.get((k, b), 0.0) == pytest.approx(want, abs=1e-6), (k, b)
    assert got[50, 200] == pytest.approx(area([square(0, 0, 10), square(5, 5, 5)[::-1]]))
    assert (50, 202) not in got


def test_meeting(spark):
    ell = [(0, 0), (10, 0), (10, 2), (2, 2), (2, 10), (0, 10)]
    frame_ring = [square(30, 30, 8), square(30, 30, 6)[::-1]]
    a = [(1, "ell", [ell]), (2, "frame", frame_ring)]
    b = [
        (10, "in the notch", [square(6, 6, 2)]), (11, "across", [square(2, 2, 1)]), (12, "in the hole", [square(30, 30, 5)]), (13, "around", [square(30, 30, 20)]),
        (14, "touches a corner", [[(10, 2), (12, 2), (12, 4)]]), (15, "within", [square(1, 1, 0.5)]), (16, "in the rim", [square(37, 30, 0.5)]), (17, "far", [square(-50, 0, 3)]),
    ]
    got = {(r["zone"], r["other"]) for r in P.zones_meeting(frame(spark, a), frame(spark, b).withColumnRenamed("zone", "other"), "zone", "other", 4.0).collect()}
    assert got == {(1, 11), (1, 14), (1, 15), (2, 13), (2, 16)}
    tiles = spark.createDataFrame([(10, {"min_x": 4.0, "min_y": 4.0, "max_x": 8.0, "max_y": 8.0}), (11, {"min_x": 1.0, "min_y": 1.0, "max_x": 3.0, "max_y": 3.0})], "tile int, bbox struct<min_x: double, min_y: double, max_x: double, max_y: double>")
    assert [r["tile"] for r in spatial.tiles_touching_zones(tiles, frame(spark, a), "tile", "zone", 4.0, "ring").collect()] == [11]
