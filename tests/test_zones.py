"""Zones of points against every polygon's rings, one ray each."""

import math
import random

import pytest

from cadence.operators import zones


def inside(rings, lat, lon):
    odd = False
    for ring in rings:
        for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > lat) != (y2 > lat) and x1 + (lat - y1) / (y2 - y1) * (x2 - x1) > lon:
                odd = not odd
    return odd


def polygons(draw):
    """Stars around a middle, every third with a hole, one with corners on whole degrees."""
    out = []
    for z in range(10):
        y, x = draw.uniform(-20, 20), draw.uniform(-20, 20)

        def ring(reach):
            n = draw.randint(3, 15)
            return [(y + reach * draw.uniform(0.4, 1) * math.sin(2 * math.pi * k / n), x + reach * draw.uniform(0.4, 1) * math.cos(2 * math.pi * k / n)) for k in range(n)]

        out.append((f"z{z}", ring(draw.uniform(0.2, 9))))
        if z % 3 == 0:
            out.append((f"z{z}", ring(0.15)))
        if z == 5:
            out[-1] = ("z5", [(float(round(a)), float(round(b))) for a, b in out[-1][1]])
    return out


@pytest.mark.parametrize("seed,side", [(1, 1.0), (2, 2.5), (3, 0.7)])
def test_against_all_polygons(spark, seed, side):
    draw = random.Random(seed)
    given = polygons(draw)
    points = [(i, draw.uniform(-25, 25), draw.uniform(-25, 25)) for i in range(1500)] + [(5000 + i, float(draw.randint(-20, 20)), draw.randint(-20, 20) + 0.5703) for i in range(60)]
    points += [(9000, *points[0][1:]), (9001, None, 1.0), (9002, 1.0, None), (9003, 89.9, 179.9)]
    rings = {}
    for zone, ring in given:
        rings.setdefault(zone, []).append(ring)
    frame = spark.createDataFrame([(i, a, b, 1, "x") for i, a, b in points], "id int, lat double, lon double, tx int, edges string")
    got = {r.id: r.zone for r in zones.with_zone(frame, spark.createDataFrame(given, "zone string, ring array<struct<lat:double,lon:double>>"), side, otherwise="UTC").collect()}
    want = {i: "UTC" if a is None or b is None else min((z for z in rings if inside(rings[z], a, b)), default="UTC") for i, a, b in points}
    assert got == want and sum(v != "UTC" for v in want.values()) > 100


def test_no_polygons_and_lines(spark):
    points = spark.createDataFrame([(1.0, 1.0)], "lat double, lon double")
    for given in ([], [("z", [(0.0, 0.0), (2.0, 2.0)])], [("z", None)]):
        assert zones.with_zone(points, spark.createDataFrame(given, "zone string, ring array<struct<lat:double,lon:double>>")).first().zone is None


def test_join_is_by_tile(spark):
    points = spark.createDataFrame([(1.0, 1.0)], "lat double, lon double")
    square = spark.createDataFrame([("z", [(0.0, 0.0), (0.0, 9.0), (9.0, 9.0), (9.0, 0.0)])], "zone string, ring array<struct<lat:double,lon:double>>")
    plan = zones.with_zone(points, square)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    found = {(r.ty, r.tx): (r.center_in, r.edges is None) for r in zones.tiles(square, 3.0).collect()}
    assert found[1, 1] == (True, True) and found[0, 0] == (True, False)
