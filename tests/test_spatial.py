"""Points in polygons against ray casting in plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from acreline.operators import spatial

KINDS = "zone_id long, zone string, rings array<array<struct<x: double, y: double>>>"


def inside(x, y, rings):
    """(in it, on a side) by all sides."""
    n, side = 0, False
    for ring in rings or []:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            turn = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
            side |= turn == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2)
            n += (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return side or n % 2 == 1, side


def star(rng, cx, cy, r, n):
    """A star with n corners, convex or not."""
    return [(cx + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * i / n), cy + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]


@pytest.mark.parametrize("cell", [0.01, 0.3, 50.0])
def test_points_equal_ray_casting(spark, cell):
    """Stars, holes in them, land in holes, overlaps; points inside, outside, on sides and on corners; cells of any size."""
    rng = random.Random(5)
    shapes = {}
    for k in range(30):
        cx, cy, r = rng.uniform(-3, 3), rng.uniform(-3, 3), rng.uniform(0.05, 1.5)
        shapes[k] = [star(rng, cx, cy, r, rng.randrange(3, 40)), *([star(rng, cx, cy, r * 0.25, 7), star(rng, cx, cy, r * 0.05, 5)] if k % 2 else [])]
    shapes[30] = [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)]]
    shapes |= {31: [], 32: None, 33: [[]], 34: [[(1.0, 1.0)]]}
    points = [(rng.uniform(-4, 4), rng.uniform(-4, 4)) for _ in range(400)]
    points += [(0.0, 0.0), (2.0, 1.0), (1.0, 0.5), (0.5, 0.5), (1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (-0.01, 0.0)] + [c for k in range(5) for c in shapes[k][0][:4]]
    odd = [(None, 1.0), (1.0, None), (float("nan"), 0.0), (float("inf"), 0.0), points[0], points[0]]
    d = spark.createDataFrame(points + odd, "lng double, lat double").withColumn("row", F.lit("clash")).withColumn("k", F.lit(1))
    got = {(r.lng, r.lat, r.zone_id): r.border for r in spatial.points_in_polygons(d, spark.createDataFrame([(k, "X", v) for k, v in shapes.items()], KINDS), cell).collect()}
    want = {(x, y, k): inside(x, y, v)[1] for x, y in points for k, v in shapes.items() if inside(x, y, v)[0]}
    assert got == want and len(want) > 100


def test_polygon_of_very_many_cells(spark):
    """Rows of cells are made in pieces and blocks; a polygon of a million cells is a few thousand rows."""
    big = [[(-60.0, -60.0), (60.0, -60.0), (0.0, 60.0)]]
    points = [(x / 3, y / 3) for x in range(-100, 100, 7) for y in range(-100, 100, 7)]
    got = {(r.lng, r.lat) for r in spatial.points_in_polygons(spark.createDataFrame(points, "lng double, lat double"), spark.createDataFrame([(1, "X", big)], KINDS), 0.005).collect()}
    assert got == {p for p in points if inside(*p, big)[0]}


def test_flood_zones(spark):
    """High risk goes first, then the order of zones; no zone is NONE; what cannot be read is unknown."""
    square = lambda a, b: [[(a, 30.0), (b, 30.0), (b, 31.0), (a, 31.0)]]
    zones = spark.createDataFrame([(1, "x", square(-90.0, -88.0)), (2, "ae", square(-89.0, -87.0)), (3, "VE", square(-89.0, -87.0)), (4, None, square(-86.0, -85.0)), (5, "", square(-86.0, -85.0))], KINDS)
    spots = [("30.5, -89.5", "X"), ("30.5, -88.5", "AE"), ("30.5, -87.5", "AE"), ("30.5, -85.5", "NONE"), ("31.0, -90.0", "X"), ("40, -100", "NONE"), ("10, -89", None), ("by the river", None), (None, None), ("", None), ("30.5, -89.5", "X")]
    d = spark.createDataFrame([(i, s, "clash") for i, (s, _) in enumerate(spots)], "id int, coordinates string, zone string")
    assert [r.zone for r in spatial.in_flood_zones(d, zones).orderBy("id").collect()] == [z for _, z in spots]
    assert {r.zone for r in spatial.in_flood_zones(d.where("id < 3"), zones.limit(0)).collect()} == {"NONE"}
    assert spatial.in_flood_zones(d.limit(0), zones).count() == 0


def test_equal_shapes_are_asked_once(spark):
    """Zones of equal rings are one shape, with the first of high risk; a zone of two rows stays one polygon with a hole."""
    big, hole = [[(-90.0, 30.0), (-88.0, 30.0), (-88.0, 32.0), (-90.0, 32.0)]], [[(-89.5, 30.5), (-88.5, 30.5), (-88.5, 31.5), (-89.5, 31.5)]]
    rows = [(i, "X" if i % 5 else None, big) for i in range(1, 200)] + [(300, "ve", big), (301, "AE", big), (400, "A", hole), (500, "V", big), (500, "V", hole)]
    zones = spark.createDataFrame(rows, KINDS)
    order = F.struct(~F.col("zone").rlike("(?i)^[av]"), F.col("zone_id"))
    kept = spatial.shapes(zones.where("zone IS NOT NULL"), order).select("zone_id", "zone").collect()
    assert sorted(map(tuple, kept)) == [(300, "ve"), (400, "A"), (500, "V"), (500, "V")]
    d = spark.createDataFrame([(1, "31.0, -89.0"), (2, "30.2, -89.0"), (3, "40.0, -89.0"), (4, None)], "id int, coordinates string")
    assert [r.zone for r in spatial.in_flood_zones(d, zones).orderBy("id").collect()] == ["VE", "VE", "NONE", None]
    assert [r.zone for r in spatial.in_flood_zones(d, zones.where("zone_id IN (400, 500)")).orderBy("id").collect()] == ["A", "V", "NONE", None]


def test_coordinates_are_read_once_by_each_reader(spark):
    """The spots, the rows with one and the rows without read the text, each with one match for lat and one for lng."""
    d = spark.createDataFrame([(1, "30.5, -89.5"), (2, None), (3, "30.5"), (4, "24,-65 or so"), (5, "-89.5, 30.5"), (6, "50.0 , -125.")], "id int, coordinates string")
    zones = spark.createDataFrame([(1, "X", [[(-90.0, 30.0), (-88.0, 30.0), (-88.0, 31.0), (-90.0, 31.0)]])], KINDS)
    got = spatial.in_flood_zones(d, zones)
    assert [(r.lat, r.lng, r.zone) for r in got.orderBy("id").collect()] == [(30.5, -89.5, "X"), (None, None, None), (None, None, None), (24.0, -65.0, "NONE"), (None, None, None), (50.0, -125.0, "NONE")]
    assert 3 <= got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 6
