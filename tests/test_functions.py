"""Column functions: boundary cases, and properties against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from pointloom.functions import crs, geometry as G, labels, tiles


def values(spark, columns, **exprs):
    df = spark.createDataFrame(columns[1], columns[0])
    return [tuple(r) for r in df.select(*[e.alias(n) for n, e in exprs.items()]).collect()]


SQUARE, HOLE = [(0, 0), (10, 0), (10, 10), (0, 10)], [(4, 4), (6, 4), (6, 6), (4, 6)]


@pytest.mark.parametrize(
    "x, y, inside, holed",
    [(0, 0, True, True), (5, 0, True, True), (10, 10, True, True), (11, 5, False, False), (5, 5, True, False), (4, 5, True, False), (6, 6, True, False), (3, 5, True, True), (-1, 0, False, False), (5, 10, True, True)],
)
def test_polygon_edges(spark, x, y, inside, holed):
    ring, hole = G.ring_of(SQUARE), G.ring_of(HOLE)
    (got,) = values(spark, ("x long, y long", [(x, y)]), a=G.in_ring(F.col("x"), F.col("y"), ring), b=G.in_polygon(F.col("x"), F.col("y"), F.array(ring, hole)))
    assert got == (inside, holed)


def test_concave_notch_and_short_rings(spark):
    ring = G.ring_of([(1000, 1000), (9000, 1000), (9000, 9000), (5000, 4000), (1000, 9000)])
    rows = [(5000, 4001), (5000, 4000), (5000, 3999), (1000, 9000), (9001, 1000)]
    got = values(spark, ("x long, y long", rows), a=G.in_ring(F.col("x"), F.col("y"), ring), b=G.in_ring(F.col("x"), F.col("y"), G.ring_of([(0, 0), (9999, 9999)])))
    assert [a for a, _ in got] == [False, True, True, True, False] and not any(b for _, b in got)


def test_in_ring_against_winding(spark):
    rng = random.Random(1)
    ring = [(round(5000 + r * c), round(5000 + r * s)) for r, c, s in ((rng.randint(1000, 4900), __import__("math").cos(k / 9), __import__("math").sin(k / 9)) for k in range(56))]
    points = [(rng.randint(0, 10000), rng.randint(0, 10000)) for _ in range(500)] + ring

    def inside(x, y):
        n = 0
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            side = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
            if side == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return True
            n += (ay <= y < by and side > 0) - (by <= y < ay and side < 0)
        return n != 0

    got = values(spark, ("x long, y long", points), a=G.in_ring(F.col("x"), F.col("y"), G.ring_of(ring)))
    assert [a for (a,) in got] == [inside(*p) for p in points]


def test_distance_to_segments_and_clipping(spark):
    x, y = F.col("x"), F.col("y")
    box = {"x_min": F.lit(0), "x_max": F.lit(10), "y_min": F.lit(0), "y_max": F.lit(10)}
    rows = [(13, 14), (5, 12), (10, 10), (5, 5)]
    got = values(spark, ("x long, y long", rows), d=G.segment_distance2(x, y, F.lit(0), F.lit(10), F.lit(10), F.lit(10)), near=G.near_ring(x, y, G.ring_of(SQUARE), 2))
    assert got == [(25.0, False), (4.0, True), (0.0, True), (25.0, True)]
    cuts = values(spark, ("ax long, ay long, bx long, by long", [(-5, 5, 15, 5), (20, 20, 30, 30), (2, 2, 8, 8), (5, -10, 5, 10), (-1, 0, -1, 5)]), c=G.clipped_segment(*map(F.col, ("ax", "ay", "bx", "by")), box))
    assert [None if c is None else (c.t0, c.t1) for (c,) in cuts] == [(0.25, 0.75), None, (0.0, 1.0), (0.5, 1.0), None]


def test_areas_and_angles(spark):
    (got,) = values(spark, ("u array<double>", [([0.0, 0.0, 2.0],)]), a=G.ring_area(G.ring_of(SQUARE)), b=G.vector_angle(F.col("u")), c=G.vector_angle(F.col("u"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))))
    assert got == pytest.approx((100.0, 0.0, 90.0))


def test_tiles(spark):
    (got,) = values(spark, ("p string", [("/a/1111_2222/filtered_2386_9702.laz",)]), c=tiles.tilecode_of_path(F.col("p")), b=tiles.box_of_tile(tiles.tilecode_of_path(F.col("p"))))
    assert got[0] == "2386_9702" and tuple(got[1]) == (119300, 485150, 119350, 485100)
    with pytest.raises(Exception, match="no tile code"):
        values(spark, ("p string", [("x.laz",)]), c=tiles.tilecode_of_path(F.col("p")))


def test_grid_and_back(spark):
    rows = [(119287.0, 485084.0), (155000.0, 463000.0), (121000.5, 487000.25)]
    w = crs.to_wgs84(F.col("x"), F.col("y"))
    got = values(spark, ("x double, y double", rows), lat=w["latitude"], lon=w["longitude"], r=crs.from_wgs84(w["latitude"], w["longitude"]))
    assert got[1][0] == pytest.approx(52.15517440) and got[1][1] == pytest.approx(5.38720621)
    for (x, y), (lat, lon, r) in zip(rows, got):
        assert 52 < lat < 53 and 4 < lon < 6 and r.x == pytest.approx(x, abs=0.5) and r.y == pytest.approx(y, abs=0.5)


def test_labels(spark):
    got = values(spark, ("c int", [(0,), (7,), (12,), (99,), (50,)]), n=labels.relabel(F.col("c")))
    assert [n for (n,) in got] == [0, 40, 0, 99, 0]
    assert labels.label_table(spark).count() == 56
    with pytest.raises(Exception, match="above the scheme"):
        values(spark, ("c int", [(100,)]), n=labels.relabel(F.col("c")))
