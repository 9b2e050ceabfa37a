"""Stages on made scenes, operators against brute force, sources and the stream."""

import http.server
import io
import json
import math
import random
import struct
import threading
import urllib.parse
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import cells, geometry as G, labels as L
from pointloom.operators import clusters, near, rasters, shapes, spatial, stages
from pointloom.plans import labelling, queries
from pointloom.plans.scratch import Scratch
from pointloom.sources import fetch, files, registry, tiff
from pointloom.streaming.tiles import label_arriving_tiles

POINTS = "tile long, point_id long, x double, y double, z double, label int, ground double, building double"


def scene(spark, xyz, ground=0.0, building=None, label=0):
    rows = [(1, i, float(x), float(y), float(z), label, ground, building) for i, (x, y, z) in enumerate(xyz)]
    return spark.createDataFrame(rows, POINTS)


def area(spark, ring, kind):
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    rows = [(1, kind, [(float(a), float(b)) for a, b in [*ring, ring[0]]], float(min(xs)), float(max(ys)), float(max(xs)), float(min(ys)))]
    return spark.createDataFrame(rows, "footprint_id long, type string, ring array<struct<x: double, y: double>>, x_min double, y_max double, x_max double, y_min double")


def marked(points, label):
    return {r.point_id for r in points.where(F.col("label") == label).collect()}


def box_of_points(rng, n, low, high):
    return [tuple(rng.uniform(a, b) for a, b in zip(low, high)) for _ in range(n)]


def test_rules_at_their_bounds(spark):
    rows = [(1, 0, 0.0, 0.0, 20.0, 0, 0.0, 30.0), (1, 1, 0.0, 0.0, 19.0, 0, 0.0, 30.0), (1, 2, 0.0, 0.0, 50.0, 0, 0.0, 30.0), (1, 3, 0.0, 0.0, 49.0, 0, None, 30.0), (1, 4, 0.0, 0.0, 1.0, 0, None, None)]
    points = spark.createDataFrame(rows, POINTS)
    assert marked(stages.Ground(refine=False, epsilon=20)(points), L.GROUND) == {1}
    assert marked(stages.BelowRoof(epsilon=20)(points), L.BUILDING) == {0, 1, 3}
    house = area(spark, [(0, 0), (5, 0), (5, 5), (0, 5)], "pand")
    assert marked(stages.Footprint(house, epsilon=20)(points), L.BUILDING) == {0, 1, 2, 3, 4}
    assert marked(stages.Footprint(house.where("false"), epsilon=20)(points), L.BUILDING) == set()


def test_ground_takes_back_what_stands_in_an_object(spark):
    rng = random.Random(1)
    body = box_of_points(rng, 300, (4, 4, 0.25), (6, 6, 0.5))
    floor = [(x / 2, y / 2, 0.05) for x in range(20) for y in range(20)]
    points = scene(spark, body + floor)
    found = marked(stages.Ground()(points), L.GROUND)
    inside = {300 + i for i, (x, y, _) in enumerate(floor) if 4.3 < x < 5.7 and 4.3 < y < 5.7}
    outside = {300 + i for i, (x, y, _) in enumerate(floor) if not (3.8 < x < 6.2 and 3.8 < y < 6.2)}
    assert outside <= found and not inside & found


def test_car(spark):
    rng = random.Random(2)
    turn = lambda x, y: (10 + x * math.cos(0.5) - y * math.sin(0.5), 10 + x * math.sin(0.5) + y * math.cos(0.5))
    body = [(*turn(rng.uniform(-2, 2), rng.uniform(-0.9, 0.9)), rng.uniform(0.3, 1.5)) for _ in range(3000)]
    roof = [(*turn(0.1 * k, 0), 1.5) for k in range(5)]
    far = [(30, 30, 1.0), (10, 10, 5.0)]
    points = scene(spark, body + roof + far)
    road = area(spark, [(0, 0), (20, 0), (20, 20), (0, 20)], "rijbaan_lokale_weg")
    limits = stages.Limits(1.2, 2.4, 1.4, 2.4, 3, 6)
    make = lambda r: stages.Car(r, Scratch(spark, "t"), limits, size=0.4, min_size=500)(points)
    got = marked(make(road), L.CAR)
    assert got == set(range(3005))
    assert marked(make(area(spark, [(100, 100), (120, 100), (120, 120)], "rijbaan_lokale_weg")), L.CAR) == set()
    assert marked(make(road.withColumn("type", F.lit("voetpad"))), L.CAR) == set()


def test_furniture(spark):
    rng = random.Random(3)
    bench = box_of_points(rng, 800, (5, 5, 0.0), (7, 5.6, 1.0))
    points = scene(spark, bench + [(50, 50, 1)])
    registry_ = spark.createDataFrame([("bank", 6.0, 6.0), ("boom", 50.0, 50.0)], "type string, x double, y double")
    limits = stages.Limits(0.5, 1.5, 0.3, 2.0, 1.0, 3.5)
    make = lambda kinds: stages.Furniture(registry_, Scratch(spark, "t"), limits, L.CITY_BENCH, kinds, size=0.3, min_size=300)(points)
    assert marked(make("bank"), L.CITY_BENCH) == set(range(800))
    assert marked(make("boom"), L.CITY_BENCH) == set()


def test_pole(spark):
    rng = random.Random(4)
    pole = [(5 + 0.08 * math.cos(a), 5 + 0.08 * math.sin(a), rng.uniform(0, 4.5)) for a in (rng.uniform(0, 7) for _ in range(4000))]
    other = box_of_points(rng, 200, (8, 8, 0), (9, 9, 3))
    points = scene(spark, pole + other)
    registry_ = spark.createDataFrame([(1, "lichtmast", 5.4, 5.1, 0.0), (2, "lichtmast", 8.5, 8.5, None)], "object_id long, type string, x double, y double, ground double")
    got = marked(stages.Pole(registry_, Scratch(spark, "t"), L.STREET_LIGHT, "lichtmast", min_points=300)(points), L.STREET_LIGHT)
    assert got == {i for i, p in enumerate(pole) if p[2] <= 4}


def test_cable(spark):
    rng = random.Random(5)
    cable = [(x, 10 + rng.uniform(-0.02, 0.02), 8 + 0.004 * (x - 15) ** 2 + rng.uniform(-0.01, 0.01)) for x in (rng.uniform(0, 30) for _ in range(1500))]
    wall = box_of_points(rng, 400, (20, 30, 5), (22, 32, 9))
    low = [(x / 10, 20, 2.0) for x in range(100)]
    points = scene(spark, cable + wall + low)
    house = area(spark, [(20, 30), (22, 30), (22, 32), (20, 32)], "pand")
    done = stages.Cable(Scratch(spark, "t"), house)(points)
    assert len(marked(done, L.CABLE) & set(range(1500))) > 1450 and marked(done, L.CABLE) <= set(range(1500))
    track = area(spark, [(0, 9), (30, 9), (30, 11), (0, 11)], "tram")
    low_cable = scene(spark, [(x, y, z - 2) for x, y, z in cable])
    assert len(marked(stages.Cable(Scratch(spark, "t"), None, track)(low_cable), L.TRAM_CABLE)) > 1450
    assert stages.Cable(Scratch(spark, "t"))(points.where("false")).count() == 0


def test_hanging_light():
    rng = np.random.default_rng(6)
    x = rng.uniform(0, 30, 6000)
    cable = np.column_stack([x, rng.uniform(-0.01, 0.01, 6000), 8 + np.abs(x - 15) * 0.08])
    lamp = np.column_stack([rng.uniform(14.75, 15.25, 3000), rng.uniform(-0.2, 0.2, 3000), rng.uniform(7.55, 7.9, 3000)])
    xyz, own = np.vstack([cable, lamp]), np.repeat([True, False], [6000, 3000])
    got = stages.hanging(xyz, own, {"width": (0.2, 1.0), "height": (0.15, 1.0), "offset": 0.2}, 2, 2)
    assert got[6000:].mean() > 0.8 and got[:6000].mean() < 0.1
    assert not stages.hanging(cable, np.ones(6000, bool), {"width": (0.2, 1.0), "height": (0.15, 1.0), "offset": 0.2}, 2, 2).any()


def test_cascade_keeps_labels_and_excluded_rows(spark):
    points = scene(spark, [(0, 0, 0.1), (1, 1, 5.0), (2, 2, 0.05)]).withColumn("label", F.when(F.col("point_id") == 2, 40).otherwise(0))
    done = stages.cascade(points, [stages.Ground(refine=False), stages.BelowRoof()], exclude=[40])
    assert done.columns == points.columns and {(r.point_id, r.label) for r in done.collect()} == {(0, 9), (1, 0), (2, 40)}


def test_cascade_reads_the_cloud_once_a_stage(spark):
    """Plans don't double: footprint stages are joins of one plan, others get a table."""
    roads = area(spark, [(0, 0), (10, 0), (10, 10), (0, 10)], "fietspad")
    houses = area(spark, [(20, 20), (30, 20), (30, 30), (20, 30)], "pand")
    points = spark.createDataFrame([(1, i, float(i), float(i), 5.0 * (i % 2), 0, 0.0, None) for i in range(40)], POINTS)
    steps = [stages.Ground(refine=False), stages.Road(roads), *[stages.Footprint(houses, offset=0.1 * k) for k in range(6)]]
    done = stages.cascade(points, steps)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ExistenceJoin") == 7 and plan.count("LogicalRDD") + plan.count("LocalRelation") <= 8 + 1
    want = {i: (10 if 20 <= i <= 30 else 1 if i % 2 == 0 and i <= 10 else 9 if i % 2 == 0 else 0) for i in range(40)}
    want = {i: (9 if i % 2 == 0 and not i <= 10 else w) for i, w in want.items()}
    assert {r.point_id: r.label for r in done.collect()} == want
    report = []
    noisy = stages.cascade(points, [*steps, stages.Noise(Scratch(spark, "noise"), size=0.5, min_size=2)], report=report)
    assert noisy.where("label = 0").count() == 0
    assert [n for _, n in report] == [20, 0, 5, 0, 0, 0, 0, 0, 15]


def test_tram_corridor_closes_gaps(spark):
    """A gap between two tracks is closed, one that is too wide isn't, and corners stay round."""
    tracks = spark.createDataFrame([(0.0, 0.0, 40.0, 0.0), (0.0, 8.0, 40.0, 8.0), (0.0, 30.0, 40.0, 30.0)], "ax double, ay double, ex double, ey double")
    cells = {((r.cx + 0.5) * 0.5, (r.cy + 0.5) * 0.5) for r in spatial.corridor(tracks, 2.0, 2.8, 0.5).collect()}
    for y in (0.25, 1.75, 3.75, 4.25, 7.75, 9.25, 30.25, 31.25):
        assert (20.25, y) in cells
    for y in (-2.75, 11.25, 15.25, 25.25, 33.25):
        assert (20.25, y) not in cells
    assert (-1.25, 30.25) in cells and (-1.75, 31.75) not in cells


def test_growing_stages(spark):
    points = scene(spark, [(k * 0.1, 0, 0.3 + k * 0.1) for k in range(30)] + [(9, 9, 1)]).withColumn("label", F.when(F.col("point_id") < 9, 30).when(F.col("point_id").between(20, 23), 99).otherwise(0))
    assert marked(stages.Grow(Scratch(spark, "t"), 30, 0.2, 5, 0.2)(points), 30) == set(range(20))
    assert marked(stages.Grow(Scratch(spark, "t"), 30, 0.2, 5, 0.2, (99,))(points), 30) == set(range(30))
    layers = ({"top": 1.05, "size": 0.2, "min_size": 3, "threshold": 0.2}, {"bottom": 0.75, "top": 2.05, "size": 0.2, "min_size": 3, "threshold": 0.1})
    assert marked(stages.GrowInLayers(Scratch(spark, "t"), 30, layers)(points), 30) == set(range(18))


def brute_components(points, touch):
    name = list(range(len(points)))
    changed = True
    while changed:
        changed = False
        for a in range(len(points)):
            for b in range(len(points)):
                if touch(points[a], points[b]) and name[b] > name[a]:
                    name[b], changed = name[a], True
    return name


@pytest.mark.parametrize("full,most", [(True, 10**6), (False, 10**6), (True, 3), (False, 3)])
def test_grid_components(spark, monkeypatch, full, most):
    monkeypatch.setattr(clusters, "TILE_CELLS", most)
    rng = random.Random(7)
    xyz = [(rng.randint(0, 99), rng.randint(0, 99), rng.randint(0, 59)) for _ in range(90)]
    near = lambda a, b: (max if full else sum)(abs(p // 20 - q // 20) for p, q in zip(a, b)) <= 1
    want = brute_components(xyz, near)
    got = {r.point_id: (r.component_id, r.size) for r in clusters.grid_components(scene(spark, xyz), 20, Scratch(spark, "t"), full=full).collect()}
    assert got == {i: (c, want.count(c)) for i, c in enumerate(want)}
    moved = clusters.grid_components(scene(spark, [(x + 40, y - 60, z + 20) for x, y, z in xyz]).orderBy(F.rand(1)), 20, Scratch(spark, "t"), full=full)
    assert {r.point_id: (r.component_id, r.size) for r in moved.collect()} == got


@pytest.mark.parametrize("most", [10**6, 3])
def test_dbscan(spark, monkeypatch, most):
    monkeypatch.setattr(clusters, "TILE_POINTS", most)
    rng = random.Random(8)
    xyz = [(rng.randint(0, 120), rng.randint(0, 120), 0) for _ in range(120)]
    near = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b)) <= 144
    core = [sum(near(p, q) for q in xyz) >= 5 for p in xyz]
    index = [i for i, c in enumerate(core) if c]
    name = dict(zip(index, (index[k] for k in brute_components([xyz[i] for i in index], near))))
    want = {i: (name[i], True) for i in index}
    for i, p in enumerate(xyz):
        if not core[i] and (own := [name[j] for j in index if near(p, xyz[j])]):
            want[i] = (min(own), False)
    got = {r.point_id: (r.cluster_id, r.core) for r in clusters.dbscan(scene(spark, xyz), 12, 5, Scratch(spark, "t")).collect()}
    assert got == want


@pytest.mark.parametrize("dims", [2, 3])
def test_density_clusters_against_all_pairs(monkeypatch, dims):
    """Dense cells beside sparse ones, points on top of each other, and few pairs at a time."""
    monkeypatch.setattr(cells, "PAIRS", 50)
    rng = np.random.default_rng(dims)
    for eps, least in ((3, 1), (4, 4), (7, 9)):
        xyz = np.concatenate([rng.integers(0, 60, (150, dims)), np.repeat(rng.integers(0, 60, (6, dims)), 12, axis=0), rng.integers(20, 26, (60, dims))]).astype(float)
        ids = rng.permutation(len(xyz)) + 10
        near = ((xyz[:, None] - xyz[None]) ** 2).sum(axis=2) <= eps * eps
        core = near.sum(axis=1) >= least
        i, j = np.nonzero(near & core[:, None] & core[None])
        low = np.array([ids[cells.lowest(i, j, len(xyz)) == k].min(initial=10**9, where=core[cells.lowest(i, j, len(xyz)) == k]) for k in cells.lowest(i, j, len(xyz))])
        want = {int(ids[k]): (int(low[near[k] & core].min()), bool(core[k])) for k in range(len(xyz)) if (near[k] & core).any()}
        at, name, is_core = cells.density_clusters(xyz, ids, eps, least)
        assert {int(ids[a]): (int(n), bool(c)) for a, n, c in zip(at, name, is_core)} == want
    assert not len(cells.density_clusters(np.zeros((0, dims)), np.zeros(0, int), 1, 1)[0])


def test_growing_bounds(spark):
    xyz = [(0, 0, 0)] * 10 + [(100, 0, 0)] * 9
    points = scene(spark, xyz).withColumn("label", F.when(F.col("point_id").isin(0, 10, 11, 12), 10).otherwise(0))
    grow = lambda size, share: marked(clusters.grow_by_components(points, 10, 5, size, share, Scratch(spark, "t")), 10)
    assert grow(10, 0.05) == set(range(10)) | {10, 11, 12}
    assert grow(9, 0.1) == {0} | set(range(10, 19))


def test_nearest_of_tile_against_brute_force(spark):
    rng = random.Random(31)
    rows = [(rng.randint(0, 1), i, *(rng.randint(0, 60) if i < 100 else rng.randint(0, 5000) for _ in range(3))) for i in range(160)] + [(7, 200 + i, i * 900, 0, 0) for i in range(4)]
    points = spark.createDataFrame(rows, "tile int, point_id long, x long, y long, z long")
    other = points.withColumnsRenamed({"tile": "other_tile", "point_id": "other_id"})
    got = spatial.nearest_of_tile(points, other, ["point_id"], "other_id", 40, 15, Scratch(spark, "t"), ("tile", "other_tile"), ("x", "y", "z"))
    want = set()
    for tile, i, *p in rows:
        near = sorted((sum((a - b) ** 2 for a, b in zip(p, q)), j) for t, j, *q in rows if t == tile)[:15]
        want |= {(i, j, d, rank) for rank, (d, j) in enumerate(near, 1)}
    assert sorted((r.point_id, r.other_id, r.d2, r["rank"]) for r in got.collect()) == sorted(want)
    flat = spatial.nearest_of_tile(points.where("tile = 7"), other.where("other_tile = 7"), ["point_id"], "other_id", 40, 2, Scratch(spark, "t"), dims=("x", "y"))
    assert {(r.point_id, r.other_id) for r in flat.collect()} == {(200, 200), (200, 201), (201, 201), (201, 200), (202, 202), (202, 201), (203, 203), (203, 202)}


def test_region_grow_links_the_nearest_of_a_sparse_cloud(spark):
    from pointloom.plans import queries

    class Sparse:
        pass

    t = Sparse()
    t.spark = spark
    t.cloud = spark.createDataFrame([(1, i, i * 1000, 0, 0, 10 if i == 0 else 0) for i in range(20)], "tile int, point_id long, x long, y long, z long, code int")
    assert {r.point_id for r in queries.region_grow_normals(t).collect()} == set(range(20))


def test_reach_over_many_steps(spark):
    edges = spark.range(205).selectExpr("id as u", "id + 1 as v").unionByName(spark.createDataFrame([(500, 3), (300, 301)], "u long, v long"))
    got = clusters.reach_from_seeds(edges, spark.createDataFrame([(0,)], "node long"), Scratch(spark, "t"))
    assert {r.node for r in got.collect()} == set(range(206))


def test_nearest_value_and_samples_on_cells(spark):
    cells = spark.createDataFrame([(0, 0, 0.0, 0.0), (1, 0, 10.0, 0.0), (2, 0, 99.0, 0.0)], "ix int, iy int, x double, y double")
    samples = spark.createDataFrame([(1, 0.0, 0.0, 5.0), (2, 3.0, 4.0, 9.0), (3, 10.0, 5.0, 1.0), (4, 10.0, -5.0, 3.0)], "id long, x double, y double, value double")
    assert {(r.ix, r.value) for r in rasters.idw(cells, samples, 6).collect()} == {(0, 5.0), (1, 2.0)}
    assert {(r.ix, r.value) for r in rasters.nearest_value(cells, samples, 6).collect()} == {(0, 5.0), (1, 1.0)}


def test_weighted_interpolation(spark):
    cells = spark.createDataFrame([(0, 0, 0.0, 0.0), (1, 0, 9.0, 0.0)], "ix int, iy int, x double, y double")
    samples = spark.createDataFrame([(1, 1.0, 0.0, 10.0, 1.0), (2, -2.0, 0.0, 40.0, 4.0), (3, 9.5, 0.0, 7.0, 0.0)], "id long, x double, y double, value double, trust double")
    got = {r.ix: r.value for r in rasters.idw(cells, samples, 3.0, weight="trust").collect()}
    assert got == {0: pytest.approx(25.0), 1: None}
    assert {r.ix: r.value for r in rasters.idw(cells, samples, 3.0).collect()} == {0: pytest.approx(16.0), 1: pytest.approx(7.0)}


def test_outlines_of_groups(spark):
    rows = [(1, float(x), float(y)) for x in range(5) for y in range(5) if (x, y) != (2, 2)] + [(2, 0.0, 0.0), (2, 1.0, 1.0)]
    got = shapes.alpha_outlines(spark.createDataFrame(rows, "tile long, x double, y double"), ["tile"], 1.2).collect()
    assert sorted((r.tile, r.hole, r.area) for r in got) == [(1, False, 16.0), (1, True, -2.0)]


def test_gap_sizes(spark):
    grid = rasters.Grid(0, 10, 1, 60, 3)
    raster = grid.cells(spark).withColumn("ground", F.when(~((F.col("iy") == 1) & (F.col("ix") < 50)) & ~((F.col("iy") == 0) & (F.col("ix") == 55)), 1.0))
    got = {(r.gap, r.cells, r.fill) for r in rasters.gaps(raster.where("ground is null"), Scratch(spark, "t"), 60).collect()}
    assert got == {(60, 50, True), (55, 1, True)}
    wide = raster.withColumn("ground", F.when(~((F.col("iy") == 1) & (F.col("ix") == 50)), F.col("ground")))
    assert {(r.cells, r.fill) for r in rasters.gaps(wide.where("ground is null"), Scratch(spark, "t"), 60).collect()} == {(51, False), (1, True)}
    assert rasters.fill_gaps(raster, Scratch(spark, "t"), grid).where("ground is null").count() == 0


def test_gaps_wider_than_the_reach_are_filled(spark):
    grid = rasters.Grid(0, 30, 1, 30, 30)
    round_gap = (F.col("ix") - 10) * (F.col("ix") - 10) + (F.col("iy") - 10) * (F.col("iy") - 10) <= 16
    half = (F.col("ix") - 29) * (F.col("ix") - 29) + (F.col("iy") - 22) * (F.col("iy") - 22) <= 26
    raster = grid.cells(spark).withColumn("ground", F.when(~round_gap & ~half, 7.0))
    sizes = sorted({(r.gap, r.cells) for r in rasters.gaps(raster.where("ground is null"), Scratch(spark, "t"), 30).collect()})
    assert [n for _, n in sizes] == [49, 50]
    got = rasters.fill_gaps(raster, Scratch(spark, "t"), grid)
    assert got.count() == 900 and got.where("ground is null or abs(ground - 7) > 1e-9").count() == 0


def test_ground_without_gaps(spark):
    grid = rasters.Grid(0, 12, 1, 12, 12)
    plane = F.col("ix") * 2.0 + F.col("iy") * 3.0
    hole = F.col("ix").between(4, 7) & F.col("iy").between(3, 6) | (F.col("ix") > 9) & (F.col("iy") > 9)
    raster = grid.cells(spark).withColumn("tilecode", F.lit("a")).withColumn("ground", F.when(~hole, plane)).withColumn("artifact", F.when((F.col("ix") == 4) & (F.col("iy") == 3), 99.0))
    empty = raster.withColumn("tilecode", F.lit("b")).withColumn("ground", F.lit(None).cast("double")).withColumn("artifact", F.lit(None).cast("double"))
    got = {(r.tilecode, r.ix, r.iy): r for r in rasters.fill_ground(raster.unionByName(empty), Scratch(spark, "t"), tile="tilecode").collect()}
    assert len(got) == 288
    for (tile, ix, iy), r in got.items():
        if tile == "b":
            assert r.surface is None
        elif ix < 10 or iy < 10:
            assert math.isclose(r.surface, ix * 2 + iy * 3)
        else:
            assert r.surface == min(((ix - a) ** 2 + (iy - b) ** 2, b, a, a * 2.0 + b * 3.0) for a in range(12) for b in range(12) if a < 10 or b < 10)[3]
    with_artifact = rasters.fill_ground(raster, Scratch(spark, "t"), artifact="artifact")
    assert with_artifact.where("ix = 4 and iy = 3").first().surface == 99.0 and with_artifact.where("surface is null").count() == 0


def test_cable_over_missing_ground(spark):
    points = scene(spark, [(1, 1, 8), (2, 1, 8), (3, 1, 2)]).withColumn("ground", F.when(F.col("point_id") == 0, 0.0)).withColumn("surface", F.lit(0.0))
    assert {r.point_id for r in stages.Cable(Scratch(spark, "t")).band(points).collect()} == {0, 1}
    assert {r.point_id for r in stages.Cable(Scratch(spark, "t")).band(points.drop("surface")).collect()} == {0}


def test_grid_edges(spark):
    grid = rasters.Grid(0, 100, 10, 10, 10)
    rows = [(0.0, 100.0), (10.0, 90.0), (100.0, 0.0), (99.9, 0.1), (100.1, 50.0), (-0.1, 50.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    assert [tuple(r) for r in df.select(grid.ix(F.col("x")), grid.iy(F.col("y"))).collect()] == [(0, 0), (1, 1), (9, 9), (9, 9), (None, 5), (None, 5)]


def test_neighbours_and_shapes_against_all_pairs(spark):
    rng = random.Random(9)
    a = [(i, rng.randint(-500, 500), rng.randint(-500, 500)) for i in range(80)]
    left, right = spark.createDataFrame(a, "i long, x long, y long"), spark.createDataFrame(a, "j long, x long, y long")
    got = {(r.i, r.j) for r in spatial.neighbours(left, right, 70, ("x", "y")).select("l.i", "r.j").collect()}
    assert got == {(p[0], q[0]) for p in a for q in a if (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= 4900}
    boxes = [(k, x, y, x + rng.randint(0, 300), y + rng.randint(0, 300)) for k, x, y in a[:20]]
    shapes_ = spark.createDataFrame(boxes, "k long, x_min long, y_min long, x_max long, y_max long")
    exact = G.in_rectangle(F.col("p.x"), F.col("p.y"), F.col("s.x_min"), F.col("s.y_min"), F.col("s.x_max"), F.col("s.y_max"))
    inside = {i for i, x, y in a if any(b[1] <= x <= b[3] and b[2] <= y <= b[4] for b in boxes)}
    assert {r.i for r in spatial.points_in_shapes(left, shapes_, exact, 100).collect()} == inside
    assert {r.i for r in spatial.points_in_shapes(left, shapes_, exact, 100, "left_anti").collect()} == {i for i, _, _ in a} - inside


def test_unknown_label_fails(spark):
    points = scene(spark, [(0, 0, 0)], label=77)
    with pytest.raises(Exception, match="no class"):
        shapes.label_statistics(points, L.label_table(spark)).collect()


def test_registry_files(spark, tmp_path):
    for name, rows in (("bgt_a", ["boom,1.5,2.5"]), ("bgt_b", ["bank,3,4"]), ("other", ["x,1,1"])):
        (tmp_path / f"{name}.csv").write_text("any,header,here\n" + "\n".join(rows) + "\n")
    got = {tuple(r) for r in registry.read_csv(spark, str(tmp_path), registry.POINTS, "bgt_").collect()}
    assert got == {("boom", 1.5, 2.5), ("bank", 3.0, 4.0)}
    (tmp_path / "poly.csv").write_text('a,b,c,d,e,f\npand,"[[0, 0], [1, 0], [1, 1], [0, 0]]",0,1,1,0\n')
    (row,) = registry.with_rings(registry.read_csv(spark, str(tmp_path / "poly.csv"), registry.POLYGONS)).collect()
    assert row.type == "pand" and [tuple(p) for p in row.ring] == [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]


def test_geojson(spark):
    text = '{"features": [{"id": "7", "properties": {"plus_type": "bank"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 0]], [[1, 0.5], [1.5, 0.5], [1.5, 1], [1, 0.5]]]}}]}'
    df = spark.createDataFrame([("BGT_WGL_rijbaan_lokale_weg", text)], "layer string, json string")
    (r,) = registry.parse_polygons(df).collect()
    assert (r.feature_id, r.type, len(r.rings), r.x_max, r.y_min) == ("7", "rijbaan_lokale_weg", 2, 2.0, 0.0)
    assert len(registry.parse_polygons(df, keep_holes=False).first().rings) == 1
    point = '{"features": [{"properties": {"plus_type": "bank"}, "geometry": {"type": "Point", "coordinates": [3.0, 4.0]}}]}'
    assert [tuple(r) for r in registry.parse_points(spark.createDataFrame([("l", point)], "layer string, json string")).collect()] == [("bank", 3.0, 4.0)]
    line = '{"features": [{"id": "1", "geometry": {"type": "LineString", "coordinates": [[0, 0], [3, 4]]}}]}'
    assert registry.parse_lines(spark.createDataFrame([("a_b_tram", line)], "layer string, json string")).first().y_max == 4.0
    signs = '[{"location": {"rd": {"x": "1", "y": "1"}}}, {"location": {"rd": {"x": "0", "y": "1"}}}]'
    assert registry.parse_signs(spark.createDataFrame([(signs,)], "json string"), {"x_min": 0, "x_max": 2, "y_min": 0, "y_max": 2}).count() == 1


def test_las_round_trip(spark, tmp_path):
    rng = random.Random(10)
    rows = [(f"2386_970{t}", i, 119300 + rng.uniform(0, 50), 485100 + rng.uniform(0, 50), rng.uniform(-2, 30), rng.randint(0, 99)) for t in (1, 2) for i in range(500)]
    points = spark.createDataFrame(rows, "tilecode string, point_id long, x double, y double, z double, label int")
    files.save_las(points, str(tmp_path))
    got = {(r.tilecode, r.point_id): r for r in files.read_las(spark, str(tmp_path)).collect()}
    assert len(got) == 1000
    for t, i, x, y, z, label in rows:
        r = got[t, i]
        assert (r.x, r.y, r.z) == pytest.approx((x, y, z), abs=0.0006) and r.label == label
    with pytest.raises(ValueError):
        files.parse_las(b"nothing")
    assert files.save_labels(points, str(tmp_path / "out")) == 1000


def test_elevation_files(spark, tmp_path):
    ground = np.array([[1.0, np.nan], [2.5, 3.0]], np.float16)
    buffer = io.BytesIO()
    np.savez_compressed(buffer, x=np.array([0.5, 1.5]), y=np.array([1.5, 0.5]), ground=ground, building=np.full((2, 2), np.nan, np.float16))
    (tmp_path / "ahn_2386_9702.npz").write_bytes(buffer.getvalue())
    got = {(r.ix, r.iy): (r.x, r.y, r.ground, r.building) for r in files.read_npz(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): (0.5, 1.5, 1.0, None), (1, 0): (1.5, 1.5, None, None), (0, 1): (0.5, 0.5, 2.5, None), (1, 1): (1.5, 0.5, 3.0, None)}
    files.save_npz(files.read_npz(spark, str(tmp_path)), str(tmp_path), "again_")
    again = {(r.ix, r.iy): (r.x, r.y, r.ground, r.building) for r in files.read_npz(spark, str(tmp_path), "again_*.npz").collect()}
    assert again == got
    assert [r.tilecode for r in files.tiles_of_folder(spark, str(tmp_path), "*.npz").collect()] == ["2386_9702"]


def tiff_of(values, way=1, predictor=1, rows=4, tiled=0, order="<", x=100.0, y=200.0, res=0.5):
    """A GeoTIFF of 32-bit floats in strips of ``rows`` rows, or in tiles of ``tiled`` pixels."""
    high, wide = values.shape
    if tiled:
        values = np.pad(values, ((0, -high % tiled), (0, -wide % tiled)))
        parts = [values[a : a + tiled, b : b + tiled] for a in range(0, values.shape[0], tiled) for b in range(0, values.shape[1], tiled)]
    else:
        parts = [values[a : a + rows] for a in range(0, high, rows)]

    def packed(part):
        part = np.ascontiguousarray(part.astype(f"{order}f4"))
        data = part.tobytes()
        if predictor == 2:
            whole = part.view(f"{order}u4")
            data = np.diff(whole, axis=1, prepend=np.zeros((len(whole), 1), whole.dtype)).astype(f"{order}u4").tobytes()
        if predictor == 3:
            planes = np.ascontiguousarray(part.astype(">f4")).view(np.uint8).reshape(*part.shape, 4).transpose(0, 2, 1).reshape(len(part), -1)
            data = np.diff(planes, axis=1, prepend=np.zeros((len(part), 1), np.uint8)).astype(np.uint8).tobytes()
        return zlib.compress(data) if way == 8 else lzw(data) if way == 5 else data

    blocks = [packed(p) for p in parts]
    sizes, at, u = [len(b) for b in blocks], [], "I"
    for n in sizes:
        at.append(8 + sum(sizes[: len(at)]))
    tags = [(256, 4, [wide]), (257, 4, [high]), (258, 3, [32]), (259, 3, [way]), (317, 3, [predictor]), (339, 3, [3]), (33550, 12, [res, res, 0.0]), (33922, 12, [0.0, 0.0, 0.0, x, y, 0.0]), (42113, 2, b"-9999\0")]
    tags += [(322, 4, [tiled]), (323, 4, [tiled]), (324, 4, at), (325, 4, sizes)] if tiled else [(273, 4, at), (278, 4, [rows]), (279, 4, sizes)]
    body, place = b"".join(blocks), 8 + sum(sizes)
    head, tail, begin = b"", b"", place + 2 + 12 * len(tags) + 4
    for tag, kind, v in sorted(tags):
        data = v if isinstance(v, bytes) else struct.pack(f"{order}{len(v)}{ {3: 'H', 4: u, 12: 'd'}[kind] }", *v)
        head += struct.pack(f"{order}HHI", tag, kind, len(v)) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(f"{order}I", begin + len(tail)))
        tail += b"" if len(data) <= 4 else data
    return (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, place) + body + struct.pack(f"{order}H", len(tags)) + head + b"\0" * 4 + tail


def lzw(data):
    """Codes of the format's LZW, without ever filling the table."""
    table, word, bits, width = {bytes([k]): k for k in range(256)}, b"", f"{256:09b}", 9
    size = 258
    for k in range(len(data)):
        c = data[k : k + 1]
        if word + c in table:
            word += c
            continue
        bits += f"{table[word]:0{width}b}"
        table[word + c], size, word = size, size + 1, c
        width = 9 + (size >= 512) + (size >= 1024) + (size >= 2048)
        if size == 4093:
            bits += f"{256:0{width}b}"
            table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
    bits += f"{table[word]:0{width}b}"
    size += 1
    bits += f"{257:0{9 + (size >= 512) + (size >= 1024) + (size >= 2048)}b}"
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


@pytest.mark.parametrize("way,predictor,tiled,order", [(1, 1, 0, "<"), (8, 2, 0, "<"), (8, 3, 16, "<"), (5, 1, 0, ">"), (5, 3, 16, "<"), (1, 1, 16, ">")])
def test_tiff_pixels(way, predictor, tiled, order):
    rng = np.random.default_rng(3)
    values = np.round(rng.normal(0, 5, (70, 90)), 1).astype(np.float32)
    values[3, 4], values[60, 80] = -9999, -9999
    want = np.where(values == -9999, np.nan, values).astype(float)
    data = tiff_of(values, way, predictor, 7, tiled, order)
    assert tiff.bounds_of(data) == {"width": 90, "height": 70, "res": 0.5, "Xmin": 100.0, "Ymax": 200.0, "Xmax": 145.0, "Ymin": 165.0}
    for x0, x1, y0, y1 in ((0, 90, 0, 70), (5, 20, 3, 9), (33, 90, 15, 70), (-5, 3, 65, 99), (40, 40, 0, 5)):
        got = tiff.pixels(data, x0, x1, y0, y1)
        np.testing.assert_array_equal(got, want[max(0, y0) : y1, max(0, x0) : x1])


def test_tiff_tiles(spark, tmp_path):
    """Each tile is cut from the first file that holds it whole; other files and tiles give nothing."""
    rng = np.random.default_rng(4)
    one, two = (rng.normal(0, 5, (400, 400)).astype(np.float32) for _ in range(2))
    one[0, 0] = 2e5
    (tmp_path / "M_1.TIF").write_bytes(tiff_of(one, 8, rows=50, x=100.0, y=300.0))
    (tmp_path / "M_2.TIF").write_bytes(tiff_of(two, 8, tiled=64, x=200.0, y=300.0))
    (tmp_path / "M_3.TIF").write_bytes(b"not an image")
    (tmp_path / "M_4.TIF").write_bytes(tiff_of(two, x=100.0, y=300.0, res=1.0))
    index = tiff.tiff_index(spark, str(tmp_path)).collect()
    assert [(r.Xmin, r.Ymax, r.Xmax, r.Ymin) for r in index] == [(100.0, 300.0, 300.0, 100.0), (200.0, 300.0, 400.0, 100.0)]
    tiles = spark.createDataFrame([("0002_0005",), ("0005_0002",), ("0007_0002",), ("0007_0005",), ("0090_0090",), ("0002_0005",)], "tilecode string")
    got = {}
    for r in tiff.read_tiff_tiles(spark, str(tmp_path), tiles).collect():
        got.setdefault(r.tilecode, {})[r.ix, r.iy] = (r.x, r.y, r.ground)
    assert set(got) == {"0002_0005", "0005_0002", "0007_0002", "0007_0005"} and all(len(v) == 10_000 for v in got.values())
    assert got["0002_0005"][0, 0] == (100.25, 299.75, None) and got["0002_0005"][7, 9] == (103.75, 295.25, float(one[9, 7]))
    assert got["0005_0002"][3, 2][2] == float(one[302, 303]) and got["0007_0005"][3, 2][2] == float(two[2, 303])


def test_las_ranges_compressed_files_and_resume(spark, tmp_path, monkeypatch):
    rng = random.Random(12)
    rows = [(t, i, 119300 + rng.uniform(0, 50), 485100 + rng.uniform(0, 50), rng.uniform(-2, 30), rng.randint(0, 99)) for t in ("2386_9701", "2386_9702") for i in range(507)]
    points = spark.createDataFrame(rows, "tilecode string, point_id long, x double, y double, z double, label int")
    files.save_las(points, str(tmp_path), "", "_done")
    whole = sorted(tuple(r) for r in files.read_las(spark, str(tmp_path)).collect())
    assert len(whole) == 1014 and (tmp_path / "2386_9701_done.las").exists()
    assert sorted(tuple(r) for r in files.read_las_ranges(spark, str(tmp_path), points=100).collect()) == whole
    done = spark.createDataFrame([("2386_9701",)], "tilecode string")
    for read in (files.read_las, files.read_las_ranges):
        assert {r.tilecode for r in read(spark, str(tmp_path), skip=done).select("tilecode").distinct().collect()} == {"2386_9702"}
    data = bytearray((tmp_path / "2386_9701_done.las").read_bytes())
    begin, size = struct.unpack_from("<I", data, 96)[0], struct.unpack_from("<H", data, 105)[0]
    data[104] |= 0x80
    monkeypatch.setitem(__import__("sys").modules, "lazrs", None)
    with pytest.raises(ValueError, match="codec"):
        files.parse_las(bytes(data))

    class Decompressor:
        def __init__(self, source, record):
            self.source = source

        def decompress_many(self, out):
            out[:] = zlib.decompress(self.source.read())

    monkeypatch.setitem(__import__("sys").modules, "lazrs", type("codec", (), {"LasZipDecompressor": Decompressor}))
    got = files.parse_las(bytes(data[:begin]) + zlib.compress(bytes(data[begin:])))
    assert size == 21 and got["x"].tolist() == [r[2] for r in whole if r[0] == "2386_9701"]


def test_prepared_elevation_is_resumed(spark, tmp_path):
    rng = random.Random(13)
    cloud = spark.createDataFrame([(i, rng.uniform(95, 205), rng.uniform(95, 155), 1.0 + i % 3, 2 if i % 2 else 6) for i in range(900)], "id long, x double, y double, z double, classification int")
    tiles = spark.createDataFrame([("0002_0002",), ("0003_0002",)], "tilecode string")
    run = lambda t, **more: sorted(r.tilecode for r in labelling.prepare_folder(spark, cloud, t, str(tmp_path), cell=1.0, ground_radius=5.0, building_radius=5.0, **more).collect())
    assert run(tiles.limit(1), clips=True) == ["0002_0002"]
    assert run(tiles, resume=True) == ["0003_0002"]
    got = files.read_npz(spark, str(tmp_path))
    assert got.count() == 5000 and got.where("ground is null").count() < 500
    clip = files.read_las(spark, str(tmp_path))
    assert clip.select("tilecode").distinct().count() == 1
    assert clip.count() == cloud.where("x between 99 and 151 and y between 99 and 151").count()


def test_layers_are_fetched_page_by_page(spark):
    asked = []

    class Answers(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            query = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
            if "town-code" in query:
                body = [{"location": {"rd": {"x": "1", "y": "1"}}}]
            else:
                asked.append((query["typeNames"], int(query["startIndex"]), query["bbox"]))
                n = {"BGT_WGL_fietspad": 5, "BGT_WGL_none": 0, "BGT_WGL_two": 4}[query["typeNames"]]
                ring = [[0, 0], [2, 0], [2, 2], [0, 0]]
                body = {"features": [{"id": str(k), "geometry": {"type": "Polygon", "coordinates": [ring]}} for k in range(n)][int(query["startIndex"]) :][: int(query["count"])]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/wfs"
    box = {"x_min": 0, "y_min": 1, "x_max": 2, "y_max": 3}
    got = fetch.fetch_layers(spark, url, ["BGT_WGL_fietspad", "BGT_WGL_none", "BGT_WGL_two"], box, count=2)
    rows = registry.parse_polygons(got).collect()
    assert sorted((r.type, r.feature_id) for r in rows) == [("fietspad", str(k)) for k in range(5)] + [("two", str(k)) for k in range(4)]
    assert {(a, b) for a, b, _ in asked} == {("BGT_WGL_fietspad", 0), ("BGT_WGL_fietspad", 2), ("BGT_WGL_fietspad", 4), ("BGT_WGL_none", 0), ("BGT_WGL_two", 0), ("BGT_WGL_two", 2), ("BGT_WGL_two", 4)}
    assert {c for _, _, c in asked} == {"0,1,2,3,EPSG:28992"}
    assert registry.parse_signs(fetch.fetch_signs(spark, url, "0363"), {"x_min": 0, "x_max": 2, "y_min": 0, "y_max": 2}).count() == 1
    server.shutdown()


def test_stream_of_tiles(spark, tmp_path):
    for k in range(3):
        scene(spark, [(k, k, 0.1), (k, k, 9.0)]).write.parquet(f"{tmp_path}/in/tile{k}")
    run = lambda: label_arriving_tiles(spark, f"{tmp_path}/in/*", f"{tmp_path}/out", f"{tmp_path}/progress", POINTS, stages.Ground(refine=False), 1).awaitTermination()
    run()
    assert spark.read.parquet(f"{tmp_path}/out").groupBy("label").count().orderBy("label").collect() == [(0, 3), (9, 3)]
    scene(spark, [(7, 7, 0.1)]).write.parquet(f"{tmp_path}/in/tile9")
    run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 7


def test_piecewise_line_reads_each_position_once(spark):
    knots = spark.createDataFrame([(0, 10, 1.0), (0, 20, 3.0), (0, 40, 7.0)], "tile long, t long, v double")
    at = [None, 5, 10, 15, 15, 20, 30, 40, 50]
    points = spark.createDataFrame([(0, k, t) for k, t in enumerate(at)] + [(1, 99, 5)], "tile long, point_id long, t long")
    line = shapes.piecewise(points, knots, ["tile"])
    assert {r.point_id: r.v for r in line.collect()} == {0: 1.0, 1: 1.0, 2: 1.0, 3: 2.0, 4: 2.0, 5: 3.0, 6: 5.0, 7: 7.0, 8: 7.0, 99: None}
    # a frame that ends at the last row is summed up anew for every row
    assert "unboundedfollowing" not in line._jdf.queryExecution().executedPlan().toString().lower()


@pytest.mark.parametrize("radius", [2.5, None])
def test_nearest_by_blocks_against_brute_force(spark, monkeypatch, radius):
    monkeypatch.setattr(near, "BLOCK_ROWS", 20)
    monkeypatch.setattr(near, "PAIRS", 50)
    rng = random.Random(5)
    place = lambda wide: tuple(rng.randrange(0, wide) / 4 for _ in range(3))
    rows = [(k % 2, k, *place(12 if k % 3 else 60)) for k in range(240)] + [(0, 900, 1e3, 0.0, 0.0), (2, 901, 0.0, 0.0, 0.0)]
    left = spark.createDataFrame(rows, "tile long, point_id long, x double, y double, z double")
    right = left.where("point_id % 2 = 0 or point_id > 100").withColumnsRenamed({"tile": "other_tile", "point_id": "other_id"})
    finish, schema = near.pairs(["point_id"], "other_id", ("x", "y", "z"), ("other_tile",), left, right)
    got = near.nearest(left, right, ["point_id"], "other_id", radius, 5, Scratch(spark, "t"), ("x", "y", "z"), finish, schema, ("tile", "other_tile"))
    want = set()
    for t, k, *p in rows:
        d = sorted((sum((a - b) ** 2 for a, b in zip(p, q, strict=True)), o) for u, o, *q in rows if u == t and (o % 2 == 0 or o > 100))
        want |= {(k, o, t, d2, n) for n, (d2, o) in enumerate([v for v in d if radius is None or v[0] <= radius * radius][:5], 1)}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_local_features_have_no_pairs_in_their_plan(spark):
    rng = random.Random(6)
    cloud = scene(spark, box_of_points(rng, 300, (0, 0, 0), (20, 20, 3)))
    shape = shapes.local_features(cloud, 5, 10)
    assert shape.count() == 300
    assert " Join" not in shape._jdf.queryExecution().optimizedPlan().toString()


def test_overlaps_of_equal_boxes(spark, monkeypatch):
    monkeypatch.setattr(spatial, "TASK_PAIRS", 3)
    rng = random.Random(8)
    boxes = [(k, x, x + rng.randrange(1, 9), y, y + rng.randrange(1, 9)) for k in range(30) for x, y in [(rng.randrange(20), rng.randrange(20))]]
    boxes += [(k + 100, *b) for k, *b in boxes]
    df = spark.createDataFrame(boxes, "id long, x_min long, x_max long, y_min long, y_max long")
    left, right = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    got = spatial.overlaps(left, right, "id", 5, Scratch(spark, "t"))
    side = lambda a0, a1, b0, b1: min(a1, b1) - max(a0, b0)
    want = [(a, b, side(*p[:2], *q[:2]) * side(*p[2:], *q[2:])) for a, *p in boxes for b, *q in boxes if a % 2 == 0 and b % 2 == 1 and side(*p[:2], *q[:2]) > 0 and side(*p[2:], *q[2:]) > 0]
    assert sorted(map(tuple, got.collect())) == sorted(want) and got.rdd.getNumPartitions() >= len(want) // 3


def test_poles_of_objects_on_one_place(spark):
    rng = random.Random(9)
    points = scene(spark, [(10 + rng.uniform(-0.05, 0.05), 10 + rng.uniform(-0.05, 0.05), k / 100) for k in range(300)])
    objects = spark.createDataFrame([(1, 10.0, 10.0, 0.0), (2, 10.0, 10.0, None), (3, 30.0, 10.0, 0.0), (4, None, 1.0, 0.0)], "object_id long, x double, y double, ground double")
    stage = stages.Pole(objects, Scratch(spark, "t"), L.TREE, min_points=10)
    found = stage.candidates(points, objects)
    assert {r.object_id for r in found.collect()} == {1, 2}
    # pairs of objects and points stay in their task
    assert "percentile" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_repeated_shapes_are_tested_once(spark):
    house = area(spark, [(0, 0), (10, 0), (10, 10), (0, 10)], "pand")
    many = house.unionByName(house).unionByName(house)
    points = scene(spark, [(5, 5, 1), (20, 5, 1)])
    out = stages.Footprint(many)(points)
    assert marked(out, L.BUILDING) == {0}
    assert "Aggregate" in out._jdf.queryExecution().optimizedPlan().toString()


def test_equal_areas_are_counted(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    spark.read.parquet(f"{source}/events.parquet").write.parquet(str(tmp_path / "events.parquet"))
    part = spark.read.parquet(f"{source}/part.parquet")
    part.unionByName(part.withColumn("p_partkey", F.col("p_partkey") + 20000)).write.parquet(str(tmp_path / "part.parquet"))
    query = queries.QUERIES["registry_grown_areas"]
    once, twice = query(spark, source), query(spark, str(tmp_path))
    assert {r.point_id: 2 * r.areas for r in once.collect()} == {r.point_id: r.areas for r in twice.collect()}
    assert twice._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2
