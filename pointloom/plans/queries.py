"""The engine's queries over tables made of the relational test data, and the same results in DuckDB's SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import crs, geometry as G, labels as L, tiles
from ..operators import clusters, near, rasters, shapes, spatial, stages
from ..sources import registry
from ..sources.views import AREA_TYPES, CLASSES, CODES, GRID, OBJECT_TYPES, Tables
from .scratch import Scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


# the derived tables of sources.views
BASE = f"""
cloud AS (
  SELECT *, (x // 5000) * 10 + y // 5000 AS tile, {_list(CODES)}[point_id % {len(CODES)} + 1] AS code, {_list(CLASSES)}[point_id % {len(CLASSES)} + 1] AS classification
  FROM (SELECT event_id AS point_id, (event_id * 7919 + user_id * 31) % 10000 AS x, (event_id * 6271 + user_id * 17) % 10000 AS y, (event_id * 104729) % 1500 AS z, user_id AS cluster_id FROM events)),
raster AS (
  SELECT ix, iy, ix * 100 + 50 AS x, 10000 - iy * 100 - 50 AS y, CAST(CASE WHEN (ix + iy) % 23 <> 0 THEN (ix * 37 + iy * 17) % 60 END AS BIGINT) AS ground,
    CAST(CASE WHEN (ix * 7 + iy * 3) % 5 = 0 THEN 300 + (ix * 11 + iy * 13) % 600 END AS BIGINT) AS building
  FROM (SELECT CAST(range AS INTEGER) AS ix FROM range(100)), (SELECT CAST(range AS INTEGER) AS iy FROM range(100))),
points AS (
  SELECT c.tile, c.point_id, c.x, c.y, c.z, r.ground, r.building
  FROM cloud c LEFT JOIN raster r ON r.ix = least(c.x // 100, 99) AND r.iy = least((10000 - c.y) // 100, 99)),
objects AS (
  SELECT s_suppkey AS object_id, (s_suppkey * 997) % 10000 AS x, (s_suppkey * 3571) % 10000 AS y, {_list(OBJECT_TYPES)}[s_suppkey % 3 + 1] AS type FROM supplier),
lines AS (
  SELECT line_id, ax, ay, ex, ey, least(ax, ex) AS x_min, greatest(ax, ex) AS x_max, least(ay, ey) AS y_min, greatest(ay, ey) AS y_max
  FROM (SELECT object_id AS line_id, x AS ax, y AS ay, x + (object_id * 37) % 2000 - 1000 AS ex, y + (object_id * 53) % 2000 - 1000 AS ey FROM objects)),
footprints AS (
  SELECT footprint_id, type, cx - h AS x_min, cy + h AS y_max, cx + h AS x_max, cy - h AS y_min
  FROM (SELECT p_partkey AS footprint_id, (p_partkey * 4987) % 10000 AS cx, (p_partkey * 7417) % 10000 AS cy, 50 + p_size * 5 AS h, {_list(AREA_TYPES)}[p_partkey % 4 + 1] AS type FROM part))"""


def query(name: str, sql: str | None = None, recursive: bool = False) -> Callable[[Callable[[Tables], DataFrame]], Callable]:
    """Register a function of the derived tables, and SQL that follows the derived tables' own."""

    def put(make: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: make(Tables(spark, folder))
        QUERIES[name].__doc__ = make.__doc__
        if sql:
            ORACLE[name] = f"WITH {'RECURSIVE ' * recursive}{BASE}{sql}"
        return make

    return put


def _round(*names: str) -> list:
    return [F.round(F.col(n), 4).alias(n) for n in names]


# ---- the flagship: elevation lookup, ground rule, statistics

@query("ground_fuser", "\nSELECT point_id, CASE WHEN abs(z - ground) < 20 THEN 9 ELSE 0 END AS label FROM points")
def ground_fuser(t: Tables) -> DataFrame:
    return stages.Ground(refine=False, epsilon=20)(t.points).select("point_id", "label")


@query(
    "label_stats",
    f""", labelled AS (SELECT CASE WHEN abs(z - ground) < 20 THEN 9 WHEN z < building + 20 THEN 10 ELSE 0 END AS label FROM points),
names(label, name) AS (VALUES {", ".join(f"({k}, '{v}')" for k, v in L.NAMES.items())})
SELECT l.label, n, round(100.0 * n / sum(n) OVER (), 4)::DOUBLE AS percentage, name FROM (SELECT label, count(*) AS n FROM labelled GROUP BY label) l JOIN names USING (label)""",
)
def label_stats(t: Tables) -> DataFrame:
    done = stages.cascade(t.points, [stages.Ground(refine=False, epsilon=20), stages.BelowRoof(epsilon=20)])
    return shapes.label_statistics(done, L.label_table(t.spark)).select("label", "n", *_round("percentage"), "name")


# ---- sources

@query("scan_raster", "\nSELECT ix, iy, ground, building FROM raster WHERE ground IS NOT NULL")
def scan_raster(t: Tables) -> DataFrame:
    return t.raster.where("ground is not null").select("ix", "iy", "ground", "building")


@query("raster_window", "\nSELECT ix, iy, CASE WHEN building > 800 THEN -1 ELSE building END AS building FROM raster WHERE ix BETWEEN 20 AND 69 AND iy BETWEEN 10 AND 59")
def raster_window(t: Tables) -> DataFrame:
    return rasters.window(t.raster.select("ix", "iy", "building"), 20, 70, 10, 60, "building", 800, -1)


@query("scan_registry", "\nSELECT type, x, y FROM objects")
def scan_registry(t: Tables) -> DataFrame:
    """Registry rows as CSV text, read with the registry schema."""
    text = t.objects.select(F.concat_ws(",", "type", "x", "y").alias("value"))
    rows = text.select(F.from_csv("value", F.lit(registry.POINTS)).alias("r")).select("r.*")
    return rows.select("type", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


@query("parse_geojson", "\nSELECT CAST(footprint_id AS VARCHAR) AS feature_id, type, 5 AS corners, x_min, y_max, x_max, y_min FROM footprints")
def parse_geojson(t: Tables) -> DataFrame:
    """Footprints as GeoJSON documents, parsed back."""
    ring = F.transform("ring", lambda p: F.array(p["x"].cast("double"), p["y"].cast("double")))
    feature = F.struct(F.col("footprint_id").cast("string").alias("id"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    text = t.footprints.select(F.concat(F.lit("BGT_FLAT_"), F.col("type")).alias("layer"), F.to_json(F.struct(F.array(feature).alias("features"))).alias("json"))
    return registry.parse_polygons(text).select("feature_id", "type", F.size(F.get("rings", 0)).alias("corners"), *[F.col(c).cast("long").alias(c) for c in ("x_min", "y_max", "x_max", "y_min")])


@query("pole_columns", "\nSELECT object_id, k, x, y, CAST(k * 10 AS BIGINT) AS z FROM objects, (SELECT CAST(range AS INTEGER) AS k FROM range(60)) WHERE k < 10 + object_id % 50")
def pole_columns(t: Tables) -> DataFrame:
    poles = t.objects.select("object_id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.lit(0).alias("z0"), F.col("x").alias("x1"), F.col("y").alias("y1"), ((10 + F.col("object_id") % 50) * 10).alias("z1"), F.lit(60).alias("label"))
    out = registry.pole_columns(poles, 10).join(poles.select("object_id", "z1"), "object_id")
    # the ends are stretched over the column; in steps of the generator this is k * 10
    return out.select("object_id", "k", F.round("x").cast("long").alias("x"), F.round("y").cast("long").alias("y"), F.round(F.col("z") * (F.col("z1") - 10) / F.col("z1")).cast("long").alias("z"))


_PATHS = "SELECT '/scans/' || (event_id % 9000 + 1000) || '_0001/run_' || (2380 + event_id % 20) || '_' || (9700 + event_id % 13) || '.laz' AS path FROM events"


def _paths(t: Tables) -> DataFrame:
    e = F.col("event_id")
    return t.read("events").select(F.concat(F.lit("/scans/"), e % 9000 + 1000, F.lit("_0001/run_"), 2380 + e % 20, F.lit("_"), 9700 + e % 13, F.lit(".laz")).alias("path"))


@query("tilecode_extract", rf", paths AS ({_PATHS})" + "\nSELECT path, regexp_extract(path, '.*(\\d{4}_\\d{4}).*', 1) AS tilecode FROM paths")
def tilecode_extract(t: Tables) -> DataFrame:
    return _paths(t).select("path", tiles.tilecode_of_path(F.col("path")).alias("tilecode"))


@query("tilecode_distinct", rf", paths AS ({_PATHS})" + "\nSELECT DISTINCT regexp_extract(path, '.*(\\d{4}_\\d{4}).*', 1) AS tilecode FROM paths")
def tilecode_distinct(t: Tables) -> DataFrame:
    return tiles.distinct_tilecodes(_paths(t))


_CODES = "codes AS (SELECT DISTINCT (2380 + event_id % 20) AS a, (9700 + event_id % 13) AS b FROM events)"


@query("tile_bbox", f", {_CODES}\nSELECT a || '_' || b AS tilecode, a * 50 - 2 AS x_min, b * 50 + 52 AS y_max, a * 50 + 52 AS x_max, b * 50 - 2 AS y_min FROM codes")
def tile_bbox(t: Tables) -> DataFrame:
    codes = tiles.distinct_tilecodes(_paths(t))
    return codes.select("tilecode", tiles.box_of_tile(F.col("tilecode"), 2).alias("b")).select("tilecode", "b.*")


@query("folder_bbox", f", {_CODES}\nSELECT min(a * 50) AS x_min, max(b * 50 + 50) AS y_max, max(a * 50 + 50) AS x_max, min(b * 50) AS y_min FROM codes")
def folder_bbox(t: Tables) -> DataFrame:
    return tiles.box_of_tiles(tiles.distinct_tilecodes(_paths(t)))


@query("relabel", f"\nSELECT point_id, coalesce(new, 0) AS label FROM cloud LEFT JOIN (VALUES {', '.join(f'({k}, {v})' for k, v in L.OLD_TO_NEW.items())}) m(old, new) ON old = point_id % 16")
def relabel(t: Tables) -> DataFrame:
    return t.cloud.select("point_id", L.relabel(F.col("point_id") % 16).alias("label"))


def _poly(terms, a: str, b: str) -> str:
    return " + ".join(f"({k}e0) * pow({a}, {p}) * pow({b}, {q})" for p, q, k in terms)


@query("rd_to_wgs84", f"""
SELECT point_id, round({crs.PHI0}e0 + ({_poly(crs.LATITUDE, 'a', 'b')}) / 3600, 7) AS latitude, round({crs.LAM0}e0 + ({_poly(crs.LONGITUDE, 'a', 'b')}) / 3600, 7) AS longitude
FROM (SELECT point_id, 1e-5 * (119000 + x - {crs.X0}) AS a, 1e-5 * (485000 + y - {crs.Y0}) AS b FROM cloud)""")
def rd_to_wgs84(t: Tables) -> DataFrame:
    out = t.cloud.select("point_id", crs.to_wgs84(119000 + F.col("x"), 485000 + F.col("y")).alias("w"))
    return out.select("point_id", F.round("w.latitude", 7).alias("latitude"), F.round("w.longitude", 7).alias("longitude"))


@query("wgs84_to_rd", f"""
SELECT point_id, round({crs.X0} + ({_poly(crs.EAST, 'a', 'b')}), 3) AS x, round({crs.Y0} + ({_poly(crs.NORTH, 'a', 'b')}), 3) AS y
FROM (SELECT point_id, 0.36e0 * (52 + x / 1e5 - {crs.PHI0}e0) AS a, 0.36e0 * (4 + y / 1e5 - {crs.LAM0}e0) AS b FROM cloud)""")
def wgs84_to_rd(t: Tables) -> DataFrame:
    out = t.cloud.select("point_id", crs.from_wgs84(52 + F.col("x") / 1e5, 4 + F.col("y") / 1e5).alias("r"))
    return out.select("point_id", F.round("r.x", 3).alias("x"), F.round("r.y", 3).alias("y"))


# ---- predicates


@query("clip_rectangle", "\nSELECT point_id FROM cloud WHERE x BETWEEN 1000 AND 6000 AND y BETWEEN 2000 AND 7000")
def clip_rectangle(t: Tables) -> DataFrame:
    return t.cloud.where(G.in_rectangle(F.col("x"), F.col("y"), 1000, 2000, 6000, 7000)).select("point_id")


@query("clip_box", "\nSELECT point_id FROM cloud WHERE x BETWEEN 1000 AND 6000 AND y BETWEEN 2000 AND 7000 AND z BETWEEN 100 AND 900")
def clip_box(t: Tables) -> DataFrame:
    return t.cloud.where(G.in_box(F.col("x"), F.col("y"), F.col("z"), 1000, 2000, 6000, 7000, 100, 900)).select("point_id")


@query("clip_circle", "\nSELECT point_id FROM cloud WHERE (x - 5000) * (x - 5000) + (y - 5000) * (y - 5000) <= 2500 * 2500")
def clip_circle(t: Tables) -> DataFrame:
    return t.cloud.where(G.in_circle(F.col("x"), F.col("y"), 5000, 5000, F.lit(2500))).select("point_id")


@query("clip_cylinder", "\nSELECT point_id FROM cloud WHERE (x - 5000) * (x - 5000) + (y - 5000) * (y - 5000) <= 2500 * 2500 AND z BETWEEN 100 AND 900")
def clip_cylinder(t: Tables) -> DataFrame:
    return t.cloud.where(G.in_cylinder(F.col("x"), F.col("y"), F.col("z"), 5000, 5000, F.lit(2500), 100, 900)).select("point_id")


SHELL = [(1000, 1000), (9000, 1000), (9000, 9000), (5000, 4000), (1000, 9000)]
HOLE = [(3000, 1500), (7000, 1500), (7000, 3500), (3000, 3500)]


def _edges(name: str, ring: list[tuple[int, int]]) -> str:
    rows = ", ".join(f"({a}, {b}, {c}, {d})" for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True))
    return f"""{name}_edges(ax, ay, ex, ey) AS (VALUES {rows}),
{name} AS (
  SELECT point_id FROM cloud, {name}_edges GROUP BY point_id
  HAVING bool_or((ex - ax) * (y - ay) = (ey - ay) * (x - ax) AND x BETWEEN least(ax, ex) AND greatest(ax, ex) AND y BETWEEN least(ay, ey) AND greatest(ay, ey))
    OR sum(CASE WHEN (ay <= y AND ey > y AND (ex - ax) * (y - ay) > (ey - ay) * (x - ax)) OR (ey <= y AND ay > y AND (ex - ax) * (y - ay) < (ey - ay) * (x - ax)) THEN 1 ELSE 0 END) % 2 = 1)"""


@query("point_in_polygon", f", {_edges('shell', SHELL)}\nSELECT point_id FROM shell")
def point_in_polygon(t: Tables) -> DataFrame:
    return t.cloud.where(G.in_ring(F.col("x"), F.col("y"), G.ring_of(SHELL))).select("point_id")


@query("polygon_clip_holes", f", {_edges('shell', SHELL)}, {_edges('hole', HOLE)}\nSELECT point_id FROM shell EXCEPT SELECT point_id FROM hole")
def polygon_clip_holes(t: Tables) -> DataFrame:
    return t.cloud.where(G.in_polygon(F.col("x"), F.col("y"), F.array(G.ring_of(SHELL), G.ring_of(HOLE)))).select("point_id")


@query("polygon_box_clip", f", {_edges('shell', SHELL)}\nSELECT point_id FROM shell JOIN cloud USING (point_id) WHERE z BETWEEN 100 AND 900")
def polygon_box_clip(t: Tables) -> DataFrame:
    return t.cloud.where(G.in_ring(F.col("x"), F.col("y"), G.ring_of(SHELL)) & F.col("z").between(100, 900)).select("point_id")


BOX = {"x_min": 2500, "y_max": 7500, "x_max": 7500, "y_min": 2500}


@query("registry_points_in_tile", "\nSELECT object_id, type, x, y FROM objects WHERE x BETWEEN 2500 AND 7500 AND y BETWEEN 2500 AND 7500 AND type <> 'boom'")
def registry_points_in_tile(t: Tables) -> DataFrame:
    return registry.points_in_tile(t.objects, BOX, exclude=["boom"]).select("object_id", "type", "x", "y")


@query("registry_polys_in_tile", "\nSELECT footprint_id, type FROM footprints WHERE x_min < 7500 AND x_max > 2500 AND y_min < 7500 AND y_max > 2500 AND type IN ('pand', 'fietspad')")
def registry_polys_in_tile(t: Tables) -> DataFrame:
    return registry.areas_in_tile(t.footprints, BOX, include=["pand", "fietspad"]).select("footprint_id", "type")


@query("registry_lines_in_tile", """, ends AS (
  SELECT line_id, (ex - ax) AS dx, (ey - ay) AS dy, ax, ay FROM lines WHERE x_min < 7500 AND x_max > 2500 AND y_min < 7500 AND y_max > 2500),
cuts AS (
  SELECT line_id,
    greatest(0e0, CASE WHEN dx > 0 THEN (2500 - ax) / (dx * 1e0) WHEN dx < 0 THEN (7500 - ax) / (dx * 1e0) END, CASE WHEN dy > 0 THEN (2500 - ay) / (dy * 1e0) WHEN dy < 0 THEN (7500 - ay) / (dy * 1e0) END) AS t0,
    least(1e0, CASE WHEN dx > 0 THEN (7500 - ax) / (dx * 1e0) WHEN dx < 0 THEN (2500 - ax) / (dx * 1e0) END, CASE WHEN dy > 0 THEN (7500 - ay) / (dy * 1e0) WHEN dy < 0 THEN (2500 - ay) / (dy * 1e0) END) AS t1
  FROM ends WHERE NOT (dx = 0 AND (ax < 2500 OR ax > 7500)) AND NOT (dy = 0 AND (ay < 2500 OR ay > 7500)))
SELECT line_id, round(t0, 4) AS t0, round(t1, 4) AS t1 FROM cuts WHERE t0 <= t1""")
def registry_lines_in_tile(t: Tables) -> DataFrame:
    return registry.lines_in_tile(t.lines, BOX).select("line_id", *_round("t0", "t1"))


@query("registry_grown_areas", """
SELECT p.point_id, count(*) AS areas FROM cloud p JOIN footprints f ON f.type = 'pand' AND f.x_min < 7500 AND f.x_max > 2500 AND f.y_min < 7500 AND f.y_max > 2500
  AND p.x BETWEEN f.x_min - 125 AND f.x_max + 125 AND p.y BETWEEN f.y_min - 125 AND f.y_max + 125
WHERE pow(greatest(f.x_min - p.x, 0, p.x - f.x_max), 2) + pow(greatest(f.y_min - p.y, 0, p.y - f.y_max), 2) <= 15625 GROUP BY p.point_id""")
def registry_grown_areas(t: Tables) -> DataFrame:
    """How many of a tile's buildings, grown by a distance, hold each point."""
    # areas that are equal are tested once
    areas = registry.areas_in_tile(t.footprints, BOX, ["pand"]).groupBy("ring", "x_min", "y_min", "x_max", "y_max").agg(F.count("*").alias("areas"))
    areas = registry.grown(areas, 125)
    x, y = F.col("p.x"), F.col("p.y")
    exact = G.in_rectangle(x, y, F.col("s.x_min"), F.col("s.y_min"), F.col("s.x_max"), F.col("s.y_max")) & G.near_ring(x, y, F.col("s.ring"), 125)
    return spatial.points_in_shapes(t.cloud.select("point_id", "x", "y"), areas, exact, 500, "inner").groupBy("point_id").agg(F.sum("areas").alias("areas"))


@query("plane_slice", "\nSELECT DISTINCT c.code AS label FROM points p JOIN cloud c USING (point_id) WHERE p.z BETWEEN p.ground + 145 AND p.ground + 155")
def plane_slice(t: Tables) -> DataFrame:
    some = rasters.lookup(t.cloud, t.raster, GRID, ["ground"])
    return some.where(F.col("z").between(F.col("ground") + 145, F.col("ground") + 155)).select(F.col("code").alias("label")).distinct()


@query("exclude_labels", "\nSELECT point_id, code AS label FROM cloud WHERE code NOT IN (9, 10)")
def exclude_labels(t: Tables) -> DataFrame:
    return t.cloud.where(~F.col("code").isin(9, 10)).select("point_id", F.col("code").alias("label"))


# ---- set operations on masks

_A, _B = "x BETWEEN 1000 AND 6000", "y BETWEEN 2000 AND 7000"


def _masks(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.cloud.where(F.col("x").between(1000, 6000)).select("point_id"), t.cloud.where(F.col("y").between(2000, 7000)).select("point_id")


@query("mask_union", f"\nSELECT point_id FROM cloud WHERE {_A} OR {_B}")
def mask_union(t: Tables) -> DataFrame:
    a, b = _masks(t)
    return a.union(b).distinct()


@query("mask_intersect", f"\nSELECT point_id FROM cloud WHERE {_A} AND {_B}")
def mask_intersect(t: Tables) -> DataFrame:
    a, b = _masks(t)
    return a.intersect(b)


@query("mask_except", f"\nSELECT point_id FROM cloud WHERE {_A} AND NOT ({_B})")
def mask_except(t: Tables) -> DataFrame:
    a, b = _masks(t)
    return a.subtract(b)


# ---- aggregates

@query("component_size_filter", "\nSELECT point_id, CASE WHEN count(*) OVER (PARTITION BY cluster_id) < 10 THEN -1 ELSE cluster_id END AS component_id FROM cloud")
def component_size_filter(t: Tables) -> DataFrame:
    size = t.cloud.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return t.cloud.join(size, "cluster_id").select("point_id", F.when(F.col("n") < 10, F.lit(-1)).otherwise(F.col("cluster_id")).alias("component_id"))


@query("seed_fraction", "\nSELECT cluster_id, round(avg(CASE WHEN code = 10 THEN 1e0 ELSE 0e0 END), 4) AS share FROM cloud GROUP BY cluster_id HAVING avg(CASE WHEN code = 10 THEN 1e0 ELSE 0e0 END) > 0.1")
def seed_fraction(t: Tables) -> DataFrame:
    share = t.cloud.groupBy("cluster_id").agg(F.avg((F.col("code") == 10).cast("double")).alias("share"))
    return share.where("share > 0.1D").select("cluster_id", *_round("share"))


@query("voxel_column_stats", "\nSELECT x // 200 AS cx, y // 200 AS cy, min(z) AS low, max(z) AS high, median(z) AS median, count(*) AS n FROM cloud GROUP BY ALL")
def voxel_column_stats(t: Tables) -> DataFrame:
    return shapes.column_statistics(t.cloud, 200)


@query("binned_mean_line", "\nSELECT tile, CAST(floor((x + 37.5) / 75) AS BIGINT) AS bin, round(avg(x), 4) AS at, round(avg(z), 4) AS mean FROM cloud GROUP BY ALL")
def binned_mean_line(t: Tables) -> DataFrame:
    return shapes.binned_line(t.cloud, ["tile"], "x", "z", 75).select("tile", "bin", *_round("at", "mean"))


@query("cluster_height", "\nSELECT cluster_id, round(avg(ground), 4) AS ground_z, max(z) AS top_z, round(max(z) - avg(ground), 4) AS height FROM points JOIN (SELECT point_id, cluster_id FROM cloud) USING (point_id) GROUP BY cluster_id")
def cluster_height(t: Tables) -> DataFrame:
    some = rasters.lookup(t.cloud, t.raster, GRID, ["ground"])
    return shapes.heights(some, ["cluster_id"]).select("cluster_id", F.round("ground_z", 4).alias("ground_z"), "top_z", *_round("height"))


@query("cluster_circle", "\nSELECT cluster_id, round(avg(x), 4) AS cx, round(avg(y), 4) AS cy, greatest(max(x) - min(x), max(y) - min(y)) / 2 AS r FROM cloud GROUP BY cluster_id")
def cluster_circle(t: Tables) -> DataFrame:
    return shapes.circles(t.cloud, ["cluster_id"]).select("cluster_id", *_round("cx", "cy"), "r")


@query("bounding_box", "\nSELECT cluster_id, min(x) AS x_min, max(y) AS y_max, max(x) AS x_max, min(y) AS y_min FROM cloud GROUP BY cluster_id")
def bounding_box(t: Tables) -> DataFrame:
    return shapes.bounding_box(t.cloud, ["cluster_id"])


@query("principal_axis_2d", "\nSELECT cluster_id, round(covar_samp(x, y), 2) AS cxy, round(0.5 * atan2(2 * covar_samp(x, y), covar_samp(x, x) - covar_samp(y, y)), 4) AS angle FROM cloud GROUP BY cluster_id HAVING count(*) > 2")
def principal_axis_2d(t: Tables) -> DataFrame:
    big = t.cloud.groupBy("cluster_id").count().where("count > 2")
    return shapes.axis_2d(t.cloud.join(big, "cluster_id", "left_semi"), ["cluster_id"]).select("cluster_id", F.round("cxy", 2).alias("cxy"), *_round("angle"))


# eigenvalues of a symmetric matrix by the cubic's three real roots, and the axis of one as the longest cross product
_EIGEN = """
eigen_a AS (SELECT *, (xx + yy + zz) / 3 AS q, xy * xy + xz * xz + yz * yz AS p1 FROM sums),
eigen_b AS (SELECT *, sqrt((pow(xx - q, 2) + pow(yy - q, 2) + pow(zz - q, 2) + 2 * p1) / 6) AS p FROM eigen_a),
eigen_c AS (
  SELECT *, CASE WHEN p = 0 THEN 0e0 ELSE acos(greatest(-1, least(1, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p * p * p)))) / 3 END AS phi FROM eigen_b),
eigen_d AS (SELECT *, q + 2 * p * cos(phi) AS l1, q + 2 * p * cos(phi + 2 * pi() / 3) AS l3 FROM eigen_c),
eigen AS (SELECT *, 3 * q - l1 - l3 AS l2 FROM eigen_d),
crossed AS (
  SELECT *, unnest([
    {'x': xy * yz - xz * (yy - L), 'y': xz * xy - (xx - L) * yz, 'z': (xx - L) * (yy - L) - xy * xy},
    {'x': xy * (zz - L) - xz * yz, 'y': xz * xz - (xx - L) * (zz - L), 'z': (xx - L) * yz - xy * xz},
    {'x': (yy - L) * (zz - L) - yz * yz, 'y': yz * xz - xy * (zz - L), 'z': xy * yz - (yy - L) * xz}]) AS v FROM eigen),
longest AS (SELECT id, max_by(v, v.x * v.x + v.y * v.y + v.z * v.z) AS v FROM crossed GROUP BY id)"""


def _eigen(which: str) -> str:
    return _EIGEN.replace(" L)", f" {which})")


_COVARIANCE = ", ".join(f"covar_samp({a}, {b}) AS {a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))


def _neighbourhoods(radius: int, most: int) -> str:
    """Covariances of the nearest points of each point, by equality on cells of the radius."""
    step = "(SELECT range AS d FROM range(-1, 2))"
    return f"""own AS (SELECT tile, point_id, x, y, z, x // {radius} AS jx, y // {radius} AS jy, z // {radius} AS jz FROM cloud),
moved AS (SELECT tile, point_id, x, y, z, jx + a.d AS jx, jy + b.d AS jy, jz + c.d AS jz FROM own, {step} a, {step} b, {step} c),
near AS (SELECT m.point_id AS id, o.point_id AS other, o.x, o.y, o.z, (m.x - o.x) * (m.x - o.x) + (m.y - o.y) * (m.y - o.y) + (m.z - o.z) * (m.z - o.z) AS d2 FROM moved m JOIN own o USING (tile, jx, jy, jz)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, other) AS k FROM near WHERE d2 <= {radius * radius}) WHERE k <= {most}),
sums AS (SELECT id, count(*) AS n, {_COVARIANCE} FROM best GROUP BY id HAVING count(*) > 2)"""


@query("principal_axis_3d", f""", sums AS (SELECT cluster_id AS id, {_COVARIANCE} FROM cloud GROUP BY cluster_id HAVING count(*) > 3), {_eigen("l1")},
unit AS (SELECT id, v.x / sqrt(v.x * v.x + v.y * v.y + v.z * v.z) AS x, v.y / sqrt(v.x * v.x + v.y * v.y + v.z * v.z) AS y, v.z / sqrt(v.x * v.x + v.y * v.y + v.z * v.z) AS z FROM longest)
SELECT id AS cluster_id, round(l1, 0) AS l1, round(l2, 0) AS l2, round(l3, 0) AS l3, round(CASE WHEN x < 0 THEN -x ELSE x END, 4) AS ax, round(CASE WHEN x < 0 THEN -y ELSE y END, 4) AS ay, round(CASE WHEN x < 0 THEN -z ELSE z END, 4) AS az
FROM eigen JOIN unit USING (id)""")
def principal_axis_3d(t: Tables) -> DataFrame:
    big = t.cloud.groupBy("cluster_id").count().where("count > 3")
    out = shapes.axes_3d(t.cloud.join(big, "cluster_id", "left_semi"), ["cluster_id"])
    return out.select("cluster_id", *[F.round(F.get("eigenvalues", k), 0).alias(f"l{k + 1}") for k in range(3)], *[F.round(F.get("axis", k), 4).alias(f"a{c}") for k, c in enumerate("xyz")])


@query("linearity", f""", {_neighbourhoods(300, 50)}, {_eigen("l1")}
SELECT id AS point_id, round((l1 - l2) / l1, 3) AS linearity, round(degrees(atan2(sqrt(v.x * v.x + v.y * v.y), abs(v.z))), 1) AS vertical_angle, round(greatest(l3, 0) / (l1 + l2 + l3), 3) AS curvature
FROM eigen JOIN longest USING (id) WHERE n > 3""")
def linearity(t: Tables) -> DataFrame:
    """Features of points with more than three neighbours, as three span a plane and make two equal eigenvalues likely."""
    out = shapes.local_features(t.cloud, 300).where("neighbours > 3")
    return out.select("point_id", F.round("linearity", 3).alias("linearity"), F.round("vertical_angle", 1).alias("vertical_angle"), F.round("curvature", 3).alias("curvature"))


@query("topk_nearest", """, pairs AS (
  SELECT o.object_id, c.point_id, (o.x - c.x) * (o.x - c.x) + (o.y - c.y) * (o.y - c.y) AS d2 FROM objects o JOIN cloud c ON c.x BETWEEN o.x - 400 AND o.x + 400 AND c.y BETWEEN o.y - 400 AND o.y + 400)
SELECT object_id, point_id, d2, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY d2, point_id) AS rank FROM pairs WHERE d2 <= 160000) WHERE rank <= 3""")
def topk_nearest(t: Tables) -> DataFrame:
    objects, points = t.objects.select("object_id", "x", "y"), t.cloud.select("point_id", "x", "y")
    finish, schema = near.pairs(["object_id"], "point_id", ("x", "y"), (), objects, points)
    return near.nearest(objects, points, ["object_id"], "point_id", 400, 3, Scratch(t.spark, "topk"), ("x", "y"), finish, schema)


@query("rank_clusters", "\nSELECT tile, cluster_id, n, CAST(row_number() OVER (PARTITION BY tile ORDER BY n DESC, cluster_id) AS INTEGER) AS rank FROM (SELECT tile, cluster_id, count(*) AS n FROM cloud GROUP BY ALL)")
def rank_clusters(t: Tables) -> DataFrame:
    size = t.cloud.groupBy("tile", "cluster_id").agg(F.count("*").alias("n"))
    return size.withColumn("rank", F.row_number().over(Window.partitionBy("tile").orderBy(F.desc("n"), "cluster_id")))


# ---- geometry

# a hull's edges: pairs of places with all others on one side, or on the line between them
_EDGES = """edges AS (
  SELECT a.cluster_id, a.x AS ax, a.y AS ay, b.x AS ex, b.y AS ey FROM places a JOIN places b ON a.cluster_id = b.cluster_id AND (a.x <> b.x OR a.y <> b.y) JOIN places c ON c.cluster_id = a.cluster_id
  GROUP BY ALL
  HAVING bool_and((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) > 0 OR ((b.x - a.x) * (c.y - a.y) = (b.y - a.y) * (c.x - a.x) AND (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) <= 0)))"""
_HULLS = f", places AS (SELECT DISTINCT cluster_id, x, y FROM cloud),\n{_EDGES}"


@query("convex_hulls", _HULLS + "\nSELECT cluster_id, coalesce(sum(ax * ey - ex * ay) / 2e0, 0) AS area, greatest(1, count(ax)) AS corners FROM (SELECT DISTINCT cluster_id FROM cloud) LEFT JOIN edges USING (cluster_id) GROUP BY cluster_id")
def convex_hulls(t: Tables) -> DataFrame:
    return shapes.convex_hulls(t.cloud, ["cluster_id"])


@query("alpha_shapes", """, places AS (SELECT DISTINCT cluster_id, x, y, row_number() OVER (PARTITION BY cluster_id ORDER BY x, y) AS k FROM (SELECT DISTINCT cluster_id, x, y FROM cloud)),
three AS (
  SELECT a.cluster_id, a.x AS ax, a.y AS ay, CASE WHEN turn > 0 THEN b.x ELSE c.x END AS ex, CASE WHEN turn > 0 THEN b.y ELSE c.y END AS ey, CASE WHEN turn > 0 THEN c.x ELSE b.x END AS cx, CASE WHEN turn > 0 THEN c.y ELSE b.y END AS cy, abs(turn) / 2e0 AS area,
    sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) * sqrt(pow(c.x - b.x, 2) + pow(c.y - b.y, 2)) * sqrt(pow(a.x - c.x, 2) + pow(a.y - c.y, 2)) AS sides
  FROM places a JOIN places b ON a.cluster_id = b.cluster_id AND a.k < b.k JOIN places c ON c.cluster_id = a.cluster_id AND b.k < c.k, LATERAL (SELECT (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS turn) WHERE turn <> 0),
small AS (SELECT * FROM three WHERE sides < 4 * area / 0.0005e0),
kept AS (
  SELECT t.cluster_id, t.area, t.ax, t.ay, t.ex, t.ey, t.cx, t.cy FROM small t JOIN places d ON d.cluster_id = t.cluster_id
  GROUP BY ALL
  HAVING bool_and(
    ((ax - d.x) * (ax - d.x) + (ay - d.y) * (ay - d.y)) * ((ex - d.x) * (cy - d.y) - (cx - d.x) * (ey - d.y))
    - ((ex - d.x) * (ex - d.x) + (ey - d.y) * (ey - d.y)) * ((ax - d.x) * (cy - d.y) - (cx - d.x) * (ay - d.y))
    + ((cx - d.x) * (cx - d.x) + (cy - d.y) * (cy - d.y)) * ((ax - d.x) * (ey - d.y) - (ex - d.x) * (ay - d.y)) <= 0))
SELECT cluster_id, coalesce(sum(area), 0) AS area, count(area) AS triangles FROM (SELECT DISTINCT cluster_id FROM cloud) LEFT JOIN (SELECT * FROM kept WHERE cluster_id IN (SELECT cluster_id FROM places GROUP BY cluster_id HAVING count(*) > 3)) USING (cluster_id) GROUP BY cluster_id""")
def alpha_shapes(t: Tables) -> DataFrame:
    return shapes.alpha_shapes(t.cloud, ["cluster_id"], 0.0005)


@query("alpha_outlines", ORACLE["alpha_shapes"].split("WITH " + BASE)[1].split("\nSELECT cluster_id, coalesce(sum(area), 0)")[0] + """,
directed AS (
  SELECT cluster_id, ax AS x, ay AS y, ex AS tx, ey AS ty FROM kept UNION ALL SELECT cluster_id, ex, ey, cx, cy FROM kept UNION ALL SELECT cluster_id, cx, cy, ax, ay FROM kept),
border AS (SELECT * FROM directed d WHERE NOT EXISTS (SELECT 1 FROM directed o WHERE o.cluster_id = d.cluster_id AND o.x = d.tx AND o.y = d.ty AND o.tx = d.x AND o.ty = d.y))
SELECT cluster_id, count(*) AS corners, round(sum(x * ty - tx * y) / 2e0, 1) AS area FROM border WHERE cluster_id IN (SELECT cluster_id FROM places GROUP BY cluster_id HAVING count(*) > 3) GROUP BY cluster_id""")
def alpha_outlines(t: Tables) -> DataFrame:
    """Corners and area of each alpha shape's rings together, holes taken off."""
    out = shapes.alpha_outlines(t.cloud, ["cluster_id"], 0.0005)
    return out.groupBy("cluster_id").agg(F.sum(F.size("ring") - 1).alias("corners"), F.round(F.sum("area"), 1).alias("area"))


# the smallest rectangle over all hull edges, in the frame of each; several of one area have the smaller side first
_BOXES = """turned AS (
  SELECT cluster_id, ex - ax AS dx, ey - ay AS dy, pow(ex - ax, 2) + pow(ey - ay, 2) AS l2, min(x * (ex - ax) + y * (ey - ay)) AS u0, max(x * (ex - ax) + y * (ey - ay)) AS u1, min(y * (ex - ax) - x * (ey - ay)) AS v0, max(y * (ex - ax) - x * (ey - ay)) AS v1
  FROM edges JOIN places USING (cluster_id) GROUP BY cluster_id, ax, ay, ex, ey),
boxes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round((u1 - u0) * ((v1 - v0) / l2), 3), least(u1 - u0, v1 - v0) / sqrt(l2)) AS k FROM turned) WHERE k = 1)"""


@query("min_bounding_rect", _HULLS + f""", {_BOXES}
SELECT cluster_id, round(coalesce(((u0 + u1) / 2 * dx - (v0 + v1) / 2 * dy) / l2, any_x), 2) AS cx, round(coalesce(((u0 + u1) / 2 * dy + (v0 + v1) / 2 * dx) / l2, any_y), 2) AS cy,
  round(coalesce(least(u1 - u0, v1 - v0) / sqrt(l2), 0), 2) AS short_side, round(coalesce(greatest(u1 - u0, v1 - v0) / sqrt(l2), 0), 2) AS long_side
FROM (SELECT cluster_id, any_value(x) AS any_x, any_value(y) AS any_y FROM cloud GROUP BY cluster_id) LEFT JOIN boxes USING (cluster_id)""")
def min_bounding_rect(t: Tables) -> DataFrame:
    out = shapes.bounding_rectangles(t.cloud, ["cluster_id"])
    return out.select("cluster_id", *[F.round(c, 2).alias(c) for c in ("cx", "cy", "short_side", "long_side")])


@query("overlap_area", """
SELECT a.footprint_id AS a, b.footprint_id AS b, (least(a.x_max, b.x_max) - greatest(a.x_min, b.x_min)) * (least(a.y_max, b.y_max) - greatest(a.y_min, b.y_min)) AS area
FROM footprints a JOIN footprints b ON a.type = 'pand' AND b.type = 'fietspad' AND a.x_min < b.x_max AND a.x_max > b.x_min AND a.y_min < b.y_max AND a.y_max > b.y_min""")
def overlap_area(t: Tables) -> DataFrame:
    return spatial.overlaps(t.footprints.where("type = 'pand'"), t.footprints.where("type = 'fietspad'"), "footprint_id", 500, Scratch(t.spark, "overlap"))


@query("vector_angle", """
SELECT vec_id, round(degrees(acos(greatest(-1, least(1, e[3]::DOUBLE / sqrt(e[1]::DOUBLE * e[1] + e[2]::DOUBLE * e[2] + e[3]::DOUBLE * e[3]))))), 3) AS angle FROM (SELECT vec_id, embedding AS e FROM embeddings)""")
def vector_angle(t: Tables) -> DataFrame:
    v = t.read("embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 3), lambda e: e.cast("double")).alias("v"))
    return v.select("vec_id", F.round(G.vector_angle(F.col("v")), 3).alias("angle"))


@query("cable_frame", "\nSELECT point_id, round((x - 5000) * cos(atan2(1, 2)) + (y - 5000) * sin(atan2(1, 2)), 4) AS along, round((y - 5000) * cos(atan2(1, 2)) - (x - 5000) * sin(atan2(1, 2)), 4) AS across FROM cloud")
def cable_frame(t: Tables) -> DataFrame:
    out = t.cloud.select("point_id", G.cable_frame(F.col("x"), F.col("y"), 5000, 5000, F.lit(2.0), F.lit(1.0)).alias("f"))
    return out.select("point_id", F.round("f.along", 4).alias("along"), F.round("f.across", 4).alias("across"))


@query("sag_angle", """, line AS (SELECT tile, x // 100 AS bin, max(z) AS mean FROM cloud GROUP BY ALL),
arms AS (SELECT tile, bin, lag(mean) OVER w - lead(mean) OVER w AS u, lead(mean) OVER w - lead(mean) OVER w AS v FROM line WINDOW w AS (PARTITION BY tile ORDER BY bin))
SELECT tile, bin, CASE WHEN u IS NULL OR v IS NULL THEN 'infinity'::DOUBLE ELSE round(180 - degrees(acos(greatest(-1, least(1, (-40000 + u * v) / sqrt((40000e0 + u * u) * (40000e0 + v * v)))))), 4) END AS sag FROM arms""")
def sag_angle(t: Tables) -> DataFrame:
    line = t.cloud.groupBy("tile", F.expr("x div 100").alias("bin")).agg(F.max("z").alias("mean"))
    return shapes.sag_angles(line, ["tile"], 200).select("tile", "bin", F.when(F.col("sag") == float("inf"), F.col("sag")).otherwise(F.round("sag", 4)).alias("sag"))


@query("piecewise_line", """, knots AS (SELECT tile, x // 500 * 500 AS t, max(z) AS v FROM cloud GROUP BY ALL),
seen AS (
  SELECT c.tile, c.point_id, c.x, (SELECT max(t) FROM knots k WHERE k.tile = c.tile AND k.t <= c.x) AS ta, (SELECT min(t) FROM knots k WHERE k.tile = c.tile AND k.t >= c.x) AS tb FROM cloud c)
SELECT s.tile, s.point_id, round(CASE WHEN ta IS NULL THEN b.v WHEN tb IS NULL OR ta = tb THEN a.v ELSE a.v + (s.x - ta) / ((tb - ta) * 1e0) * (b.v - a.v) END, 4) AS v
FROM seen s LEFT JOIN knots a ON a.tile = s.tile AND a.t = s.ta LEFT JOIN knots b ON b.tile = s.tile AND b.t = s.tb""")
def piecewise_line(t: Tables) -> DataFrame:
    knots = t.cloud.groupBy("tile", F.expr("x div 500 * 500").alias("t")).agg(F.max("z").alias("v"))
    return shapes.piecewise(t.cloud.select("tile", "point_id", F.col("x").alias("t")), knots, ["tile"]).select("tile", "point_id", *_round("v"))


# ---- rasters

@query("grid_lookup", "\nSELECT point_id, ground, building FROM points")
def grid_lookup(t: Tables) -> DataFrame:
    return t.points.select("point_id", "ground", "building")


# a sample within a cell's size of its centre lies in the cell or beside it, so samples meet moved cells by equality
_AROUND = """
  SELECT ix, iy, x, y, ix + a.d AS jx, iy + b.d AS jy FROM raster, (SELECT range AS d FROM range(-1, 2)) a, (SELECT range AS d FROM range(-1, 2)) b"""


def _best(name: str, radius: int, where: str = "true") -> str:
    """The eight nearest samples of each cell."""
    return f"""{name}_near AS (
  SELECT ix, iy, point_id AS id, z AS value, (r.x - c.x) * (r.x - c.x) + (r.y - c.y) * (r.y - c.y) AS d2
  FROM ({_AROUND}) r JOIN (SELECT *, x // 100 AS jx, (10000 - y) // 100 AS jy FROM cloud WHERE {where}) c USING (jx, jy)),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ix, iy ORDER BY d2, id) AS k FROM {name}_near WHERE d2 <= {radius * radius}) WHERE k <= 8)"""


_NEAR = ", " + _best("best", 100)


def _samples(t: Tables) -> DataFrame:
    return t.cloud.select(F.col("point_id").alias("id"), "x", "y", F.col("z").alias("value"))


@query("idw_surface", _NEAR + "\nSELECT ix, iy, round(CASE WHEN min(d2) = 0 THEN min_by(value, (d2, id)) ELSE sum(value / d2) FILTER (d2 > 0) / sum(1e0 / d2) FILTER (d2 > 0) END, 4) AS value FROM best GROUP BY ix, iy")
def idw_surface(t: Tables) -> DataFrame:
    return rasters.idw(t.raster, _samples(t), 100).select("ix", "iy", *_round("value"))


@query("max_surface", _NEAR + "\nSELECT ix, iy, max(value) AS value FROM best GROUP BY ix, iy")
def max_surface(t: Tables) -> DataFrame:
    return rasters.highest(t.raster, _samples(t), 100)


@query("nearest_surface", _NEAR + "\nSELECT ix, iy, value FROM best WHERE k = 1")
def nearest_surface(t: Tables) -> DataFrame:
    return rasters.nearest_value(t.raster, _samples(t), 100)


@query("build_surface", f""", {_best('g_best', 100, 'classification = 2')}, {_best('b_best', 50, 'classification = 6')},
g AS (SELECT ix, iy, round(CASE WHEN min(d2) = 0 THEN min_by(value, (d2, id)) ELSE sum(value / d2) FILTER (d2 > 0) / sum(1e0 / d2) FILTER (d2 > 0) END, 4) AS ground FROM g_best GROUP BY ix, iy),
b AS (SELECT ix, iy, max(value)::DOUBLE AS building FROM b_best GROUP BY ix, iy)
SELECT r.ix, r.iy, g.ground, b.building FROM raster r LEFT JOIN g USING (ix, iy) LEFT JOIN b USING (ix, iy)""")
def build_surface(t: Tables) -> DataFrame:
    some = t.cloud.select(F.col("point_id").alias("id"), "x", "y", "z", "classification")
    return rasters.build_surface(t.raster.select("ix", "iy", "x", "y"), some).select("ix", "iy", *_round("ground"), "building")


@query("clip_tiles", """
SELECT point_id, tx, ty FROM cloud, (SELECT range AS tx FROM range(-1, 4)), (SELECT range AS ty FROM range(-1, 4))
WHERE x BETWEEN tx * 5000 - 100 AND tx * 5000 + 5100 AND y BETWEEN ty * 5000 - 100 AND ty * 5000 + 5100""")
def clip_tiles(t: Tables) -> DataFrame:
    return rasters.clip_tiles(t.cloud, 5000, 100).select("point_id", "tx", "ty")


_GAPS = """, missing AS (SELECT ix, iy, CAST(iy * 100 + ix AS BIGINT) AS c FROM raster WHERE (ix * ix + iy * 3) % 7 < 2),
steps AS (SELECT a.c AS u, b.c AS v FROM missing a JOIN missing b ON abs(a.ix - b.ix) + abs(a.iy - b.iy) = 1),
reach AS (SELECT c, c AS r FROM missing UNION SELECT reach.c, s.v FROM reach JOIN steps s ON s.u = reach.r),
named AS (SELECT c, min(r) AS gap FROM reach GROUP BY c)"""


@query("raster_gaps", _GAPS + "\nSELECT CAST(c % 100 AS INTEGER) AS ix, CAST(c // 100 AS INTEGER) AS iy, gap, count(*) OVER (PARTITION BY gap) AS cells, count(*) OVER (PARTITION BY gap) <= 5 AS fill FROM named", recursive=True)
def raster_gaps(t: Tables) -> DataFrame:
    missing = t.raster.where("(ix * ix + iy * 3) % 7 < 2")
    return rasters.gaps(missing, Scratch(t.spark, "gaps"), GRID.nx, 5)


@query("fill_gaps", """, moved AS (SELECT ix, iy, ix + a.d AS jx, iy + b.d AS jy, a.d * a.d + b.d * b.d AS d2 FROM raster, (SELECT range AS d FROM range(-4, 5)) a, (SELECT range AS d FROM range(-4, 5)) b WHERE ground IS NULL),
best AS (SELECT * FROM (SELECT m.ix, m.iy, d2, r.ground, row_number() OVER (PARTITION BY m.ix, m.iy ORDER BY d2, r.iy * 100 + r.ix) AS k FROM moved m JOIN raster r ON r.ix = jx AND r.iy = jy WHERE d2 <= 16 AND r.ground IS NOT NULL) WHERE k <= 8),
filled AS (SELECT ix, iy, sum(ground / d2) / sum(1e0 / d2) AS value FROM best GROUP BY ix, iy)
SELECT ix, iy, round(coalesce(ground, value), 4) AS ground FROM raster LEFT JOIN filled USING (ix, iy)""")
def fill_gaps(t: Tables) -> DataFrame:
    """The raster's gaps are single cells, so all of them are filled from within the reach."""
    return rasters.fill_gaps(t.raster, Scratch(t.spark, "fill"), GRID, "ground").select("ix", "iy", *_round("ground"))


@query("coalesce_surface", "\nSELECT ix, iy, coalesce(building, ground) AS surface FROM raster")
def coalesce_surface(t: Tables) -> DataFrame:
    return rasters.coalesce_surface(t.raster, "building", "ground", "surface").select("ix", "iy", "surface")


@query("smooth_edges", f""", moved AS ({_AROUND}),
beside AS (SELECT m.ix, m.iy, abs(m.jx - m.ix) + abs(m.jy - m.iy) AS far, r.ground FROM moved m JOIN raster r ON r.ix = m.jx AND r.iy = m.jy),
mean AS (SELECT ix, iy, avg(ground) AS m FROM beside GROUP BY ALL HAVING bool_or(far = 0 AND ground IS NOT NULL) AND bool_or(far = 1 AND ground IS NULL))
SELECT ix, iy, round(coalesce(m, ground), 4) AS ground FROM raster LEFT JOIN mean USING (ix, iy)""")
def smooth_edges(t: Tables) -> DataFrame:
    return rasters.smooth_edges(t.raster.select("ix", "iy", "ground")).select("ix", "iy", *_round("ground"))


# ---- clusters

@query("octree_level", "\nSELECT cluster_id, CASE WHEN e < 0.001 THEN 0 ELSE greatest(1, CAST(round_even(log2(e / 60e0), 0) AS INTEGER)) END AS level FROM (SELECT cluster_id, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS e FROM cloud GROUP BY cluster_id)")
def octree_level(t: Tables) -> DataFrame:
    extent = t.cloud.groupBy("cluster_id").agg(F.greatest(*[F.max(c) - F.min(c) for c in "xyz"]).alias("e"))
    return extent.select("cluster_id", clusters.octree_level(F.col("e"), 60).alias("level"))


@query("voxelize", "\nSELECT tile, x // 90 AS cx, y // 90 AS cy, z // 90 AS cz, count(*) AS n, min(point_id) AS rep FROM cloud GROUP BY ALL")
def voxelize(t: Tables) -> DataFrame:
    return clusters.occupied(t.cloud, 90).select("tile", "cx", "cy", "cz", "n", "rep")


def _components(source: str, size: int, name: str = "parts") -> str:
    """Components of the cells of the rows of ``source``; the cells' neighbours are found by equality on the moved cell."""
    return f"""{name}_cells AS (SELECT tile, x // {size} AS i, y // {size} AS j, z // {size} AS k, min(point_id) AS rep FROM {source} GROUP BY ALL),
{name}_moved AS (
  SELECT rep, tile, i + a.d AS i, j + b.d AS j, k + c.d AS k FROM {name}_cells, (SELECT range AS d FROM range(-1, 2)) a, (SELECT range AS d FROM range(-1, 2)) b, (SELECT range AS d FROM range(-1, 2)) c),
{name}_steps AS (SELECT m.rep AS u, n.rep AS v FROM {name}_moved m JOIN {name}_cells n USING (tile, i, j, k)),
{name}_reach AS (SELECT rep AS c, rep AS r FROM {name}_cells UNION SELECT w.c, s.v FROM {name}_reach w JOIN {name}_steps s ON s.u = w.r),
{name}_names AS (SELECT c, min(r) AS component_id FROM {name}_reach GROUP BY c),
{name} AS (
  SELECT p.point_id, n.component_id, count(*) OVER (PARTITION BY n.component_id) AS size FROM {source} p
  JOIN {name}_cells c ON c.tile = p.tile AND c.i = p.x // {size} AND c.j = p.y // {size} AND c.k = p.z // {size} JOIN {name}_names n ON n.c = c.rep)"""


@query("connected_components", f", {_components('cloud', 60)}\nSELECT * FROM parts", recursive=True)
def connected_components(t: Tables) -> DataFrame:
    return clusters.grid_components(t.cloud, 60, Scratch(t.spark, "components"))


@query("raster_label", _GAPS + "\nSELECT CAST(c % 100 AS INTEGER) AS ix, CAST(c // 100 AS INTEGER) AS iy, gap FROM named", recursive=True)
def raster_label(t: Tables) -> DataFrame:
    missing = t.raster.where("(ix * ix + iy * 3) % 7 < 2")
    return rasters.gaps(missing, Scratch(t.spark, "label"), GRID.nx).select("ix", "iy", "gap")


_DBSCAN = """, pairs AS (
  SELECT a.point_id AS u, b.point_id AS v FROM cloud a JOIN cloud b
  ON a.tile = b.tile AND b.x BETWEEN a.x - 150 AND a.x + 150 AND b.y BETWEEN a.y - 150 AND a.y + 150 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 22500),
core AS (SELECT u FROM pairs GROUP BY u HAVING count(*) >= 3),
steps AS (SELECT u, v FROM pairs WHERE u IN (SELECT u FROM core) AND v IN (SELECT u FROM core)),
reach AS (SELECT u AS c, u AS r FROM core UNION SELECT w.c, s.v FROM reach w JOIN steps s ON s.u = w.r),
named AS (SELECT c, min(r) AS cluster_id FROM reach GROUP BY c)"""


@query("dbscan", _DBSCAN + "\nSELECT point_id, coalesce(own.cluster_id, border.cluster_id) AS cluster_id, own.cluster_id IS NOT NULL AS core FROM (SELECT v AS point_id, min(cluster_id) AS cluster_id FROM pairs JOIN named ON c = u GROUP BY v) border LEFT JOIN named own ON own.c = point_id", recursive=True)
def dbscan(t: Tables) -> DataFrame:
    return clusters.dbscan(t.cloud, 150, 3, Scratch(t.spark, "dbscan"))


@query("nearest_grow", """, seeds AS (SELECT * FROM cloud WHERE code = 10), free AS (SELECT * FROM cloud WHERE code = 0),
near AS (SELECT f.point_id, s.cluster_id, s.point_id AS id, (f.x - s.x) * (f.x - s.x) + (f.y - s.y) * (f.y - s.y) + (f.z - s.z) * (f.z - s.z) AS d2 FROM free f JOIN seeds s ON f.tile = s.tile AND s.x BETWEEN f.x - 300 AND f.x + 300 AND s.y BETWEEN f.y - 300 AND f.y + 300)
SELECT point_id, min_by(cluster_id, (d2, id)) AS cluster_id FROM near WHERE d2 <= 90000 GROUP BY point_id""")
def nearest_grow(t: Tables) -> DataFrame:
    return clusters.grow_by_nearest(t.cloud.where("code = 0"), t.cloud.where("code = 10"), 300)


def _coded(t: Tables) -> DataFrame:
    """The cloud with both elevations, labelled by its codes."""
    return rasters.lookup(t.cloud.select("tile", "point_id", "x", "y", "z", F.col("code").alias("label")), t.raster, GRID, ["ground", "building"])


@query("region_grow_lcc", f""", chosen AS (SELECT * FROM cloud WHERE code IN (0, 10)), {_components('chosen', 150)},
seeds AS (SELECT component_id, avg(CASE WHEN code = 10 THEN 1e0 ELSE 0e0 END) AS share FROM parts JOIN chosen USING (point_id) WHERE size >= 3 GROUP BY component_id)
SELECT point_id, CASE WHEN share > 0.3 THEN 10 ELSE code END AS label FROM cloud LEFT JOIN parts USING (point_id) LEFT JOIN seeds USING (component_id)""", recursive=True)
def region_grow_lcc(t: Tables) -> DataFrame:
    return clusters.grow_by_components(_coded(t), 10, 150, 3, 0.3, Scratch(t.spark, "grow")).select("point_id", "label")


def _layer(name: str, source: str, band: str, size: int, least: int, share: str) -> str:
    return f"""{name}_some AS (SELECT * FROM {source} WHERE label IN (0, 99, 30) AND {band}), {_components(f'{name}_some', size, f'{name}_parts')},
{name}_seeds AS (SELECT component_id, avg(CASE WHEN label = 30 THEN 1e0 ELSE 0e0 END) AS share FROM {name}_parts JOIN {name}_some USING (point_id) WHERE size >= {least} GROUP BY component_id),
{name} AS (
  SELECT p.tile, p.point_id, p.x, p.y, p.z, p.ground, CASE WHEN share > {share} AND label IN (0, 99) THEN 30 ELSE label END AS label
  FROM {source} p LEFT JOIN {name}_parts USING (point_id) LEFT JOIN {name}_seeds USING (component_id))"""


@query("layered_lcc", f""", coded AS (SELECT p.*, CASE WHEN code = 60 THEN 99 ELSE code END AS label FROM points p JOIN (SELECT point_id, code FROM cloud) USING (point_id)),
{_layer('low', 'coded', 'z - ground <= 500', 150, 3, '0.4')}, {_layer('high', 'low', 'z - ground > 400', 120, 2, '0.1')}
SELECT point_id, label FROM high""", recursive=True)
def layered_lcc(t: Tables) -> DataFrame:
    some = _coded(t).withColumn("label", F.when(F.col("label") == 60, 99).otherwise(F.col("label")))
    layers = [{"top": 500, "size": 150, "min_size": 3, "threshold": 0.4}, {"bottom": 400, "size": 120, "min_size": 2, "threshold": 0.1}]
    return clusters.grow_in_layers(some, 30, layers, Scratch(t.spark, "layers"), reset_noise=True).select("point_id", "label")


@query("region_grow_normals", f""", {_neighbourhoods(400, 30)}, {_eigen("l3")},
shape AS (
  SELECT c.tile, c.point_id, c.x, c.y, c.z, c.code, coalesce(v.x / sqrt(v.x * v.x + v.y * v.y + v.z * v.z), 0) AS nx, coalesce(v.y / sqrt(v.x * v.x + v.y * v.y + v.z * v.z), 0) AS ny, coalesce(v.z / sqrt(v.x * v.x + v.y * v.y + v.z * v.z), 1) AS nz
  FROM cloud c LEFT JOIN longest ON id = c.point_id),
nearest AS (
  SELECT a.point_id AS u, unnest(min(((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) * 10000000000 + b.point_id, 15)) % 10000000000 AS v
  FROM cloud a JOIN cloud b USING (tile) GROUP BY a.point_id),
edges AS (SELECT u, v FROM nearest JOIN shape a ON a.point_id = u JOIN shape b ON b.point_id = v WHERE abs(a.nx * b.nx + a.ny * b.ny + a.nz * b.nz) > cos(radians(20))),
reach AS (SELECT point_id FROM cloud WHERE code = 10 UNION SELECT e.v FROM reach r JOIN edges e ON e.u = r.point_id)
SELECT point_id FROM reach""", recursive=True)
def region_grow_normals(t: Tables) -> DataFrame:
    """Points that seeds reach over neighbours whose normals differ by less than 20 degrees."""
    scratch = Scratch(t.spark, "normals")
    shape = scratch.table(t.cloud.select("tile", "point_id", "x", "y", "z").join(shapes.local_features(t.cloud, 400, 30, scratch), "point_id"), "shape")
    other = shape.select(F.col("tile").alias("other_tile"), F.col("point_id").alias("other_id"), "x", "y", "z", "nx", "ny", "nz", "curvature")
    least = math.cos(math.radians(20))

    def alike(own: pa.Table, others: pa.Table, i, j, d2, rank) -> pa.Table:
        a, b = (np.column_stack([np.asarray(v[c]) for c in ("nx", "ny", "nz")]) for v in (own, others))
        keep = np.flatnonzero((np.abs((a[i] * b[j]).sum(axis=1)) > least) & (np.asarray(others["curvature"])[j] < 1.0))
        return pa.table({"u": own["point_id"].take(pa.array(i[keep])), "v": others["other_id"].take(pa.array(j[keep]))})

    edges = near.nearest(shape, other, ["point_id"], "other_id", None, 15, scratch, ("x", "y", "z"), alike, "u long, v long", ("tile", "other_tile"))
    seeds = t.cloud.where("code = 10").select(F.col("point_id").alias("node"))
    return clusters.reach_from_seeds(edges, seeds, scratch).select(F.col("node").alias("point_id"))


# ---- stages

@query("ground_refined")
def ground_refined(t: Tables) -> DataFrame:
    scratch = Scratch(t.spark, "ground")
    return stages.Ground(epsilon=20, scratch=scratch, bottom=2, top=300, size=150, min_size=4, buffer=5, alpha=0.002)(t.points).select("point_id", "label")


@query("ahn_building_fuser", "\nSELECT point_id, CASE WHEN z < building + 20 THEN 10 ELSE 0 END AS label FROM points")
def ahn_building_fuser(t: Tables) -> DataFrame:
    return stages.BelowRoof(epsilon=20)(t.points).select("point_id", "label")


_IN = "EXISTS (SELECT 1 FROM footprints f WHERE {} AND p.x BETWEEN f.x_min AND f.x_max AND p.y BETWEEN f.y_min AND f.y_max)"


@query("building_fuser", f"\nSELECT point_id, CASE WHEN coalesce(z <= building + 20, true) AND {_IN.format(chr(102) + '.type = ' + chr(39) + 'pand' + chr(39))} THEN 10 ELSE 0 END AS label FROM points p")
def building_fuser(t: Tables) -> DataFrame:
    return stages.Footprint(t.footprints, epsilon=20, bin=300)(t.points).select("point_id", "label")


@query("building_fuser_grown", """, ring AS (
  SELECT point_id, bool_or(pow(greatest(f.x_min - p.x, 0, p.x - f.x_max), 2) + pow(greatest(f.y_min - p.y, 0, p.y - f.y_max), 2) <= 625) AS hit
  FROM points p JOIN footprints f ON f.type = 'pand' AND p.x BETWEEN f.x_min - 25 AND f.x_max + 25 AND p.y BETWEEN f.y_min - 25 AND f.y_max + 25 GROUP BY point_id)
SELECT point_id, CASE WHEN coalesce(z <= building + 20, true) AND coalesce(hit, false) THEN 10 ELSE 0 END AS label FROM points LEFT JOIN ring USING (point_id)""")
def building_fuser_grown(t: Tables) -> DataFrame:
    return stages.Footprint(t.footprints, offset=25, epsilon=20, bin=300)(t.points).select("point_id", "label")


_ROAD = _IN.format("f.type IN ('rijbaan_lokale_weg', 'fietspad')")


@query("road_fuser", f", grounded AS (SELECT *, CASE WHEN abs(z - ground) < 20 THEN 9 ELSE 0 END AS label FROM points)\nSELECT point_id, CASE WHEN label = 9 AND {_ROAD} THEN 1 ELSE label END AS label FROM grounded p")
def road_fuser(t: Tables) -> DataFrame:
    return stages.cascade(t.points, [stages.Ground(refine=False, epsilon=20), stages.Road(t.footprints, bin=300)]).select("point_id", "label")


@query("noise_filter", f", {_components('cloud', 60)}\nSELECT point_id, CASE WHEN size < 3 OR z - ground < -20 THEN 99 ELSE 0 END AS label FROM points JOIN parts USING (point_id)", recursive=True)
def noise_filter(t: Tables) -> DataFrame:
    return stages.Noise(Scratch(t.spark, "noise"), epsilon=20, size=60, min_size=3)(t.points).select("point_id", "label")


@query("car_candidates", f""", {_components('cloud', 150)},
boxes AS (SELECT component_id, max(z) - avg(ground) AS height, max(x) - min(x) AS dx, max(y) - min(y) AS dy, count(*) AS n FROM parts JOIN points USING (point_id) WHERE size >= 3 GROUP BY component_id)
SELECT component_id, n, dx, dy, round(height, 4) AS height FROM boxes WHERE height BETWEEN 100 AND 1200 AND least(dx, dy) > 20 AND least(dx, dy) < 400 AND greatest(dx, dy) > 60 AND greatest(dx, dy) < 900""", recursive=True)
def car_candidates(t: Tables) -> DataFrame:
    parts = clusters.grid_components(t.cloud, 150, Scratch(t.spark, "cars")).where("size >= 3")
    own = t.points.join(parts.select("point_id", "component_id"), "point_id")
    box = own.groupBy("component_id").agg((F.max("z") - F.avg("ground")).alias("height"), (F.max("x") - F.min("x")).alias("dx"), (F.max("y") - F.min("y")).alias("dy"), F.count("*").alias("n"))
    ok = F.col("height").between(100, 1200) & (F.least("dx", "dy") > 20) & (F.least("dx", "dy") < 400) & (F.greatest("dx", "dy") > 60) & (F.greatest("dx", "dy") < 900)
    return box.where(ok).select("component_id", "n", "dx", "dy", *_round("height"))


_LIMITS = stages.Limits(100, 1200, 20, 400, 60, 900)


# components of an object's size with their smallest rectangles, as stages.shaped finds them
_SHAPED = f"""{_components('cloud', 150)},
own AS (SELECT p.point_id, p.tile, p.x, p.y, p.z, p.ground, component_id FROM parts JOIN points p USING (point_id) WHERE size >= 3),
high AS (SELECT component_id, any_value(tile) AS tile, avg(ground) AS ground_z FROM own GROUP BY component_id HAVING max(z) - avg(ground) BETWEEN 100 AND 1200),
places AS (SELECT DISTINCT component_id AS cluster_id, x, y FROM own WHERE component_id IN (SELECT component_id FROM high)),
{_EDGES}, {_BOXES},
fit AS (
  SELECT b.*, tile, ground_z, ((u0 + u1) / 2 * dx - (v0 + v1) / 2 * dy) / l2 AS mx, ((u0 + u1) / 2 * dy + (v0 + v1) / 2 * dx) / l2 AS my FROM boxes b JOIN high ON component_id = cluster_id
  WHERE least(u1 - u0, v1 - v0) / sqrt(l2) > 20 AND least(u1 - u0, v1 - v0) / sqrt(l2) < 400 AND greatest(u1 - u0, v1 - v0) / sqrt(l2) > 60 AND greatest(u1 - u0, v1 - v0) / sqrt(l2) < 900)"""


# what a rectangle shares with a square: the polygon of corners of one in the other and of crossings of their edges
@query("car_fuser", f""", {_SHAPED},
corners AS (
  SELECT cluster_id, dx, dy, l2, u0, u1, v0, v1, nth, (u * dx - v * dy) / l2 AS x, (u * dy + v * dx) / l2 AS y
  FROM (SELECT *, unnest([u0, u1, u1, u0]) AS u, unnest([v0, v0, v1, v1]) AS v, unnest([0, 1, 2, 3]) AS nth FROM fit)),
sides AS (SELECT a.*, b.x AS tx, b.y AS ty FROM corners a JOIN corners b ON b.cluster_id = a.cluster_id AND b.nth = (a.nth + 1) % 4),
extent AS (SELECT cluster_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM corners GROUP BY cluster_id),
near AS (SELECT cluster_id, f.footprint_id, f.x_min, f.x_max, f.y_min, f.y_max FROM extent JOIN footprints f ON f.type NOT IN ('fietspad', 'voetpad') AND x0 < f.x_max AND x1 > f.x_min AND y0 < f.y_max AND y1 > f.y_min),
shared AS (
  SELECT n.cluster_id, footprint_id, c.x, c.y FROM near n JOIN corners c USING (cluster_id) WHERE c.x BETWEEN x_min AND x_max AND c.y BETWEEN y_min AND y_max
  UNION ALL SELECT cluster_id, footprint_id, q.x, q.y FROM (SELECT cluster_id, footprint_id, unnest([{{'x': x_min, 'y': y_min}}, {{'x': x_max, 'y': y_min}}, {{'x': x_max, 'y': y_max}}, {{'x': x_min, 'y': y_max}}]) AS q FROM near) JOIN fit USING (cluster_id)
    WHERE q.x * dx + q.y * dy BETWEEN u0 AND u1 AND q.y * dx - q.x * dy BETWEEN v0 AND v1
  UNION ALL SELECT n.cluster_id, footprint_id, wall, s.y + (wall - s.x) / (s.tx - s.x) * (s.ty - s.y) AS cut FROM (SELECT *, unnest([x_min, x_max]) AS wall FROM near) n JOIN sides s USING (cluster_id) WHERE wall > least(s.x, s.tx) AND wall < greatest(s.x, s.tx) AND s.y + (wall - s.x) / (s.tx - s.x) * (s.ty - s.y) BETWEEN y_min AND y_max
  UNION ALL SELECT n.cluster_id, footprint_id, s.x + (wall - s.y) / (s.ty - s.y) * (s.tx - s.x) AS cut, wall FROM (SELECT *, unnest([y_min, y_max]) AS wall FROM near) n JOIN sides s USING (cluster_id) WHERE wall > least(s.y, s.ty) AND wall < greatest(s.y, s.ty) AND s.x + (wall - s.y) / (s.ty - s.y) * (s.tx - s.x) BETWEEN x_min AND x_max),
middle AS (SELECT cluster_id, footprint_id, avg(x) AS ox, avg(y) AS oy FROM shared GROUP BY ALL),
turned_round AS (SELECT cluster_id, footprint_id, x - ox AS x, y - oy AS y, atan2(y - oy, x - ox) AS angle FROM shared JOIN middle USING (cluster_id, footprint_id)),
next_round AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, first(x) OVER w AS fx, first(y) OVER w AS fy FROM turned_round WINDOW w AS (PARTITION BY cluster_id, footprint_id ORDER BY angle)),
area AS (SELECT cluster_id, footprint_id, sum(x * coalesce(ny, fy) - y * coalesce(nx, fx)) / 2 AS area FROM next_round GROUP BY ALL),
cars AS (SELECT * FROM fit WHERE cluster_id IN (SELECT cluster_id FROM area JOIN fit USING (cluster_id) WHERE 100 * area / ((u1 - u0) * ((v1 - v0) / l2)) > 20)),
hit AS (
  SELECT DISTINCT p.point_id FROM cars c JOIN points p ON p.tile = c.tile AND p.x BETWEEN c.mx - 1000 AND c.mx + 1000 AND p.x * dx + p.y * dy BETWEEN u0 AND u1 AND p.y * dx - p.x * dy BETWEEN v0 AND v1 AND p.z BETWEEN ground_z AND ground_z + 1200)
SELECT point_id, CASE WHEN point_id IN (SELECT point_id FROM hit) THEN 40 ELSE 0 END AS label FROM cloud""", recursive=True)
def car_fuser(t: Tables) -> DataFrame:
    return stages.Car(t.footprints, Scratch(t.spark, "car"), _LIMITS, size=150, min_size=3, bin=300)(t.points).select("point_id", "label")


@query("furniture_fuser", f""", {_SHAPED},
near AS (SELECT DISTINCT cluster_id FROM fit JOIN objects o ON pow(mx - o.x, 2) + pow(my - o.y, 2) <= 90000)
SELECT point_id, CASE WHEN component_id IN (SELECT cluster_id FROM near) THEN 80 ELSE 0 END AS label FROM cloud LEFT JOIN parts USING (point_id)""", recursive=True)
def furniture_fuser(t: Tables) -> DataFrame:
    return stages.Furniture(t.objects, Scratch(t.spark, "furniture"), _LIMITS, L.CITY_BENCH, size=150, min_size=3, max_distance=300)(t.points).select("point_id", "label")


def _pole(t: Tables, name: str) -> tuple[stages.Pole, DataFrame]:
    objects = rasters.lookup(t.objects, t.raster, GRID, ["ground"])
    return stages.Pole(objects, Scratch(t.spark, name), L.TREE, pad=300, max_distance=400, size=200, seed_height=600, min_height=100, min_points=1, max_r=400, z_min=20, z_max=1400, plane=500, radius=300, near=200, eps=400, min_samples=2, label_height=900), objects


@query("pole_candidates", """, based AS (SELECT o.object_id, o.x, o.y, coalesce(r.ground, 0) AS g FROM objects o LEFT JOIN raster r ON r.ix = least(o.x // 100, 99) AND r.iy = least((10000 - o.y) // 100, 99)),
cells AS (
  SELECT object_id, b.x AS ox, b.y AS oy, (c.x - b.x + 300) // 200 AS i, (c.y - b.y + 300) // 200 AS j, min(c.z) AS low, max(c.z) AS high, median(c.z) AS mid, count(*) AS n
  FROM based b JOIN cloud c ON c.x BETWEEN b.x - 300 AND b.x + 300 AND c.y BETWEEN b.y - 300 AND b.y + 300 AND c.z BETWEEN b.g + 20 AND b.g + 1400 GROUP BY ALL),
good AS (
  SELECT object_id, i, j, ox - 300 + (i + 0.5e0) * 200 AS cx, oy - 300 + (j + 0.5e0) * 200 AS cy, pow(-300 + (i + 0.5e0) * 200, 2) + pow(-300 + (j + 0.5e0) * 200, 2) AS d2
  FROM cells WHERE high - low > 100 AND n > 1 AND abs(mid - (low + high) / 2e0) < 0.2e0 * (high - low))
SELECT object_id, cx, cy FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY d2, i, j) AS k FROM good) WHERE k = 1 AND d2 <= 160000""")
def pole_candidates(t: Tables) -> DataFrame:
    stage, objects = _pole(t, "candidates")
    return stage.candidates(t.points, objects)


@query("pole_fuser", ORACLE["pole_candidates"].split("WITH " + BASE)[1].replace("\nSELECT object_id, cx, cy FROM (", ",\nfound AS (SELECT object_id, cx, cy, b.g FROM (", 1).replace("WHERE k = 1 AND d2 <= 160000", "JOIN based b USING (object_id) WHERE k = 1 AND d2 <= 160000)") + """,
slab AS (SELECT object_id, point_id, c.x, c.y, c.z, cx, cy, g FROM found JOIN cloud c ON c.x BETWEEN cx - 300 AND cx + 300 AND c.y BETWEEN cy - 300 AND cy + 300 AND pow(c.x - cx, 2) + pow(c.y - cy, 2) <= 90000 AND c.z BETWEEN g + 100 AND g + 1100),
pairs AS (SELECT object_id, a.point_id AS u, b.point_id AS v FROM slab a JOIN slab b USING (object_id) WHERE a.point_id <> b.point_id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= 160000),
reach AS (SELECT object_id, u AS c, u AS r FROM pairs UNION SELECT w.object_id, w.c, p.v FROM reach w JOIN pairs p ON p.object_id = w.object_id AND p.u = w.r),
named AS (SELECT object_id, c AS point_id, min(r) AS cluster_id FROM reach GROUP BY object_id, c),
circles AS (
  SELECT object_id, cluster_id, avg(x) AS px, avg(y) AS py, greatest(max(x) - min(x), max(y) - min(y)) / 2e0 AS r, any_value(cx) AS cx, any_value(cy) AS cy, any_value(g) AS g, min(point_id) AS first_id
  FROM slab JOIN named USING (object_id, point_id) GROUP BY object_id, cluster_id),
pole AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY first_id) AS nth FROM circles WHERE r <= 400 AND pow(cx - px, 2) + pow(cy - py, 2) <= pow(r + 200, 2)) WHERE nth = 1),
hit AS (SELECT DISTINCT point_id FROM pole JOIN cloud c ON c.x BETWEEN px - 601 AND px + 601 AND pow(c.x - px, 2) + pow(c.y - py, 2) <= pow(1.5e0 * r, 2) AND c.z <= g + 900)
SELECT point_id, CASE WHEN point_id IN (SELECT point_id FROM hit) THEN 30 ELSE 0 END AS label FROM cloud""", recursive=True)
def pole_fuser(t: Tables) -> DataFrame:
    stage, _ = _pole(t, "pole")
    return stage(t.points).select("point_id", "label")


@query("cable_height_band", "\nSELECT point_id FROM points p WHERE z - ground > 450 AND z - ground < 1200 AND NOT " + _IN.format("f.type = 'pand'"))
def cable_height_band(t: Tables) -> DataFrame:
    houses = t.footprints.where("type = 'pand'")
    return stages.Cable(Scratch(t.spark, "band"), houses, bottom=450, top=1200, offset=0, bin=300).open_air(t.points).select("point_id")


@query("cable_fuser")
def cable_fuser(t: Tables) -> DataFrame:
    scratch = Scratch(t.spark, "cable")
    filled = rasters.fill_ground(t.raster, scratch)
    points = rasters.lookup(t.points, filled, GRID, ["surface"])
    return stages.Cable(scratch, t.footprints.where("type = 'pand'"), t.lines, tram_height=900, tram_distance=100, tram_gap=200, tram_cell=50, bottom=450, top=1200, offset=125, size=9, radius=400, linear=0.8, max_tilt=80, cluster_eps=200, grow=150, min_length=100, bin=300)(points).select("point_id", "label")


@query("cascade", f""", ground AS (SELECT *, CASE WHEN abs(z - ground) < 20 THEN 9 ELSE 0 END AS l1 FROM points),
road AS (SELECT *, CASE WHEN l1 = 9 AND {_ROAD} THEN 1 ELSE l1 END AS l2 FROM ground p),
free AS (SELECT * FROM road WHERE l2 = 0), {_components('free', 60)},
noise AS (SELECT road.*, CASE WHEN l2 = 0 AND (size < 2 OR z - ground < -20) THEN 99 ELSE l2 END AS l3 FROM road LEFT JOIN parts USING (point_id)),
house AS (SELECT *, CASE WHEN l3 = 0 AND coalesce(z <= building + 20, true) AND {_IN.format("f.type = 'pand'")} THEN 10 ELSE l3 END AS l4 FROM noise p)
SELECT tile, l4 AS label, count(*) AS n, sum(point_id)::BIGINT AS ids FROM house GROUP BY ALL""", recursive=True)
def cascade(t: Tables) -> DataFrame:
    """Ground, road, noise and footprints, counted by tile."""
    steps = [stages.Ground(refine=False, epsilon=20), stages.Road(t.footprints, bin=300), stages.Noise(Scratch(t.spark, "noise"), epsilon=20, size=60, min_size=2), stages.Footprint(t.footprints, epsilon=20, bin=300)]
    return stages.cascade(t.points, steps).groupBy("tile", "label").agg(F.count("*").alias("n"), F.sum("point_id").alias("ids"))


@query("points_by_stage", ORACLE["cascade"].split("WITH RECURSIVE " + BASE)[1].split("\nSELECT tile, l4")[0] + """,
free_after AS (SELECT count(*) FILTER (l1 = 0) AS n1, count(*) FILTER (l2 = 0) AS n2, count(*) FILTER (l3 = 0) AS n3, count(*) FILTER (l4 = 0) AS n4, count(*) AS n0 FROM house)
SELECT unnest([1, 2, 3, 4]) AS step, unnest(['Ground', 'Road', 'Noise', 'Footprint']) AS stage, unnest([n0 - n1, n1 - n2, n2 - n3, n3 - n4]) AS labelled FROM free_after""", recursive=True)
def points_by_stage(t: Tables) -> DataFrame:
    """How many points each stage of the cascade labels."""
    report: list = []
    steps = [stages.Ground(refine=False, epsilon=20), stages.Road(t.footprints, bin=300), stages.Noise(Scratch(t.spark, "noise"), epsilon=20, size=60, min_size=2), stages.Footprint(t.footprints, epsilon=20, bin=300)]
    stages.cascade(t.points, steps, report=report)
    return t.spark.createDataFrame([(k, name, n) for k, (name, n) in enumerate(report, 1)], "step int, stage string, labelled long")


@query("tram_corridor", """, cells AS (SELECT a.range AS cx, b.range AS cy, (a.range + 0.5e0) * 100 AS x, (b.range + 0.5e0) * 100 AS y FROM range(-40, 140) a, range(-40, 140) b),
spans AS (SELECT cx, cy, x, y, ax, ay, (ex - ax)::DOUBLE AS dx, (ey - ay)::DOUBLE AS dy FROM cells JOIN lines ON x BETWEEN x_min - 700 AND x_max + 700 AND y BETWEEN y_min - 700 AND y_max + 700),
feet AS (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE greatest(0, least(1, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) END AS t FROM spans),
grown AS (SELECT DISTINCT cx, cy, x, y FROM feet WHERE pow(x - (ax + t * dx), 2) + pow(y - (ay + t * dy), 2) <= 360000),
rim AS (SELECT c.x, c.y, c.cx, c.cy FROM cells c WHERE (c.cx, c.cy) NOT IN (SELECT (cx, cy) FROM grown)),
gone AS (SELECT DISTINCT g.cx, g.cy FROM grown g JOIN rim r ON r.cx BETWEEN g.cx - 4 AND g.cx + 4 AND r.cy BETWEEN g.cy - 4 AND g.cy + 4 WHERE pow(g.x - r.x, 2) + pow(g.y - r.y, 2) <= 160000)
SELECT cx, cy FROM grown WHERE (cx, cy) NOT IN (SELECT (cx, cy) FROM gone)""")
def tram_corridor(t: Tables) -> DataFrame:
    return spatial.corridor(t.lines, 200, 400, 100)


@query("full_cascade")
def full_cascade(t: Tables) -> DataFrame:
    """All kinds of stages in their usual order, counted by tile: ground to cars, trees and lamps, furniture, and growing."""
    scratch = Scratch(t.spark, "full")
    objects = rasters.lookup(t.objects, t.raster, GRID, ["ground"])
    pole = {"pad": 300, "max_distance": 400, "size": 200, "seed_height": 600, "min_height": 100, "min_points": 1, "max_r": 400, "z_min": 20, "z_max": 1400, "plane": 500, "radius": 300, "near": 200, "eps": 400, "min_samples": 2}
    cable = {"tram_height": 900, "tram_distance": 100, "tram_gap": 200, "tram_cell": 50, "bottom": 450, "top": 1200, "offset": 125, "size": 9, "radius": 400, "linear": 0.8, "max_tilt": 80, "cluster_eps": 200, "grow": 150, "min_length": 100, "bin": 300}
    small = stages.Limits(50, 1200, 5, 400, 5, 900)
    steps = [
        stages.Ground(refine=False, epsilon=20),
        stages.Road(t.footprints, bin=300),
        stages.Noise(scratch, epsilon=20, size=90, min_size=2),
        stages.Footprint(t.footprints, epsilon=20, bin=300),
        stages.Cable(scratch, t.footprints.where("type = 'pand'"), t.lines, **cable),
        stages.Car(t.footprints, scratch, _LIMITS, size=120, min_size=3, bin=300),
        stages.Pole(objects, scratch, L.TREE, "boom", label_height=900, **pole),
        stages.Pole(objects, scratch, L.STREET_LIGHT, "lichtmast", label_height=700, **pole),
        stages.Pole(objects, scratch, L.TRAFFIC_SIGN, "verkeersbord", label_height=500, **pole),
        stages.Furniture(t.objects, scratch, small, L.RUBBISH_BIN, "lichtmast", size=100, min_size=2, max_distance=300),
        stages.Furniture(t.objects, scratch, small, L.CITY_BENCH, "verkeersbord", size=100, min_size=2, max_distance=300),
        stages.Grow(scratch, L.BUILDING, 100, 3, 0.3),
        stages.Grow(scratch, L.STREET_LIGHT, 100, 2, 0.1),
        stages.Grow(scratch, L.TRAFFIC_SIGN, 100, 2, 0.1),
        stages.GrowInLayers(scratch, L.TREE, ({"top": 500, "size": 120, "min_size": 3, "threshold": 0.2}, {"bottom": 400, "size": 100, "min_size": 2, "threshold": 0.1}), True),
    ]
    return stages.cascade(t.points, steps).groupBy("tile", "label").agg(F.count("*").alias("n"))
