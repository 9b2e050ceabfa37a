"""Labelling stages and their cascade.

A stage takes and returns a cloud ``(tile, point_id, x, y, z, label, ground, building, …)``, where ``ground`` and
``building`` are the elevations looked up once for every point. By default a stage sees points with label 0 only. All
defaults are in metres; pass your own for other units. Stages that find nothing, or get empty tables, change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import geometry as G
from ..functions import kernels as K
from ..functions import labels as L
from ..plans.scratch import Scratch
from . import clusters, shapes, spatial

# Surface types that count as road.
ROAD_TYPES = ["rijbaan_lokale_weg", "parkeervlak", "rijbaan_autoweg", "rijbaan_autosnelweg", "rijbaan_regionale_weg", "ov-baan", "fietspad"]

Stage = Callable[[DataFrame], DataFrame]


def _set(points: DataFrame, where: Column, label: int) -> DataFrame:
    return points.withColumn("label", F.when(where, F.lit(label)).otherwise(F.col("label")).cast("int"))


def _set_ids(points: DataFrame, ids: DataFrame, label: int, only: Column | None = None) -> DataFrame:
    """Label the points whose id is in ``ids``."""
    mark = ids.select("point_id").distinct().withColumn("_hit", F.lit(True))
    where = F.col("_hit").isNotNull() if only is None else F.col("_hit").isNotNull() & only
    return _set(points.join(mark, "point_id", "left"), where, label).drop("_hit")


def _types(registry: DataFrame, types: str | Iterable[str] | None, exclude: Iterable[str] = ()) -> DataFrame:
    if types is not None:
        registry = registry.where(F.col("type").isin([types] if isinstance(types, str) else list(types)))
    return registry.where(~F.col("type").isin(list(exclude))) if exclude else registry


def _on_surface(registry: DataFrame, types: str | Iterable[str] | None, offset: float, bin: float) -> Column:
    """Whether a point is on a registry surface of these types, or within ``offset`` of one."""
    own = _types(registry, types).select(*[F.col(c).alias(f"_{c}") for c in ("ring", "x_min", "y_min", "x_max", "y_max")])
    x, y, ring = F.col("x").outer(), F.col("y").outer(), F.col("_ring")
    exact = G.near_ring(x, y, ring, offset) if offset else G.in_ring(x, y, ring)
    box = G.in_rectangle(x, y, F.col("_x_min") - offset, F.col("_y_min") - offset, F.col("_x_max") + offset, F.col("_y_max") + offset)
    own = own.withColumnsRenamed({"_x_min": "x_min", "_y_min": "y_min", "_x_max": "x_max", "_y_max": "y_max"})
    for c in ("x_min", "y_min", "x_max", "y_max"):
        own = own.withColumn(f"_{c}", F.col(c))
    return spatial.held_by(own, box & exact, bin, offset)


def _free() -> Column:
    return F.col("label") == L.UNKNOWN


@dataclass(frozen=True)
class Ground:
    """``|z - ground| < epsilon``, strictly; points that stand in an object's outline are taken back if ``refine``."""

    label: int = L.GROUND
    epsilon: float = 0.2
    refine: bool = True
    scratch: Scratch | None = None
    bottom: float = 0.02
    top: float = 0.5
    size: float = 0.4
    min_size: int = 50
    buffer: float = 0.05
    alpha: float | None = 2.0

    def __call__(self, points: DataFrame) -> DataFrame:
        near = F.coalesce(F.abs(F.col("z") - F.col("ground")) < self.epsilon, F.lit(False))
        if not self.refine:
            return _set(points, _free() & near, self.label)
        scratch = self.scratch or Scratch(points.sparkSession, "ground")
        marked = points.withColumn("_g", _free() & near)
        low = marked.where((F.col("z") >= F.col("ground") - self.bottom) & (F.col("z") <= F.col("ground") + self.top))
        parts = clusters.grid_components(low.where(_free() & ~F.col("_g")), self.size, scratch).where(F.col("size") >= self.min_size)
        outline = low.select("tile", "point_id", "x", "y").join(parts.select("point_id", "component_id"), "point_id")
        box = shapes.bounding_box(outline, ["tile", "component_id"]).withColumnsRenamed({"tile": "_tile"})
        inside = spatial.points_in_shapes(low.where("_g").select("tile", "point_id", "x", "y"), box, (F.col("p.tile") == F.col("s._tile")) & G.in_rectangle(F.col("p.x"), F.col("p.y"), F.col("s.x_min") - self.buffer, F.col("s.y_min") - self.buffer, F.col("s.x_max") + self.buffer, F.col("s.y_max") + self.buffer), 10 * self.size, "inner", self.buffer)
        both = outline.select("component_id", "x", "y", F.lit(None).cast("long").alias("ground_id")).unionByName(inside.select("component_id", "x", "y", F.col("point_id").alias("ground_id")))
        buffer, alpha = self.buffer, self.alpha

        def hidden(key: tuple, table: pa.Table) -> pa.Table:
            ids = table["ground_id"].to_pandas().to_numpy()
            xy = np.column_stack([table["x"].to_numpy(), table["y"].to_numpy()]).astype(float)
            own = np.isnan(ids.astype(float))
            shape = K.alpha_triangles(xy[own], alpha) if alpha and len(np.unique(xy[own], axis=0)) > 3 else np.zeros((0, 3, 2))
            if not alpha:
                hull = K.convex_hull(xy[own])
                shape = np.array([[hull[0], hull[k], hull[k + 1]] for k in range(1, len(hull) - 1)]).reshape(-1, 3, 2)
            return pa.table({"point_id": pa.array(ids[~own][K.in_triangles(xy[~own], shape, buffer)].astype(np.int64))})

        back = both.groupBy("component_id").applyInArrow(hidden, "point_id long").distinct().withColumn("_back", F.lit(True))
        out = marked.join(back, "point_id", "left")
        return _set(out, F.col("_g") & F.col("_back").isNull(), self.label).drop("_g", "_back")


@dataclass(frozen=True)
class BelowRoof:
    """``z < building + epsilon``, strictly; no lower bound."""

    label: int = L.BUILDING
    epsilon: float = 0.2

    def __call__(self, points: DataFrame) -> DataFrame:
        return _set(points, _free() & F.coalesce(F.col("z") < F.col("building") + self.epsilon, F.lit(False)), self.label)


@dataclass(frozen=True)
class Footprint:
    """Points in a footprint grown by ``offset``; where a roof is known, not above it by more than ``epsilon``.

    ``registry(type, ring, x_min, y_min, x_max, y_max)``; growth is by distance, so corners are round.
    """

    registry: DataFrame
    label: int = L.BUILDING
    offset: float = 0
    epsilon: float | None = 0.2
    types: tuple[str, ...] = ("pand",)
    bin: float = 10

    def __call__(self, points: DataFrame) -> DataFrame:
        roof = F.lit(True) if self.epsilon is None else F.coalesce(F.col("z") <= F.col("building") + self.epsilon, F.lit(True))
        return _set(points, _free() & roof & _on_surface(self.registry, self.types, self.offset, self.bin), self.label)


@dataclass(frozen=True)
class Road:
    """Ground points on a road surface become road, whatever other stages left free."""

    registry: DataFrame
    label: int = L.ROAD
    types: tuple[str, ...] | str = tuple(ROAD_TYPES)
    offset: float = 0
    bin: float = 10

    def __call__(self, points: DataFrame) -> DataFrame:
        return _set(points, (F.col("label") == L.GROUND) & _on_surface(self.registry, self.types, self.offset, self.bin), self.label)


@dataclass(frozen=True)
class Noise:
    """Points of small components, and points more than ``epsilon`` below the ground."""

    scratch: Scratch
    label: int = L.NOISE
    epsilon: float = 0.2
    size: float = 0.1
    min_size: int = 100

    def __call__(self, points: DataFrame) -> DataFrame:
        some = points.where(_free())
        small = clusters.grid_components(some, self.size, self.scratch).where(F.col("size") < self.min_size).select("point_id")
        low = some.where(F.col("z") - F.col("ground") < -self.epsilon).select("point_id")
        return _set_ids(points, small.unionByName(low), self.label)


@dataclass(frozen=True)
class Limits:
    """Size of an object: closed bounds of its height, open bounds of the sides of its rectangle."""

    min_height: float
    max_height: float
    min_width: float
    max_width: float
    min_length: float
    max_length: float


def shaped(points: DataFrame, limits: Limits, size: float, min_size: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Components of free points that have an object's size, with rectangle and ground, and their points."""
    some = points.where(_free())
    parts = clusters.grid_components(some, size, scratch).where(F.col("size") >= min_size)
    own = some.select("tile", "point_id", "x", "y", "z", "ground").join(parts.select("point_id", "component_id"), "point_id")
    high = shapes.heights(own, ["tile", "component_id"]).where(F.col("height").between(limits.min_height, limits.max_height))
    fit = own.join(high.select("component_id"), "component_id", "left_semi")
    boxes = shapes.bounding_rectangles(fit, ["tile", "component_id"])
    ok = (F.col("short_side") > limits.min_width) & (F.col("short_side") < limits.max_width) & (F.col("long_side") > limits.min_length) & (F.col("long_side") < limits.max_length)
    return scratch.table(boxes.where(ok).join(high, ["tile", "component_id"]), "shaped"), own


@dataclass(frozen=True)
class Car:
    """Components of a car's size whose rectangle is covered by one road surface by more than ``overlap`` per cent.

    All free points in the rectangle from the ground up to the largest height are labelled.
    """

    registry: DataFrame
    scratch: Scratch
    limits: Limits
    label: int = L.CAR
    size: float = 0.05
    min_size: int = 5000
    overlap: float = 20
    exclude: tuple[str, ...] = ("fietspad", "voetpad")
    bin: float = 10

    def __call__(self, points: DataFrame) -> DataFrame:
        found, _ = shaped(points, self.limits, self.size, self.min_size, self.scratch)
        xs, ys = F.expr("filter(corners, (v, i) -> i % 2 = 0)"), F.expr("filter(corners, (v, i) -> i % 2 = 1)")
        boxes = found.select("*", F.array_min(xs).alias("x_min"), F.array_max(xs).alias("x_max"), F.array_min(ys).alias("y_min"), F.array_max(ys).alias("y_max"))
        roads = spatial.binned_boxes(_types(self.registry, None, self.exclude).select("ring", "x_min", "y_min", "x_max", "y_max").distinct(), self.bin).alias("s")
        near = spatial.binned_boxes(boxes, self.bin).alias("c").join(roads, (F.col("c._bx") == F.col("s._bx")) & (F.col("c._by") == F.col("s._by")) & G.boxes_overlap(*({k: F.col(f"{a}.{k}") for k in ("x_min", "x_max", "y_min", "y_max")} for a in "cs")))
        near = near.select("c.component_id", "c.corners", "s.ring").distinct()
        overlap = self.overlap

        def covered(batches):
            for b in batches:
                keep = [i for i, (c, r) in enumerate(zip(b.column("corners"), b.column("ring"), strict=True)) if K.overlap_percent(np.array(c.as_py()).reshape(-1, 2), np.array([[p["x"], p["y"]] for p in r.as_py()])) > overlap]
                yield pa.RecordBatch.from_arrays([b.column("component_id").take(pa.array(keep, pa.int64()))], ["component_id"])

        on_road = near.mapInArrow(covered, "component_id long").distinct()
        cars = boxes.join(on_road, "component_id", "left_semi")
        ring = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.struct(F.get("corners", k % 4 * 2).alias("x"), F.get("corners", k % 4 * 2 + 1).alias("y")))
        cars = cars.select(ring.alias("ring"), "x_min", "y_min", "x_max", "y_max", F.col("ground_z"), F.col("tile").alias("_tile"))
        x, y, z = F.col("p.x"), F.col("p.y"), F.col("p.z")
        tiny = 1e-6  # corners of a turned rectangle are rounded, and its edges hold points of the car
        exact = (F.col("p.tile") == F.col("s._tile")) & G.in_rectangle(x, y, F.col("s.x_min") - tiny, F.col("s.y_min") - tiny, F.col("s.x_max") + tiny, F.col("s.y_max") + tiny) & G.near_ring(x, y, F.col("s.ring"), tiny) & z.between(F.col("s.ground_z"), F.col("s.ground_z") + self.limits.max_height)
        hit = spatial.points_in_shapes(points.where(_free()).select("tile", "point_id", "x", "y", "z"), cars, exact, self.bin, grow=tiny)
        return _set_ids(points, hit, self.label)


@dataclass(frozen=True)
class Furniture:
    """Components of an object's size with a registry object within ``max_distance`` of the middle of their rectangle."""

    registry: DataFrame
    scratch: Scratch
    limits: Limits
    label: int
    types: tuple[str, ...] | str | None = None
    size: float = 0.05
    min_size: int = 1500
    max_distance: float = 1.0

    def __call__(self, points: DataFrame) -> DataFrame:
        found, own = shaped(points, self.limits, self.size, self.min_size, self.scratch)
        objects = _types(self.registry, self.types).select("x", "y")
        middle = found.select("component_id", F.col("cx").alias("x"), F.col("cy").alias("y"))
        near = spatial.neighbours(middle, objects, self.max_distance, ("x", "y")).select("l.component_id").distinct()
        return _set_ids(points, own.join(near, "component_id", "left_semi"), self.label)


@dataclass(frozen=True)
class Pole:
    """Poles at registry objects: the nearest dense column, its circle at seed height, and a cylinder up from there."""

    registry: DataFrame
    scratch: Scratch
    label: int
    types: tuple[str, ...] | str | None = None
    r_mult: float = 1.5
    label_height: float = 4
    pad: float = 1.5
    max_distance: float = 1.2
    size: float = 0.2
    seed_height: float = 1.5
    min_height: float = 2
    min_points: int = 500
    max_r: float = 0.5
    z_min: float = 0.2
    z_max: float = 2.7
    plane: float = 0.1
    radius: float = 1.0
    near: float = 0.1
    eps: float = 0.05
    min_samples: int = 5

    def candidates(self, points: DataFrame, objects: DataFrame) -> DataFrame:
        """``object_id, cx, cy``: the nearest column of each object that looks like a pole, within ``max_distance``.

        ``objects(object_id, x, y, ground)``; an object on unknown ground stands at 0.
        """
        found = self._columns(points, objects).withColumnsRenamed({"x": "_x", "y": "_y", "g": "_g"})
        same = (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")) & (F.coalesce("ground", F.lit(0)).cast("double") == F.col("_g"))
        return objects.join(found, same).select("object_id", "cx", "cy")

    def _columns(self, points: DataFrame, objects: DataFrame) -> DataFrame:
        """``x, y, g, cx, cy``: ``candidates`` for each place of objects, those that stand on one another taken once."""
        places = objects.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.coalesce("ground", F.lit(0)).cast("double").alias("g"))
        pad, size, far = self.pad, self.size, self.max_distance
        low, high, min_height, min_points = self.z_min, self.z_max, self.min_height, self.min_points

        def column(place: np.ndarray, at: np.ndarray, ids: np.ndarray) -> tuple | None:
            x, y, g = place
            at = at[(at[:, 2] >= g + low) & (at[:, 2] <= g + high)]
            if not len(at):
                return None
            i, j = (np.floor((at[:, k] - (v - pad)) / size).astype(np.int64) for k, v in ((0, x), (1, y)))
            wide = int(j.max()) + 1
            cell = i * wide + j
            count = np.bincount(cell)
            some = [divmod(int(k), wide) for k in np.flatnonzero(count > min_points)]
            middle = [(x - pad + (a + 0.5) * size, y - pad + (b + 0.5) * size) for a, b in some]
            for d2, a, b, cx, cy in sorted(((cx - x) * (cx - x) + (cy - y) * (cy - y), a, b, cx, cy) for (a, b), (cx, cy) in zip(some, middle, strict=True)):
                if d2 > far * far:
                    return None
                z = at[cell == a * wide + b, 2]
                height = z.max() - z.min()
                if height > min_height and abs(np.median(z) - (z.min() + z.max()) / 2) < 0.2 * height:
                    return cx, cy
            return None

        return _around(places, points.where(_free()), pad, column, ["x", "y", "g"], ["cx", "cy"])

    def _circles(self, points: DataFrame, found: DataFrame) -> DataFrame:
        """``px, py, r, g`` of the first cluster at seed height of each of ``found(x, y, g)`` that is a pole's."""
        radius, near, eps, least, most = self.radius, self.near, self.eps, self.min_samples, self.max_r
        low, high = self.seed_height - self.plane, self.seed_height + self.plane

        def circle(place: np.ndarray, at: np.ndarray, ids: np.ndarray) -> tuple | None:
            x, y, g = place
            own = (at[:, 2] >= g + low) & (at[:, 2] <= g + high) & ((at[:, 0] - x) ** 2 + (at[:, 1] - y) ** 2 <= radius * radius)
            at, ids = at[own], ids[own]
            rows, name, _ = C.density_clusters(at, ids, float(eps), least)
            best = None
            for k in np.unique(name):
                some = rows[name == k]
                px, py = at[some, 0].mean(), at[some, 1].mean()
                r = max(np.ptp(at[some, 0]), np.ptp(at[some, 1])) / 2
                if r <= most and (x - px) ** 2 + (y - py) ** 2 <= (r + near) ** 2 and (best is None or ids[some].min() < best[0]):
                    best = ids[some].min(), px, py, r
            return best[1:] if best else None

        return _around(found, points.where(_free()), radius, circle, ["x", "y", "g"], ["px", "py", "r"])

    def __call__(self, points: DataFrame) -> DataFrame:
        objects = _types(self.registry, self.types).select("x", "y", "ground")
        found = self._columns(points, objects).select(F.col("cx").alias("x"), F.col("cy").alias("y"), "g")
        pole = self._circles(points, found).select("px", "py", "g", (F.col("r") * self.r_mult).alias("r")).distinct()
        pole = self.scratch.table(pole, "poles")
        pole = pole.select("*", *[(F.col(c) + s * F.col("r")).alias(n) for c, s, n in (("px", -1, "x_min"), ("px", 1, "x_max"), ("py", -1, "y_min"), ("py", 1, "y_max"))])
        x, y, z = F.col("p.x"), F.col("p.y"), F.col("p.z")
        hit = spatial.points_in_shapes(points.where(_free()).select("point_id", "x", "y", "z"), pole, G.in_circle(x, y, F.col("s.px"), F.col("s.py"), F.col("s.r")) & (z <= F.col("s.g") + self.label_height), 2 * self.radius)
        return _set_ids(points, hit, self.label)


def _around(places: DataFrame, points: DataFrame, reach: float, solve: Callable, key: list[str], values: list[str]) -> DataFrame:
    """``key`` of distinct ``places(x, y, g)`` and the ``values`` that ``solve(place, xyz, ids)`` gives for the points of the square around it.

    Places and the points within ``reach`` of them go to blocks, so pairs of both are made in a task and nowhere else.
    """
    size = 4 * reach
    a = spatial.binned_points(places.select(*key).dropna().distinct(), size)
    b = points.select("point_id", *[F.col(c).cast("double").alias(c) for c in "xyz"]).dropna(subset=["x", "y", "z"])
    for c in "xy":
        b = b.withColumn(f"_b{c}", F.explode(spatial.bins_between(F.col(c) - reach, F.col(c) + reach, size)))
    b = b.join(a.select("_bx", "_by").distinct(), ["_bx", "_by"], "left_semi")

    def run(own: pa.Table, other: pa.Table) -> pa.Table:
        rows = []
        if own.num_rows and other.num_rows:
            at, ids = np.column_stack([np.asarray(other[c]) for c in "xyz"]), np.asarray(other["point_id"])
            by = np.argsort(at[:, 0], kind="stable")
            at, ids = at[by], ids[by]
            for place in np.column_stack([np.asarray(own[c]) for c in key]):
                s, e = np.searchsorted(at[:, 0], place[0] - reach), np.searchsorted(at[:, 0], place[0] + reach, "right")
                near = s + np.flatnonzero((at[s:e, 1] >= place[1] - reach) & (at[s:e, 1] <= place[1] + reach))
                got = solve(place, at[near], ids[near]) if len(near) else None
                if got is not None:
                    rows.append([*place.tolist(), *map(float, got)])
        return pa.table({c: pa.array([r[k] for r in rows], pa.float64()) for k, c in enumerate((*key, *values))})

    return a.groupBy("_bx", "_by").cogroup(b.groupBy("_bx", "_by")).applyInArrow(run, ", ".join(f"{c} double" for c in (*key, *values)))


@dataclass(frozen=True)
class Grow:
    """Points in components with enough points of ``label`` take it; of points that have a class already, those with ``over`` do."""

    scratch: Scratch
    label: int
    size: float = 0.1
    min_size: int = 50
    threshold: float = 0.1
    over: tuple[int, ...] = ()

    def __call__(self, points: DataFrame) -> DataFrame:
        free = [L.UNKNOWN, *self.over]
        return clusters.grow_by_components(points, self.label, self.size, self.min_size, self.threshold, self.scratch, F.col("label").isin(*free, self.label), F.col("label").isin(*free))


@dataclass(frozen=True)
class GrowInLayers:
    """``Grow`` in height bands above ground, one after another; see ``clusters.grow_in_layers`` for a layer's fields."""

    scratch: Scratch
    label: int
    layers: tuple[dict, ...]
    reset_noise: bool = False

    def __call__(self, points: DataFrame) -> DataFrame:
        return clusters.grow_in_layers(points, self.label, list(self.layers), self.scratch, self.reset_noise, L.NOISE)


@dataclass(frozen=True)
class Cable:
    """Overhead cables, tram cables and the lights that hang from them.

    Points in the height band and outside of buildings that lie on lines are clustered, grown, merged along catenaries and
    kept if long enough. A cable over the corridor of the tram tracks, gaps between them closed, and low
    enough is a tram cable. Without candidates nothing changes.
    """

    scratch: Scratch
    buildings: DataFrame | None = None
    tracks: DataFrame | None = None
    label: int = L.CABLE
    tram_label: int = L.TRAM_CABLE
    light_label: int = L.HANGING_LIGHT
    bottom: float = 4.5
    top: float = 12
    offset: float = 1.25
    size: float = 0.09
    radius: float = 0.5
    linear: float = 0.9
    max_tilt: float = 20
    cluster_eps: float = 0.5
    grow: float = 0.3
    min_length: float = 3
    tram_height: float = 7.5
    tram_distance: float = 2.5
    tram_gap: float = 5.6
    tram_cell: float = 0.2
    min_sag: float = 2
    light: dict = field(default_factory=lambda: {"width": (0.2, 1.0), "height": (0.15, 1.0), "offset": 0.2})
    sag_span: float = 2
    bin: float = 10

    def band(self, points: DataFrame) -> DataFrame:
        """Free points strictly inside the height band above ground, which is ``surface``, the ground without gaps, where points have it."""
        if "surface" in points.columns:
            points = points.withColumn("ground", F.coalesce("surface", "ground"))
        height = F.col("z") - F.col("ground")
        return points.where(_free() & (height > self.bottom) & (height < self.top))

    def open_air(self, points: DataFrame) -> DataFrame:
        """``band`` without points in buildings grown by ``offset``."""
        some = self.band(points)
        if self.buildings is None:
            return some
        x, y = F.col("p.x"), F.col("p.y")
        exact = G.in_rectangle(x, y, F.col("s.x_min") - self.offset, F.col("s.y_min") - self.offset, F.col("s.x_max") + self.offset, F.col("s.y_max") + self.offset) & G.near_ring(x, y, F.col("s.ring"), self.offset)
        houses = self.buildings.select("ring", "x_min", "y_min", "x_max", "y_max").distinct()
        return spatial.points_in_shapes(some, houses, exact, self.bin, "left_anti", self.offset)

    def cables(self, points: DataFrame) -> DataFrame:
        """``tile, point_id, cluster_id, x, y, z, ground`` of the points on cables."""
        some = self.scratch.table(self.open_air(points).select("tile", "point_id", "x", "y", "z", "ground"), "air")
        cells = self.scratch.table(clusters.occupied(some, self.size).select("tile", F.col("rep").alias("point_id"), "x", "y", "z", "cx", "cy", "cz"), "cells")
        shape = shapes.local_features(cells, self.radius, scratch=self.scratch)
        lines = cells.join(shape.where((F.col("linearity") > self.linear) & (F.col("vertical_angle") > 90 - self.max_tilt)), "point_id").select("tile", "cx", "cy", "cz")
        on = self.scratch.table(clusters.voxels(some, self.size).join(lines, ["tile", "cx", "cy", "cz"], "left_semi").drop("cx", "cy", "cz"), "lines")
        parts = clusters.dbscan(on, self.cluster_eps, 1, self.scratch)
        known = self.scratch.table(on.join(parts.select("point_id", "cluster_id"), "point_id"), "known")
        more = clusters.grow_by_nearest(some.join(known, "point_id", "left_anti"), known, self.grow, self.scratch)
        every = some.join(known.select("point_id", "cluster_id").unionByName(more), "point_id", "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))
        least = self.min_length

        def merged(table: pa.Table) -> pa.Table:
            table = table.sort_by("point_id")
            xyz = np.column_stack([table[c].to_numpy() for c in "xyz"]).astype(float)
            out = K.merge_cables(xyz, table["cluster_id"].to_numpy().copy())
            for k in np.unique(out[out >= 0]):
                if K.cluster_line(xyz[out == k])["length"] < least:
                    out[out == k] = -1
            keep = pa.array(np.flatnonzero(out >= 0))
            return pa.table({c: (table[c] if c != "cluster_id" else pa.array(out.astype(np.int64))).take(keep) for c in ("tile", "point_id", "cluster_id", "x", "y", "z", "ground")})

        kinds = dict(some.dtypes)
        schema = f"tile {kinds['tile']}, point_id long, cluster_id long, " + ", ".join(f"{c} {kinds[c]}" for c in ("x", "y", "z", "ground"))
        has = every.where("cluster_id >= 0").select("tile").distinct()
        return every.select("tile", "point_id", "cluster_id", "x", "y", "z", "ground").join(has, "tile", "left_semi").groupBy("tile").applyInArrow(merged, schema)

    def lights(self, cables: DataFrame, points: DataFrame) -> DataFrame:
        """``point_id`` of lights hanging from cables of more than 100 points."""
        big = cables.groupBy("tile", "cluster_id").agg(F.count("*").alias("n"), *[f("x").alias(f"x_{n}") for f, n in ((F.min, "min"), (F.max, "max"))], *[f("y").alias(f"y_{n}") for f, n in ((F.min, "min"), (F.max, "max"))]).where("n > 100").withColumnRenamed("tile", "_tile")
        exact = (F.col("p.tile") == F.col("s._tile")) & G.in_rectangle(F.col("p.x"), F.col("p.y"), F.col("s.x_min") - 1, F.col("s.y_min") - 1, F.col("s.x_max") + 1, F.col("s.y_max") + 1)
        around = spatial.points_in_shapes(self.band(points).select("tile", "point_id", "x", "y", "z"), big, exact, self.bin, "inner", 1)
        both = around.select("tile", "cluster_id", "point_id", "x", "y", "z").join(cables.select("tile", "cluster_id", "point_id", F.lit(True).alias("own")), ["tile", "cluster_id", "point_id"], "left")
        rules, min_sag, span = self.light, self.min_sag, self.sag_span

        def kernel(table: pa.Table) -> pa.Table:
            ids = table["point_id"].to_numpy()
            xyz = np.column_stack([table[c].to_numpy() for c in "xyz"]).astype(float)
            own = np.array([bool(v) for v in table["own"].to_pylist()])
            return pa.table({"point_id": pa.array(ids[hanging(xyz, own, rules, min_sag, span)].astype(np.int64))})

        return both.groupBy("tile", "cluster_id").applyInArrow(kernel, "point_id long").distinct()

    def __call__(self, points: DataFrame) -> DataFrame:
        found = self.scratch.table(self.cables(points), "cables")
        if found.isEmpty():
            return points
        tram = None
        if self.tracks is not None:
            low = shapes.heights(found, ["tile", "cluster_id"]).join(found.groupBy("tile", "cluster_id").agg(F.min(F.col("z") - F.col("ground")).alias("clear")), ["tile", "cluster_id"]).where(F.col("clear") < self.tram_height)
            lane = spatial.corridor(_segments(self.tracks), self.tram_distance, self.tram_gap / 2, self.tram_cell)
            near = found.join(lane, (spatial.bin_of(F.col("x"), self.tram_cell) == F.col("cx")) & (spatial.bin_of(F.col("y"), self.tram_cell) == F.col("cy")), "left_semi")
            tram = found.join(near.join(low, ["tile", "cluster_id"], "left_semi").select("tile", "cluster_id").distinct(), ["tile", "cluster_id"], "left_semi")
        out = _set_ids(points, found, self.label, _free())
        if tram is not None:
            out = _set_ids(out, tram, self.tram_label, F.col("label") == self.label)
        return _set_ids(out, self.lights(found, points), self.light_label, F.col("label").isin(0, self.label, self.tram_label))


def _segments(tracks: DataFrame) -> DataFrame:
    """``ax, ay, ex, ey`` of tracks that are segments, or have a ``line`` or ``ring`` of points."""
    if "ax" in tracks.columns:
        return tracks
    line = F.col("ring" if "ring" in tracks.columns else "line")
    pairs = F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line) - 1), lambda a, e: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), e["x"].alias("ex"), e["y"].alias("ey")))
    return tracks.where(F.size(line) > 1).select(F.inline(pairs))


def hanging(xyz: np.ndarray, own: np.ndarray, rules: dict, min_sag: float, span: float, voxel: float = 0.05, width: float = 0.75) -> np.ndarray:
    """Which of the points around one cable belong to a light that hangs from it.

    Points are turned into the cable's frame and voxels; slices of three voxels across are opened up, split into
    components, and those of a lamp's size, beside the axis by little, below the cable, where it sags, are kept if they
    join to a body of a lamp's plan.
    """
    out = np.zeros(len(xyz), bool)
    line = K.cluster_line(xyz[own])
    start, d = line["ends"][0][:2], line["dir"]
    t = (xyz[:, :2] - start) @ d
    s = (xyz[:, :2] - start) @ np.array([-d[1], d[0]])
    bins = np.floor((t[own] + width / 2) / width).astype(int)
    at = np.unique(bins)
    if len(at) < 3:
        return out
    mean = lambda v: np.array([v[own][bins == b].mean() for b in at])
    bt, bs, bz = mean(t), mean(s), mean(xyz[:, 2])
    side, top = np.interp(t, bt, bs), np.interp(t, bt, bz)
    near = (np.abs(s - side) <= 1) & (np.abs(xyz[:, 2] - top) <= 1) & (t >= bt[0]) & (t <= bt[-1])
    if near.sum() < 10:
        return out
    k = max(1, round(span / width))
    sag = np.full(len(at), np.inf)
    for i in range(k, len(at) - k):
        o = bz[min(i + 1, len(at) - 1)]
        u, v = np.array([-span, bz[i - k] - o]), np.array([span, bz[i + k] - o])
        sag[i] = 180 - np.degrees(np.arccos(np.clip(u @ v / np.linalg.norm(u) / np.linalg.norm(v), -1, 1)))
    cell = np.floor(np.column_stack([t, s, xyz[:, 2]])[near] / voxel).astype(int)
    low = cell.min(axis=0)
    grid = np.zeros(cell.max(axis=0) - low + 1, bool)
    grid[tuple((cell - low).T)] = True
    marked = np.zeros_like(grid)
    for x in range(0, grid.shape[0], 3):
        part = grid[x : x + 3].any(axis=0)
        tx = (low[0] + x + 1.5) * voxel
        cy, cz = np.interp(tx, bt, bs) / voxel - low[1], np.interp(tx, bt, bz) / voxel - low[2]
        if part[:, : max(0, int(cz))].sum() <= 5:
            continue
        closed = K.shifted(K.shifted(np.pad(part, 2), 2, True), 2, False)[2:-2, 2:-2]
        names = K.label_image(closed)
        for name in range(1, names.max() + 1):
            y, z = np.nonzero(names == name)
            if len(y) <= 5:
                continue
            w, h = (np.ptp(y) + 1) * voxel, (np.ptp(z) + 1) * voxel
            off, below = abs(y.mean() + 0.5 - cy) * voxel, (z.mean() + 0.5 - cz) * voxel
            bend = sag[np.abs(bt - tx).argmin()]
            if rules["width"][0] <= w < rules["width"][1] and rules["height"][0] <= h < rules["height"][1] and off < rules["offset"] and below <= max(0.1, h / 2) and bend > min_sag:
                marked[x : x + 3] |= K.shifted(names == name, 1, True)[None]
    body = K.label_image(marked & K.shifted(grid, 1, True))
    inside = body[tuple((cell - low).T)]
    index = np.flatnonzero(near)
    for name in range(1, body.max() + 1):
        x, y, _ = np.nonzero(body == name)
        if len(np.unique(np.column_stack([x, y]), axis=0)) < 2:
            continue
        _, short, long, _, _ = K.min_bounding_rectangle(np.column_stack([x, y]) * voxel)
        if short > rules["width"][0] and long < rules["width"][1]:
            out[index[inside == name]] = True
    return out


def _reads_once(stage: Stage) -> bool:
    """Whether a stage's plan has its input once, so that the next stage can go on from the plan."""
    return isinstance(stage, (BelowRoof, Footprint, Road)) or isinstance(stage, Ground) and not stage.refine


def cascade(points: DataFrame, stages: list[Stage], exclude: Iterable[int] = (), scratch: Scratch | None = None, report: list | None = None) -> DataFrame:
    """Apply the stages in order. Rows with a label in ``exclude`` bypass them and come back as they are.

    Stages that read the cloud more than once get it from a table, as plans would otherwise double with each of them; the
    tables are in ``scratch``, and each goes when the next one is written. With ``report``, a list, every stage's result is
    written and its name and the number of points that it labelled are added.
    """
    exclude = list(exclude)
    aside = points.where(F.col("label").isin(exclude)) if exclude else None
    if exclude:
        points = points.where(~F.col("label").isin(exclude))
    scratch = scratch or Scratch(points.sparkSession, "cascade")
    written, free = None, None

    def put(df: DataFrame, name: str) -> DataFrame:
        nonlocal written, free
        seen = Observation()
        out = scratch.table(df.observe(seen, F.count(F.when(_free(), 1)).alias("free")), name)
        if written is not None:
            scratch.drop(written)
        written, free = out, seen.get["free"]
        return out

    if report is not None:
        points = put(points, "start")
    for stage in stages:
        if not _reads_once(stage) and points is not written:
            points = put(points, "before")
        points = stage(points)
        if report is not None:
            before = free
            points = put(points, type(stage).__name__.lower())
            report.append((type(stage).__name__, before - free))
    return points.unionByName(aside) if aside is not None else points
