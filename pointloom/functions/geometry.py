"""Geometry as column expressions; exact on integer coordinates.

A ring is an array of ``struct<x, y>`` whose last point repeats the first. Bounds are closed unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_rectangle(x, y, x_min, y_min, x_max, y_max) -> Column:
    return x.between(x_min, x_max) & y.between(y_min, y_max)


def in_box(x, y, z, x_min, y_min, x_max, y_max, bottom, top) -> Column:
    return in_rectangle(x, y, x_min, y_min, x_max, y_max) & z.between(bottom, top)


def in_circle(x, y, cx, cy, r) -> Column:
    return (x - cx) * (x - cx) + (y - cy) * (y - cy) <= r * r


def in_cylinder(x, y, z, cx, cy, r, bottom, top) -> Column:
    return in_circle(x, y, cx, cy, r) & z.between(bottom, top)


def ring_of(points: list[tuple[float, float]]) -> Column:
    """A literal ring, closed if it isn't."""
    if points and points[0] != points[-1]:
        points = [*points, points[0]]
    return F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in points])


def edges_of(ring: Column) -> Column:
    """``struct(a, b)`` of neighbouring points; none for fewer than two points."""
    pairs = F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.when(F.size(ring) >= 2, pairs).otherwise(F.slice(pairs, 1, 0))


def _cross(a, b, x, y) -> Column:
    return (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])


def on_ring(x: Column, y: Column, ring: Column) -> Column:
    def touches(e):
        a, b = e["a"], e["b"]
        return (_cross(a, b, x, y) == 0) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    return F.exists(edges_of(ring), touches)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is inside a ring or on it; false for rings of fewer than three points."""

    def crosses(n, e):
        a, b = e["a"], e["b"]
        up, down = (a["y"] <= y) & (b["y"] > y), (b["y"] <= y) & (a["y"] > y)
        side = _cross(a, b, x, y)
        return n + F.when((up & (side > 0)) | (down & (side < 0)), 1).otherwise(0)

    inside = F.aggregate(edges_of(ring), F.lit(0), crosses) % 2 == 1
    return (F.size(ring) >= 4) & (on_ring(x, y, ring) | inside)


def in_polygon(x: Column, y: Column, rings: Column) -> Column:
    """Whether a point is in the first ring and in none of the others, whose edges count as holes."""
    holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
    return in_ring(x, y, rings[0]) & ~F.exists(holes, lambda h: in_ring(x, y, h))


def box_of_ring(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x_min"), F.array_max(ys).alias("y_max"), F.array_max(xs).alias("x_max"), F.array_min(ys).alias("y_min"))


def boxes_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two boxes share more than an edge."""
    return (a["x_min"] < b["x_max"]) & (a["x_max"] > b["x_min"]) & (a["y_min"] < b["y_max"]) & (a["y_max"] > b["y_min"])


def segment_distance2(x, y, ax, ay, bx, by) -> Column:
    """Squared distance of a point to a segment, as a double."""
    dx, dy = (bx - ax).cast("double"), (by - ay).cast("double")
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / length)))
    ex, ey = x - (ax + t * dx), y - (ay + t * dy)
    return ex * ex + ey * ey


def near_ring(x: Column, y: Column, ring: Column, distance) -> Column:
    """Whether a point is in a ring grown by ``distance``: inside it, or that near to an edge."""
    d2 = distance * distance
    return in_ring(x, y, ring) | F.exists(edges_of(ring), lambda e: segment_distance2(x, y, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]) <= d2)


def clipped_segment(ax, ay, bx, by, box: dict[str, Column]) -> Column:
    """The share ``struct(t0, t1)`` of a segment that lies in a box; null if none does."""
    dx, dy = (bx - ax).cast("double"), (by - ay).cast("double")
    low, high, ok = F.lit(0.0), F.lit(1.0), F.lit(True)
    for p, q in ((-dx, ax - box["x_min"]), (dx, box["x_max"] - ax), (-dy, ay - box["y_min"]), (dy, box["y_max"] - ay)):
        q = q.cast("double")
        ratio = q / F.when(p != 0, p)
        ok = ok & ~((p == 0) & (q < 0))
        low = F.when(p < 0, F.greatest(low, ratio)).otherwise(low)
        high = F.when(p > 0, F.least(high, ratio)).otherwise(high)
    return F.when(ok & (low <= high), F.struct(low.alias("t0"), high.alias("t1")))


def overlap_area(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Shared area of two boxes."""
    wide = F.least(a["x_max"], b["x_max"]) - F.greatest(a["x_min"], b["x_min"])
    high = F.least(a["y_max"], b["y_max"]) - F.greatest(a["y_min"], b["y_min"])
    return F.greatest(wide, F.lit(0)) * F.greatest(high, F.lit(0))


def ring_area(ring: Column) -> Column:
    """Area of a ring by the shoelace sum."""
    return F.abs(F.aggregate(edges_of(ring), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]).cast("double"))) / 2


def vector_angle(u: Column, v: Column | None = None) -> Column:
    """Degrees between two vectors given as arrays, or between one and the z-axis."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, p: s + p)
    other = F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)) if v is None else v
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, other) / F.sqrt(dot(u, u) * dot(other, other))))))


def cable_frame(x, y, x0, y0, dx, dy) -> Column:
    """``struct(along, across)`` of a point in the frame that starts at (x0, y0) and runs along (dx, dy)."""
    angle = F.atan2(dy, dx)
    a, b = x - x0, y - y0
    return F.struct((a * F.cos(angle) + b * F.sin(angle)).alias("along"), (b * F.cos(angle) - a * F.sin(angle)).alias("across"))
