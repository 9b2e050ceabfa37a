"""Registry files: CSV with a fixed schema, and saved GeoJSON answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import box_of_ring, clipped_segment

POINTS = "type string, x double, y double"
POLYGONS = "type string, polygon string, x_min double, y_max double, x_max double, y_min double"
LINES = "type string, linestring string, x_min double, y_max double, x_max double, y_min double"


def read_csv(spark: SparkSession, path: str, schema: str, prefix: str = "") -> DataFrame:
    """A file, or all CSV files of a folder whose names begin with ``prefix``; the header is skipped, columns go by place."""
    options = {"header": "true", "enforceSchema": "true", "escape": '"'}
    reader = spark.read.schema(schema).options(**options)
    return (reader.option("pathGlobFilter", f"{prefix}*.csv") if prefix else reader).csv(path)


def ring_of_string(text: Column) -> Column:
    """``[[x, y], …]`` as an array of ``struct<x, y>``."""
    return F.transform(F.from_json(text, "array<array<double>>"), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def with_rings(polygons: DataFrame) -> DataFrame:
    return polygons.withColumn("ring", ring_of_string(F.col("polygon")))


def points_in_tile(registry: DataFrame, box: dict, include: list[str] | None = None, exclude: list[str] | None = None, padding=0) -> DataFrame:
    """Registry points in a tile, its edges included."""
    out = registry.where(F.col("x").between(box["x_min"] - padding, box["x_max"] + padding) & F.col("y").between(box["y_min"] - padding, box["y_max"] + padding))
    if include:
        out = out.where(F.col("type").isin(include))
    return out.where(~F.col("type").isin(exclude)) if exclude else out


def areas_in_tile(registry: DataFrame, box: dict, include: list[str] | None = None, exclude: list[str] | None = None, padding=0) -> DataFrame:
    """Registry polygons or lines whose boxes share more than an edge with a tile."""
    out = registry.where((F.col("x_min") < box["x_max"] + padding) & (F.col("x_max") > box["x_min"] - padding) & (F.col("y_min") < box["y_max"] + padding) & (F.col("y_max") > box["y_min"] - padding))
    if include:
        out = out.where(F.col("type").isin(include))
    return out.where(~F.col("type").isin(exclude)) if exclude else out


def lines_in_tile(registry: DataFrame, box: dict, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Segments ``ax, ay, ex, ey`` that cross a tile, with the share of each that lies in it as ``t0, t1``."""
    some = areas_in_tile(registry, box, include, exclude)
    part = clipped_segment(F.col("ax"), F.col("ay"), F.col("ex"), F.col("ey"), {k: F.lit(v) for k, v in box.items()})
    return some.withColumn("_part", part).where("_part is not null").select(*registry.columns, F.col("_part.t0").alias("t0"), F.col("_part.t1").alias("t1"))


def grown(areas: DataFrame, offset) -> DataFrame:
    """Registry polygons with their boxes grown and ``offset`` beside them, for ``geometry.near_ring`` or a stage's own offset.

    Membership in a polygon grown by a distance, and in several of them, needs neither a grown ring nor a merged one.
    """
    sides = {"x_min": -1, "y_min": -1, "x_max": 1, "y_max": 1}
    return areas.withColumns({c: F.col(c) + sign * offset for c, sign in sides.items()} | {"offset": F.lit(offset)})


def type_of_layer(name: Column) -> Column:
    """A layer's name without its first two parts."""
    parts = F.split(name, "_")
    return F.concat_ws("_", F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))))


_FEATURE = "struct<id: string, properties: struct<plus_type: string, function: string>, geometry: struct<type: string, coordinates: {}>>"


def parse_polygons(text: DataFrame, keep_holes: bool = True) -> DataFrame:
    """``json, layer`` to ``feature_id, type, rings, x_min, …``; without ``keep_holes`` only outer rings."""
    kind = f"struct<features: array<{_FEATURE.format('array<array<array<double>>>')}>>"
    out = text.select(type_of_layer(F.col("layer")).alias("type"), F.explode(F.from_json("json", kind)["features"]).alias("f"))
    ring = lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    rings = F.transform(F.col("f.geometry.coordinates"), ring)
    out = out.select(F.col("f.id").alias("feature_id"), "type", (rings if keep_holes else F.slice(rings, 1, 1)).alias("rings"))
    return out.select("*", box_of_ring(F.get("rings", 0)).alias("b")).select("feature_id", "type", "rings", "b.*")


def parse_lines(text: DataFrame) -> DataFrame:
    kind = f"struct<features: array<{_FEATURE.format('array<array<double>>')}>>"
    out = text.select(type_of_layer(F.col("layer")).alias("type"), F.explode(F.from_json("json", kind)["features"]).alias("f"))
    line = F.transform(F.col("f.geometry.coordinates"), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return out.select(F.col("f.id").alias("feature_id"), "type", line.alias("line")).select("*", box_of_ring(F.col("line")).alias("b")).select("feature_id", "type", "line", "b.*")


def parse_points(text: DataFrame) -> DataFrame:
    """Points take their type from the feature."""
    kind = f"struct<features: array<{_FEATURE.format('array<double>')}>>"
    out = text.select(F.explode(F.from_json("json", kind)["features"]).alias("f"))
    c = F.col("f.geometry.coordinates")
    return out.select(F.coalesce("f.properties.plus_type", "f.properties.function").alias("type"), F.get(c, 0).alias("x"), F.get(c, 1).alias("y"))


def parse_signs(text: DataFrame, box: dict) -> DataFrame:
    """Traffic signs strictly inside a box."""
    kind = "array<struct<location: struct<rd: struct<x: string, y: string>>>>"
    out = text.select(F.explode(F.from_json("json", kind)).alias("s")).select(F.lit("verkeersbord").alias("type"), F.col("s.location.rd.x").cast("double").alias("x"), F.col("s.location.rd.y").cast("double").alias("y"))
    return out.where((F.col("x") > box["x_min"]) & (F.col("x") < box["x_max"]) & (F.col("y") > box["y_min"]) & (F.col("y") < box["y_max"]))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", "true").option("escape", '"').csv(path)


def pole_columns(objects: DataFrame, step: float) -> DataFrame:
    """Each ``object_id, x0, y0, z0, x1, y1, z1, label`` as a column of points from one end to the other.

    There are ``(z1 - z0) div step`` points, the ends among them; a single point stands at the lower end.
    """
    n = F.floor((F.col("z1") - F.col("z0")) / step).cast("int")
    out = objects.withColumn("_n", n).where("_n > 0").withColumn("k", F.explode(F.expr("sequence(0, _n - 1)")))
    share = F.when(F.col("_n") > 1, F.col("k") / (F.col("_n") - 1)).otherwise(0.0)
    return out.select("object_id", "k", *[(F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * share).alias(c) for c in "xyz"], "label")
