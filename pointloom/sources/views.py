"""Clouds, registries and rasters made of relational tables, in whole centimetres, so that results can be compared exactly."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rasters import Grid, lookup

GRID = Grid(0, 10_000, 100, 100, 100)
OBJECT_TYPES = ["boom", "lichtmast", "verkeersbord"]
AREA_TYPES = ["pand", "rijbaan_lokale_weg", "fietspad", "voetpad"]
CLASSES = [1, 2, 2, 6, 9]
CODES = [0, 1, 9, 10, 30, 40, 60]


class Tables:
    """The derived tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def cloud(self) -> DataFrame:
        """Every event as a point of a 100 m square of four tiles."""
        out = self.read("events").selectExpr(
            "event_id as point_id", "(event_id * 7919 + user_id * 31) % 10000 as x", "(event_id * 6271 + user_id * 17) % 10000 as y", "(event_id * 104729) % 1500 as z", "user_id as cluster_id"
        )
        codes, classes = F.array(*map(F.lit, CODES)), F.array(*map(F.lit, CLASSES))
        tile = F.expr("(x div 5000) * 10 + y div 5000")
        return out.withColumn("tile", tile).withColumn("code", F.get(codes, (F.col("point_id") % len(CODES)).cast("int"))).withColumn("classification", F.get(classes, (F.col("point_id") % len(CLASSES)).cast("int")))

    @cached_property
    def raster(self) -> DataFrame:
        cells = GRID.cells(self.spark)
        ground = F.when((F.col("ix") + F.col("iy")) % 23 != 0, (F.col("ix") * 37 + F.col("iy") * 17) % 60)
        building = F.when((F.col("ix") * 7 + F.col("iy") * 3) % 5 == 0, 300 + (F.col("ix") * 11 + F.col("iy") * 13) % 600)
        return cells.select("ix", "iy", "x", "y", ground.cast("long").alias("ground"), building.cast("long").alias("building"))

    @cached_property
    def points(self) -> DataFrame:
        """The cloud, unlabelled, with both elevations."""
        some = self.cloud.select("tile", "point_id", "x", "y", "z", F.lit(0).alias("label"))
        return lookup(some, self.raster, GRID, ["ground", "building"])

    @cached_property
    def objects(self) -> DataFrame:
        """Every supplier as a registry point."""
        out = self.read("supplier").selectExpr("s_suppkey as object_id", "(s_suppkey * 997) % 10000 as x", "(s_suppkey * 3571) % 10000 as y")
        return out.withColumn("type", F.get(F.array(*map(F.lit, OBJECT_TYPES)), (F.col("object_id") % 3).cast("int")))

    @cached_property
    def lines(self) -> DataFrame:
        """A segment from every supplier's point."""
        out = self.objects.withColumn("ex", F.expr("x + (object_id * 37) % 2000 - 1000")).withColumn("ey", F.expr("y + (object_id * 53) % 2000 - 1000"))
        return out.selectExpr("object_id as line_id", "x as ax", "y as ay", "ex", "ey", "least(x, ex) as x_min", "greatest(x, ex) as x_max", "least(y, ey) as y_min", "greatest(y, ey) as y_max")

    @cached_property
    def footprints(self) -> DataFrame:
        """Every part as a square registry polygon."""
        out = self.read("part").selectExpr("p_partkey as footprint_id", "(p_partkey * 4987) % 10000 as cx", "(p_partkey * 7417) % 10000 as cy", "50 + p_size * 5 as h")
        out = out.withColumn("type", F.get(F.array(*map(F.lit, AREA_TYPES)), (F.col("footprint_id") % 4).cast("int")))
        out = out.selectExpr("footprint_id", "type", "cx - h as x_min", "cy + h as y_max", "cx + h as x_max", "cy - h as y_min")
        corner = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
        return out.withColumn("ring", F.array(corner("x_min", "y_min"), corner("x_max", "y_min"), corner("x_max", "y_max"), corner("x_min", "y_max"), corner("x_min", "y_min")))
