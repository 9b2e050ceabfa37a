"""Elevation rasters in long form ``(ix, iy, value columns)``; a missing cell is null or has no row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from .graph import connected_components
from .spatial import nearest, nearest_of_tile


@dataclass(frozen=True)
class Grid:
    """``nx`` by ``ny`` square cells; ``ix`` counts from the left edge, ``iy`` from the upper edge."""

    x_min: float
    y_max: float
    size: float
    nx: int
    ny: int

    def ix(self, x: Column) -> Column:
        """Column of the grid; the far edge belongs to the last one, beyond the grid it is null."""
        i = F.floor((x - self.x_min) / self.size).cast("int")
        return F.when((x >= self.x_min) & (x <= self.x_min + self.nx * self.size), F.least(i, F.lit(self.nx - 1)))

    def iy(self, y: Column) -> Column:
        i = F.floor((self.y_max - y) / self.size).cast("int")
        return F.when((y <= self.y_max) & (y >= self.y_max - self.ny * self.size), F.least(i, F.lit(self.ny - 1)))

    def cells(self, spark) -> DataFrame:
        """All cells with their centres."""
        n = spark.range(self.nx * self.ny)
        out = n.select((F.col("id") % self.nx).cast("int").alias("ix"), F.expr(f"cast(id div {self.nx} as int)").alias("iy"))
        half = self.size / 2
        half = int(half) if half == int(half) else half
        return out.select("ix", "iy", (self.x_min + F.col("ix") * self.size + half).alias("x"), (self.y_max - F.col("iy") * self.size - half).alias("y"))


def lookup(points: DataFrame, raster: DataFrame, grid: Grid, values: list[str]) -> DataFrame:
    """Add the values of the cell that each point lies in; null outside of the grid and for missing cells.

    Points keep all their columns. The raster is one row a cell, so the join is an equi-join on the cell.
    """
    cell = raster.select(F.col("ix").alias("_ix"), F.col("iy").alias("_iy"), *values)
    return points.join(cell, (grid.ix(F.col("x")) == F.col("_ix")) & (grid.iy(F.col("y")) == F.col("_iy")), "left").drop("_ix", "_iy")


def window(raster: DataFrame, ix_from: int, ix_to: int, iy_from: int, iy_to: int, value: str = "ground", too_high: float = 1e5, fill: float | None = None) -> DataFrame:
    """Cells of a range of rows and columns, the ends excluded; values above ``too_high`` become ``fill``."""
    part = raster.where(F.col("ix").between(ix_from, ix_to - 1) & F.col("iy").between(iy_from, iy_to - 1))
    kind = raster.schema[value].dataType
    return part.withColumn(value, F.when(F.col(value) > too_high, F.lit(fill).cast(kind)).otherwise(F.col(value)))


def file_of_tile(index: DataFrame, box: dict[str, Column]) -> DataFrame:
    """The first raster file, by ``Xmin, Ymax``, that holds a tile's whole box."""
    inside = (F.col("Xmin") <= box["x_min"]) & (F.col("Xmax") >= box["x_max"]) & (F.col("Ymin") <= box["y_min"]) & (F.col("Ymax") >= box["y_max"])
    return index.where(inside).orderBy("Xmin", "Ymax", "Filename").limit(1)


def idw(cells: DataFrame, samples: DataFrame, radius, k: int = 8, power: float = 2, reg: float = 0, near: float = 1e-12, keys: tuple[str, ...] = ("ix", "iy"), weight: str | None = None) -> DataFrame:
    """Inverse-distance-weighted value of ``samples(id, x, y, value)`` at each cell; cells without a sample have no row.

    The ``k`` nearest samples within ``radius`` count with ``1 / (d ** power + reg)``, times their column ``weight`` if it is
    named; one at most ``near`` away decides. A cell whose weights don't add up to more than 0 is null.
    """
    found = nearest(cells, samples, list(keys), "id", radius, k, keep=("value", *([weight] if weight else [])))
    d = F.sqrt(F.col("d2").cast("double"))
    w = 1 / (F.pow(d, F.lit(float(power))) + reg)
    if weight:
        w = w * F.col(weight)
    on_sample = F.min_by("value", F.struct("d2", "id"))
    total = F.sum(F.when(d > near, w))
    mean = F.when(total > 0, F.sum(F.when(d > near, w * F.col("value"))) / total)
    return found.groupBy(*keys).agg(F.when(F.min(d) <= near, on_sample.cast("double")).otherwise(mean).alias("value"))


def highest(cells: DataFrame, samples: DataFrame, radius, k: int = 8, keys: tuple[str, ...] = ("ix", "iy")) -> DataFrame:
    """The largest value of the ``k`` nearest samples within ``radius`` of each cell."""
    return nearest(cells, samples, list(keys), "id", radius, k, keep=("value",)).groupBy(*keys).agg(F.max("value").alias("value"))


def nearest_value(cells: DataFrame, samples: DataFrame, radius, keys: tuple[str, ...] = ("ix", "iy")) -> DataFrame:
    return nearest(cells, samples, list(keys), "id", radius, 1, keep=("value",)).select(*keys, "value")


def build_surface(cells: DataFrame, cloud: DataFrame, ground_class: int = 2, building_class: int = 6, ground_radius=100, building_radius=50, k: int = 8) -> DataFrame:
    """``ix, iy, ground, building`` from a classified cloud ``(id, x, y, z, classification)``.

    Ground by inverse distance, building by the highest neighbour. A class of fewer than two points gives no surface.
    """
    out = cells.select("ix", "iy")
    for name, code, radius, make in (("ground", ground_class, ground_radius, idw), ("building", building_class, building_radius, highest)):
        own = cloud.where(F.col("classification") == code).select("id", "x", "y", F.col("z").alias("value"))
        enough = own.limit(2).count() > 1
        value = make(cells, own if enough else own.where(F.lit(False)), radius, k).select("ix", "iy", F.col("value").cast("double").alias(name))
        out = out.join(value, ["ix", "iy"], "left")
    return out


def clip_tiles(points: DataFrame, size, buffer) -> DataFrame:
    """Each point once for every tile whose box, grown by ``buffer``, holds it, with ``tx`` and ``ty`` of the tile."""
    # a tile t holds x if t * size - buffer <= x <= (t + 1) * size + buffer
    def tiles(v: str) -> Column:
        return F.sequence(F.ceil((F.col(v) - buffer) / size).cast("long") - 1, F.floor((F.col(v) + buffer) / size).cast("long"))

    return points.withColumn("tx", F.explode(tiles("x"))).withColumn("ty", F.explode(tiles("y")))


def gaps(missing: DataFrame, scratch: Scratch, nx: int, max_cells: int = 50) -> DataFrame:
    """4-connected groups of missing cells ``(ix, iy)``: ``ix, iy, gap, cells, fill`` with ``gap`` the smallest ``iy * nx + ix``.

    ``fill`` says whether the group is small enough to be filled.
    """
    cell = missing.select("ix", "iy", (F.col("iy").cast("long") * nx + F.col("ix")).alias("c"))
    steps = F.array(F.struct(F.lit(1).alias("dx"), F.lit(0).alias("dy")), F.struct(F.lit(0).alias("dx"), F.lit(1).alias("dy")))
    moved = cell.select("c", F.explode(steps).alias("s"), "ix", "iy").select("c", (F.col("ix") + F.col("s.dx")).alias("ix"), (F.col("iy") + F.col("s.dy")).alias("iy"))
    edges = moved.join(cell.withColumnRenamed("c", "d"), ["ix", "iy"]).select(F.col("c").alias("u"), F.col("d").alias("v"))
    root = connected_components(edges, scratch)
    named = cell.join(root, cell.c == root.node, "left").select("ix", "iy", F.coalesce("root", "c").alias("gap"))
    size = named.groupBy("gap").agg(F.count("*").alias("cells"))
    return named.join(size, "gap").select("ix", "iy", "gap", "cells", (F.col("cells") <= max_cells).alias("fill"))


def fill_gaps(raster: DataFrame, scratch: Scratch, grid: Grid, value: str = "ground", max_cells: int = 50, reach: int = 4) -> DataFrame:
    """``raster`` with small gaps filled by inverse distance to the known cells within ``reach`` cells.

    Cells that have none there take those within ``max_cells``, which is as far as a known cell can be from a gap's.
    """
    small = gaps(raster.where(F.col(value).isNull()), scratch, grid.nx, max_cells).where("fill").select("ix", "iy", F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"))
    known = raster.where(F.col(value).isNotNull()).select((F.col("iy").cast("long") * grid.nx + F.col("ix")).alias("id"), F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"), F.col(value).alias("value"))
    small = scratch.table(small, "small")
    found = scratch.table(idw(small, known, reach).select("ix", "iy", "value"), "filled")
    rest = small.join(found, ["ix", "iy"], "left_anti")
    found = found.unionByName(idw(rest, known, max_cells).select("ix", "iy", "value")).withColumnRenamed("value", "_filled")
    out = raster.join(found, ["ix", "iy"], "left")
    return out.withColumn(value, F.coalesce(F.col(value).cast("double"), "_filled")).drop("_filled")


def coalesce_surface(raster: DataFrame, first: str, second: str, name: str) -> DataFrame:
    return raster.withColumn(name, F.coalesce(first, second))


def fill_ground(raster: DataFrame, scratch: Scratch, value: str = "ground", artifact: str | None = None, tile: str | None = None, name: str = "surface") -> DataFrame:
    """Add ``name``: ``value`` with all gaps filled, by the ``artifact`` surface, then linearly, then by the nearest cell.

    Linear is between the known cells at both ends of a gap in its row and in its column, the mean of both weighted by the
    inverse of their distance. Cells that have none on both sides take the nearest one's value; a tile without known cells
    keeps its nulls. Missing cells need a row.
    """
    keys = ["ix", "iy", *([tile] if tile else [])]
    start = F.col(value).cast("double") if artifact is None else F.coalesce(value, artifact).cast("double")
    sides, span = [], []
    for along, across in (("ix", "iy"), ("iy", "ix")):
        w = Window.partitionBy(*keys[2:], across).orderBy(along)
        at = F.when(F.col("_v").isNotNull(), F.struct(F.col(along).cast("double").alias("at"), F.col("_v").alias("v")))
        low = F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        high = F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing))
        sides.append((low, high, along))
    cells = raster.select(*keys, start.alias("_v"))
    for k, (low, high, along) in enumerate(sides):
        cells = cells.withColumn("_low", low).withColumn("_high", high)
        wide = F.col("_high.at") - F.col("_low.at")
        line = F.col("_low.v") + (F.col("_high.v") - F.col("_low.v")) * (F.col(along) - F.col("_low.at")) / wide
        cells = cells.withColumn(f"_line{k}", F.when(wide > 0, line)).withColumn(f"_w{k}", F.when(wide > 0, 1 / wide)).drop("_low", "_high")
        span.append(F.coalesce(F.col(f"_line{k}") * F.col(f"_w{k}"), F.lit(0.0)))
    weight = F.coalesce("_w0", F.lit(0.0)) + F.coalesce("_w1", F.lit(0.0))
    cells = scratch.table(cells.select(*keys, F.coalesce("_v", F.when(weight > 0, (span[0] + span[1]) / weight)).alias("_v")), "lines")
    place = [F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y")]
    left = cells.where("_v is null").select(*keys, *place)
    known = cells.where("_v is not null").select(F.struct("iy", "ix").alias("id"), *place, F.col("_v").alias("_near"), *([F.col(tile).alias("_other_tile")] if tile else []))
    near = nearest_of_tile(left, known, keys, "id", 4, 1, scratch, (tile, "_other_tile") if tile else None, keep=("_near",)).select(*keys, "_near")
    full = cells.join(near, keys, "left").select(*keys, F.coalesce("_v", "_near").alias(name))
    return raster.join(full, keys, "left")


def smooth_edges(raster: DataFrame, value: str = "ground", thickness: int = 1) -> DataFrame:
    """Cells within ``thickness`` steps of a missing one, themselves known, take the mean of the known cells of their 3 x 3.

    Distance counts along rows and columns, as a cross-shaped dilation does.
    """
    near = [(dx, dy) for dx in range(-thickness, thickness + 1) for dy in range(-thickness, thickness + 1) if 0 < abs(dx) + abs(dy) <= thickness]

    def moved(df: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
        s = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps])
        return df.withColumn("_s", F.explode(s)).withColumn("ix", F.col("ix") + F.col("_s.dx")).withColumn("iy", F.col("iy") + F.col("_s.dy")).drop("_s")

    edge = moved(raster.where(F.col(value).isNull()).select("ix", "iy"), near).distinct()
    edge = raster.where(F.col(value).isNotNull()).select("ix", "iy").join(edge, ["ix", "iy"], "left_semi")
    around = moved(raster.where(F.col(value).isNotNull()).select("ix", "iy", F.col(value).alias("_v")), [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    mean = around.join(edge, ["ix", "iy"], "left_semi").groupBy("ix", "iy").agg(F.avg("_v").alias("_mean"))
    return raster.join(mean, ["ix", "iy"], "left").withColumn(value, F.coalesce("_mean", F.col(value).cast("double"))).drop("_mean")
