"""From folders of scans and elevation to labelled scans: what a user runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import label_table
from ..functions.tiles import TILE_SIZE
from ..operators import rasters, shapes, stages
from ..sources import files
from .scratch import Scratch
from .ship import ship


def _corner(code: Column, part: int, size: int = TILE_SIZE) -> Column:
    return F.split(code, "_")[part].cast("long") * size


def global_ids(points: DataFrame) -> DataFrame:
    """``tilecode, point_id`` of files as one id for all tiles; ``tile`` is the code as a number."""
    tile = F.replace("tilecode", F.lit("_"), F.lit("")).cast("long")
    return points.withColumn("tile", tile).withColumn("file_id", F.col("point_id")).withColumn("point_id", tile * (1 << 35) + F.col("point_id"))


def with_elevation(points: DataFrame, elevation: DataFrame, cell: float = 0.1, tile_size: int = TILE_SIZE) -> DataFrame:
    """Add ``ground`` and ``building``, and ``surface`` if there, of each point's cell in its tile's raster; null where there is none.

    Cells are numbered from the tile's upper left corner. Points on a tile's far edges belong to its last cells, points
    beyond it to none.
    """
    n = round(tile_size / cell)

    def index(distance: Column) -> Column:
        i = F.floor(F.round(distance / cell, 6)).cast("int")
        return F.when((i >= 0) & (i <= n), F.least(i, F.lit(n - 1)))

    ix = index(F.col("x") - _corner(F.col("tilecode"), 0, tile_size))
    iy = index(_corner(F.col("tilecode"), 1, tile_size) + tile_size - F.col("y"))
    raster = elevation.select("tilecode", F.col("ix").alias("_ix"), F.col("iy").alias("_iy"), *[c for c in ("ground", "building", "surface") if c in elevation.columns])
    return points.withColumn("_ix", ix).withColumn("_iy", iy).join(raster, ["tilecode", "_ix", "_iy"], "left").drop("_ix", "_iy")


def tile_cells(tiles: DataFrame, cell: float = 0.1, tile_size: int = TILE_SIZE) -> DataFrame:
    """``tilecode, ix, iy, x, y``: all cells of the tiles with their centres."""
    n = round(tile_size / cell)
    out = tiles.select("tilecode").distinct().withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("iy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    x = _corner(F.col("tilecode"), 0, tile_size) + (F.col("ix") + 0.5) * cell
    return out.select("tilecode", "ix", "iy", x.alias("x"), (_corner(F.col("tilecode"), 1, tile_size) + tile_size - (F.col("iy") + 0.5) * cell).alias("y"))


def build_elevation(cloud: DataFrame, tiles: DataFrame, cell: float = 0.1, ground_class: int = 2, building_class: int = 6, ground_radius: float = 1.0, building_radius: float = 0.5) -> DataFrame:
    """``tilecode, ix, iy, ground, building`` from a classified cloud ``(id, x, y, z, classification)``.

    Samples beyond a tile's edge count for its cells, so no clipping with a margin is needed. Values are rounded to
    centimetres; a cell without a sample in reach is null.
    """
    cells, keys = tile_cells(tiles, cell), ("tilecode", "ix", "iy")
    own = lambda code: cloud.where(F.col("classification") == code).select("id", "x", "y", F.col("z").alias("value"))
    ground = rasters.idw(cells, own(ground_class), ground_radius, keys=keys).withColumnRenamed("value", "ground")
    building = rasters.highest(cells, own(building_class), building_radius, keys=keys).withColumnRenamed("value", "building")
    out = cells.select(*keys).join(ground, list(keys), "left").join(building, list(keys), "left")
    return out.select(*keys, F.round("ground", 2).alias("ground"), F.round("building", 2).alias("building"))


def label_cloud(points: DataFrame, elevation: DataFrame, steps: list[stages.Stage], exclude: tuple[int, ...] = (), cell: float = 0.1) -> DataFrame:
    """A cloud ``(tilecode, point_id, x, y, z, label)`` labelled by the stages, with its own ids.

    Cables need ground without gaps, so it is filled if they are among the stages and ``elevation`` has no ``surface``.
    """
    if "surface" not in elevation.columns and any(isinstance(s, stages.Cable) for s in steps):
        elevation = rasters.fill_ground(elevation, Scratch(elevation.sparkSession, "surface"), artifact="artifact" if "artifact" in elevation.columns else None, tile="tilecode")
    some = global_ids(points).withColumn("label", F.col("label").cast("int"))
    done = stages.cascade(with_elevation(some, elevation, cell), steps, exclude)
    return done.withColumn("point_id", F.col("file_id")).select(*points.columns)


def label_folder(spark: SparkSession, source: str, target: str, elevation: DataFrame, make: Callable[[SparkSession], list[stages.Stage]], prefix: str = "", out_prefix: str = "processed_", out_suffix: str = "", resume: bool = False) -> DataFrame:
    """Label the scans of a folder, write them to another, and return the class statistics of all that is there.

    ``target`` has to differ from ``source``, whose files are still being read, and be mounted on all executors. With
    ``resume``, tiles that ``target`` has already aren't read again.
    """
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("the target can't be the folder that is read")
    ship(spark)
    own = f"{out_prefix}*{out_suffix}.las"
    points = files.read_las(spark, source, f"{prefix}*.la[sz]", files.tiles_of_folder(spark, target, own) if resume else None)
    done = label_cloud(points, elevation, make(spark))
    files.save_las(done, target, out_prefix, out_suffix)
    return shapes.label_statistics(files.read_las(spark, target, own).withColumn("label", F.col("label").cast("int")), label_table(spark))


def prepare_folder(spark: SparkSession, cloud: DataFrame, tiles: DataFrame, target: str, resume: bool = False, clips: bool = False, margin: float = 1.0, cell: float = 0.1, tile_size: int = TILE_SIZE, **surfaces) -> DataFrame:
    """Elevation archives ``ahn_<tile>.npz`` of ``tiles(tilecode)`` from a classified cloud, and the tiles that were made.

    ``cloud(id, x, y, z, classification)``; ``surfaces`` go to ``build_elevation``. With ``resume``, tiles that ``target``
    has already are left out; with ``clips``, each tile's part of the cloud with a ``margin`` is written beside it.
    """
    ship(spark)
    todo = tiles.select("tilecode").distinct()
    if resume:
        todo = todo.join(files.tiles_of_folder(spark, target, "ahn_*.npz"), "tilecode", "left_anti")
    todo = Scratch(spark, "prepare").table(todo, "todo")
    if clips:
        part = rasters.clip_tiles(cloud.withColumn("point_id", F.col("id")).withColumn("label", F.col("classification")), tile_size, margin)
        part = part.withColumn("tilecode", F.concat_ws("_", *[F.lpad(F.col(c).cast("string"), 4, "0") for c in ("tx", "ty")])).join(F.broadcast(todo), "tilecode", "left_semi")
        files.save_las(part, target, "ahn_")
    made = build_elevation(cloud, todo, cell, **surfaces).join(tile_cells(todo, cell, tile_size), ["tilecode", "ix", "iy"])
    files.save_npz(made, target)
    return todo
