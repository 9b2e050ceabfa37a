"""Tile codes ``NNNN_NNNN``, a tile's lower left corner in units of its size, and their bounding boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE_SIZE = 50


def tilecode_of_path(path: Column) -> Column:
    """The last ``dddd_dddd`` in a path; a path without one raises."""
    code = F.regexp_extract(path, r".*(\d{4}_\d{4}).*", 1)
    return F.when(code == "", F.raise_error(F.concat(F.lit("no tile code in "), path)).cast("string")).otherwise(code)


def box_of_tile(code: Column, padding: int | float = 0, width: int = TILE_SIZE, height: int = TILE_SIZE) -> Column:
    """``struct(x_min, y_max, x_max, y_min)`` of a tile, grown by ``padding``."""
    part = F.split(code, "_")
    x, y = part[0].cast("long") * width, part[1].cast("long") * height
    return F.struct((x - padding).alias("x_min"), (y + height + padding).alias("y_max"), (x + width + padding).alias("x_max"), (y - padding).alias("y_min"))


def polygon_of_tile(code: Column, padding: int | float = 0) -> Column:
    """The tile's closed ring of corners."""
    box = box_of_tile(code, padding)
    corner = lambda x, y: F.struct(box[x].alias("x"), box[y].alias("y"))
    return F.array(corner("x_min", "y_max"), corner("x_max", "y_max"), corner("x_max", "y_min"), corner("x_min", "y_min"), corner("x_min", "y_max"))


def tile_of_point(x: Column, y: Column, size: int = TILE_SIZE) -> Column:
    """The code of the tile that a point lies in."""
    return F.format_string("%04d_%04d", F.floor(x / size).cast("long"), F.floor(y / size).cast("long"))


def distinct_tilecodes(files: DataFrame, path: str = "path") -> DataFrame:
    return files.select(tilecode_of_path(F.col(path)).alias("tilecode")).distinct()


def box_of_tiles(tiles: DataFrame, code: str = "tilecode", padding: int | float = 0) -> DataFrame:
    """One row: the box around all tiles."""
    box = box_of_tile(F.col(code), padding)
    return tiles.select(box.alias("b")).agg(F.min("b.x_min").alias("x_min"), F.max("b.y_max").alias("y_max"), F.max("b.x_max").alias("x_max"), F.min("b.y_min").alias("y_min"))
