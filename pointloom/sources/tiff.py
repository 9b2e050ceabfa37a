"""GeoTIFF pixels: tags, strips and tiles, and only those that a window touches."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tiles import TILE_SIZE
from ..operators.spatial import bin_of, bins_between

# Field types (code and bytes) and the tags that are used, by the format's definition.
_KINDS = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_SIZE, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES, FORMAT, PIXEL_SCALE, TIE_POINT, NO_DATA = 322, 323, 324, 325, 339, 33550, 33922, 42113


def tags_of(data: bytes) -> tuple[str, dict[int, tuple]] | None:
    """Byte order and tags of a TIFF's first image; none for other files."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        return None
    at = struct.unpack_from(order + "I", data, 4)[0]
    tags = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        code, width = _KINDS.get(kind, ("B", 1))
        where = at + 10 + 12 * k if n * width <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
        tags[tag] = (data[where : where + n],) if code == "c" else struct.unpack_from(f"{order}{n}{code}", data, where)
    return order, tags


def bounds_of(data: bytes) -> dict | None:
    """Size, pixel size and bounds of a GeoTIFF, from its tags; none for other files."""
    found = tags_of(data)
    if found is None or PIXEL_SCALE not in found[1] or TIE_POINT not in found[1]:
        return None
    tags = found[1]
    wide, high, sx, sy = tags[WIDTH][0], tags[HEIGHT][0], *tags[PIXEL_SCALE][:2]
    tie = tags[TIE_POINT]
    x, y = tie[3] - tie[0] * sx, tie[4] + tie[1] * sy
    return {"width": wide, "height": high, "res": sx, "Xmin": x, "Ymax": y, "Xmax": x + wide * sx, "Ymin": y - high * sy}


def unpack_lzw(data: bytes) -> bytes:
    """The format's variant of LZW: codes of 9 to 12 bits, highest first, one earlier than the table asks for."""
    clear, end = 256, 257
    table: list[bytes] = []
    out, last, width, bits, held = [], b"", 9, 0, 0
    for byte in data:
        bits, held = (bits << 8) | byte, held + 8
        if held < width:
            continue
        held -= width
        code, bits = bits >> held, bits & ((1 << held) - 1)
        if code == end:
            break
        if code == clear:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            raise ValueError("LZW data begins with a clear code")
        if code < len(table):
            word = table[code]
        elif code == len(table) and last:
            word = last + last[:1]
        else:
            raise ValueError("LZW code out of order")
        out.append(word)
        if last:
            table.append(last + word[:1])
        last = word
        width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return b"".join(out)


def _block(data: bytes, order: str, tags: dict, wide: int, high: int) -> np.ndarray:
    """Pixels of one strip or tile."""
    way = tags.get(COMPRESSION, (1,))[0]
    if way in (8, 32946):
        data = zlib.decompress(data)
    elif way == 5:
        data = unpack_lzw(data)
    elif way != 1:
        raise ValueError(f"compression {way} isn't supported")
    bits, kind, predictor = tags.get(BITS, (1,))[0], tags.get(FORMAT, (1,))[0], tags.get(PREDICTOR, (1,))[0]
    if tags.get(SAMPLES, (1,))[0] != 1 or bits % 8 or kind not in (1, 2, 3):
        raise ValueError("elevation has one whole-byte sample a pixel")
    size = bits // 8
    raw = np.frombuffer(data, np.uint8, wide * high * size)
    if predictor == 3:  # bytes of a row's floats, highest first, as differences
        rows = np.cumsum(raw.reshape(high, wide * size), axis=1, dtype=np.uint8).reshape(high, size, wide)
        return np.ascontiguousarray(rows.transpose(0, 2, 1)).view(f">f{size}").reshape(high, wide).astype(float)
    if predictor == 2:  # differences of whole samples, whatever they mean
        raw = np.cumsum(raw.view(f"{order}u{size}").reshape(high, wide), axis=1, dtype=f"u{size}").astype(f"{order}u{size}")
    return raw.view(f"{order}{'uif'[kind - 1]}{size}").reshape(high, wide).astype(float)


def pixels(data: bytes, x_from: int, x_to: int, y_from: int, y_to: int) -> np.ndarray:
    """Columns ``x_from`` to ``x_to`` and rows ``y_from`` to ``y_to`` (excluded) of an image; no-data pixels are NaN."""
    found = tags_of(data)
    if found is None:
        raise ValueError("not a TIFF")
    order, tags = found
    width, height = tags[WIDTH][0], tags[HEIGHT][0]
    x_from, x_to, y_from, y_to = max(0, x_from), min(width, x_to), max(0, y_from), min(height, y_to)
    out = np.full((max(0, y_to - y_from), max(0, x_to - x_from)), np.nan)
    tiled = TILE_AT in tags
    bw, bh = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(height, tags.get(STRIP_ROWS, (height,))[0]))
    at, size = (tags[TILE_AT], tags[TILE_BYTES]) if tiled else (tags[STRIP_AT], tags[STRIP_SIZE])
    across = -(-width // bw)
    if not out.size:
        return out
    for by in range(y_from // bh, (y_to - 1) // bh + 1):
        for bx in range(x_from // bw, (x_to - 1) // bw + 1):
            k = by * across + bx
            rows = bh if tiled else min(bh, height - by * bh)
            block = _block(data[at[k] : at[k] + size[k]], order, tags, bw, rows)
            left, top = max(x_from, bx * bw), max(y_from, by * bh)
            right, low = min(x_to, bx * bw + bw), min(y_to, by * bh + rows)
            out[top - y_from : low - y_from, left - x_from : right - x_from] = block[top - by * bh : low - by * bh, left - bx * bw : right - bx * bw]
    if NO_DATA in tags:
        out[out == float(tags[NO_DATA][0].rstrip(b"\0 ") or b"nan")] = np.nan
    return out


def tiff_index(spark: SparkSession, path: str, glob: str = "M_*.TIF", res: float = 0.5) -> DataFrame:
    """``Filename, Xmin, Ymax, Xmax, Ymin`` of the GeoTIFFs of a folder with the given pixel size, by ``Xmin, Ymax``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p.as_py(), b) for p, c in zip(batch.column("path"), batch.column("content"), strict=True) if (b := bounds_of(c.as_py())) and b["res"] == res]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), *[pa.array([b[c] for _, b in found], pa.float64()) for c in ("Xmin", "Ymax", "Xmax", "Ymin")]], ["Filename", "Xmin", "Ymax", "Xmax", "Ymin"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInArrow(run, "Filename string, Xmin double, Ymax double, Xmax double, Ymin double").orderBy("Xmin", "Ymax")


def file_of_each(tiles: DataFrame, index: DataFrame, tile_size: int = TILE_SIZE) -> DataFrame:
    """``tilecode, x_min, y_min, Filename``: the first file, by ``Xmin, Ymax``, that holds each tile's whole box; none, no row.

    Files are dealt over bins of ten tiles, so tiles meet the few files around them.
    """
    bin = 10 * tile_size
    x, y = (F.split("tilecode", "_")[k].cast("long") * tile_size for k in (0, 1))
    own = tiles.select("tilecode").distinct().select("tilecode", x.alias("x_min"), y.alias("y_min"))
    own = own.withColumn("_bx", bin_of(F.col("x_min"), bin)).withColumn("_by", bin_of(F.col("y_min"), bin))
    files = index.withColumn("_bx", F.explode(bins_between(F.col("Xmin"), F.col("Xmax"), bin))).withColumn("_by", F.explode(bins_between(F.col("Ymin"), F.col("Ymax"), bin)))
    inside = (F.col("Xmin") <= F.col("x_min")) & (F.col("Xmax") >= F.col("x_min") + tile_size) & (F.col("Ymin") <= F.col("y_min")) & (F.col("Ymax") >= F.col("y_min") + tile_size)
    first = F.row_number().over(Window.partitionBy("tilecode").orderBy("Xmin", "Ymax", "Filename"))
    return own.join(files, ["_bx", "_by"]).where(inside).withColumn("_k", first).where("_k = 1").select("tilecode", "x_min", "y_min", "Filename")


def read_tiff_tiles(spark: SparkSession, path: str, tiles: DataFrame, glob: str = "M_*.TIF", res: float = 0.5, too_high: float = 1e5, tile_size: int = TILE_SIZE) -> DataFrame:
    """``tilecode, ix, iy, x, y, ground``: the pixels of each tile of ``tiles(tilecode)`` that a file holds whole.

    Cells are numbered from the tile's upper left corner and have the file's pixel size; values above ``too_high`` and
    no-data pixels are null. A tile that no file holds has no row. A file is decoded where its tiles are.
    """
    asked = file_of_each(tiles, tiff_index(spark, path, glob, res), tile_size).groupBy("Filename").agg(F.collect_list(F.struct("tilecode", "x_min", "y_min")).alias("tiles"))
    names = ["tilecode", "ix", "iy", "x", "y", "ground"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, own in zip(batch.column("content"), batch.column("tiles"), strict=True):
                data = content.as_py()
                b = bounds_of(data)
                n = round(tile_size / res)
                for tile in own.as_py():
                    left, top = int((tile["x_min"] - b["Xmin"]) / res), int((b["Ymax"] - tile["y_min"] - tile_size) / res)
                    value = pixels(data, left, left + n, top, top + n)
                    value[value > too_high] = np.nan
                    iy, ix = (a.ravel() for a in np.indices(value.shape))
                    x, y = b["Xmin"] + (left + ix + 0.5) * res, b["Ymax"] - (top + iy + 0.5) * res
                    yield pa.RecordBatch.from_arrays([pa.array([tile["tilecode"]] * len(ix), pa.string()), pa.array(ix.astype(np.int32)), pa.array(iy.astype(np.int32)), pa.array(x), pa.array(y), pa.array(value.ravel(), mask=np.isnan(value.ravel()))], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.col("path").alias("Filename"), "content")
    return files.join(asked, "Filename").select("content", "tiles").mapInArrow(run, "tilecode string, ix int, iy int, x double, y double, ground double")
