"""Scan and raster files. All are read through Spark's ``binaryFile``, so from any store, and in parallel over files."""

from __future__ import annotations

import io
import os
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tiles import tilecode_of_path

# Bytes of the point formats of LAS before extra bytes.
POINT_BYTES = {0: 20, 1: 28, 2: 26, 3: 34, 6: 30, 7: 36, 8: 38}
#: Points that leave a task at once.
BATCH = 200_000


def _head(data: bytes) -> dict:
    """Layout of a LAS file, from its header and records: first point, format, bytes and number of points, scale, offset, place of ``label``."""
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    head, begin, n_records = struct.unpack_from("<HII", data, 94)
    kind, size, n = struct.unpack_from("<BHI", data, 104)
    if data[25] >= 4 and n == 0:
        n = struct.unpack_from("<Q", data, 247)[0]
    out = {"begin": begin, "kind": kind & 0x3F, "packed": bool(kind & 0x80), "size": size, "n": n, "label": None, "record": b""}
    out |= {"scale": np.array(struct.unpack_from("<3d", data, 131)), "offset": np.array(struct.unpack_from("<3d", data, 155))}
    at, extra = head, POINT_BYTES[out["kind"]]
    for _ in range(n_records):
        user, number, length = data[at + 2 : at + 18].rstrip(b"\0"), *struct.unpack_from("<HH", data, at + 18)
        if user == b"LASF_Spec" and number == 4:
            for k in range(at + 54, at + 54 + length, 192):
                width = {1: 1, 2: 1, 3: 2, 4: 2, 5: 4, 6: 4, 7: 8, 8: 8, 9: 4, 10: 8}.get(data[k + 2], 0)
                if data[k + 4 : k + 36].rstrip(b"\0") == b"label" and width == 1:
                    out["label"] = extra
                extra += width
        if user == b"laszip encoded" and number == 22204:
            out["record"] = data[at + 54 : at + 54 + length]
        at += 54 + length
    return out


def _unpacked(data: bytes, head: dict) -> bytes:
    """Points of a compressed file, by the codec if it is installed."""
    try:
        import lazrs
    except ImportError:
        raise ValueError("compressed points need the codec lazrs, which isn't installed") from None
    source = io.BytesIO(data)
    source.seek(head["begin"])
    out = bytearray(head["n"] * head["size"])
    lazrs.LasZipDecompressor(source, head["record"]).decompress_many(out)
    return bytes(out)


def _points(data: bytes, head: dict) -> dict[str, np.ndarray]:
    """Columns of uncompressed points."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, head["size"])
    xyz = rows[:, :12].copy().view("<i4").astype(float) * head["scale"] + head["offset"]
    modern = head["kind"] >= 6
    out = {"x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "classification": rows[:, 16 if modern else 15] & (0xFF if modern else 0x1F)}
    return out | ({"label": rows[:, head["label"]].copy()} if head["label"] is not None else {})


def parse_las(data: bytes) -> dict[str, np.ndarray]:
    """Coordinates, classification and, if there is such an extra byte, ``label`` of a LAS 1.2 to 1.4 file.

    Compressed files need the codec ``lazrs``.
    """
    head = _head(data)
    return _points(_unpacked(data, head) if head["packed"] else data[head["begin"] : head["begin"] + head["n"] * head["size"]], head)


def make_las(x: np.ndarray, y: np.ndarray, z: np.ndarray, label: np.ndarray, scale: float = 0.001) -> bytes:
    """An uncompressed LAS 1.2 file, point format 0 with an extra byte ``label``."""
    n = len(x)
    xyz = np.column_stack([x, y, z]).astype(float).reshape(n, 3)
    low = np.floor(xyz.min(axis=0)) if n else np.zeros(3)
    high = xyz.max(axis=0) if n else np.zeros(3)
    field = struct.pack("<HBB32s", 0, 1, 0, b"label").ljust(192, b"\0")
    record = struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, len(field), b"extra bytes") + field
    begin = 227 + len(record)
    head = struct.pack("<4sHHIHH8sBB32s32sHHHIIBHI", b"LASF", 0, 0, 0, 0, 0, b"", 1, 2, b"", b"pointloom", 1, 2024, 227, begin, 1, 0, 21, n) + struct.pack("<5I", n, 0, 0, 0, 0)
    head += struct.pack("<12d", scale, scale, scale, *low, high[0], low[0], high[1], low[1], high[2], low[2])
    rows = np.zeros((n, 21), np.uint8)
    rows[:, :12] = np.round((xyz - low) / scale).astype("<i4").view(np.uint8).reshape(n, 12)
    rows[:, 20] = label
    return head + record + rows.tobytes()


_CLOUD = "tilecode string, point_id long, x double, y double, z double, classification short, label short"


def _batches(tile: str, got: dict[str, np.ndarray], first: int = 0) -> Iterator[pa.RecordBatch]:
    n = len(got["x"])
    label = got.get("label", np.zeros(n, np.uint8))
    for a in range(0, n, BATCH):
        s = slice(a, min(n, a + BATCH))
        yield pa.RecordBatch.from_arrays([pa.array([tile] * (s.stop - a), pa.string()), pa.array(np.arange(first + a, first + s.stop)), *[pa.array(got[c][s].copy()) for c in "xyz"], pa.array(got["classification"][s].astype(np.int16)), pa.array(label[s].astype(np.int16))], ["tilecode", "point_id", "x", "y", "z", "classification", "label"])


def _files(spark: SparkSession, path: str, glob: str, skip: DataFrame | None) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).withColumn("tilecode", tilecode_of_path(F.col("path")))
    return files if skip is None else files.join(F.broadcast(skip.select("tilecode").distinct()), "tilecode", "left_anti")


def read_las(spark: SparkSession, path: str, glob: str = "*.la[sz]", skip: DataFrame | None = None) -> DataFrame:
    """``tilecode, point_id, x, y, z, classification, label``; ``point_id`` is the place in the file, label 0 if it has none.

    A file is read whole, from any store that Spark reaches; files of tiles in ``skip(tilecode)`` aren't read. Larger files
    than a row can hold, 2 GB, are for ``read_las_ranges``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, content in zip(batch.column("tilecode"), batch.column("content"), strict=True):
                yield from _batches(tile.as_py(), parse_las(content.as_py()))

    return _files(spark, path, glob, skip).select("tilecode", "content").mapInArrow(run, _CLOUD)


def read_las_ranges(spark: SparkSession, path: str, glob: str = "*.las", points: int = 4_000_000, skip: DataFrame | None = None) -> DataFrame:
    """What ``read_las`` gives, by ranges of ``points`` points, so that a file of any size is read by many tasks.

    Headers are read first, by a task for each file, then ranges. Files are opened by Arrow, so their store has to be one of
    its own (mounted folders, HDFS, S3, GCS); compressed files can't be cut and are for ``read_las``.
    """
    from pyarrow import fs

    def opened(path: str):
        store, name = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
        return store.open_input_file(name)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, path in zip(batch.column("tilecode").to_pylist(), batch.column("path").to_pylist(), strict=True):
                with opened(path) as f:
                    begin = struct.unpack_from("<I", f.read_at(104, 0), 96)[0]
                    head = _head(f.read_at(max(375, begin), 0))
                if head["packed"]:
                    raise ValueError(f"{path} is compressed")
                at = list(range(0, head["n"], points))
                yield pa.RecordBatch.from_arrays([pa.array([tile] * len(at), pa.string()), pa.array([path] * len(at), pa.string()), pa.array(at, pa.int64())], ["tilecode", "path", "first"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, path, first in zip(*(batch.column(c).to_pylist() for c in ("tilecode", "path", "first")), strict=True):
                with opened(path) as f:
                    begin = struct.unpack_from("<I", f.read_at(104, 0), 96)[0]
                    head = _head(f.read_at(max(375, begin), 0))
                    n = min(points, head["n"] - first)
                    data = f.read_at(n * head["size"], head["begin"] + first * head["size"])
                yield from _batches(tile, _points(data, head), first)

    ranges = _files(spark, path, glob, skip).select("tilecode", "path").mapInArrow(plan, "tilecode string, path string, first long")
    return ranges.repartition("path", "first").mapInArrow(read, _CLOUD)


def as_las(points: DataFrame) -> DataFrame:
    """``tilecode, content``: one LAS file a tile, points in the order of their ids."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("point_id")
        return pa.table({"tilecode": [key[0].as_py()], "content": pa.array([make_las(*(table[c].to_numpy() for c in ("x", "y", "z", "label")))], pa.binary())})

    return points.select("tilecode", "point_id", "x", "y", "z", "label").groupBy("tilecode").applyInArrow(run, "tilecode string, content binary")


def save_las(points: DataFrame, folder: str, prefix: str = "processed_", suffix: str = "") -> None:
    """Write LAS files to a folder that all executors have mounted; a file appears whole or not at all."""

    as_las(points).foreachPartition(lambda rows: [put_file(folder, f"{prefix}{r.tilecode}{suffix}.las", r.content) for r in rows] and None)


def save_labels(points: DataFrame, path: str) -> int:
    """Write a labelled cloud by tile, and fail if rows got lost; the input path can't be the output path."""
    want = points.count()
    points.write.mode("errorifexists").partitionBy("tilecode").parquet(path)
    got = points.sparkSession.read.parquet(path).count()
    if got != want:
        raise RuntimeError(f"{path} has {got} rows of {want}")
    return got


def read_npz(spark: SparkSession, path: str, glob: str = "*.npz") -> DataFrame:
    """Elevation archives with ``x, y, ground, building`` as ``tilecode, ix, iy, x, y, ground, building``; NaN becomes null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, content in zip(batch.column("tilecode"), batch.column("content"), strict=True):
                data = np.load(io.BytesIO(content.as_py()))
                x, y, ground, building = (data[c].astype(float) for c in ("x", "y", "ground", "building"))
                iy, ix = (a.ravel() for a in np.indices(ground.shape))
                value = lambda a: pa.array(a.ravel(), mask=np.isnan(a.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([tile.as_py()] * len(ix)), pa.array(ix.astype(np.int32)), pa.array(iy.astype(np.int32)), pa.array(x[ix]), pa.array(y[iy]), value(ground), value(building)], ["tilecode", "ix", "iy", "x", "y", "ground", "building"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(tilecode_of_path(F.col("path")).alias("tilecode"), "content").mapInArrow(run, "tilecode string, ix int, iy int, x double, y double, ground double, building double")


def save_npz(elevation: DataFrame, folder: str, prefix: str = "ahn_") -> None:
    """Write ``tilecode, ix, iy, x, y, ground, building`` as one archive a tile to a mounted folder, as ``read_npz`` reads it.

    ``iy`` counts downwards, so ``y`` descends; surfaces are rounded to centimetres in 16 bits, and a missing cell is NaN.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ix, iy = (np.asarray(table[c]) for c in ("ix", "iy"))
        shape = (iy.max() + 1, ix.max() + 1)
        out: dict[str, np.ndarray] = {}
        for c, at, n in (("x", ix, shape[1]), ("y", iy, shape[0])):
            out[c] = np.full(n, np.nan)
            out[c][at] = np.asarray(table[c], dtype=float)
        for c in ("ground", "building"):
            out[c] = np.full(shape, np.nan, np.float16)
            out[c][iy, ix] = np.round(table[c].to_numpy().astype(float), 2)
        data = io.BytesIO()
        np.savez_compressed(data, **out)
        return pa.table({"tilecode": [key[0].as_py()], "content": pa.array([data.getvalue()], pa.binary())})

    files = elevation.select("tilecode", "ix", "iy", "x", "y", "ground", "building").groupBy("tilecode").applyInArrow(run, "tilecode string, content binary")
    files.foreachPartition(lambda rows: [put_file(folder, f"{prefix}{r.tilecode}.npz", r.content) for r in rows] and None)


def put_file(folder: str, name: str, content: bytes) -> None:
    """Write a file that appears whole or not at all."""
    with tempfile.NamedTemporaryFile(dir=folder, delete=False) as f:
        f.write(content)
    os.replace(f.name, os.path.join(folder, name))


def tiles_of_folder(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """``tilecode`` of the files of a folder, each once; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(tilecode_of_path(F.col("path")).alias("tilecode")).distinct()
