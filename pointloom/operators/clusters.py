"""Grid components, DBSCAN and growing of labels over clouds ``(tile, point_id, x, y, z, …)``.

Components are named by their smallest point_id. Clusters end at tile borders, so a tile whose cells or points fit one
task is solved there, after one exchange; larger ones take part in an iteration over edges, which gives the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells as C
from ..plans.scratch import Scratch
from . import near
from .graph import connected_components
from .spatial import bin_of, neighbours


#: Occupied cells, and points for density clusters, of a tile that one task solves; some 100 bytes each.
TILE_CELLS, TILE_POINTS = 4_000_000, 2_000_000


def octree_level(extent: Column, grid_size: float) -> Column:
    """Subdivisions of a cube that bring its cells nearest to ``grid_size``: at least 1, and 0 for no extent."""
    return F.when(extent < 0.001, 0).otherwise(F.greatest(F.lit(1), F.rint(F.log2(extent / F.lit(float(grid_size)))).cast("int")))


def voxels(points: DataFrame, size, dims: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Add the cell of each point as ``c<dim>``."""
    for d in dims:
        points = points.withColumn(f"c{d}", bin_of(F.col(d), size))
    return points


def occupied(points: DataFrame, size, dims: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Occupied cells with their centres and numbers of points."""
    cells = voxels(points, size, dims).groupBy("tile", *[f"c{d}" for d in dims]).agg(F.count("*").alias("n"), F.min("point_id").alias("rep"))
    for d in dims:
        cells = cells.withColumn(d, (F.col(f"c{d}") + 0.5) * size)
    return cells


def _by_size(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of tiles of at most ``most`` rows, and those of larger ones; none if there are none."""
    size = rows.groupBy("tile").agg(F.count("*").alias("_n"))
    if (size.agg(F.max("_n")).first()[0] or 0) <= most:
        return rows, None
    large = size.where(F.col("_n") > most).select(F.col("tile").alias("_tile"))
    same = F.col("tile").eqNullSafe(F.col("_tile"))
    return rows.join(large, same, "left_anti"), rows.join(large, same, "left_semi")


def grid_components(points: DataFrame, size, scratch: Scratch, dims: tuple[str, ...] = ("x", "y", "z"), full: bool = True) -> DataFrame:
    """``point_id, component_id, size``: points whose cells touch, over any chain of occupied cells, are one component.

    Cells touch by faces, edges and corners, or by faces only if not ``full``. Points are first reduced to occupied cells;
    only cells are searched, so a tile takes what its extent allows however dense the cloud is. Points without a
    coordinate are in no component.
    """
    c = [f"c{d}" for d in dims]
    own = voxels(points.dropna(subset=list(dims)), size, dims).select("tile", "point_id", *c)
    cells = scratch.table(own.groupBy("tile", *c).agg(F.min("point_id").alias("rep"), F.count("*").alias("n")), "cells")

    def solve(table: pa.Table) -> pa.Table:
        rep, n = np.asarray(table["rep"]), np.asarray(table["n"])
        low = C.touching(np.column_stack([np.asarray(table[k]) for k in c]), full)
        least = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(least, low, rep)
        total = np.bincount(low, n, len(rep)).astype(np.int64)
        return table.select(["tile", *c]).append_column("component_id", pa.array(least[low])).append_column("size", pa.array(total[low]))

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema.fields if f.name not in ("rep", "n")) + ", component_id long, size long"
    small, large = _by_size(cells, TILE_CELLS)
    named = small.groupBy("tile").applyInArrow(solve, kind)
    if large is not None:
        step = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for v, k in zip(s, c, strict=True)]) for s in C.steps(len(dims), full=full)]))
        moved = large.withColumn("_s", step).select("tile", F.col("rep").alias("u"), *[(F.col(k) + F.col(f"_s.{k}")).alias(k) for k in c])
        root = connected_components(moved.join(large.withColumnRenamed("rep", "v"), ["tile", *c]).select("u", "v"), scratch)
        rest = large.join(root, F.col("rep") == F.col("node"), "left").withColumn("component_id", F.coalesce("root", "rep"))
        total = rest.groupBy("component_id").agg(F.sum("n").alias("size"))
        named = named.unionByName(rest.join(total, "component_id").select("tile", *c, "component_id", "size"))
    return own.join(named, ["tile", *c]).select("point_id", "component_id", "size")


def dbscan(points: DataFrame, eps, min_points: int, scratch: Scratch, dims: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """``point_id, cluster_id, core`` of the points in clusters; noise has no row.

    A core point has ``min_points`` points within ``eps``, itself among them; core points within ``eps`` are one cluster,
    named by its smallest core point. Any other point within ``eps`` of a core point joins the cluster with the smallest name.
    """
    some = points.select("tile", "point_id", *dims).dropna(subset=list(dims))

    def solve(table: pa.Table) -> pa.Table:
        ids = np.asarray(table["point_id"])
        at, name, core = C.density_clusters(np.column_stack([np.asarray(table[d], dtype=float) for d in dims]), ids, float(eps), min_points)
        return pa.table({"point_id": pa.array(ids[at]), "cluster_id": pa.array(name), "core": pa.array(core)})

    small, large = _by_size(some, TILE_POINTS)
    found = small.groupBy("tile").applyInArrow(solve, "point_id long, cluster_id long, core boolean")
    return found if large is None else found.unionByName(_dbscan_by_pairs(large, eps, min_points, scratch, dims))


def _dbscan_by_pairs(points: DataFrame, eps, min_points: int, scratch: Scratch, dims: tuple[str, ...]) -> DataFrame:
    """``dbscan`` for tiles that no task holds: over the pairs of points within ``eps``."""
    pairs = neighbours(points, points, eps, dims, extra=F.col("l.tile").eqNullSafe(F.col("r.tile")))
    pairs = scratch.table(pairs.select(F.col("l.point_id").alias("u"), F.col("r.point_id").alias("v")), "pairs")
    core = scratch.table(pairs.groupBy("u").count().where(F.col("count") >= min_points).select("u"), "core")
    reach = pairs.join(core, "u")
    edges = reach.join(core.withColumnRenamed("u", "v"), "v", "left_semi").where("u < v").select("u", "v")
    root = connected_components(edges, scratch)
    named = core.join(root, F.col("u") == F.col("node"), "left").select("u", F.coalesce("root", "u").alias("cluster_id"))
    every = pairs.join(named, "u").groupBy("v").agg(F.min("cluster_id").alias("any_id"))
    out = every.join(named.withColumnRenamed("u", "v").withColumnRenamed("cluster_id", "own_id"), "v", "left")
    return out.select(F.col("v").alias("point_id"), F.coalesce("own_id", "any_id").alias("cluster_id"), F.col("own_id").isNotNull().alias("core"))


def grow_by_components(points: DataFrame, label: int, size, min_size: int, threshold: float, scratch: Scratch, candidates: Column | None = None, write: Column | None = None) -> DataFrame:
    """Points in components with enough points of ``label`` take that label.

    Components are made of the rows where ``candidates`` holds (unlabelled and ``label`` itself by default). One is grown if
    it has ``min_size`` points and more than ``threshold`` of them have ``label``; only rows where ``write`` holds change.
    """
    mask = F.col("label").isin(0, label) if candidates is None else candidates
    some = points.where(mask)
    parts = grid_components(some, size, scratch).where(F.col("size") >= min_size)
    seeds = parts.join(some.select("point_id", (F.col("label") == label).cast("int").alias("_seed")), "point_id").groupBy("component_id").agg((F.sum("_seed") / F.count("*")).alias("_share"))
    grown = parts.join(seeds.where(F.col("_share") > threshold), "component_id").select("point_id", F.lit(True).alias("_grown"))
    out = points.join(grown, "point_id", "left")
    change = F.col("_grown") & (F.lit(True) if write is None else write)
    return out.withColumn("label", F.when(change, F.lit(label)).otherwise(F.col("label")).cast("int")).drop("_grown")


def grow_in_layers(points: DataFrame, label: int, layers: list[dict], scratch: Scratch, reset_noise: bool = False, noise: int = 99) -> DataFrame:
    """Grow ``label`` in height bands above ``ground``, one after another: ``bottom < z - ground <= top``.

    A layer has ``bottom, top, size, min_size, threshold``. Points without a ground value are in no band. Grown points are
    seeds of later layers. With ``reset_noise`` noise points take part and may change.
    """
    free = [0, noise] if reset_noise else [0]
    for layer in layers:
        height = F.col("z") - F.col("ground")
        band = F.lit(True)
        if layer.get("bottom") is not None:
            band = band & (height > layer["bottom"])
        if layer.get("top") is not None:
            band = band & (height <= layer["top"])
        band = F.coalesce(band & F.col("ground").isNotNull(), F.lit(False))
        points = scratch.table(grow_by_components(points, label, layer["size"], layer["min_size"], layer["threshold"], scratch, band & F.col("label").isin(*free, label), F.col("label").isin(*free)), "layer")
    return points


def reach_from_seeds(edges: DataFrame, seeds: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes of directed ``edges(u, v)`` that ``seeds(node)`` reach, the seeds included; one round a step, until none is new."""
    edges = scratch.table(edges.select("u", "v").distinct(), "reach-edges")
    seen = scratch.table(seeds.select("node").distinct(), "seen")
    front = seen
    while True:
        after = scratch.table(edges.join(front, F.col("u") == F.col("node"), "left_semi").select(F.col("v").alias("node")).distinct().join(seen, "node", "left_anti"), "front")
        if after.isEmpty():
            return seen
        more = scratch.table(seen.unionByName(after), "seen")
        scratch.drop(seen, front)
        seen, front = more, after


def grow_by_nearest(free: DataFrame, seeds: DataFrame, radius, scratch: Scratch | None = None) -> DataFrame:
    """Each free point within ``radius`` of a seed takes the nearest seed's cluster: ``point_id, cluster_id``."""
    own = free.select("tile", "point_id", "x", "y", "z")
    others = seeds.select(F.col("tile").alias("seed_tile"), F.col("point_id").alias("seed_id"), "x", "y", "z", "cluster_id")
    finish, schema = near.pairs(["point_id"], "seed_id", ("x", "y", "z"), ("cluster_id",), own, others)
    scratch = scratch or Scratch(free.sparkSession, "nearest")
    return near.nearest(own, others, ["point_id"], "seed_id", radius, 1, scratch, ("x", "y", "z"), finish, schema, ("tile", "seed_tile")).select("point_id", "cluster_id")
