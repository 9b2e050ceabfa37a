"""Spatial joins as equi-joins on grid bins.

A join on geometry alone becomes a nested loop. Here both sides get the number of the bin they fall in, the side with an
extent one row for each bin it touches, and the exact test stays as a residual condition. Bins of about the size of the
extents or the search radius keep the copies few. No side is forced into a broadcast; adaptive execution decides by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import boxes_overlap, overlap_area, segment_distance2
from ..plans.scratch import Scratch


def bin_of(value: Column, size) -> Column:
    return F.floor(value / size).cast("long")


def bins_between(low: Column, high: Column, size) -> Column:
    return F.sequence(bin_of(low, size), bin_of(high, size))


def binned_points(points: DataFrame, size, x: str = "x", y: str = "y") -> DataFrame:
    return points.withColumn("_bx", bin_of(F.col(x), size)).withColumn("_by", bin_of(F.col(y), size))


def binned_boxes(shapes: DataFrame, size, grow=0) -> DataFrame:
    """One row of ``shapes(x_min, y_min, x_max, y_max, …)`` for each bin that the box, grown by ``grow``, touches."""
    across = shapes.withColumn("_bx", F.explode(bins_between(F.col("x_min") - grow, F.col("x_max") + grow, size)))
    return across.withColumn("_by", F.explode(bins_between(F.col("y_min") - grow, F.col("y_max") + grow, size)))


def points_in_shapes(points: DataFrame, shapes: DataFrame, exact: Column, size, how: str = "left_semi", grow=0) -> DataFrame:
    """Points that some shape holds (``left_semi``), that none does (``left_anti``), or pairs (``inner``).

    ``exact`` refers to columns of ``points`` by ``p.`` and of ``shapes`` by ``s.``. A point without a coordinate is in no
    shape.
    """
    a, b = binned_points(points, size).alias("p"), binned_boxes(shapes, size, grow).alias("s")
    on = (F.col("p._bx") == F.col("s._bx")) & (F.col("p._by") == F.col("s._by")) & exact
    out = a.join(b, on, how)
    return out.drop("_bx", "_by")


def held_by(shapes: DataFrame, exact: Column, size, grow=0, x: str = "x", y: str = "y") -> Column:
    """Whether some shape holds a row of the frame that this column is added to, as an existence join that reads the frame once.

    ``exact`` refers to columns of that frame by ``F.col(…).outer()`` and of ``shapes`` by their names, which the frame
    must not have. A row without a coordinate is in no shape.
    """
    boxes = binned_boxes(shapes.distinct(), size, grow)  # a shape that comes again holds nothing more
    own = (F.col("_bx") == bin_of(F.col(x).outer(), size)) & (F.col("_by") == bin_of(F.col(y).outer(), size))
    return boxes.where(own & exact).exists()


def corridor(segments: DataFrame, distance, close, cell) -> DataFrame:
    """Cells ``cx, cy`` within ``distance`` of ``segments(ax, ay, ex, ey)``, and those of gaps between them up to ``2 * close`` wide.

    Cells around the segments are grown by both distances and shrunk by ``close``: one goes if a cell outside lies within
    ``close`` of it, by their centres.
    """
    wide = distance + close
    boxes = segments.select("ax", "ay", "ex", "ey", F.least("ax", "ex").alias("x_min"), F.greatest("ax", "ex").alias("x_max"), F.least("ay", "ey").alias("y_min"), F.greatest("ay", "ey").alias("y_max"))
    x, y = ((F.col(c) + 0.5) * cell for c in ("_bx", "_by"))
    grown = binned_boxes(boxes, cell, wide).where(segment_distance2(x, y, F.col("ax"), F.col("ay"), F.col("ex"), F.col("ey")) <= wide * wide)
    grown = grown.select(F.col("_bx").alias("cx"), F.col("_by").alias("cy")).distinct()
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    rim = grown.withColumn("s", F.explode(steps)).select((F.col("cx") + F.col("s.a")).alias("cx"), (F.col("cy") + F.col("s.b")).alias("cy")).distinct().join(grown, ["cx", "cy"], "left_anti")
    centre = lambda df: df.withColumn("x", (F.col("cx") + 0.5) * cell).withColumn("y", (F.col("cy") + 0.5) * cell)
    edge = neighbours(centre(grown), centre(rim).select("x", "y"), close, ("x", "y"), how="left_semi").select("cx", "cy").distinct()
    return grown.join(edge, ["cx", "cy"], "left_anti")


def neighbours(left: DataFrame, right: DataFrame, radius, dims: tuple[str, ...] = ("x", "y", "z"), how: str = "inner", extra: Column | None = None) -> DataFrame:
    """Pairs of a ``left`` row (alias ``l``) and a ``right`` row (alias ``r``) at most ``radius`` apart, with ``d2``.

    The left side is copied to the bins around its own, the right side stays in one bin. With ``left_semi`` a left row comes
    back from each of its copies that has a neighbour.
    """
    if how not in ("inner", "left_semi"):
        raise ValueError("a copy without a neighbour says nothing of its row")
    a, b = left, right
    for d in dims:
        own = bin_of(F.col(d), radius)
        a = a.withColumn(f"_b{d}", F.explode(F.array(own - 1, own, own + 1)))
        b = b.withColumn(f"_b{d}", bin_of(F.col(d), radius))
    a, b = a.alias("l"), b.alias("r")
    d2 = sum(((F.col(f"l.{d}") - F.col(f"r.{d}")) * (F.col(f"l.{d}") - F.col(f"r.{d}")) for d in dims), F.lit(0))
    on = d2 <= radius * radius
    for d in dims:
        on = (F.col(f"l._b{d}") == F.col(f"r._b{d}")) & on
    if extra is not None:
        on = on & extra
    out = a.join(b, on, how)
    return out if how == "left_semi" else out.withColumn("d2", d2)


def nearest(left: DataFrame, right: DataFrame, key: list[str], tie: str, radius, k: int, dims: tuple[str, ...] = ("x", "y"), keep: tuple[str, ...] = (), carry: tuple[str, ...] = (), extra: Column | None = None) -> DataFrame:
    """The ``k`` nearest right rows of each left row within ``radius``; ties go to the smaller ``tie``.

    Columns: ``key`` and ``carry`` of the left row, ``tie`` and ``keep`` of the right row, ``d2`` and ``rank``.
    """
    pairs = neighbours(left, right, radius, dims, extra=extra)
    pairs = pairs.select(*[F.col(f"l.{c}").alias(c) for c in (*key, *carry)], F.col(f"r.{tie}").alias(tie), *[F.col(f"r.{c}").alias(c) for c in keep], "d2")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("d2", tie))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_of_tile(left: DataFrame, right: DataFrame, key: list[str], tie: str, radius, k: int, scratch: Scratch, tile: tuple[str, str] | None = None, dims: tuple[str, ...] = ("x", "y"), keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``k`` nearest right rows of each left row, whatever their distance, or all if there are fewer.

    Columns are those of ``nearest``. ``tile`` names the tile's column on either side; without it all rows are of one tile.
    ``radius`` is where the search begins: it doubles for rows that have found too few, until they hold their tile.
    """
    a, b = ("_tile", "_other_tile") if tile is None else tile
    if tile is None:
        left, right = left.withColumn(a, F.lit(0)), right.withColumn(b, F.lit(0))
    right = scratch.table(right.dropna(subset=[*dims, b]), "others")
    size = right.groupBy(F.col(b).alias(a)).agg(F.least(F.count("*"), F.lit(k)).alias("_want"))
    todo = scratch.table(left.dropna(subset=list(dims)).join(size, a), "todo")
    both = todo.select(*dims).unionByName(right.select(*dims))
    extent = both.agg(*[(F.max(d) - F.min(d)).alias(d) for d in dims]).first()
    far = sum(float(v or 0) for v in extent)
    out = None
    while True:
        some = scratch.table(nearest(todo, right, key, tie, radius, k, dims, keep, extra=F.col(f"l.{a}") == F.col(f"r.{b}")), "near")
        full = some.groupBy(*key).agg(F.count("*").alias("_n")).join(todo.select(*key, "_want"), key).where(F.col("_n") >= F.col("_want")).select(*key)
        last = radius > far
        done = some if last else some.join(full, key, "left_semi")
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        todo = scratch.table(todo.join(full, key, "left_anti"), "todo")
        if todo.isEmpty():
            return out
        radius = radius * 2


#: Pairs that one task writes.
TASK_PAIRS = 4_000_000


def overlaps(left: DataFrame, right: DataFrame, key: str, size, scratch: Scratch) -> DataFrame:
    """``a, b, area``: all pairs of a left and a right box that share an area.

    Pairs can grow with the square of the rows. Boxes that are equal meet once, with lists of their keys; a task writes
    some ``TASK_PAIRS`` pairs whatever their number, and none is held.
    """
    sides = ["x_min", "x_max", "y_min", "y_max"]
    boxes = [binned_boxes(df.groupBy(*sides).agg(F.collect_list(key).alias("ids")), size).alias(n) for df, n in ((left, "a"), (right, "b"))]
    box = lambda s: {k: F.col(f"{s}.{k}") for k in sides}
    # a pair counts in the first bin that both touch
    first = (F.col("a._bx") == bin_of(F.greatest("a.x_min", "b.x_min"), size)) & (F.col("a._by") == bin_of(F.greatest("a.y_min", "b.y_min"), size))
    near = boxes[0].join(boxes[1], (F.col("a._bx") == F.col("b._bx")) & (F.col("a._by") == F.col("b._by")) & boxes_overlap(box("a"), box("b")) & first)
    near = scratch.table(near.select(F.col("a.ids").alias("a"), F.col("b.ids").alias("b"), overlap_area(box("a"), box("b")).alias("area")), "overlaps")
    pairs = near.agg(F.sum(F.size("a").cast("long") * F.size("b"))).first()[0] or 0
    some = near.repartition(max(near.sparkSession.sparkContext.defaultParallelism, -(-pairs // TASK_PAIRS)))
    return some.withColumn("a", F.explode("a")).withColumn("b", F.explode("b"))
