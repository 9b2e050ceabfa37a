"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points on a ring of 2**32 positions; a row belongs to the first point clockwise of the hash of
its doc_id. A shard takes the rows of its arcs, in ring order, until its load reaches ``(1 + slack)`` times the mean; what
is left of its arcs goes on clockwise, to the next points whose shards have room. A plan is a list of ranges of running
bytes within arcs. It is made from one sum for each arc, of which there are ``shards * vnodes`` whatever the size of the
table. Arcs are cut into ``PARTS`` parts by a hash of doc_id and text, as one doc_id may have a third of all rows; rows are
in the order of their positions within a part, and find their range without leaving it.
"""

from __future__ import annotations

import hashlib
import json
import math
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import order
from ..plans.scratch import Scratch

SHARDS, VNODES, SLACK = 24, 128, 0.001
#: Parts of an arc.
PARTS = 32


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """Positions of the points and their shards, in ring order; of points at one position the smallest shard's stays."""
    found: dict[int, int] = {}
    for shard in range(shards):
        for k in range(vnodes):
            at = int.from_bytes(hashlib.sha256(f"shard-{shard}-point-{k}".encode()).digest()[:4], "big")
            found[at] = min(shard, found.get(at, shard))
    return sorted(found.items())


def plan(loads: dict[int, int], owners: list[int], shards: int, slack: float) -> list[tuple[int, int, int, int]]:
    """``(arc, from, to, shard)``: which shard takes the rows of an arc that begin in this range of its running bytes."""
    total = sum(loads.values())
    room = [math.ceil(total / shards * (1 + slack))] * shards
    out, over = [], []
    for arc, load in sorted(loads.items()):
        shard = owners[arc]
        take = min(load, room[shard])
        room[shard] -= take
        if take:
            out.append((arc, 0, take, shard))
        if take < load:
            over.append((arc, take, load))
    for arc, at, load in over:
        step = arc
        while at < load:
            step = (step + 1) % len(owners)
            shard = owners[step]
            take = min(load - at, room[shard])
            if take:
                room[shard] -= take
                out.append((arc, at, at + take, shard))
                at += take
    return out


def shard(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, slack: float = SLACK) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row of ``docs(doc_id, text, …)``.

    ``size`` is the text's UTF-8 bytes plus 8, 8 for a null text. The law is ``bytes``: no shard exceeds ``1 + slack`` times
    the mean by more than two rows. ``slot`` counts a shard's rows without gaps, in ring order; ``grown_shard`` is null, as
    loads decide where a row goes. Rows that repeat follow each other; a null doc_id has a position like any other. Rows are
    written and the ring is planned when this is called.
    """
    scratch = Scratch(docs.sparkSession, "ring")
    points = ring(shards, vnodes)
    position = F.pmod(F.xxhash64("doc_id"), F.lit(2**32))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    rows = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), position.alias("position"), F.pmod(F.xxhash64("doc_id", crc, F.lit(1)), F.lit(PARTS)).cast("int").alias("part"))
    # the arc of a point holds the positions above the point before it, up to its own
    rows = scratch.table(rows.withColumn("arc", F.pmod(order.bucket(F.col("position") - 1, [p for p, _ in points]), F.lit(len(points)))), "rows")
    cells = rows.groupBy("arc", "part").agg(F.sum("size").alias("load"))
    loads = {r.arc: r.load for r in cells.groupBy("arc").agg(F.sum("load").alias("load")).collect()}
    ranges = plan(loads, [s for _, s in points], shards, slack)
    spark = docs.sparkSession
    kind = "array<struct<arc: int, lo: bigint, hi: bigint, shard: int>>"
    text = json.dumps([dict(zip(("arc", "lo", "hi", "shard"), r, strict=True)) for r in ranges])
    ranges_df = spark.range(1).select(F.inline(F.from_json(F.lit(text), kind)))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    before = cells.select("arc", "part", F.coalesce(F.sum("load").over(upto(Window.partitionBy("arc").orderBy("part"))), F.lit(0)).alias("before"))  # PARTS rows an arc at most
    ahead = F.sum("size").over(upto(Window.partitionBy("arc", "part").orderBy("position", "doc_id", "text_crc32")))
    rows = rows.withColumn("ahead", F.coalesce(ahead, F.lit(0))).join(F.broadcast(before), ["arc", "part"]).withColumn("begin", F.col("before") + F.col("ahead"))
    rows = rows.join(F.broadcast(ranges_df), "arc").where("begin >= lo and begin < hi")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("arc", "part", "lo").orderBy("begin")))
    rows = scratch.table(rows.select("doc_id", "size", "text_crc32", "shard", "arc", "lo", "part", "k"), "dealt")
    parts = rows.groupBy("shard", "arc", "lo", "part").agg(F.count("*").alias("n"))
    base = parts.select("shard", "arc", "lo", "part", F.coalesce(F.sum("n").over(upto(Window.partitionBy("shard").orderBy("arc", "lo", "part"))), F.lit(0)).alias("base"))
    rows = rows.join(F.broadcast(base), ["shard", "arc", "lo", "part"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("k") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def arc_of(position: int, points: list[tuple[int, int]]) -> int:
    """The arc of a position; what the expression in ``shard`` does for a column."""
    return bisect_left([p for p, _ in points], position) % len(points)
