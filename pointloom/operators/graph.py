"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch

#: Parts into which the edges of one node are dealt, as a node may have a third of all edges.
SALT = 16


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Nodes of ``edges(u, v)`` with the smallest node that each can reach: ``(node, root)``.

    Each round points every node's larger neighbours, then its smaller ones, at its smallest neighbour; the number of
    edges never rises and the rounds grow with the logarithm of the largest diameter. Self loops, repeated edges and
    an empty table are fine; nulls are ignored. Rounds are written to the shared folder. What a round looks up by a node
    is one row for each node, copied ``SALT`` times, so the edges of a hub are dealt over as many tasks.
    """
    now = scratch.table(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _is_stars(now):
            break
        large = _lowest(now, now, "v", "u").select("u", F.coalesce("m", "v").alias("v")).distinct()
        small = _lowest(large, large, "u", "v").select(F.explode(F.when(F.col("v") == F.col("m"), F.array(F.struct("u", "m"))).otherwise(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m")))).alias("e"))
        after = scratch.table(small.select("e.u", F.col("e.m").alias("v")).distinct(), "edges")
        scratch.drop(now)
        now = after
    else:
        raise RuntimeError(f"components aren't found after {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _lowest(of: DataFrame, edges: DataFrame, at: str, other: str) -> DataFrame:
    """Edges with ``m``, the smallest of the smaller neighbours that the node in column ``at`` has in ``of``; null for none."""
    low = of.groupBy(F.col("u").alias(at)).agg(F.min("v").alias("m")).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return edges.withColumn("_s", F.pmod(F.hash(other), F.lit(SALT))).join(low, [at, "_s"], "left")


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and none that has one is itself a smaller neighbour."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("top")), F.struct(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("top")))).alias("e")).select("e.*")
    node = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("top").alias("top"))
    most = node.agg(F.max(F.col("up") + F.when(F.col("up") > 0, F.col("top")).otherwise(0))).first()[0]
    return (most or 0) <= 1
