"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are partitioned by the number of their shingles, each partition with as many MinHash bands as make a miss at
the threshold less likely than ``MISS``; small items have all of their shingles in their sketch, so none is missed. A
document is a candidate for an item if it holds the shingle of one of the item's bands. A document that holds a share c of
an item's shingles collides in each band with probability c however long the document is, which a plain MinHash of the
whole document doesn't give.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingle_sql as S
from ..plans.scratch import Scratch

#: Chance that an item that is contained just at the threshold meets no band.
MISS = 1e-9


def _items(benchmark: DataFrame) -> DataFrame:
    """``item_id, item, width, hashes, shingles`` of the items with words; ``item`` tells an id's word sequences apart."""
    rows = S.with_words(benchmark.select("item_id", "text"), "text", "w").dropDuplicates(["item_id", "w"])
    rows = rows.select("item_id", F.xxhash64("w").alias("item"), F.least(F.size("w"), F.lit(S.WIDTH)).alias("width"), S.of_text("w", "hash").alias("hashes"), S.of_text("w", "text").alias("shingles"))
    return rows.where("size(shingles) > 0")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75) -> DataFrame:
    """``doc_id, item_id, containment, matched, item_shingles`` of every document that holds an item.

    Containment is the share of the item's distinct shingles that the document has, ``threshold`` at least. Items without
    words are held by nothing; items of fewer words than a shingle are held where their whole word sequence occurs. Rows of
    ``benchmark`` that repeat id and words are one item; those that repeat an id with other words are items of their own,
    each with its own row here. Null texts hold nothing. Rows that repeat a doc_id with other texts are documents of their
    own; equal results come once. Items and their sketches are written when this is called, the rest is lazy.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = scratch.table(_items(benchmark), "items")
    key = ["item_id", "item"]
    sketch = None
    # partitions by size: 1, 2-3, 4-7, … shingles
    parts = [r.part for r in items.select(F.floor(F.log2(F.size("shingles"))).alias("part")).distinct().orderBy("part").collect()]
    need = max(1, math.ceil(math.log(MISS) / math.log(1 - threshold))) if threshold < 1 else 1
    for part in parts:
        own = items.where(F.floor(F.log2(F.size("shingles"))) == part)
        few = 2 ** (part + 1) <= need
        one = own.select(*key, "width", F.explode("hashes").alias("h")) if few else S.sketches(own, key, need).select(*key, "width", "h").distinct()
        sketch = one if sketch is None else sketch.unionByName(one)
    if sketch is None:
        return docs.select("doc_id").where(F.lit(False)).selectExpr("doc_id", "cast(null as long) item_id", "cast(null as double) containment", "cast(null as long) matched", "cast(null as long) item_shingles")
    sketch = scratch.table(sketch, "sketch")
    rows = S.with_words(docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("t")), "text", "w").drop("text")
    near = scratch.table(S.hits(rows, "w", sketch), "near").dropDuplicates(["doc_id", "t"])
    pairs = near.select("doc_id", "t", F.explode("hits").alias("s")).select("doc_id", "t", "s.width", "s.h").distinct()
    pairs = pairs.join(sketch, ["width", "h"]).select("doc_id", "t", *key).distinct()
    widths = [r.width for r in items.select("width").distinct().orderBy("width").collect()]
    every = ", ".join(f"transform({S.starts('w', n)}, i -> array_join(slice(w, i + 1, {n}), ' '))" for n in widths)
    shingles = near.select("doc_id", "t", F.explode(F.expr(f"array_distinct(concat({every}))")).alias("shingle"))
    wanted = items.select(*key, F.size("shingles").alias("m"), F.explode("shingles").alias("shingle"))
    matched = shingles.join(wanted, "shingle").groupBy("doc_id", "t", *key, "m").agg(F.count("*").alias("matched"))
    held = matched.where(F.col("matched") >= threshold * F.col("m"))
    pairs = pairs.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "t", *key)])
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("t") == F.col("_t")) & F.col("item_id").eqNullSafe(F.col("_item_id")) & (F.col("item") == F.col("_item"))
    exact = held.join(pairs, same, "left_semi")
    return exact.select("doc_id", "item_id", (F.col("matched") / F.col("m")).alias("containment"), "matched", F.col("m").cast("long").alias("item_shingles")).distinct()


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75) -> DataFrame:
    """``docs``, all columns as they are, without the documents that hold a test item.

    Rows are told apart by doc_id and text, so a row goes only if its own text holds an item.
    """
    bad = contaminated(docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text"), benchmark, threshold).select(F.col("doc_id").alias("__held_row")).distinct()
    return docs.join(bad, F.xxhash64("doc_id", "text") == F.col("__held_row"), "left_anti")
