"""Sequence packing by non-negative least squares on the histogram of lengths.

Documents are cut into windows of ``WINDOW`` tokens; whole windows are sequences by themselves. The rests are counted by
length, in classes of ``GRAIN`` tokens. Shallow combinations of up to three classes that fill a window are enumerated,
their repeat counts solved for against the histogram by non-negative least squares and rounded down, and what is left is
packed greedily, by patterns and their repeats. Only the histogram comes to the driver; rows find their sequence by their
rank in their class, which is counted in salted parts, so a length that a third of all rows share isn't ranked by one task.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from .textbuf import buffers, lean, small_batches, spans, trim
from .tokens import Encoder

WINDOW, GRAIN, DEPTH = 2048, 8, 3
TEXT_BYTES = 4 << 20
#: Rows of a part of a class, roughly, and parts at most.
PART_ROWS, MOST_PARTS = 100_000, 1024


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` of every piece, and its ids (4 bytes each) if ``keep_ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            raw, offs = buffers(batch.column("text"))
            doc_ids = batch.column("doc_id")
            for a, z in spans(offs, TEXT_BYTES):
                ids, count = encoder.encode(raw[offs[a] : offs[z]], offs[a : z + 1] - offs[a])
                parts = -(-count // window)
                row = np.repeat(np.arange(z - a), parts)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * window
                length = np.minimum(count[row] - start, window)
                at = np.repeat(np.cumsum(count) - count, parts) + start
                data = ids.astype("<u4")
                own = [data[x : x + n].tobytes() for x, n in zip(at, length, strict=True)]
                out = [doc_ids.slice(a, z - a).take(pa.array(row)), pa.array(start), pa.array(length), pa.array([zlib.crc32(b) for b in own], pa.int64()), pa.array(count[row])]
                yield pa.RecordBatch.from_arrays(out + [pa.array(own, pa.binary())] * keep_ids, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids)

    return docs.select("doc_id", "text").transform(small_batches).mapInArrow(lean(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids)


def combinations(full: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Classes, ascending, that fill a window of ``full`` grains: all pairs and, for depth 3, all triples."""
    out: list[tuple[int, ...]] = [(a, full - a) for a in range(1, full // 2 + 1)]
    if depth > 2:
        out += [(a, b, full - a - b) for a in range(1, full // 3 + 1) for b in range(a, (full - a) // 2 + 1)]
    return out


def nnls(matrix: np.ndarray, target: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 that minimises |matrix x - target|, by the active-set method; scale-free stopping.

    After ``rounds`` columns the search ends with what it has, which is feasible; the rest is packed greedily.
    """
    columns = matrix.shape[1]
    x, active, barred = np.zeros(columns), np.zeros(columns, bool), np.zeros(columns, bool)
    scale = max(1.0, float(np.abs(target).max()))
    for _ in range(rounds):
        gain = matrix.T @ (target - matrix @ x)
        gain[active | barred] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= 1e-7 * scale:
            break
        active[best] = True
        while active.any():
            on = np.flatnonzero(active)
            solved = np.linalg.lstsq(matrix[:, on], target, rcond=None)[0]
            low = solved <= 1e-10 * scale
            if not low.any():
                x[:] = 0
                x[on] = solved
                barred[:] = False
                break
            if on[low].tolist() == [best]:  # a column that rounding alone let in
                active[best], barred[best] = False, True
                break
            ratio = x[on][low] / np.maximum(x[on][low] - solved[low], 1e-300)
            x[on] += float(ratio.min()) * (solved - x[on])
            drop = on[x[on] <= 1e-10 * scale]
            active[drop] = False
            x[drop] = 0
    return x


def plan(histogram: dict[int, int], full: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ``{class: pieces}`` and their repeats, which together take each class's count exactly."""
    left = np.zeros(full + 1, np.int64)
    for c, n in histogram.items():
        left[c] = n
    out: list[tuple[dict[int, int], int]] = []
    if left[full]:
        out.append(({full: 1}, int(left[full])))
        left[full] = 0
    choices = [c for c in combinations(full) if all(left[k] for k in c)]
    if choices:
        matrix = np.zeros((full - 1, len(choices)))
        for j, c in enumerate(choices):
            for k in c:
                matrix[k - 1, j] += 1
        repeat = nnls(matrix, left[1:full].astype(float))
        for j in np.argsort(-repeat, kind="stable"):
            own: dict[int, int] = {}
            for k in choices[j]:
                own[k] = own.get(k, 0) + 1
            n = min(int(repeat[j] + 1e-6), *(int(left[k]) // m for k, m in own.items()))
            if n < 1:
                continue
            out.append((own, n))
            for k, m in own.items():
                left[k] -= m * n
    while left.any():  # greedily: the longest rest, then the longest that still fits
        own, room, c = {}, full, int(np.flatnonzero(left)[-1])
        while c:
            m = min(room // c, int(left[c]))
            if m:
                own[c] = m
                room -= m * c
            below = np.flatnonzero(left[: min(c, room + 1)])
            c = int(below[-1]) if len(below) else 0
        n = min(int(left[k]) // m for k, m in own.items())
        out.append((own, n))
        for k, m in own.items():
            left[k] -= m * n
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Pieces of ``docs(doc_id, text, …)`` in sequences of at most ``window`` tokens.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, and ``ids`` (4 bytes each, little-endian) if
    ``keep_ids``. Each document ends with id 1; a null text is that id alone. A document is cut every ``window`` tokens
    and nowhere else. Offsets have no gaps; equal pieces are told apart by nothing but where they go, and repeated rows
    are packed each.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    rows = scratch.table(pieces(docs, tokenizer or default_tokenizer(), window, keep_ids), "pieces")
    grain = GRAIN if window % GRAIN == 0 else 1
    full = window // grain
    n = rows.count()
    parts = max(1, min(MOST_PARTS, n // PART_ROWS + 16))
    keyed = rows.withColumn("class", F.ceil(F.col("length") / grain).cast("int")).withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)).cast("int"))
    counts = keyed.groupBy("class", "part").agg(F.count("*").alias("n"))
    histogram = {r["class"]: r.n for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    ranges, base = [], 0
    taken: dict[int, int] = {}
    for own, repeats in plan(histogram, full):
        for c, m in own.items():
            lo = taken.get(c, 0)
            taken[c] = lo + m * repeats
            ranges.append({"class": c, "lo": lo, "hi": taken[c], "base": base, "m": m})
        base += repeats
    trim()
    kind = "array<struct<class: int, lo: bigint, hi: bigint, base: bigint, m: bigint>>"
    where = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(ranges)), kind)))
    ahead = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("class", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("class", "part").orderBy("doc_id", "start", "ids_crc32"))
    ranked = keyed.withColumn("k", own).join(F.broadcast(before), ["class", "part"]).withColumn("rank", F.col("before") + F.col("k") - 1)
    placed = ranked.join(F.broadcast(where), "class").where("rank >= lo and rank < hi").withColumn("sequence_id", F.expr("base + (rank - lo) div m"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32", "rank").rowsBetween(Window.unboundedPreceding, -1)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"]
    return placed.select(*names, F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"), *["ids"] * keep_ids)
