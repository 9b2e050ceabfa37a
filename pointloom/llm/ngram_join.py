"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Nothing is emitted for pairs of copies: documents with equal n-gram sets are one class, and classes are compared.

1. ``_sets``: every text becomes a sorted array of 64-bit n-gram hashes; a class is a set.
2. ``_alive``: the product's first, cheap block pass. A class that links with another shares at least
   ``t * n * extra`` n-grams among the first ``(1 - t + extra) * n`` of both, in any common order; column blocks count for
   each class how many of these columns have a second class, and classes below the bound go.
3. ``_rarest`` and ``_candidates``: a second block pass over what is left counts the classes of every column; classes
   that share one of the first ``(1 - t) * n + 1`` columns in the order of these counts may link. Columns of one class
   come first and frequent ones last, so passages that many texts share don't bring them together.
4. ``_links``: the product itself for each group of candidates, in blocks of rows whose size is bounded; overlap counts
   are accumulated column by column and pairs below the bound from their sizes are discarded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..plans.scratch import Scratch
from .textbuf import U, buffers, lean, mix, pack, set_digests, shingle_sets, small_batches, spans, trim, unpack

#: Share of a set by which the first pass looks further than the prefix bound.
EXTRA = Fraction(1, 8)
#: Bytes of text handled at once, n-grams in a column block and in a row block.
TEXT_BYTES, COLUMN_BLOCK, ROW_BLOCK = 4 << 20, 1_000_000, 150_000
#: Column blocks into which one exchange deals; where there are more, a second one deals each of these, so many entries at a time.
FAN, SPLIT = 20_000, 4_000_000


def _sets(docs: DataFrame, width: int, sets: bool) -> DataFrame:
    """``doc_id, t, n, node`` of every row, ``t`` being a hash of its text, or ``n, node`` with the set itself if ``sets``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = buffers(batch.column("text"))
            for a, z in spans(offs, TEXT_BYTES):
                h, bounds, _ = shingle_sets(raw[offs[a] : offs[z]], offs[a : z + 1] - offs[a], width)
                n = np.diff(bounds)
                out = [pa.array(n.astype(np.int64)), pa.array(set_digests(h, bounds).view(np.int64))]
                if sets:
                    blob = pa.py_buffer(h.astype("<u8").tobytes())
                    out.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), z - a, [None, pa.py_buffer((bounds * 8).astype(np.int64).tobytes()), blob]).cast(pa.binary()))
                    yield pa.RecordBatch.from_arrays(out, ["n", "node", "grams"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, z - a), batch.column("t").slice(a, z - a), *out], ["doc_id", "t", "n", "node"])

    if sets:
        return docs.select("text").transform(small_batches).mapInArrow(lean(run), "n long, node long, grams binary")
    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).transform(small_batches).mapInArrow(lean(run), "doc_id long, t long, n long, node long")


def _prefix(n: np.ndarray, t: Fraction, extra: Fraction) -> np.ndarray:
    """How many of a set's n-grams, in a common order, a linked set shares ``ceil(extra * smaller)`` of at least."""
    least = -((-t.numerator * n) // t.denominator)
    more = -((-extra.numerator * n) // extra.denominator) if extra else np.ones_like(n)
    return np.minimum(n, n - least + np.maximum(more, 1))


def _first(h: np.ndarray, bounds: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first ``take`` hashes of each row, and their rows."""
    row = np.repeat(np.arange(len(take)), np.diff(bounds))
    keep = np.arange(len(h)) - bounds[row] < take[row]
    return h[keep], row[keep]


def _bytes(blocks: int) -> int:
    """Bytes of a hash that are sent; few blocks tell the others apart well enough, as what a block finds is verified."""
    return 6 if blocks <= FAN else 8


def _blocks(h: np.ndarray, c: np.ndarray, width: int, blocks: int, coarse: bool = True) -> Iterator[tuple[int, bytes, bytes]]:
    """Column block, packed hashes and ``width`` bytes of the classes in it; blocks beyond ``FAN`` together if ``coarse``."""
    block = ((h >> U(32)) % U(blocks)).astype(np.int64)
    if coarse:
        block %= FAN
    order = np.argsort(block, kind="stable")
    h, c, block = h[order], c[order], block[order]
    edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(h) else np.zeros(0, np.int64)
    for s, e in zip(edge, np.append(edge[1:], len(h))[: len(edge)], strict=True):
        yield int(block[s]), pack(h[s:e], _bytes(blocks)), pack(c[s:e], width)


def _rows(got: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "h", "c"])


def _dealt(sent: DataFrame, width: int, blocks: int) -> GroupedData:
    """Entries ``block, h, c`` by their blocks, over two exchanges if there are more than ``FAN``."""
    if blocks <= FAN:
        return sent.groupBy("block")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return _rows(list(_blocks(np.concatenate(hs), np.concatenate(cs), width, blocks, False)))

        hs, cs, held = [], [], 0
        for batch in batches:
            for h, c in zip(batch.column("h"), batch.column("c"), strict=True):
                hs.append(unpack(h.as_py(), _bytes(blocks)))
                cs.append(unpack(c.as_py(), width))
                held += len(hs[-1])
                if held >= SPLIT:
                    yield out()
                    hs, cs, held = [], [], 0
        if held:
            yield out()

    return sent.repartition(FAN, "block").mapInArrow(lean(split), sent.schema).groupBy("block")


def _columns(table: pa.Table, width: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Incidence of a column block without repeats: hashes and classes in order, the first of each column, classes in each."""
    h = np.concatenate([unpack(x.as_py(), _bytes(blocks)) for x in table["h"]])
    c = np.concatenate([unpack(x.as_py(), width) for x in table["c"]])
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    h, c = h[new], c[new]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h, c, start, np.diff(np.append(start, len(h)))


def _alive(docs: DataFrame, width: int, t: Fraction, blocks: int) -> DataFrame:
    """``key, n``: how many of the first columns of each class key (40 bits) have a second class, block by block."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = buffers(batch.column("text"))
            for a, z in spans(offs, TEXT_BYTES):
                h, bounds, _ = shingle_sets(raw[offs[a] : offs[z]], offs[a : z + 1] - offs[a], width)
                key = set_digests(h, bounds)
                # copies within the slice add nothing
                once = np.zeros(len(key), bool)
                once[np.unique(key, return_index=True)[1]] = True
                h, row = _first(h, bounds, np.where(once, _prefix(np.diff(bounds), t, EXTRA), 0))
                got = list(_blocks(h, key[row], 5, blocks))
                if got:
                    yield _rows(got)

    def count(table: pa.Table) -> pa.Table:
        h, c, start, df = _columns(table, 5, blocks)
        shared = np.repeat(df > 1, df)
        key, n = np.unique(c[shared], return_counts=True)
        trim()
        return pa.table({"key": pa.array(key.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    sent = docs.select("text").transform(small_batches).mapInArrow(lean(emit), "block int, h binary, c binary")
    return _dealt(sent, 5, blocks).applyInArrow(count, "key long, n long")


def _rarest(sets: DataFrame, blocks: int) -> DataFrame:
    """``node, h, df``: the columns of each class that have a second one, with their numbers of classes, block by block."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = buffers(batch.column("grams"))
            node = np.asarray(batch.column("node")).view(np.uint64)
            for a, z in spans(offs, TEXT_BYTES):
                row = np.repeat(np.arange(a, z), np.diff(offs[a : z + 1]) // 8)
                got = list(_blocks(raw[offs[a] : offs[z]].view("<u8").astype(np.uint64), node[row], 8, blocks))
                if got:
                    yield _rows(got)

    def count(table: pa.Table) -> pa.Table:
        h, c, _, df = _columns(table, 8, blocks)
        each = np.repeat(df, df)
        shared = each > 1
        h, c, each = h[shared], c[shared], np.minimum(each[shared], 0xFFFF)
        order = np.argsort(c, kind="stable")
        h, c, each = h[order], c[order], each[order].astype("<u2")
        heads = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
        cut = list(zip(heads, np.append(heads[1:], len(c))[: len(heads)], strict=True))
        trim()
        return pa.table({
            "node": pa.array(c[heads].view(np.int64)), "h": pa.array([pack(h[s:e], _bytes(blocks)) for s, e in cut], pa.binary()),
            "df": pa.array([each[s:e].tobytes() for s, e in cut], pa.binary()),
        })

    sent = sets.select("node", "grams").transform(small_batches).mapInArrow(lean(emit), "block int, h binary, c binary")
    return _dealt(sent, 8, blocks).applyInArrow(count, "node long, h binary, df binary")


def _candidates(ranked: DataFrame, t: Fraction, blocks: int) -> DataFrame:
    """Edges ``u, v`` that connect, block by block, the classes of every column that is early in them.

    ``ranked(node, n, h, df)`` lists the shared columns of a class; all others have one class and come before them.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, cs = [], []
            take = _prefix(np.asarray(batch.column("n")), t, Fraction(0))
            for node, n, p, h, df in zip(np.asarray(batch.column("node")), np.asarray(batch.column("n")), take, batch.column("h"), batch.column("df"), strict=True):
                own = unpack(b"".join(h.as_py()), _bytes(blocks))
                p -= n - len(own)
                if p > 0:
                    own = own[np.lexsort((own, np.frombuffer(b"".join(df.as_py()), "<u2")))][:p]
                    hs.append(own)
                    cs.append(np.full(len(own), node))
            if hs:
                h = np.concatenate(hs)
                yield _rows(list(_blocks(h, np.concatenate(cs).view(np.uint64), 8, blocks)))

    def pair(table: pa.Table) -> pa.Table:
        _, c, start, df = _columns(table, 8, blocks)
        node, at = np.unique(c.view(np.int64), return_inverse=True)
        low = _lowest(np.repeat(at[start], df), at, len(node))
        moved = np.flatnonzero(low != np.arange(len(node)))
        trim()
        return pa.table({"u": pa.array(node[moved]), "v": pa.array(node[low[moved]])})

    sent = ranked.select("node", "n", "h", "df").transform(small_batches).mapInArrow(lean(emit), "block int, h binary, c binary")
    return _dealt(sent, 8, blocks).applyInArrow(pair, "u long, v long").distinct()


def _lowest(i: np.ndarray, j: np.ndarray, rows: int) -> np.ndarray:
    """The smallest row that each row reaches by pairs ``i, j``."""
    low = np.arange(rows)
    while True:
        a, b = low[i], low[j]
        apart = a != b
        if not apart.any():
            return low
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = low[low]
            if (up == low).all():
                break
            low = up


def _overlaps(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows i < j that share a column, and how many they share."""
    order = np.lexsort((row, h))
    h, row = h[order], row[order]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    df = np.diff(np.append(start, len(h)))
    each = np.repeat(df, df)
    codes, counts = [], []
    few = (each > 1) & (each <= 32)
    hs, rs = h[few], row[few].astype(np.int64)
    for lag in range(1, int(each[few].max()) if few.any() else 0):
        same = hs[lag:] == hs[:-lag]
        if same.any():
            code, n = np.unique(rs[:-lag][same] * rows + rs[lag:][same], return_counts=True)
            codes.append(code)
            counts.append(n)
    many = each > 32
    if many.any():
        used, r = np.unique(row[many], return_inverse=True)
        _, col = np.unique(h[many], return_inverse=True)
        total = np.zeros((len(used), len(used)), np.float32)
        for at in range(0, int(col.max()) + 1, 2048):
            own = (col >= at) & (col < at + 2048)
            dense = np.zeros((len(used), 2048), np.float32)
            dense[r[own], col[own] - at] = 1
            total += dense @ dense.T
        i, j = np.nonzero(np.triu(total, 1))
        codes.append(used[i].astype(np.int64) * rows + used[j])
        counts.append(total[i, j].astype(np.int64))
    if not codes:
        return (np.zeros(0, np.int64),) * 3
    code, inverse = np.unique(np.concatenate(codes), return_inverse=True)
    n = np.bincount(inverse, np.concatenate(counts), len(code)).astype(np.int64)
    return code // rows, code % rows, n


def _links(groups: DataFrame, t: Fraction, pairs: bool) -> DataFrame:
    """Links within each block: all of them if ``pairs``, else edges that connect the same classes."""

    def product(table: pa.Table) -> pa.Table:
        node, first = np.unique(np.asarray(table["node"]), return_index=True)
        table = table.take(pa.array(first))
        rows = len(node)
        n = np.asarray(table["n"])
        own = mix(np.asarray(table["root"]).view(np.uint64))  # groups that share a block stay apart
        raw, _ = buffers(table["grams"])
        row = np.repeat(np.arange(rows), n)
        i, j, both = _overlaps(raw.view("<u8").astype(np.uint64) ^ own[row], row, rows)
        trim()
        linked = both * t.denominator >= t.numerator * (n[i] + n[j] - both)
        i, j, both = i[linked], j[linked], both[linked]
        if pairs:
            return pa.table({"u": pa.array(node[i]), "v": pa.array(node[j]), "overlap": pa.array(both)})
        low = _lowest(i, j, rows)
        moved = np.flatnonzero(low != np.arange(rows))
        return pa.table({"u": pa.array(node[moved]), "v": pa.array(node[low[moved]]), "overlap": pa.nulls(len(moved), pa.int64())})

    return groups.groupBy("block", "a", "z").applyInArrow(product, "u long, v long, overlap long")


def _join(docs: DataFrame, scratch: Scratch, threshold: float, width: int, pairs: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their classes, classes (node, n, rep, first), and links between classes.

    ``rep`` is a class's smallest doc_id, and ``first`` its first row, as ``_place`` orders them.
    """
    t = Fraction(threshold).limit_denominator(1000)
    if not 0 < t <= 1:
        raise ValueError("the threshold lies above 0, and at 1 at most")
    rows = scratch.table(_sets(docs, width, False), "rows")
    classes = scratch.table(rows.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.min("doc_id").alias("rep"), F.min(_place()).alias("first")), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    alive = scratch.table(_alive(docs, width, t, max(16, math.ceil(total * float(1 - t + EXTRA) / COLUMN_BLOCK))), "alive")
    least = F.ceil(F.ceil(F.col("n") * t.numerator / F.lit(t.denominator)) * EXTRA.numerator / F.lit(EXTRA.denominator))
    shared = alive.groupBy("key").agg(F.sum("n").alias("shared"))
    left = scratch.table(
        classes.withColumn("key", F.col("node").bitwiseAND(F.lit((1 << 40) - 1))).join(shared, "key").where(F.col("shared") >= F.greatest(F.lit(1), least)).select("node", "n", "rep"), "left"
    )
    count, some_grams = left.agg(F.count("*"), F.sum("n")).first()
    some = left.select("rep").distinct()
    if count <= BROADCAST_IDS:
        some = F.broadcast(some)
    # classes that aren't left but share a doc_id with one that is come along and find no place
    sets = scratch.table(_sets(docs.select("doc_id", "text").join(some, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi"), width, True), "sets")
    few = max(16, math.ceil((some_grams or 0) / COLUMN_BLOCK))
    ranked = _rarest(sets, few).groupBy("node").agg(F.collect_list("h").alias("h"), F.collect_list("df").alias("df")).join(left.select("node", "n"), "node")
    near = scratch.table(connected_components(_candidates(ranked, t, few), scratch).join(left.select("node", "n"), "node"), "near")
    # where each class goes is settled on narrow rows; sets meet it in one exchange, whose kind doesn't depend on sizes
    size = near.groupBy("root").agg(F.ceil(F.sum("n") / ROW_BLOCK).cast("long").alias("parts"))
    bins = max(16, math.ceil((some_grams or 0) / ROW_BLOCK))
    alone = F.col("parts") == 1
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    other = F.explode(F.expr("case when parts = 1 then array(0L) else sequence(0L, parts - 1) end"))
    place = near.join(size, "root").withColumn("part", part).withColumn("other", other).select(
        "node", "root",
        F.when(alone, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.col("root")).alias("block"),
        F.when(alone, F.lit(-1)).otherwise(F.least("part", "other")).alias("a"),
        F.when(alone, F.lit(-1)).otherwise(F.greatest("part", "other")).alias("z"),
    )
    links = scratch.table(_links(sets.join(place.hint("merge"), "node"), t, pairs).distinct(), "links")
    scratch.drop(alive, left, sets, near)
    return rows, classes, links


def _place() -> F.Column:
    """What rows are ordered by: doc_id, a null last, then a hash of the text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "t")


#: Ids of 8 bytes that are broadcast at most; above it the join is dealt by id.
BROADCAST_IDS = 200_000


def _components(docs: DataFrame, scratch: Scratch, threshold: float, width: int) -> DataFrame:
    """Every row ``doc_id, t, n`` with ``first``, the first row of its component; null for a row without words."""
    rows, classes, links = _join(docs, scratch, threshold, width, False)
    root = connected_components(links.select("u", "v"), scratch)
    named = classes.join(root, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    lowest = named.groupBy("root").agg(F.min("first").alias("first"))
    named = scratch.table(named.select("node", "root").join(lowest, "root").select("node", "first"), "named")
    done = scratch.table(rows.join(named, "node", "left").select("doc_id", "t", "n", "first"), "components")
    scratch.drop(rows, classes, links, named)
    return done


def ngram_components(docs: DataFrame, threshold: float = 0.75, width: int = 5) -> DataFrame:
    """One row per row of ``docs(doc_id, text, …)``: ``doc_id, n_shingles, component_id``.

    Two rows link where the Jaccard similarity of their sets of ``width``-word shingles reaches ``threshold``;
    ``component_id`` is the smallest doc_id that links lead to. A null text or one without words has an empty set, links
    with nothing and is its own component. A null doc_id counts as larger than any other. Repeated rows come back
    repeated. Other columns of ``docs`` are left out. The work is done when this is called; what is lazy is its reading.
    """
    rows = _components(docs, Scratch(docs.sparkSession, "ngram-join"), threshold, width)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("first.id")).alias("component_id"))


def ngram_links(docs: DataFrame, threshold: float = 0.75, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """Links between class representatives ``(a, b, overlap, jaccard)``, and members ``(doc_id, rep, n_shingles)``.

    Rows with equal sets are one class, represented by its smallest doc_id, and aren't paired with each other.
    """
    scratch = Scratch(docs.sparkSession, "ngram-links")
    rows, classes, links = _join(docs, scratch, threshold, width, True)
    x, y = classes.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("rep").alias("ru")), classes.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("rep").alias("rv"))
    out = links.join(x, "u").join(y, "v").select(F.least("ru", "rv").alias("a"), F.greatest("ru", "rv").alias("b"), "overlap", (F.col("overlap") / (F.col("nu") + F.col("nv") - F.col("overlap"))).alias("jaccard"))
    members = rows.join(classes.select("node", "rep"), "node", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), F.col("n").alias("n_shingles"))
    return out, members


def keep_one(docs: DataFrame, threshold: float = 0.75, width: int = 5) -> DataFrame:
    """The first row of each group of rows of ``docs`` that link, over any chain.

    Rows are ordered by doc_id, nulls last, and by a hash of the text where a doc_id repeats. Rows without words link with
    nothing and stay. Rows that repeat both doc_id and text stay once. All columns are kept as they are.
    """
    scratch = Scratch(docs.sparkSession, "ngram-join")
    rows = _components(docs, scratch, threshold, width)
    known = rows.groupBy("doc_id", "t").agg(F.count("*").alias("__n"), F.max((F.col("n") > 0) & (_place() != F.col("first"))).alias("__gone"))
    known = scratch.table(known.where("__gone or __n > 1").withColumnsRenamed({"doc_id": "__id", "t": "__t"}), "known")
    scratch.drop(rows)
    count, again = known.agg(F.count("*"), F.max((F.col("__n") > 1) & ~F.col("__gone"))).first()
    if count <= BROADCAST_IDS:
        known = F.broadcast(known)
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__t"))
    if not again:
        return docs.join(known, same, "left_anti")
    repeated = docs.join(known.where("not __gone"), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(known, same, "left_anti").unionByName(repeated)
