"""Substring deduplication by content-defined chunking.

A gear hash rolls over the UTF-8 bytes and cuts where some of its bits are zero, so a passage is cut alike wherever it
stands, from the gear's window on. Chunks are short (about 16 bytes), so that little of a passage is lost at its ends;
what is deduplicated is the digest of a run of chunks, from each chunk to the first cut ``RUN_WORDS`` words later, which is
long enough not to repeat by chance. A digest that a document with a smaller doc_id has too marks its run.

Neighbouring marks that the same earlier document has, side by side there too, are one piece. The text around a piece's
place in that document says how far both agree; a stretch that this one document holds and that has ``min_words`` words or
more is a repeat. So no stretch is put together from several documents.

Where the gear cuts too seldom for ``SPAN`` words to hold a run wherever they stand, as in a short line said again and
again, each ``SPAN`` words in a row have a digest too. So two documents that share ``MIN_WORDS`` words share a digest.

Digests are dealt over blocks. Within a slice of the input only the smallest document of each digest is sent on, the
others being repeats already, so a passage in a third of all documents doesn't gather in one task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from .textbuf import _SPACE, U, buffers, lean, mix, pack, small_batches, spans, trim, unpack

#: Bytes that the gear sees, chunk limits, words of a run, words of a repeat at least.
WINDOW, CUT_BITS, MIN_CHUNK, MAX_CHUNK, RUN_WORDS, MIN_WORDS = 16, 0x7000, 6, 256, 24, 50
#: Words of a digest of words: a passage's first and last word may be parts of longer ones in one of two documents. Their marks count from WORDS.
SPAN, WORDS = MIN_WORDS - 2, 1 << 30
TEXT_BYTES, BLOCK = 2 << 20, 1_000_000
#: Blocks into which one exchange deals; where there are more, a second one deals each of these, so many entries at a time.
FAN, SPLIT = 20_000, 2_000_000
#: What is compared to either side of a piece: so many words and bytes at least. Beyond it the next run of chunks would have been marked.
AROUND_WORDS, AROUND = MIN_WORDS + 2, 2 * MAX_CHUNK
#: Documents whose ids are broadcast at most.
BROADCAST_IDS = 200_000
_rng = np.random.default_rng(0x6EA7)
_GEAR = _rng.integers(0, 1 << 16, 256, dtype=np.uint16)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_POS = _rng.integers(1, 2**63, MAX_CHUNK + 1, dtype=np.uint64) | U(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _cuts(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where the gear cuts; whether it does depends on the ``WINDOW + MIN_CHUNK`` bytes before and the next byte."""
    n = np.diff(offs)
    put = np.arange(len(raw)) + np.repeat(WINDOW * np.arange(1, len(n) + 1), n)
    gear = np.zeros(len(raw) + WINDOW * len(n), np.uint16)
    gear[put] = _GEAR[raw]
    for k in (1, 2, 4, 8):
        gear[k:] = gear[k:] + (gear[:-k] << np.uint16(k))
    hit = (gear[put] & np.uint16(CUT_BITS)) == 0
    # a cut stands before the next byte, which has to begin a character
    cut = np.zeros(len(raw) + 1, bool)
    cut[1:] = hit
    cut[:-1] &= (raw & 0xC0) != 0x80
    cut[offs] = False  # what a row begins with says nothing of it
    at = np.flatnonzero(cut[:-1])
    # of cuts that crowd, only those that none of the same row precedes within MIN_CHUNK bytes count
    row = np.searchsorted(offs, at, "right")
    return at[np.concatenate([[True], (np.diff(at) >= MIN_CHUNK) | (np.diff(row) > 0)])] if len(at) else at


def chunks(raw: np.ndarray, offs: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all chunks of all rows, and the index of each row's first chunk (one more at the end)."""
    n = np.diff(offs)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    at = _cuts(raw, offs) if cuts is None else cuts
    begin = offs[:-1][n > 0]
    at = np.union1d(at, begin)
    size = np.diff(np.append(at, len(raw)))
    more = (size - 1) // MAX_CHUNK
    if more.any():
        first = np.repeat(at, more + 1)
        step = np.arange(len(first)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
        at = first + step * MAX_CHUNK
        inside = (raw[np.minimum(at, len(raw) - 1)] & 0xC0) == 0x80
        while inside.any():  # forced cuts too stand between characters
            at[inside] -= 1
            inside = (raw[at] & 0xC0) == 0x80
    return at, np.searchsorted(at, offs)


def run_ends(at: np.ndarray, first: np.ndarray, size: int, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of chunks that hold the begins of ``RUN_WORDS`` words: indices of their first chunks, and of the chunks after them.

    ``begin`` has the starts of words; a run's last cut may be the end of its row.
    """
    before = np.searchsorted(begin, np.append(at, size))
    to = np.searchsorted(before, before[:-1] + RUN_WORDS)
    k = np.flatnonzero(to <= np.repeat(first[1:], np.diff(first)))
    return k, to[k]


def run_digests(raw: np.ndarray, at: np.ndarray, k: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Digests of runs of chunks, the same wherever the run stands."""
    if not len(k):
        return np.zeros(0, np.uint64)
    size = np.diff(np.append(at, len(raw)))
    pos = np.arange(len(raw)) - np.repeat(at, size)
    one = mix(np.add.reduceat(_BYTE[raw] * _POS[pos], at) + size.astype(np.uint64))
    up, down = (np.cumprod(np.concatenate([[U(1)], np.full(len(at) - 1, U(b))])) for b in (_BASE, _BACK))
    total = np.concatenate([[U(0)], np.cumsum(one * up)])
    return mix((total[to] - total[k]) * down[k])


def _words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words of all rows."""
    solid = np.zeros(len(raw) + 1, bool)
    solid[:-1] = ~_SPACE[raw]
    begins, ends = solid.copy(), np.zeros(len(raw) + 1, bool)
    begins[1:] &= ~solid[:-1]
    ends[1:] = solid[:-1] & ~solid[1:]
    begins[offs] = solid[offs]
    inner = offs[(offs > 0) & (offs < len(raw))]
    ends[inner] = solid[inner - 1]
    return np.flatnonzero(begins[:-1]), np.flatnonzero(ends)


def word_digests(raw: np.ndarray, offs: np.ndarray, cuts: np.ndarray, at: np.ndarray, first: np.ndarray, words: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest of each ``SPAN`` words in a row that may not hold a whole run of chunks: (row, index of its first word in the row, digest)."""
    begin, end = words
    row = np.searchsorted(offs, begin, "right") - 1
    j = np.flatnonzero(row[: max(0, len(begin) - SPAN + 1)] == row[SPAN - 1 :])
    a, z = begin[j], end[j + SPAN - 1]
    # where the run ends that begins with the first cut that the words' own bytes make
    k, to = run_ends(at, first, len(raw), begin)
    ends = np.full(len(at) + 1, len(raw) + 1)
    ends[k] = np.append(at, len(raw))[to]
    own = np.searchsorted(cuts, a + WINDOW + MIN_CHUNK)
    stop = np.append(ends[np.searchsorted(at, cuts)], len(raw) + 1)
    few = stop[own] > z
    j, a, z = j[few], a[few], z[few]
    text = raw.tobytes() if len(j) else b""
    out = np.array([int.from_bytes(blake2b(text[p:q], digest_size=8).digest(), "little") for p, q in zip(a, z, strict=True)], np.uint64)
    return row[j], j - np.searchsorted(row, row[j]), out


def _bounds(raw: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the digests with these marks begin and end in a text."""
    offs = np.array([0, len(raw)])
    a, z = np.zeros(len(marks), np.int64), np.zeros(len(marks), np.int64)
    begin, end = _words(raw, offs)
    of_words = marks >= WORDS
    if not of_words.all():
        at, first = chunks(raw, offs)
        k, to = run_ends(at, first, len(raw), begin)
        ends = np.zeros(len(at), np.int64)
        ends[k] = np.append(at, len(raw))[to]
        a[~of_words], z[~of_words] = at[marks[~of_words]], ends[marks[~of_words]]
    if of_words.any():
        k = marks[of_words] - WORDS
        a[of_words], z[of_words] = begin[k], end[k + SPAN - 1]
    return a, z


def _firsts(digest: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For every entry, the entry with the same digest in the smallest document, there the first."""
    order = np.lexsort((at, ids, digest))
    d = digest[order]
    start = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
    out = np.empty(len(d), np.int64)
    out[order] = np.repeat(order[start], np.diff(np.append(start, len(d))))
    return out


def _digest_bytes(blocks: int) -> int:
    return 6 if blocks <= FAN else 8


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin and end."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for x in keys:
        new[1:] |= x[1:] != x[:-1]
    head = np.flatnonzero(new)
    return head, np.append(head[1:], n)[: len(head)]


_SENT = ("block", "d", "at", "ids", "crc", "runs", "ecrc", "there")


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), *[pa.binary()] * 7], strict=True)], _SENT)


def _dealt(block: np.ndarray, digest: np.ndarray, at: np.ndarray, ids: np.ndarray, crc: np.ndarray, nbytes: int) -> list[tuple]:
    """A row for each block: digests and places, and the documents with how many digests each has."""
    order = np.lexsort((at, crc, ids, block))
    block, digest, at, ids, crc = (x[order] for x in (block, digest, at, ids, crc))
    out = []
    for s, e in zip(*_groups(block), strict=True):
        heads, ends = _groups(ids[s:e], crc[s:e])
        out.append((int(block[s]), pack(digest[s:e], nbytes), at[s:e].astype("<u4").tobytes(), ids[s:e][heads].astype("<i8").tobytes(), crc[s:e][heads].astype("<u4").tobytes(), (ends - heads).astype("<u4").tobytes(), b"", b""))
    return out


def _documents_of(table: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
    """Document, its checksum and place of each digest."""
    join = lambda c, t: np.frombuffer(b"".join(table[c].to_pylist()), t)
    runs = join("runs", "<u4")
    return [np.repeat(join("ids", "<i8"), runs), np.repeat(join("crc", "<u4"), runs), join("at", "<u4")]


def _marks(docs: DataFrame, blocks: int) -> DataFrame:
    """``doc_id, crc, at, earlier, ecrc, there``: a row for each digest, by the index of its first chunk or word, that an earlier document has, and where."""
    nbytes = _digest_bytes(blocks)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = buffers(batch.column("text"))
            ids = np.asarray(batch.column("doc_id")).astype(np.int64)
            for a, z in spans(offs, TEXT_BYTES):
                text, o = raw[offs[a] : offs[z]], offs[a : z + 1] - offs[a]
                if not len(text):
                    continue
                cuts, words = _cuts(text, o), _words(text, o)
                at, first = chunks(text, o, cuts)
                k, to = run_ends(at, first, len(text), words[0])
                run_row = np.searchsorted(first, k, "right") - 1
                word_row, word, word_digest = word_digests(text, o, cuts, at, first, words)
                at_row = np.concatenate([k - first[run_row], word + WORDS]).astype(np.uint32)
                row, digest = np.concatenate([run_row, word_row]), np.concatenate([run_digests(text, at, k, to), word_digest])
                if not len(row):
                    continue
                own = ids[a:z][row]
                crc = np.array([zlib.crc32(text[o[i] : o[i + 1]]) for i in range(z - a)], np.uint32)[row]
                least = _firsts(digest, own, at_row)
                new = own == own[least]
                rows = _dealt(((digest[new] >> U(32)) % U(blocks)).astype(np.int64) % FAN, digest[new], at_row[new], own[new], crc[new], nbytes)
                if not new.all():  # known repeats go to any block, with where they stand first
                    x = np.flatnonzero(~new)
                    x = x[np.lexsort((at_row[x], row[x]))]
                    heads, ends = _groups(row[x])
                    y = least[x]
                    rows.append((-1 - int((a + ids[a]) % min(blocks, FAN)), own[y].astype("<i8").tobytes(), at_row[x].astype("<u4").tobytes(), own[x][heads].astype("<i8").tobytes(), crc[x][heads].astype("<u4").tobytes(), (ends - heads).astype("<u4").tobytes(), crc[y].astype("<u4").tobytes(), at_row[y].astype("<u4").tobytes()))
                yield _sent(rows)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            digest, ids, crc, at = (np.concatenate(x) for x in zip(*held, strict=True))
            return _sent(_dealt(((digest >> U(32)) % U(blocks)).astype(np.int64), digest, at, ids, crc, nbytes))

        held, n = [], 0
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                one = batch.slice(i, 1)
                if block < 0:
                    yield one
                    continue
                held.append((unpack(one["d"][0].as_py(), nbytes), *_documents_of(one)))
                n += len(held[-1][0])
                if n >= SPLIT:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    def repeats(key: tuple, table: pa.Table) -> pa.Table:
        join = lambda c, t: np.frombuffer(b"".join(table[c].to_pylist()), t)
        ids, crc, at = _documents_of(table)
        if key[0].as_py() < 0:
            earlier, ecrc, there = join("d", "<i8"), join("ecrc", "<u4"), join("there", "<u4")
        else:
            least = _firsts(np.concatenate([unpack(x.as_py(), nbytes) for x in table["d"]]), ids, at)
            keep = ids[least] != ids
            least = least[keep]
            earlier, ecrc, there = ids[least], crc[least], at[least]
            ids, crc, at = ids[keep], crc[keep], at[keep]
        trim()
        return pa.table({"doc_id": pa.array(ids), "crc": pa.array(crc.astype(np.int64)), "at": pa.array(at.astype(np.int32)), "earlier": pa.array(earlier), "ecrc": pa.array(ecrc.astype(np.int64)), "there": pa.array(there.astype(np.int32))})

    kind = "block int, " + ", ".join(f"{c} binary" for c in _SENT[1:])
    sent = docs.where("doc_id is not null and text is not null").select("doc_id", "text").transform(small_batches).mapInArrow(lean(emit), kind)
    if blocks > FAN:
        sent = sent.repartition(FAN, "block").mapInArrow(lean(split), kind)
    return sent.groupBy("block").applyInArrow(repeats, "doc_id long, crc long, at int, earlier long, ecrc long, there int")


def _pieces(marks: pa.ListScalar) -> tuple[np.ndarray, ...]:
    """First and last mark of each piece of a document, the earlier document with its checksum, and the first and last mark there.

    A piece's marks follow each other here and, in one earlier document, there.
    """
    at, earlier, ecrc, there = (marks.values.field(n).to_numpy().astype(np.int64) for n in ("at", "earlier", "ecrc", "there"))
    _, order = np.unique(at, return_index=True)  # rows that repeat a document have the same marks
    at, earlier, ecrc, there = at[order], earlier[order], ecrc[order], there[order]
    s, e = _groups(at - np.arange(len(at)), earlier, ecrc, there - at)
    return at[s], at[e - 1], earlier[s], ecrc[s], there[s], there[e - 1]


_PIECE = ("earlier", "ecrc", "f", "l")


def _asked(marks: DataFrame) -> DataFrame:
    """``doc_id, crc, earlier, ecrc, f, l``: the pieces of a document by where they stand first, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, crc, m in zip(*(batch.column(c) for c in ("doc_id", "crc", "m")), strict=True):
                _, _, earlier, ecrc, f, z = _pieces(m)
                out += [(doc_id.as_py(), crc.as_py(), *x) for x in set(zip(earlier.tolist(), ecrc.tolist(), f.tolist(), z.tolist(), strict=True))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "crc", *_PIECE])

    return marks.transform(small_batches).mapInArrow(lean(run), "doc_id long, crc long, earlier long, ecrc long, f int, l int")


def _places(text: bytes, a: int, z: int) -> set[int]:
    """Where ``text[a:z]`` begins: at ``a`` and, if it says the same again and again, where that ends."""
    last, to = a, text.find(text[a:z], a + 1, 2 * z - a)
    while 0 <= to <= last + z - a:
        last, to = to, text.find(text[a:z], to + 1, to + 2 * (z - a))
    return {a, last}


def _beside(text: bytes, a: int, z: int, begin: np.ndarray) -> tuple[bytes, bytes]:
    """What stands before and after ``text[a:z]``: ``AROUND`` bytes and ``AROUND_WORDS`` words at least."""
    i, j = int(np.searchsorted(begin, a)) - AROUND_WORDS, int(np.searchsorted(begin, z)) + AROUND_WORDS
    low = min(int(begin[i]), a - AROUND) if i >= 0 else 0
    high = max(int(begin[j]), z + AROUND) if j < len(begin) else len(text)
    return text[max(0, low) : a], text[z:high]


def _around(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """``earlier, ecrc, f, l, places``: the text before and after each piece in the document that has it first.

    Where the piece's text is said again and again there are two places, the first and the last time.
    """
    asked = asked.select(*_PIECE).distinct().groupBy("earlier", "ecrc").agg(F.collect_list(F.struct("f", "l")).alias("asked"))
    ids = asked.select("earlier").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    some = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("earlier"), "left_semi")
    both = some.join(asked, (F.col("doc_id") == F.col("earlier")) & (F.crc32(F.col("text").cast("binary")) == F.col("ecrc"))).dropDuplicates(["earlier", "ecrc"])
    kind = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, crc, text, asked in zip(*(batch.column(c) for c in ("earlier", "ecrc", "text", "asked")), strict=True):
                b = text.as_py().encode()
                raw = np.frombuffer(b, np.uint8)
                begin, _ = _words(raw, np.array([0, len(raw)]))
                f, last = (asked.values.field(n).to_numpy() for n in ("f", "l"))
                starts, ends = _bounds(raw, f)[0].tolist(), _bounds(raw, last)[1].tolist()
                for x, y, a, z in zip(f.tolist(), last.tolist(), starts, ends, strict=True):
                    out.append((doc_id.as_py(), crc.as_py(), x, y, [dict(zip(("before", "after"), _beside(b, p, p + z - a, begin), strict=True)) for p in _places(b, a, z)]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), kind), strict=True)], [*_PIECE, "places"])

    return both.select("earlier", "ecrc", "text", "asked").transform(small_batches).mapInArrow(lean(run), "earlier long, ecrc long, f int, l int, places array<struct<before: binary, after: binary>>")


def _agree(a: bytes, b: bytes) -> int:
    """How many bytes two strings share from their starts."""
    n = min(len(a), len(b))
    same = np.frombuffer(a[:n], np.uint8) == np.frombuffer(b[:n], np.uint8)
    return n if same.all() else int(same.argmin())


def _stretches(text: bytes, marks: pa.ListScalar, around: pa.ListScalar, min_words: int) -> list[tuple[int, int, int]]:
    """Byte ranges of whole words that one earlier document holds, and that document; none lies in another one's range.

    Stretches of one document that overlap, as in text that says the same again and again, are one range.
    """
    raw = np.frombuffer(text, np.uint8)
    at, to, earlier, ecrc, f, z = _pieces(marks)
    start, end = _bounds(raw, at)[0], _bounds(raw, to)[1]
    near = {(x["earlier"], x["ecrc"], x["f"], x["l"]): x["places"] for x in around.as_py()}
    space = lambda i: text[i : i + 1].isspace()
    found = set()
    for a0, z0, *key in zip(start.tolist(), end.tolist(), earlier.tolist(), ecrc.tolist(), f.tolist(), z.tolist(), strict=True):
        for place in near.get(tuple(key), ()):
            before, after = place["before"], place["after"]
            a = a0 - _agree(text[max(0, a0 - len(before)) : a0][::-1], before[::-1])
            b = z0 + _agree(text[z0 : z0 + len(after)], after)
            while a < b and a > 0 and not space(a - 1):
                a += 1
            while b > a and b < len(text) and not space(b):
                b -= 1
            if len(text[a:b].split()) >= min_words:
                found.add((key[0], a, b))
    whole: list[tuple[int, int, int]] = []
    for first, a, b in sorted(found):
        if whole and whole[-1][0] == first and a < whole[-1][2]:
            whole[-1] = (first, whole[-1][1], max(b, whole[-1][2]))
        else:
            whole.append((first, a, b))
    out: list[tuple[int, int, int]] = []
    for a, b, first in sorted((a, -b, first) for first, a, b in whole):  # of one range, the smallest document's
        if not out or -b > out[-1][1]:
            out.append((a, -b, first))
    return out


def _marked(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Marks of every document that has some, and the text around its pieces where they stand first."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    marks = scratch.table(_marks(docs, max(16, math.ceil(total / 12 / BLOCK))).groupBy("doc_id", "crc").agg(F.collect_list(F.struct("at", "earlier", "ecrc", "there")).alias("m")), "marks")
    scratch.drop()  # the digests' shuffle files go before texts are shuffled
    asked = scratch.table(_asked(marks), "asked")
    near = asked.join(_around(docs, asked), [*_PIECE]).groupBy("doc_id", "crc").agg(F.collect_list(F.struct(*_PIECE, "places")).alias("e"))
    both = marks.join(near, ["doc_id", "crc"])
    done = scratch.table(both.select(F.col("doc_id").alias("__repeat_id"), F.col("crc").alias("__repeat_crc"), F.col("m").alias("__repeat_at"), F.col("e").alias("__repeat_ends")), "marked")
    scratch.drop(marks, asked)
    return done


def _scratch(docs: DataFrame, min_words: int) -> Scratch:
    if min_words < MIN_WORDS:
        raise ValueError(f"shorter repeats than {MIN_WORDS} words may have no digest")
    return Scratch(docs.sparkSession, "chunk-dedup")


def _joined(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    return docs.join(marks, (F.col("doc_id") == F.col("__repeat_id")) & (F.crc32(F.col("text").cast("binary")) == F.col("__repeat_crc")), how)


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every repeated stretch: ``doc_id, start, length, passage, earlier_doc_id`` (code points; whole words).

    A stretch repeats if one document with a smaller doc_id, ``earlier_doc_id``, holds it; the first document of a passage
    has no row. Stretches of one earlier document that overlap come as one, those of several as they are. Marks of one document on itself don't count.
    Rows with a null doc_id or text are left alone; rows that repeat a doc_id and text come back repeated, as do their
    stretches. ``min_words`` is ``MIN_WORDS`` at least. Marks are written when this is called, the rest is lazy.
    """
    scratch = _scratch(docs, min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, at, earlier in zip(*(batch.column(c) for c in ("doc_id", "text", "__repeat_at", "__repeat_ends")), strict=True):
                b = text.as_py().encode()
                done, chars = 0, 0
                for a, z, first in _stretches(b, at, earlier, min_words):
                    chars += len(b[done:a].decode())
                    done = a
                    passage = b[a:z].decode()
                    out.append((doc_id.as_py(), chars, len(passage), passage, first))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["doc_id", "start", "length", "passage", "earlier_doc_id"])

    found = _joined(docs.select("doc_id", "text"), _marked(docs, scratch), "inner")
    return found.select("doc_id", "text", "__repeat_at", "__repeat_ends").transform(small_batches).mapInArrow(lean(run), "doc_id long, start long, length long, passage string, earlier_doc_id long")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated stretches cut out of ``text``, and ``n_chars`` (if there) counted anew where it was cut.

    Documents of which nothing but white space is left go; all others stay, with all columns.
    """
    scratch = _scratch(docs, min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, at, earlier in zip(*(batch.column(c) for c in ("_text", "__repeat_at", "__repeat_ends")), strict=True):
                if not at.is_valid:
                    out.append(text.as_py())
                    continue
                b = text.as_py().encode()
                kept, done = [], 0
                for a, z, _ in _stretches(b, at, earlier, min_words):
                    kept.append(b[done:a])  # empty where stretches overlap
                    done = z
                left = b"".join([*kept, b[done:]]).decode()
                out.append(left if not kept or left.strip() else None)
            names = [c for c in batch.schema.names if c not in ("_text", "__repeat_at", "__repeat_ends")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.string()), pa.array([x.is_valid for x in batch.column("__repeat_at")], pa.bool_())], [*names, "_text", "_cut"])

    columns = docs.columns
    rows = _joined(docs, _marked(docs, scratch), "left")
    others = [c for c in columns if c != "text"]
    rows = rows.select(F.col("text").alias("_text"), "__repeat_at", "__repeat_ends", *[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(others)])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in ("_text", "__repeat_at", "__repeat_ends"))
    done = rows.transform(small_batches).mapInArrow(lean(run), kinds + ", _text string, _cut boolean").where("_text is not null or not _cut")
    back = {c: F.col(f"_{k}") for k, c in enumerate(others)} | {"text": F.col("_text")}
    if "n_chars" in back:
        back["n_chars"] = F.when(F.col("_cut"), F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(back["n_chars"])
    return done.select(*[back[c].alias(c) for c in columns])
