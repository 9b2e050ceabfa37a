"""Vectorised word and shingle hashing over the byte buffers of Arrow string columns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U = np.uint64
_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_POS = _rng.integers(1, 2**63, 1 << 16, dtype=np.uint64) | U(1)
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) | U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Rows that go to Python at once; Spark's default of 10,000 is made for narrow rows and not for texts.
ROWS = 1500
#: Bytes of text that are hashed at once.
SLICE = 1 << 20


def trim() -> None:
    """Give memory that is free inside of this process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session was told to send at most ``ROWS`` rows to Python at once."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ROWS:
        conf.set(key, str(ROWS))
    return df


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``; the worker, which goes on to other tasks, keeps no free memory after it."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising mixer of 64-bit hashes."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def spans(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes together, a longer row alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def _piece_words(b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of ``b``; ``first`` marks bytes that begin a row."""
    solid = ~_SPACE[b]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    lead = np.zeros(len(b), np.int64)
    lead[starts] = starts
    np.maximum.accumulate(lead, out=lead)
    pos = np.arange(len(b)) - lead
    v = _BYTE[_LOWER[b]] * _POS[pos & 0xFFFF] + (pos >> 16).astype(np.uint64)
    v = np.where(solid, v ^ (v >> U(31)), U(0))
    v[: starts[0]] = 0
    return starts, mix(np.add.reduceat(v, starts))


def string_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each string, none of which is empty."""
    n = np.diff(offsets)
    if not len(n):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    pos = np.arange(len(raw)) - np.repeat(offsets[:-1], n)
    v = _BYTE[raw] * _POS[pos & 0xFFFF] + (pos >> 16).astype(np.uint64)
    own = n.astype(np.uint64) * _STEP[11]
    other = (v ^ (v >> U(29))) * _STEP[12]
    return mix(np.add.reduceat(v ^ (v >> U(31)), offsets[:-1]) + own), np.add.reduceat(other ^ (other >> U(32)), offsets[:-1])


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row index and hash of every word, in order; words are runs of bytes other than white space, A-Z lower-cased."""
    n = len(raw)
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    first = first[:n]
    at, starts, hashes = 0, [], []
    while at < n:
        to = min(at + SLICE, n)
        if to < n:  # end where a word can't go on
            cut = np.flatnonzero(_SPACE[raw[at + 1 : to]])
            if len(cut):
                to = at + 1 + int(cut[-1])
            else:
                while to < n and not (_SPACE[raw[to]] or first[to]):
                    more = np.flatnonzero(_SPACE[raw[to : to + SLICE]] | first[to : to + SLICE])
                    to = to + int(more[0]) if len(more) else min(n, to + SLICE)
        s, h = _piece_words(raw[at:to], first[at:to])
        starts.append(s + at)
        hashes.append(h)
        at = to
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    s = np.concatenate(starts)
    return np.searchsorted(offsets, s, "right") - 1, np.concatenate(hashes)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending within the row: (hashes, bounds of rows, row of each hash).

    A row with fewer than ``width`` words has its whole word sequence as its one shingle; a row without words has none.
    """
    rows = len(offsets) - 1
    doc, w = words(raw, offsets)
    count = np.bincount(doc, minlength=rows)
    begin = np.concatenate([[0], np.cumsum(count)])
    with np.errstate(over="ignore"):
        if len(w) >= width:
            full = doc[: len(doc) - width + 1] == doc[width - 1 :]
            h = np.zeros(len(full), np.uint64)
            for j in range(width):
                h += w[j : j + len(full)] * _STEP[j]
            h, d = mix(h[full]), doc[: len(full)][full]
        else:
            h, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short):
            own = np.zeros(len(short), np.uint64)
            for j in range(width - 1):
                has = count[short] > j
                own[has] += w[begin[short[has]] + j] * _STEP[j]
            h = np.concatenate([h, mix(own + count[short].astype(np.uint64) * _STEP[width + 1])])
            d = np.concatenate([d, short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(rows + 1)), d


def set_digests(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit digest of each row's set, the same for equal sets; 0 for empty ones."""
    n = np.diff(bounds)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    with np.errstate(over="ignore"):
        if len(full):
            out[full] = mix(np.add.reduceat(mix(h ^ U(0x9E3779B97F4A7C15)), bounds[:-1][full]) + n[full].astype(np.uint64) * _STEP[9])
    return out


def pack(x: np.ndarray, nbytes: int) -> bytes:
    """The low ``nbytes`` bytes of each 64-bit number."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :nbytes].tobytes()


def unpack(data: bytes, nbytes: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, nbytes)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :nbytes] = raw
    return out.reshape(-1).view("<u8").astype(np.uint64)
