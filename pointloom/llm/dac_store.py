"""Token ids in directly addressable codes.

An id is split into chunks of ``BITS`` bits, lowest first. Level k holds chunk k of every id that has one, and a bitmap
that says which of them go on at level k + 1; a rank directory counts the bitmap's ones before every block, so the
position of an id at the next level is a lookup and a popcount of less than a block. Any id, or range of ids, is read
without decoding what stands before it.

The store is a folder of rows in Parquet, written and read by Spark alone, so it can be in any file system that Spark
reaches and lost tasks are simply run again. A row is a segment: documents in ascending doc_id order, their ends, and one
coded block of their ids. Segments are ordered by (bucket, before).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import order
from ..plans.scratch import Scratch
from .textbuf import buffers, lean, small_batches, spans
from .tokens import Encoder

BITS, BLOCK_BITS, MAGIC = 8, 512, b"DAC1"
#: Tokens after which a segment ends.
SEGMENT = 1 << 20
TEXT_BYTES = 4 << 20


def encode(ids: np.ndarray) -> bytes:
    """Code unsigned 32-bit ids."""
    out, rest, levels = [], ids.astype(np.uint32), 0
    while True:
        chunk, rest = (rest & np.uint32(0xFF)).astype(np.uint8), rest >> np.uint32(BITS)
        more = rest > 0
        bitmap = np.packbits(more, bitorder="little")
        bitmap = np.concatenate([bitmap, np.zeros(-len(bitmap) % (BLOCK_BITS // 8), np.uint8)])
        ones = np.bitwise_count(bitmap).reshape(-1, BLOCK_BITS // 8).sum(axis=1, dtype=np.int64) if len(bitmap) else np.zeros(0, np.int64)
        rank = (np.cumsum(ones) - ones).astype("<u4")
        last = not more.any()
        out.append(struct.pack("<QB", len(chunk), not last) + chunk.tobytes() + (b"" if last else bitmap.tobytes() + rank.tobytes()))
        levels += 1
        if last:
            break
        rest = rest[more]
    return MAGIC + struct.pack("<B", levels) + b"".join(out)


class Reader:
    """Random access to coded ids."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        self.levels: list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]] = []
        at = 5
        for _ in range(data[4]):
            n, more = struct.unpack_from("<QB", data, at)
            at += 9
            chunk = np.frombuffer(data, np.uint8, n, at)
            at += n
            if not more:
                self.levels.append((chunk, None, None))
                continue
            blocks = -(-n // BLOCK_BITS)
            bitmap = np.frombuffer(data, np.uint8, blocks * BLOCK_BITS // 8, at)
            at += len(bitmap)
            rank = np.frombuffer(data, "<u4", blocks, at)
            at += 4 * blocks
            self.levels.append((chunk, bitmap, rank))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def _rank(self, level: int, i: int) -> int:
        """Ones before bit i."""
        _, bitmap, rank = self.levels[level]
        block, inside = divmod(i, BLOCK_BITS)
        if inside == 0 and block == len(rank):
            block, inside = block - 1, BLOCK_BITS
        at = block * BLOCK_BITS // 8
        whole, odd = divmod(inside, 8)
        ones = int(np.bitwise_count(bitmap[at : at + whole]).sum(dtype=np.int64))
        return int(rank[block]) + ones + (int(bitmap[at + whole] & ((1 << odd) - 1)).bit_count() if odd else 0)

    def read(self, a: int, z: int) -> np.ndarray:
        """Ids a to z - 1."""
        if not 0 <= a <= z <= len(self):
            raise IndexError(f"{a}:{z} of {len(self)}")
        out = np.zeros(z - a, np.uint32)
        who = np.arange(z - a)
        for k, (chunk, bitmap, _) in enumerate(self.levels):
            out[who] |= chunk[a:z].astype(np.uint32) << np.uint32(BITS * k)
            if bitmap is None or a == z:
                break
            bits = np.unpackbits(bitmap[a // 8 : -(-z // 8)], bitorder="little")[a % 8 : a % 8 + z - a]
            who = who[bits.astype(bool)]
            a, z = self._rank(k, a), self._rank(k, z)
        return out

    def __getitem__(self, i: int) -> int:
        return int(self.read(i, i + 1)[0])


def write(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Write the ids of ``docs(doc_id, text, …)``, id 1 after each document, to the folder ``path``.

    A null text is id 1 alone. A null doc_id comes first; rows that repeat a doc_id follow each other by a hash of their
    texts. Texts cross the network once, to the task of their bucket, which reads them in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        bucket, before, doc_ids, sizes, ids, held = None, 0, [], [], [], 0

        def segment() -> pa.RecordBatch:
            all_ids = np.concatenate(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([before], pa.int64()), pa.array([len(all_ids)], pa.int64()), pa.array([pa.concat_arrays(doc_ids).to_pylist()], pa.list_(pa.int64())), pa.array([np.cumsum(np.concatenate(sizes)).astype("<i8").tobytes()], pa.binary()), pa.array([encode(all_ids)], pa.binary())],
                ["bucket", "before", "n_tokens", "doc_ids", "ends", "data"],
            )

        for batch in batches:
            raw, offs = buffers(batch.column("text"))
            b = np.asarray(batch.column("b"))
            for a, z in spans(offs, TEXT_BYTES):
                every, n = encoder.encode(raw[offs[a] : offs[z]], offs[a : z + 1] - offs[a])
                ends = np.concatenate([[0], np.cumsum(n)])
                cut = np.flatnonzero(np.diff(b[a:z])) + 1
                for s, e in zip([0, *cut], [*cut, z - a], strict=True):
                    if bucket is not None and (b[a + s] != bucket or held >= SEGMENT):
                        yield segment()
                        before = before + held if b[a + s] == bucket else 0
                        doc_ids, sizes, ids, held = [], [], [], 0
                    bucket = int(b[a + s])
                    doc_ids.append(batch.column("doc_id").slice(a + s, e - s))
                    sizes.append(n[s:e])
                    ids.append(every[ends[s] : ends[e]])
                    held += int(ends[e] - ends[s])
        if held:
            yield segment()

    at = order.bounds(docs, "doc_id")
    rows = docs.select("doc_id", "text").withColumn("b", order.bucket(F.col("doc_id"), at))
    rows = rows.repartition("b").sortWithinPartitions("b", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows.transform(small_batches).mapInArrow(lean(run), "bucket int, before long, n_tokens long, doc_ids array<long>, ends binary, data binary").write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in a store, from its coded ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, doc_ids, ends, data in zip(*(batch.column(c) for c in ("base", "doc_ids", "ends", "data")), strict=True):
                reader, end = Reader(data.as_py()), np.frombuffer(ends.as_py(), "<i8")
                begin = np.concatenate([[0], end[:-1]])
                crc = [zlib.crc32(reader.read(int(a), int(z)).astype("<u4").tobytes()) for a, z in zip(begin, end, strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(begin + base.as_py()), pa.array(end - begin), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = spark.read.parquet(path)
    ahead = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row for each of at most order.MOST buckets
    base = rows.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).select("bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("bucket_base"))
    rows = rows.join(F.broadcast(base), "bucket").select((F.col("bucket_base") + F.col("before")).alias("base"), "doc_ids", "ends", "data")
    return rows.transform(small_batches).mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write a store to the shared folder and read it back."""
    scratch = Scratch(docs.sparkSession, "dac")
    path = scratch.path("store")
    write(docs, path, tokenizer)
    return read(docs.sparkSession, path)
