"""Language identification by prediction by partial matching.

One variable-order byte context tree per language, of order ``ORDER``: a byte costs ``-log2(n / (N + q))`` bits in the
longest context that has seen it and each longer context that hasn't costs its escape ``-log2(q / (N + q))``, where a
context was seen ``N`` times with ``q`` different successors; a byte that is new to order 0 costs 8 bits more. The counts
are frozen after training, so a text's code length is a sum over its bytes of a function of ``ORDER + 1`` bytes. That
function is tabulated for the frequent byte pairs and computed from the trees for all others; both give the same bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textbuf import buffers, lean, small_batches, spans, trim

ORDER = 3
#: The bound of the training sample: so many whole documents of a language, and so many bytes of all of them together.
SAMPLE_DOCS, SAMPLE_BYTES = 400, 2 << 20
#: Numbers in the table of code lengths, of 4 bytes each.
TABLE_CELLS = 4_000_000
#: A text whose best code takes more bits a byte than this, its own length, is in none of the learned languages.
STRANGE_BITS = 8.0
UNDETERMINED = "und"
TEXT_BYTES = 1 << 20


@dataclass
class Tree:
    """Context counts of one language: for each order the contexts with (N, q), and contexts with a byte with n."""

    contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    grams: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def grow(code: np.ndarray) -> Tree:
        contexts, grams = [], []
        for order in range(ORDER + 1):
            gram, n = np.unique(code & np.uint32((1 << 8 * (order + 1)) - 1), return_counts=True)
            ctx = gram >> np.uint32(8)
            start = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
            contexts.append((ctx[start], np.add.reduceat(n, start).astype(np.float64), np.diff(np.append(start, len(ctx))).astype(np.float64)))
            grams.append((gram, n.astype(np.float64)))
        return Tree(contexts, grams)

    def bits(self, code: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each gram, given the bytes before it."""
        out = np.zeros(len(code))
        open_ = np.ones(len(code), bool)
        for order in range(ORDER, -1, -1):
            gram = code & np.uint32((1 << 8 * (order + 1)) - 1)
            ctx = gram >> np.uint32(8)
            keys, total, kinds = self.contexts[order]
            at = np.minimum(np.searchsorted(keys, ctx), len(keys) - 1)
            known = keys[at] == ctx
            grams, n = self.grams[order]
            to = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
            seen = grams[to] == gram
            whole = np.log2(total[at] + kinds[at])
            hit = open_ & known & seen
            out[hit] += (whole - np.log2(n[to]))[hit]
            miss = open_ & known & ~seen
            out[miss] += (whole - np.log2(kinds[at]))[miss]
            open_ &= ~hit
        out[open_] += 8
        return out


def _codes(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Each byte with the ``ORDER`` bytes before it, as one number; blanks stand before a text."""
    n = np.diff(offs)
    room = np.full(len(raw) + ORDER * len(n), 32, np.uint8)
    put = np.arange(len(raw)) + np.repeat(ORDER * np.arange(1, len(n) + 1), n)
    room[put] = raw
    code = room[put].astype(np.uint32)
    for k in range(1, ORDER + 1):
        code |= room[put - k].astype(np.uint32) << np.uint32(8 * k)
    return code


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return buffers(pc.utf8_lower(column))


@dataclass
class Model:
    langs: list[str]
    trees: list[Tree]
    pair: np.ndarray
    table: np.ndarray

    @staticmethod
    def train(samples: dict[str, list[str]]) -> Model:
        langs, trees, pairs = [], [], np.zeros(1 << 16, np.int64)
        for lang in sorted(samples):
            code = _codes(*_lowered(pa.array(samples[lang], pa.large_string())))
            if len(code):
                langs.append(lang)
                trees.append(Tree.grow(code))
                pairs += np.bincount(code & np.uint32(0xFFFF), minlength=1 << 16)
        pair, table = np.full(1 << 16, -1, np.int32), np.zeros((0, len(langs)), np.float32)
        if langs:
            most = max(1, int((TABLE_CELLS / len(langs)) ** 0.5))
            often = np.argsort(-pairs, kind="stable")[:most]
            often = np.sort(often[pairs[often] > 0])
            pair[often] = np.arange(len(often))
            table = np.empty((len(often) ** 2, len(langs)), np.float32)
            for a, high in enumerate(often):
                code = (np.uint32(high) << np.uint32(16)) | often.astype(np.uint32)
                for k, tree in enumerate(trees):
                    table[a * len(often) : (a + 1) * len(often), k] = tree.bits(code)
        return Model(langs, trees, pair, table)

    def lengths(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Bits of every text in every language."""
        rows = len(offs) - 1
        code = _codes(raw, offs)
        wide = int(self.pair.max()) + 1
        high, low = self.pair[code >> np.uint32(16)], self.pair[code & np.uint32(0xFFFF)]
        odd = (high < 0) | (low < 0)
        bits = self.table[np.where(odd, 0, high.astype(np.int64) * wide + low)]
        if odd.any():
            rare, at = np.unique(code[odd], return_inverse=True)
            bits[odd] = np.stack([t.bits(rare) for t in self.trees], axis=1)[at]
        out = np.zeros((rows, len(self.langs)))
        full = np.flatnonzero(np.diff(offs))
        if len(full):
            out[full] = np.add.reduceat(bits, offs[:-1][full], axis=0, dtype=np.float64)
        return out


def fit(docs: DataFrame) -> Model:
    """Train on labelled rows whose ``crc32(doc_id) mod 4`` isn't 2, in a sample of whole texts.

    The rows of a language are taken by a hash of their doc_id, ``SAMPLE_DOCS`` at most, as long as their texts have
    ``SAMPLE_BYTES`` together; texts longer than an eighth of that come last, and the first one is taken in any case.
    Without labelled rows the model has no language.
    """
    rows = docs.where("doc_id is not null and lang is not null and text is not null").where(~held_out()).select("lang", "text", F.xxhash64("doc_id").alias("_h"), F.octet_length("text").cast("long").alias("_n"))
    rows = rows.withColumn("_long", F.col("_n") > SAMPLE_BYTES // 8)
    counts = {(r.lang, r._long): r.n for r in rows.groupBy("lang", "_long").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model.train({})
    # a little more than the sample by threshold, so that no window sees all rows of a language
    share = F.create_map(*[x for (lang, long), n in counts.items() for x in (F.concat_ws(" ", F.lit(long).cast("string"), F.lit(lang)), F.lit(min(1.0, (50.0 if long else 2.0 * SAMPLE_DOCS + 100) / n)))])
    some = rows.where(F.pmod("_h", F.lit(1 << 30)) < share[F.concat_ws(" ", F.col("_long").cast("string"), "lang")] * (1 << 30))
    by = Window.partitionBy("lang").orderBy("_long", "_h", "_n", F.xxhash64("text"))
    first = some.withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= SAMPLE_DOCS)
    upto = F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = first.withColumn("_upto", upto).where((F.col("_k") == 1) | (F.col("_upto") <= SAMPLE_BYTES))
    samples: dict[str, list[str]] = {}
    for r in first.select("lang", "text").orderBy("lang", "text").collect():
        samples.setdefault(r.lang, []).append(r.text)
    model = Model.train(samples)
    trim()
    return model


def held_out() -> F.Column:
    """Whether a row is kept from training; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, bits_per_byte`` of every row; the k-th column named in ``keep`` comes as ``_k``.

    ``score`` is the share of ``2 ** -bits`` that the best language has. A null text, one without a letter, or any text if
    no language was learned, is ``und`` with score 0 and null bits. Ties go to the first language by name.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in batches:
            text = batch.column("_text")
            raw, offs = _lowered(text)
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            names = [c for c in batch.schema.names if c != "_text"] + texts
            rest = [batch.column("_text" if c in texts else c) for c in names]
            for a, z in spans(offs, TEXT_BYTES):
                lang, score, per = np.full(z - a, UNDETERMINED, object), np.zeros(z - a), np.full(z - a, np.nan)
                if m.langs:
                    bits = m.lengths(raw[offs[a] : offs[z]], offs[a : z + 1] - offs[a])
                    best = bits.min(axis=1)
                    ok = letters[a:z]
                    lang[ok] = np.array(m.langs, object)[bits.argmin(axis=1)][ok]
                    score[ok] = (1 / np.exp2(best[:, None] - bits).sum(axis=1))[ok]
                    per[ok] = (best / np.maximum(np.diff(offs[a : z + 1]), 1))[ok]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, z - a) for c in rest), pa.array(lang, pa.string()), pa.array(score), pa.array(per, mask=np.isnan(per))],
                    [*names, "lang_pred", "score", "bits_per_byte"],
                )

    texts = [f"_{k}" for k, c in enumerate(keep) if c == "text"]  # the text goes to Python once
    rows = docs.select(F.col("text").alias("_text"), "doc_id", held_out().alias("held_out"), *[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(keep) if c != "text"])
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text"] + [f"{c} string" for c in texts])
    return rows.transform(small_batches).mapInArrow(lean(run), kinds + ", lang_pred string, score double, bits_per_byte double")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the labelled rows and predict all rows: ``doc_id, held_out, lang_pred, score``."""
    return predict(docs, fit(docs)).drop("bits_per_byte")


def accepted(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns as they are, without those in no learned language.

    A row is rejected if it is ``und`` or if its best code takes more than ``STRANGE_BITS`` bits a byte. Without labelled
    rows nothing is known of languages and only texts without a letter are rejected.
    """
    model = fit(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    columns = docs.columns
    kept = predict(docs, model, columns).where((F.col("lang_pred") != UNDETERMINED) & (F.col("bits_per_byte") <= STRANGE_BITS))
    return kept.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(columns)])
