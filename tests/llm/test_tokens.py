"""Packing, the token store, sharding and the pipeline."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pointloom.llm import dac_store, packing, ring_shards
from pointloom.llm.tokens import Encoder

from .helpers import documents, prose

PATH = packing.default_tokenizer()


LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [1]


def encode(encoder, texts):
    offs = np.cumsum([0, *(len(t.encode()) for t in texts)])
    return encoder.encode(np.frombuffer("".join(texts).encode(), np.uint8), offs)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aZ é'́ \x1c\x85 \n\t\x0b.,!?19ßΣς<|>endoftxsar\U0001f600"), max_size=40), max_size=6))
def test_piecewise_ids_are_the_librarys(texts):
    ids, count = encode(Encoder.of(PATH), texts)
    assert ids.tolist() == [i for t in texts for i in ids_of(t)]
    assert count.tolist() == [len(ids_of(t)) for t in texts]


def test_dotted_letters_and_marks():
    for mark in ".;!?:,)":
        ids, _ = encode(Encoder.of(PATH), [f"\u0130{mark} a\u0130{mark} \u0130\u0130{mark}"])
        assert ids.tolist() == ids_of(f"\u0130{mark} a\u0130{mark} \u0130\u0130{mark}")


def test_files_with_other_rules_get_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library = Encoder(path), Tokenizer.from_file(path)
    texts = ["two  words, here ", "", "\n one", "a" * 300]
    ids, count = encode(encoder, texts)
    want = [library.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    assert not encoder.by_pieces and Encoder.of(PATH).by_pieces
    assert ids.tolist() == [i for x in want for i in x] and count.tolist() == [len(x) for x in want]


def test_pieces_whose_hashes_are_equal(monkeypatch):
    from pointloom.llm import tokens

    real = tokens.string_hashes
    monkeypatch.setattr(tokens, "string_hashes", lambda raw, offs: (real(raw, offs)[0] % np.uint64(3), real(raw, offs)[1]))
    encoder = Encoder(PATH)
    for text in ["one two three four five six", "seven two nine one", "one three two"]:
        assert encode(encoder, [text])[0].tolist() == ids_of(text)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr("pointloom.llm.tokens.PIECES", 3)
    encoder = Encoder(PATH)
    for text in ["some words here", "", "other words <|endoftext|> here", "some"] * 2:
        assert encode(encoder, [text])[0].tolist() == ids_of(text)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500), st.data())
def test_codes_round_trip(ids, data):
    reader = dac_store.Reader(dac_store.encode(np.array(ids, np.uint32)))
    assert len(reader) == len(ids) and reader.read(0, len(ids)).tolist() == ids
    a = data.draw(st.integers(0, len(ids)))
    z = data.draw(st.integers(a, len(ids)))
    assert reader.read(a, z).tolist() == ids[a:z]
    if ids:
        assert reader[a % len(ids)] == ids[a % len(ids)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def texts_for_tokens():
    rng = random.Random(21)
    return [prose(rng, n) for n in (5, 2500, 1, 700, 90, 6000, 300)] + [None, "", "x" * 5000, "same text"] + ["same text"] * 40 + [prose(rng, rng.randint(1, 900)) for _ in range(60)]


def test_store_reads_back(spark, monkeypatch):
    texts = texts_for_tokens()
    docs = documents(spark, texts)
    want, start = set(), 0
    for i, t in enumerate(texts):
        ids = ids_of(t)
        want.add((i, start, len(ids), crc(ids)))
        start += len(ids)
    for segment, rows in ((1 << 20, 1000), (500, 9)):
        monkeypatch.setattr(dac_store, "SEGMENT", segment)
        monkeypatch.setattr(dac_store.order.bounds, "__defaults__", (rows,))
        assert {tuple(r) for r in dac_store.round_trip(docs, PATH).collect()} == want
    assert dac_store.round_trip(docs.where("false"), PATH).count() == 0


def test_packing(spark):
    texts = texts_for_tokens()
    rows = packing.pack(documents(spark, texts), keep_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids, at = ids_of(t), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            assert np.frombuffer(r.ids, "<u4").tolist() == ids[at : at + r.length]
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    tokens = sum(len(ids_of(t)) for t in texts)
    assert len(by_sequence) * 2048 <= 1.1 * tokens + 2048
    assert packing.pack(documents(spark, texts).where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 400), max_size=20))
def test_plan_takes_every_piece_once(histogram):
    used = Counter()
    for own, n in packing.plan(histogram, 32):
        assert n > 0 and sum(c * m for c, m in own.items()) <= 32
        for c, m in own.items():
            used[c] += m * n
    assert used == Counter(histogram)


def test_nnls():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, x = rng.random((12, 8)), np.maximum(rng.normal(size=8), 0)
        assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
        b = rng.normal(size=12)
        got = packing.nnls(a, b)
        grad = a.T @ (a @ got - b)
        assert (got >= 0).all() and (grad >= -1e-6).all() and abs(grad @ got) < 1e-6


def test_shards(spark):
    rng = random.Random(31)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(3000)] + [None, "", "ü"] + ["copy of the same text"] * 1500
    rows = ring_shards.shard(documents(spark, texts)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        t = texts[r.doc_id]
        assert r.size == len((t or "").encode()) + 8 and r.text_crc32 == zlib.crc32((t or "").encode())
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    mean, most = sum(load.values()) / 24, max(r.size for r in rows)
    assert len(load) == 24 and max(load.values()) <= 1.001 * mean + 2 * most + 1 and min(load.values()) >= 0.97 * mean - 2 * most
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # the ring moves few rows: most stay with the first point clockwise of their hash
    points = ring_shards.ring(24, 128)
    at = {r.doc_id: r.p for r in spark.range(len(texts)).selectExpr("id doc_id", "pmod(xxhash64(id), 4294967296) p").collect()}
    moved = sum(points[ring_shards.arc_of(at[r.doc_id], points)][1] != r.shard for r in rows)
    assert moved < 0.12 * len(rows)
    assert ring_shards.shard(documents(spark, texts).where("false")).count() == 0


def _walked(rows, points, shards, slack):
    """A plain ring with bounded loads over ``(key, arc, size)`` in ring order: shard of each key."""
    room = [math.ceil(sum(n for _, _, n in rows) / shards * (1 + slack))] * shards
    arcs, out = defaultdict(list), {}
    for key, arc, n in rows:
        arcs[arc].append((key, n))
    spans = []
    for arc in sorted(arcs):  # what each arc's own shard takes, in bytes, and what is left over
        load, shard = sum(n for _, n in arcs[arc]), points[arc][1]
        take = min(load, room[shard])
        room[shard] -= take
        spans.append([arc, [(0, take, shard)], take, load])
    for span in spans:
        step = span[0]
        while span[2] < span[3]:
            step = (step + 1) % len(points)
            shard = points[step][1]
            take = min(span[3] - span[2], room[shard])
            if take:
                room[shard] -= take
                span[1].append((span[2], span[2] + take, shard))
                span[2] += take
    for arc, parts, _, _ in spans:
        at = 0
        for key, n in arcs[arc]:
            out[key] = next(s for lo, hi, s in parts if lo <= at < hi)
            at += n
    return out


def test_shards_match_a_plain_ring(spark):
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(0, 40)) for _ in range(800)]
    docs = documents(spark, texts)
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") < 250, 7).when(F.col("doc_id") < 300, F.lit(None)).otherwise(F.col("doc_id")))
    key = ["pmod(xxhash64(doc_id), 4294967296) p", "cast(coalesce(crc32(cast(text as binary)), 0) as long) c"]
    rows = docs.selectExpr("doc_id", "octet_length(text) + 8 n", *key).selectExpr("*", f"pmod(xxhash64(doc_id, c, 1), {ring_shards.PARTS}) part").collect()
    points = ring_shards.ring(24, 128)
    order = sorted(rows, key=lambda r: (ring_shards.arc_of(r.p, points), r.part, r.p, -1 if r.doc_id is None else r.doc_id, r.c))
    want = _walked([((k, r.doc_id, r.c), ring_shards.arc_of(r.p, points), r.n) for k, r in enumerate(order)], points, 24, 0.001)
    got = Counter((r.doc_id, r.text_crc32, r.shard) for r in ring_shards.shard(docs).collect())
    assert got == Counter((i, c, s) for (_, i, c), s in want.items())
    load = Counter()
    for (k, _, _), s in want.items():
        load[s] += order[k].n
    assert max(load.values()) < 1.3 * sum(load.values()) / 24  # however many rows one doc_id has


def test_a_new_shard_moves_few_rows(spark):
    rng = random.Random(9)
    docs = documents(spark, [prose(rng, rng.randint(1, 60)) for _ in range(4000)])
    old, new = ({r.doc_id: r.shard for r in ring_shards.shard(docs, shards=n).collect()} for n in (24, 25))
    moved = [i for i in old if old[i] != new[i]]
    assert len(moved) < 0.12 * len(old) and sum(new[i] != 24 for i in moved) < 0.08 * len(old)


def test_shards_keep_their_bound_for_any_loads():
    points = ring_shards.ring(5, 16)
    for seed in range(20):
        rng = random.Random(seed)
        loads = {a: rng.randint(0, 1000) ** 2 for a in range(len(points)) if rng.random() < 0.8}
        got, taken = ring_shards.plan(loads, [s for _, s in points], 5, 0.001), defaultdict(list)
        use = Counter()
        for arc, lo, hi, shard in got:
            taken[arc].append((lo, hi))
            use[shard] += hi - lo
        assert max(use.values()) <= sum(loads.values()) / 5 * 1.001 + 1
        for arc, load in loads.items():
            edges = sorted(taken[arc])
            assert [a for a, _ in edges] == [0, *[z for _, z in edges[:-1]]][: len(edges)] and (edges[-1][1] if edges else 0) == load


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(41)
    words = [prose(rng, 1) + rng.choice(["", "er", "ing"]) for _ in range(300)] + ["the", "of", "and"] * 30
    own = [prose(rng, 120, words) for _ in range(40)]
    item, passage = prose(rng, 30, words), prose(rng, 60, words)
    texts = own + [own[0], own[1] + " more words", None, "12345 678", f"{prose(rng, 60, words)} {item.upper()} {prose(rng, 40, words)}"]
    texts += [f"{prose(rng, 90, words)} {passage} {prose(rng, 90, words)}" for _ in range(4)]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
            docs = out
            seen.append({r.doc_id: r.text for r in out.collect()})
    every = dict(enumerate(texts))
    assert seen[0] == {i: t for i, t in every.items() if i not in (42, 43)}
    assert seen[1] == {i: t for i, t in seen[0].items() if i not in (40, 41)}
    assert set(seen[2]) == set(seen[1]) and [i for i in seen[2] if seen[2][i] != seen[1][i]] and all(seen[2][i] == seen[1][i] for i in seen[2] if i < 46)
    assert all(passage not in seen[2][i] for i in (46, 47, 48))
    assert seen[3] == {i: t for i, t in seen[2].items() if i != 44}
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] += r.length
    assert got == {i: len(ids_of(t)) for i, t in seen[3].items()}


def test_pipeline_on_nothing(spark, tmp_path):
    import corpus_pipeline

    documents(spark, ["x"]).where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
