"""N-gram join, SpotSigs, decontamination and license scan against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pointloom.llm import decontaminate, license_scan, ngram_join, shingle_sql, spotsigs

from .helpers import ascii_words, components, documents, letter_words, prose, shingles


def corpus(seed):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(3, 120)) for _ in range(40)]
    passage = prose(rng, 60)
    out = list(base)
    for t in base[:20]:  # near copies of several distances, chains of them
        w = t.split()
        for _ in range(rng.randint(1, 4)):
            w = list(w)
            w[rng.randrange(len(w))] = "changed" + str(rng.random())
            out.append(" ".join(w))
    out += [base[3]] * 30 + [base[4].upper(), base[5].replace(" ", "\n  "), None, "", "   ", "one", "ONE", "one two", passage]
    out += [f"{prose(rng, 12)} {passage} {prose(rng, 12)}" for _ in range(25)]
    out += ["wort " * 3000, "ä ö ü", "\U0001f600 word"]
    rng.shuffle(out)
    return out


def linked(a, b):
    return bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    texts = corpus(seed)
    got = {tuple(r) for r in ngram_join.ngram_components(documents(spark, texts)).collect()}
    rows = [(i, shingles(ascii_words(t))) for i, t in enumerate(texts)]
    assert got == components(rows, linked)


def test_blocks_of_a_large_group(spark, monkeypatch):
    """Groups of more n-grams than a row block are split and lose nothing."""
    monkeypatch.setattr(ngram_join, "ROW_BLOCK", 300)
    rng = random.Random(5)
    base = prose(rng, 80).split()
    texts = []
    for _ in range(90):
        w = list(base)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = str(rng.random())
        texts.append(" ".join(w))
    rows = [(i, shingles(ascii_words(t))) for i, t in enumerate(texts)]
    got = {tuple(r) for r in ngram_join.ngram_components(documents(spark, texts)).collect()}
    assert got == components(rows, linked)


def test_columns_dealt_twice(spark, monkeypatch):
    """More blocks than one exchange deals, and ids that are joined instead of broadcast, change nothing."""
    for name, value in (("FAN", 5), ("COLUMN_BLOCK", 40), ("SPLIT", 100), ("BROADCAST_IDS", 0)):
        monkeypatch.setattr(ngram_join, name, value)
    texts = corpus(4)[:90]
    got = {tuple(r) for r in ngram_join.ngram_components(documents(spark, texts)).collect()}
    assert got == components([(i, shingles(ascii_words(t))) for i, t in enumerate(texts)], linked)


def test_links_and_members(spark):
    texts = corpus(3)
    sets = [shingles(ascii_words(t)) for t in texts]
    links, members = ngram_join.ngram_links(documents(spark, texts))
    rep = {}
    for i, s in enumerate(sets):
        rep[i] = min(j for j, o in enumerate(sets) if o == s) if s else i
    assert {(r.doc_id, r.rep) for r in members.collect()} == set(rep.items())
    reps = sorted({rep[i] for i, s in enumerate(sets) if s})
    want = {(a, b, len(sets[a] & sets[b])) for a in reps for b in reps if a < b and linked(sets[a], sets[b])}
    assert {(r.a, r.b, r.overlap) for r in links.collect()} == want


def test_keep_one_keeps_columns_and_odd_rows(spark):
    docs = documents(spark, ["a b c d e f g h", "a b c d e f g h", None, None, "", "z y x w v u t"])
    docs = docs.unionByName(docs.where("doc_id = 5")).unionByName(docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), *docs.columns[1:]).withColumn("text", F.lit("q r s t u v")))
    docs = docs.withColumn("_kept", F.col("source")).withColumn("node", F.col("source")).withColumn("n", F.lit(1))
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect()) == [-1, 0, 2, 3, 4, 5]
    assert ngram_join.keep_one(docs.where("false")).count() == 0


@pytest.mark.parametrize("ids", [0, 500_000])
def test_keep_one_where_ids_repeat(spark, monkeypatch, ids):
    """An id that repeats with another text doesn't keep a copy, and a kept row's id doesn't keep another one's."""
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", ids)
    a, b, c = ("a b c d e f g h", "i j k l m n o p", "q r s t u v w x")
    rows = [(1, a), (2, a), (2, b), (2, b), (3, c), (3, c + " "), (None, b), (None, "y z a b c d"), (None, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, __gone string")
    kept = sorted(((r.doc_id or 0, r.text) for r in ngram_join.keep_one(docs).collect()), key=str)
    assert [x for x in kept if x[0] != 3] == sorted([(1, a), (2, b), (0, "y z a b c d"), (0, None), (4, "")], key=str)
    assert len([x for x in kept if x[0] == 3]) == 1


def test_spotsigs_order_and_edit(spark):
    rng = random.Random(7)
    texts = [prose(rng, n) for n in (50, 3, 200, 1, 80)] + [None, "", "Ünïcode \U0001f600 of the wörld and a täst"] + ["the same text of the day"] * 3
    ids = rng.sample(range(1000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4)
    down = sorted(zip(ids, [t or "" for t in texts]), reverse=True)
    for rows_in_bucket in (1000, 2):
        spotsigs.order.ROWS = rows_in_bucket
        spotsigs.order.bounds.__defaults__ = (rows_in_bucket,)
        got = {r.doc_id: r for r in spotsigs.edit_report(docs).collect()}
        assert len(got) == len(texts)
        for k, (i, t) in enumerate(down):
            nxt = down[(k + 1) % len(down)][1]
            m = len(t) // 3
            want = t[: len(t) - m] + nxt[:m]
            assert got[i].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
            assert got[i].n_chars == len(t)
            assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    spotsigs.order.bounds.__defaults__ = (1000,)
    prints = {}
    for i, t in down:
        assert prints.setdefault(t, got[i].fingerprint) == got[i].fingerprint


@pytest.fixture(scope="module")
def spots(spark):
    """Signatures of a text as tuples."""
    even = {}

    def of(text):
        w = letter_words(text)
        for r in spark.createDataFrame([(x,) for x in set(w) - set(even)], "w string").selectExpr("w", "pmod(hash(w), 2) = 0 e").collect():
            even[r.w] = r.e
        anchors = set(spotsigs.ANCHORS)
        content = [k for k, x in enumerate(w) if x not in anchors]
        out = {(x,) for x in w} if len(w) < spotsigs.SHORT else set()
        for c in range(len(content) - 1):
            chain = (w[content[c]], w[content[c + 1]])
            a = content[c] - 1
            if c >= spotsigs.BARE and content[c] - content[c - spotsigs.BARE] == spotsigs.BARE and even[chain[0]]:
                out.add(("", *chain))
            while a >= 0 and w[a] in anchors:
                out.add((w[a], *chain))
                a -= 1
        return out or ({tuple(w)} if w else set())

    return of


def test_spot_likeness_is_jaccard(spark, spots):
    rng = random.Random(8)
    words = ["the", "of", "and"] + [f"w{k}" for k in range(12)]
    bare = [f"w{k}" for k in range(12)]
    a, b = [prose(rng, n, words) for n in (40, 60, 90, 10)] + [prose(rng, 60, bare), "x y z"], [prose(rng, n, words) for n in (50, 60, 70, 12)] + [prose(rng, 60, bare), "x y"]
    df = spark.createDataFrame(list(zip(a, b)), "x string, y string")
    df = spotsigs.with_signatures(spotsigs.with_signatures(df, "x", "s"), "y", "t")
    for r in df.select("x", "y", "s", spotsigs.likeness("s", "t").alias("j")).collect():
        p, q = spots(r.x), spots(r.y)
        assert len(r.s) == len(p)
        assert r.j == pytest.approx(len(p & q) / len(p | q))


def test_spot_near_duplicates(spark, spots):
    rng = random.Random(9)
    words = ["the", "of", "and"] * 8 + [f"w{k}" for k in range(40)]
    texts = [prose(rng, rng.randint(20, 90), words) for _ in range(25)]
    for t in texts[:15]:
        w = t.split()
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = "x" + str(rng.randint(0, 9))
        texts.append(" ".join(w))
    texts += [texts[0]] * 3 + [None, "", "lonely"]
    links, members = spotsigs.near_duplicates(documents(spark, texts), 0.6)
    sets = [spots(t) for t in texts]
    rep = {i: min(j for j, o in enumerate(sets) if o == s) if s else i for i, s in enumerate(sets)}
    assert {(r.doc_id, r.rep) for r in members.collect()} == set(rep.items())
    reps = sorted({rep[i] for i, s in enumerate(sets) if s})
    want = {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in links.collect()} == want


def test_decontamination_matches_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    items = [prose(rng, n) for n in (30, 40, 12, 5, 4, 2, 60)] + [None, "", "!!"]
    texts = [prose(rng, 50) for _ in range(15)] + [None, "", items[4], "A, " + items[5].upper() + "!"]
    for k, t in enumerate(items[:7]):
        w = t.split()
        texts += [f"{prose(rng, 200)}. {t.upper()}! {prose(rng, 90)}", " ".join(w[: max(1, len(w) * 3 // 5)]), " ".join(w[: max(1, len(w) * 9 // 10)])]
    texts += [texts[-1]] * 5
    docs = documents(spark, texts)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = set()
    for i, t in enumerate(texts):
        w = letter_words(t)
        for j, x in enumerate(items):
            v = letter_words(x)
            own = shingles(v)
            if own:
                n = min(5, len(v))
                has = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
                if len(own & has) >= 0.75 * len(own):
                    want.add((i, j, len(own & has)))
    for limit in (20_000, 3):
        monkeypatch.setattr(shingle_sql, "LITERALS", limit)
        got = {(r.doc_id, r.item_id, r.matched) for r in decontaminate.contaminated(docs, bench).collect()}
        assert got == want
    monkeypatch.setattr(shingle_sql, "LITERALS", 20_000)
    docs = docs.withColumn("_bad", F.col("source")).withColumn("t", F.col("source")).withColumn("w", F.col("source")).withColumn("item_id", F.lit(0))
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == set(range(len(texts))) - {i for i, _, _ in want}
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0
    assert decontaminate.contaminated(docs.where("false"), bench).count() == 0


def test_decontamination_where_items_repeat(spark):
    """An item that is listed twice counts once, and texts that share an id are items of their own."""
    rng = random.Random(17)
    one, two = prose(rng, 20), prose(rng, 20)
    half = " ".join(one.split()[:12])
    docs = documents(spark, [half, f"{prose(rng, 30)} {one}", f"{two} {prose(rng, 9)}", f"{one} {two}", f"{half} {' '.join(two.split()[:12])}"])
    bench = spark.createDataFrame([(7, one), (7, one), (7, one.upper()), (8, one), (7, two), (None, two)], "item_id long, text string")
    n, m = (len(shingles(letter_words(t))) for t in (one, two))
    got = sorted((tuple(r) for r in decontaminate.contaminated(docs, bench).collect()), key=str)
    want = {(1, 7, 1.0, n, n), (1, 8, 1.0, n, n), (2, 7, 1.0, m, m), (2, None, 1.0, m, m), (3, 7, 1.0, n, n), (3, 8, 1.0, n, n), (3, 7, 1.0, m, m), (3, None, 1.0, m, m)}
    assert got == sorted(want, key=str)
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {0, 4}


@pytest.mark.parametrize("literals", [20_000, 3])
def test_license_scan(spark, monkeypatch, literals):
    monkeypatch.setattr(shingle_sql, "LITERALS", literals)
    rng = random.Random(13)
    long_one = dict(license_scan.TEMPLATES)["mit-grant"]
    w = long_one.split()
    w[10] = "changed"
    texts = [prose(rng, 30), f"{prose(rng, 500)}\nAll rights reserved.", None, "", f"x {long_one} y", " ".join(w), " ".join(w[:8]), "LICENSED under the Apache license version 2.0", "all rights"]
    got = {(r.doc_id, r.license_id): r.containment for r in license_scan.scan(documents(spark, texts)).collect()}
    assert got[(1, "all-rights-reserved")] == 1 and got[(4, "mit-grant")] == 1 and got[(7, "apache-2.0-notice")] == 1
    assert {k for k in got} == {(1, "all-rights-reserved"), (4, "mit-grant"), (7, "apache-2.0-notice")} | ({(5, "mit-grant")} if (5, "mit-grant") in got else set())
    every = shingles(letter_words(long_one))
    share = len(every & shingles(letter_words(" ".join(w)))) / len(every)
    assert ((5, "mit-grant") in got) == (share >= 0.75)
    assert license_scan.scan(documents(spark, texts).where("false")).count() == 0
