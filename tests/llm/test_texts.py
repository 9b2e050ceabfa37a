"""Language ID, HTML extraction and substring dedup."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pointloom.llm import block_html, chunk_dedup, ppm_langid

from .helpers import documents, prose

VOCAB = {
    "en": "the of and house water night reading with that other thing through would".split(),
    "de": "der die und haus wasser nacht lesen mit dass andere sache durch würde straße".split(),
    "fr": "le la et maison eau nuit lire avec que autre chose travers voudrait été".split(),
}


def ppm_bits(samples, text):
    """Code length by counting dictionaries, one byte at a time."""
    counts = Counter()
    for s in samples:
        b = b"   " + s.lower().encode()
        for i in range(3, len(b)):
            for k in range(4):
                counts[b[i - k : i], b[i]] += 1
    contexts = {}
    for (c, x), n in counts.items():
        t, q = contexts.get(c, (0, 0))
        contexts[c] = (t + n, q + 1)
    b, bits = b"   " + text.lower().encode(), 0.0
    for i in range(3, len(b)):
        for k in (3, 2, 1, 0):
            c = b[i - k : i]
            if c in contexts:
                t, q = contexts[c]
                if (c, b[i]) in counts:
                    bits -= math.log2(counts[c, b[i]] / (t + q))
                    break
                bits -= math.log2(q / (t + q))
        else:
            bits += 8
    return bits


def test_code_lengths_match_a_plain_coder(monkeypatch):
    rng = random.Random(3)
    samples = {k: [prose(rng, 40, v) for _ in range(5)] for k, v in VOCAB.items()}
    texts = [prose(rng, 20, VOCAB["de"]), "", "Ω≈ç zzz 123", "the water und maison"]
    for cells in (10_000_000, 300):  # with few cells most pairs go by the trees
        monkeypatch.setattr(ppm_langid, "TABLE_CELLS", cells)
        model = ppm_langid.Model.train(samples)
        raw, offs = ppm_langid._lowered(pa.array(texts))
        got = model.lengths(raw, offs)
        want = np.array([[ppm_bits(samples[lang], t) for lang in model.langs] for t in texts])
        assert np.allclose(got, want, rtol=1e-4)


def test_language_of_held_out_rows_and_odd_rows(spark):
    rng = random.Random(4)
    langs = [rng.choice(list(VOCAB)) for _ in range(120)]
    texts = [prose(rng, 30, VOCAB[x]) for x in langs] + [None, "", "123 !!", "Привет мир это русский текст " * 5]
    docs = documents(spark, texts, dict(enumerate(langs + [None] * 4)))
    got = {r.doc_id: r for r in ppm_langid.identify(docs).collect()}
    for i, lang in enumerate(langs):
        assert got[i].lang_pred == lang and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= got[i].score <= 1
    assert [got[i].lang_pred for i in (120, 121, 122)] == ["und"] * 3
    clash = docs.withColumn("score", docs.doc_id).withColumn("lang_pred", docs.lang)
    kept = ppm_langid.accepted(clash)
    assert kept.columns == clash.columns
    assert {r.doc_id for r in kept.collect()} == set(range(120))
    assert {r.lang_pred for r in ppm_langid.identify(docs.withColumn("lang", docs.source.substr(9, 1)).where("false")).collect()} == set()
    unlabelled = ppm_langid.identify(docs.drop("lang").selectExpr("*", "cast(null as string) as lang"))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_sample_is_of_whole_texts_and_bounded(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(ppm_langid, "SAMPLE_BYTES", 4000)
    monkeypatch.setattr(ppm_langid, "SAMPLE_DOCS", 20)
    monkeypatch.setattr(ppm_langid.Model, "train", staticmethod(lambda samples: seen.update(samples) or ppm_langid.Model([], [], None, None)))
    rng = random.Random(6)
    texts = [prose(rng, rng.choice([5, 40])) for _ in range(400)] + ["word " * 2000] * 5 + ["mot " * 3000] * 9
    langs = ["en" if i < 200 else "de" if i < 400 else "en" if i < 405 else "fr" for i in range(414)]
    ppm_langid.fit(documents(spark, texts, dict(enumerate(langs))))
    assert set(seen) == {"en", "de", "fr"} and set().union(*seen.values()) <= set(texts)
    for lang in ("en", "de"):
        assert 10 <= len(seen[lang]) <= 20 and sum(map(len, seen[lang])) <= 4000
    assert seen["fr"] == ["mot " * 3000]


PAGE = """<!DOCTYPE html><html lang=en><head><title>No</title><style>p{margin:0}</style><script>var t="</p><p>no";</script></head>
<body class="has-sidebar"><header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use the cookies of this site.</div><form>Search <button>Go</button></form>
<article><h1>Title &amp; more</h1><p>First   <b>para<br>graph</b>&nbsp;here.<p>Second one</p><div class="ad">Buy now</div><p>Third &lt;3
<aside>See also</aside><section id="comments"><article><p>A reader says the thing.</p></article></section></article><footer>&copy; x"""


def test_html_article():
    assert block_html.main_text(PAGE) == "Title & more\n\nFirst para graph here.\n\nSecond one\n\nThird <3"


def test_html_two_passes():
    long = "the cat of the house and the dog of the street are in the garden with the others and they stay there. " * 2
    page = f'<body><div><a href=x>Home</a> <a href=y>News</a></div><h1>Heading</h1><p>{long}</p><p>Short one.</p><p>{long}</p><div class="comments"><p>{long}</p></div><ul><li><a href=z>More of the same and the others that there are</a></ul>'
    want = " ".join(long.split())
    assert block_html.main_text(page) == f"Heading\n\n{want}\n\nShort one.\n\n{want}"


def test_html_body_beside_or_partly_in_an_article():
    long = "the cat of the house and the dog of the street are in the garden with the others and they stay there. " * 2
    want = " ".join(long.split())
    teaser = '<article class="card"><h3><a href="x">Another story</a></h3><p>Read it <a href="x">here now</a></p></article>'
    page = f"<body><nav>Home</nav><div><p>{long}</p></div><div>Short one.</div><div><p>{long}</p></div>{teaser}<footer>Us</footer>"
    assert block_html.main_text(page) == f"{want}\n\nShort one.\n\n{want}"
    partly = f"<body><nav>Home</nav><article><h1>Title</h1><p>{long}</p><p>A note</p></article><div><p>{long}</p></div><footer>{long}</footer>"
    assert block_html.main_text(partly) == f"Title\n\n{want}\n\nA note\n\n{want}"
    listed = f"<article><p>{long}</p><li><a href=x>More of it</a></li><li>Of us</li><li><a href=y>More of them</a></li></article>"
    assert block_html.main_text(listed) == want


@pytest.mark.parametrize(
    "name, boiler",
    [("ad", True), ("comment-body", True), ("sidebar-content", True), ("entry-comments", True), ("site-header", True), ("article-header", False), ("content sidebar-right", False), ("post", False)]
    + [("content-with-sidebar", False), ("shadow", False), ("download", False), ("cookieNotice", True), ("main-menu", True), ("ad-container", True), ("", False), ("has-nav", False), ("leading", False)],
)
def test_names_of_boilerplate(name, boiler):
    assert bool(block_html._boiler_name(name, 0)) == boiler


LONG = "the cat of the house and the dog of the street are in the garden with the others and they stay there. " * 2
WANT = " ".join(LONG.split())


def test_html_names_that_mislead():
    """No name empties a page or takes a paragraph of an article."""
    form = f'<body><form id="aspnetForm"><nav><a href=x>Home</a></nav><h1>Title</h1><p>{LONG}</p><p>Short one.</p><button>Go</button></form><footer>Us</footer>'
    assert block_html.main_text(form) == f"Title\n\n{WANT}\n\nShort one."
    bare = f"<body><form><p>{LONG}</p></form>"
    assert block_html.main_text(bare) == WANT
    review = f'<body><div class="review"><article><h1>Film</h1><p>{LONG}</p></article><div class="comments"><p>{LONG}</p></div></div>'
    assert block_html.main_text(review) == f"Film\n\n{WANT}"
    story = f'<body><div id="story"><h1>Top</h1><p>{LONG}</p><p>{LONG}</p></div><article class="teaser"><a href="x">Next story</a></article>'
    assert block_html.main_text(story) == f"Top\n\n{WANT}\n\n{WANT}"
    named = f'<article><p>{LONG}</p><p class="social-history">{LONG}</p><p id="popular-culture">{LONG}</p><p>© of {LONG}</p></article>'
    assert block_html.main_text(named).count("\n\n") == 3
    plain = f"<body><div><p>{LONG}</p><p>© {LONG}</p></div><div>© us</div>"
    assert block_html.main_text(plain) == f"{WANT}\n\n© {WANT}"
    comments = f'<body><div class="comments"><article><p>{LONG}</p></article></div>'
    assert block_html.main_text(comments) == ""


def test_html_neighbours_in_the_same_element_come_first():
    page = f"<body><ul><li><a href=x>Home</a></li></ul><div><h2>Title</h2><p>Short one</p><p>{LONG}</p><p>One</p><p>two</p></div><div><a href=y>More</a> us</div>"
    assert block_html.main_text(page) == f"Title\n\nShort one\n\n{WANT}\n\nOne\n\ntwo"


def _two_passes(html):
    """The block rules without names or elements, on a flat list of paragraphs."""
    found = [(" ".join(x.split()), "<a" in x) for x in re.findall(r"<p>(.*?)</p>", html)]
    label = []
    for text, links in found:
        text = re.sub("<[^>]*>", "", text)
        w = re.findall(r"[^\W\d_]+", text.lower())
        share = sum(x in block_html.STOP_WORDS for x in w) / max(1, len(w))
        label.append(-1 if links else 0 if len(text) < 70 else 1 if share >= 0.22 else 0 if share >= 0.1 or text[-1] in ".!?" else -1)
    out = []
    for i, x in enumerate(label):
        near = min(abs(i - j) for j in range(len(label)) if label[j])
        known = {label[j] for j in range(len(label)) if label[j] and abs(i - j) == near}
        out.append(x or (known.pop() if len(known) == 1 else 1 if found[i][0][-1] in ".!?" else -1))
    return "\n\n".join(t for (t, _), x in zip(found, out) if x > 0)


def test_html_rules_match_a_plain_version():
    rng = random.Random(41)
    words = ["cat", "dog", "house", "tree", "water", "stone"]
    for _ in range(300):
        parts = [f"<p>{LONG}</p>"]
        for _ in range(rng.randint(0, 9)):
            n, share = rng.choice([3, 8, 30, 60]), rng.choice([0, 0.15, 0.5])
            text = " ".join(rng.choice(["the", "of", "and"]) if rng.random() < share else rng.choice(words) for _ in range(n)) + rng.choice([".", ""])
            parts.append(f"<p>{text}</p>" if rng.random() < 0.8 else f"<p><a href=x>{text}</a></p>")
        parts.append(f"<p>{LONG}</p>")  # the ends of a page count as boilerplate, so both are decided
        assert block_html.main_text("<body>" + "".join(parts)) == _two_passes("".join(parts))


def test_html_pages_without_names():
    """Test pages give what they give without class names and with plain divs for articles, but for few of them."""
    import pyarrow.parquet as pq

    same = total = 0
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        plain = re.sub(r"\s(class|id|role|itemprop)=\"[^\"]*\"", "", re.sub(r"<(/?)(?:article|main)\b[^>]*>", r"<\1div>", page or ""))
        a, b = block_html.main_text(page).split("\n\n"), block_html.main_text(plain).split("\n\n")
        # an advert that nothing names and that reads like prose is prose
        total += 1
        same += a == b or a == b[1:]
    assert same >= 0.95 * total


def test_html_deep_pages_take_linear_time():
    n = 30_000
    assert block_html.main_text("<div>" * n + f"<p>{LONG}</p>" + "</div>" * n) == WANT
    assert block_html.main_text("<b></i>" * n + f"<p>{LONG}</p>") == WANT


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "<p>", "</div></div>", "<a href='x", "<!-- open", "<script>open", "plain", "<p class=\"x>y</p>", "<<<>>>", "&", "<svg/>"])
def test_html_odd_pages(page):
    assert isinstance(block_html.main_text(page), str)


def test_html_query(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, "v", ""), (None, "w", "<article>x")], "page_id long, url string, html string").withColumn("text", pa_lit())
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in block_html.extract(pages).collect())
    assert [g[1:] for g in got[:3]] == [("x", 1), (block_html.main_text(PAGE), len(block_html.main_text(PAGE))), ("", 0)]
    assert block_html.extract(pages.where("false")).count() == 0


def pa_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_chunks_resist_shifts():
    rng = random.Random(9)
    body = prose(rng, 400).encode()
    one, _ = chunk_dedup.chunks(np.frombuffer(body, np.uint8), np.array([0, len(body)]))
    text = b"something put before " + body
    two, _ = chunk_dedup.chunks(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    shift = len(text) - len(body)
    assert len(set(one) & {x - shift for x in two}) > 0.9 * len(one)
    both, first = chunk_dedup.chunks(np.frombuffer(body + text, np.uint8), np.array([0, len(body), len(body) + len(text)]))
    assert (both[first[1] : first[2]] - len(body) == two).all()


def test_chunks_of_a_row_depend_on_it_alone():
    rng = random.Random(19)
    rows = [b"", *(prose(rng, rng.randint(1, 40)).encode() for _ in range(300)), b"", "ü".encode() * 900, b"x" * 2000, "\U0001f600".encode() * 300]
    offs = np.cumsum([0, *map(len, rows)])
    at, first = chunk_dedup.chunks(np.frombuffer(b"".join(rows), np.uint8), offs)
    for i, row in enumerate(rows):
        own, _ = chunk_dedup.chunks(np.frombuffer(row, np.uint8), np.array([0, len(row)]))
        assert (at[first[i] : first[i + 1]] - offs[i]).tolist() == own.tolist()
        for a, z in zip(own, [*own[1:], len(row)]):
            assert 0 < z - a <= chunk_dedup.MAX_CHUNK + 3
            row[a:z].decode()


def test_repeated_passages(spark):
    rng = random.Random(10)
    own = [prose(rng, 150) for _ in range(30)]
    passage = [" ".join(f"{rng.choice('abcdefgh')}{rng.randint(100, 999)}" for _ in range(n)) for n in (51, 55)]
    short = " ".join(f"{rng.choice('abcdefgh')}{rng.randint(100, 999)}" for _ in range(47))
    own[25:] = [f"{t} {short} {t}" for t in own[25:]]
    texts = [f"{t} {passage[i % 2]} {t[::-1]}" if i < 20 else t for i, t in enumerate(own)]
    texts += [None, "", passage[0], "ü ö ä é " * 100, "ü ö ä é " * 100, "repeat me " * 60]
    docs = documents(spark, texts)
    clash = docs.withColumn("at", docs.doc_id).withColumn("_at", docs.doc_id).withColumn("_id", docs.doc_id).withColumn("_0", docs.lang)
    got = {r.doc_id: r for r in chunk_dedup.without_repeats(clash).collect()}
    assert list(got[0].asDict()) == clash.columns
    for i, t in enumerate(texts[:32]):
        if i in range(2, 20):
            assert got[i].text.split() == (own[i] + " " + own[i][::-1]).split() and got[i].n_chars == len(got[i].text)
        else:
            assert got[i].text == t
    spans = [r for r in chunk_dedup.repeats(docs).collect()]
    assert {r.doc_id for r in spans} == set(range(2, 20)) | {32, 34}
    for r in spans:
        assert texts[r.doc_id][r.start : r.start + r.length] == r.passage
        assert r.passage in texts[r.earlier_doc_id] and r.earlier_doc_id < r.doc_id
    assert 34 not in got and got[35].text == texts[35]
    assert chunk_dedup.repeats(docs.where("false")).count() == 0
    twice = docs.unionByName(docs.where("doc_id = 2")).unionByName(docs.where("doc_id = 3").selectExpr("cast(null as long) doc_id", *docs.columns[1:]))
    again = [r for r in chunk_dedup.without_repeats(twice).collect()]
    assert sum(r.doc_id == 2 and r.text == got[2].text for r in again) == 2
    assert [r.text for r in again if r.doc_id is None] == [texts[3]]


def test_every_shared_passage_has_a_common_digest():
    rng = random.Random(21)

    def digests(text):
        raw, offs = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
        cuts, words = chunk_dedup._cuts(raw, offs), chunk_dedup._words(raw, offs)
        at, first = chunk_dedup.chunks(raw, offs, cuts)
        k, to = chunk_dedup.run_ends(at, first, len(raw), words[0])
        return set(chunk_dedup.run_digests(raw, at, k, to).tolist()) | set(chunk_dedup.word_digests(raw, offs, cuts, at, first, words)[2].tolist())

    for n in range(200):
        line = "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) if n % 2 else " ".join(prose(rng, 1) for _ in range(1 + n % 5))
        passage = " ".join(rng.choice("abc") for _ in range(50)) if n % 10 == 0 else " ".join([line] * 60)
        one, two = (prose(rng, rng.randint(5, 40)) + rng.choice([" ", "x"]) + passage + rng.choice([" ", "y"]) + prose(rng, 30) for _ in range(2))
        assert digests(one) & digests(two), passage


def test_repeats_of_few_words(spark):
    rng = random.Random(22)
    passages = [" ".join([" ".join(f"{rng.choice('abcdefgh')}{rng.randint(10, 999)}" for _ in range(1 + i % 3))] * 60) for i in range(24)]
    own = [(prose(rng, 60 + rng.randint(0, 9)), prose(rng, 40)) for _ in range(48)]
    texts = [f"{a} {passages[i % 24]} {z}" for i, (a, z) in enumerate(own)]
    got = {r.doc_id: r for r in chunk_dedup.repeats(documents(spark, texts)).collect()}
    assert set(got) == set(range(24, 48))
    for i, r in got.items():
        assert r.passage in texts[i - 24] and r.earlier_doc_id == i - 24 and passages[i - 24] in r.passage


def test_no_chance_repeats_in_prose(spark):
    rng = random.Random(12)
    words = [prose(rng, 1) + str(k) for k in range(60)] + ["the", "of", "and"] * 10
    assert chunk_dedup.repeats(documents(spark, [prose(rng, 300, words) for _ in range(60)])).count() == 0


def _covered(texts, min_words=50):
    """Words of each text in stretches of ``min_words`` words that one earlier text holds, by looking at all pairs."""
    out = []
    for i, text in enumerate(texts):
        words, own = text.split(" "), set()
        for k in range(len(words) - min_words + 1):
            own |= set(range(k, k + min_words)) if any(f" {' '.join(words[k : k + min_words])} " in f" {t} " for t in texts[:i]) else set()
        out.append(own)
    return out


def test_repeats_match_brute_force(spark):
    rng = random.Random(23)
    words = ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    passages = [some(n) for n in (49, 50, 60, 80, 35, 35, 120, 400)] + [some(3) * 25, some(1) * 70, some(2) * 20]
    texts = []
    for _ in range(70):
        parts = [some(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a, z = (rng.randint(0, len(p) // 3), len(p) - rng.randint(0, len(p) // 3)) if rng.random() < 0.4 else (0, len(p))
            parts += [p[a:z], some(rng.randint(0, 3))]
        texts.append(" ".join(w for p in parts for w in p))
    a, b = some(35), some(35)
    texts += [" ".join(some(20) + a + some(20)), " ".join(some(20) + b + some(20)), " ".join(a + b), " ".join(some(9) + a + b + some(9))]
    rows = chunk_dedup.repeats(documents(spark, texts)).collect()
    got = [set() for _ in texts]
    for r in rows:
        assert texts[r.doc_id][r.start : r.start + r.length] == r.passage and r.earlier_doc_id < r.doc_id
        at = len(texts[r.doc_id][: r.start].split())
        got[r.doc_id] |= set(range(at, at + len(r.passage.split())))
    want = _covered(texts)
    assert not want[-2] and len(want[-1]) == 70
    for i, (g, w) in enumerate(zip(got, want, strict=True)):
        # a word may be the end of a longer one in the earlier text, and the ends of what a later document shares beyond a
        # stretch of an earlier one may be missing
        assert len(g - w) <= 2 and len(w - g) <= 5 and bool(g) == bool(w), (i, sorted(g ^ w))


def test_digests_dealt_twice(spark, monkeypatch):
    rng = random.Random(24)
    passage = prose(rng, 90)
    docs = documents(spark, [f"{prose(rng, 80)} {passage} {prose(rng, 60)}" for _ in range(12)])
    want = {tuple(r) for r in chunk_dedup.repeats(docs).collect()}
    monkeypatch.setattr(chunk_dedup, "FAN", 3)
    monkeypatch.setattr(chunk_dedup, "SPLIT", 100)
    monkeypatch.setattr(chunk_dedup, "BROADCAST_IDS", 0)
    assert {tuple(r) for r in chunk_dedup.repeats(docs).collect()} == want and len(want) == 11
