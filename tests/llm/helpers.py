"""Small tables and plain-Python versions to compare with."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def documents(spark, texts, langs=None, first=0):
    """A documents table, with a column that clashes with nothing it should."""
    rows = [(first + i, t, (langs or {}).get(i, "en"), "s", len(t or ""), "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def prose(rng: random.Random, n: int, words=None) -> str:
    words = words or ["the", "of", "and", "to", "in"] + ["".join(rng.choice(["an", "er", "th", "on", "sh", "le", "ti"]) for _ in range(rng.randint(2, 4))) for _ in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


def ascii_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def letter_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(words, width=5):
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


def components(rows, linked):
    """Smallest id of each row's component; rows: list of (id, set)."""
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if linked(rows[a][1], rows[b][1]):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return {(i, len(s), least[find(k)]) for k, (i, s) in enumerate(rows)}
