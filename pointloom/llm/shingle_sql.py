"""Word shingles and MinHash sketches as Spark SQL expressions.

Words are runs of letters and digits, lower-cased. A text of at least ``WIDTH`` words has its ``WIDTH``-word shingles; one
with fewer words has its whole word sequence as its one shingle; one without words has none.

``minhash`` bands hold one value each. The band of hash function j collides for two sets where the shingle that j puts
first is the same, so looking up a set of short texts costs one membership test a shingle: a document can only collide
with a text in band j if it has the shingle that j puts first in that text (``sketches``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 5


def words(text: str) -> Column:
    return F.expr(rf"array_remove(split(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+'), '')")


def with_words(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the words of column ``text`` as ``name``.

    They come out of a generator, as the optimiser would otherwise put the splitting into every lambda that reads a word.
    """
    return df.select("*", F.explode(F.array(words(text))).alias(name))


def hash_at(w: str, i: str, width: int) -> str:
    """Hash of the shingle of ``width`` words that begins at index ``i``."""
    return f"xxhash64({', '.join(f'{w}[{i} + {k}]' for k in range(width))})"


def starts(w: str, width: int) -> str:
    """Indices at which shingles of ``width`` words begin."""
    return f"case when size({w}) >= {width} then sequence(0, size({w}) - {width}) else cast(array() as array<int>) end"


def of_text(w: str, what: str) -> Column:
    """A short text's shingles: ``what`` is 'hash' or 'text'."""
    one = (lambda width: f"transform({starts(w, width)}, i -> {hash_at(w, 'i', width)})") if what == "hash" else (lambda width: f"transform({starts(w, width)}, i -> array_join(slice({w}, i + 1, {width}), ' '))")
    cases = " ".join(f"when size({w}) = {n} then {one(n)}" for n in range(1, WIDTH))
    kind = "bigint" if what == "hash" else "string"
    return F.expr(f"array_distinct(case {cases} when size({w}) >= {WIDTH} then {one(WIDTH)} else cast(array() as array<{kind}>) end)")


def sketches(texts: DataFrame, keys: list[str], bands: int) -> DataFrame:
    """``keys, width, band, value, h``: for each band of each text its least value and the shingle that has it.

    ``texts`` has ``keys``, ``width`` and ``hashes``.
    """
    each = texts.where("size(hashes) > 0").select(*keys, "width", "hashes", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    least = F.expr("array_min(transform(hashes, h -> struct(xxhash64(h, band) as value, h as h)))")
    return each.select(*keys, "width", "band", least.alias("m")).select(*keys, "width", "band", F.col("m.value").alias("value"), F.col("m.h").alias("h"))


#: Sketch hashes that stand in the plan at most; beyond it, shingles are joined with the sketch table.
LITERALS = 20_000


def hits(docs: DataFrame, w: str, sketch: DataFrame) -> DataFrame:
    """Rows of ``docs`` with ``hits``, the ``(at, width, h)`` of shingles that are in ``sketch(width, h)``; rows without go.

    Up to ``LITERALS`` hashes are tested inside the row, without a shuffle. For more of them the shingles are joined with
    the sketch, by broadcast or shuffle as Spark finds fit, and the hits are gathered per row.
    """
    some = sketch.select("width", "h").distinct()
    known = some.limit(LITERALS + 1).collect()
    by_width: dict[int, list[int]] = {}
    for r in known:
        by_width.setdefault(r.width, []).append(r.h)
    if not by_width:
        return docs.withColumn("hits", F.expr("cast(array() as array<struct<at: int, width: int, h: bigint>>)")).where(F.lit(False))
    make = lambda width, at: f"transform({at}, i -> named_struct('at', i, 'width', {width}, 'h', {hash_at(w, 'i', width)}))"
    if len(known) <= LITERALS:
        parts = [make(width, f"filter({starts(w, width)}, i -> {hash_at(w, 'i', width)} in ({', '.join(f'{h}L' if h > -(2**63) else 'bigint(-9223372036854775808)' for h in sorted(hs))}))") for width, hs in sorted(by_width.items())]
        return docs.withColumn("hits", F.expr(f"concat({', '.join(parts)})")).where("size(hits) > 0")
    widths = [r.width for r in some.select("width").distinct().orderBy("width").collect()]
    keyed = docs.withColumn("_row", F.xxhash64(*[F.col(c) for c in docs.columns]))
    every = keyed.select("_row", F.explode(F.expr(f"concat({', '.join(make(width, starts(w, width)) for width in widths)})")).alias("s")).select("_row", "s.*")
    found = every.join(some, ["width", "h"], "left_semi").groupBy("_row").agg(F.collect_set(F.struct("at", "width", "h")).alias("hits"))
    return keyed.join(found, "_row").drop("_row")
