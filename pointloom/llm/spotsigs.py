"""SpotSigs: a document's fingerprint is the set of its spot signatures.

An anchor is a common word. Its spot signature is the anchor with the chain of the ``CHAIN`` content words that follow it,
content words being all words that aren't common; common words inside of the chain are skipped. Two additions let texts
with few anchors be compared: after ``BARE`` content words in a row, every other content word, by its hash, begins a chain
without an anchor; and in texts of fewer than ``SHORT`` words every word is a signature by itself. A longer text without
any signature has one made of all of its words. A text without words has the empty set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import order
from .shingle_sql import with_words

CHAIN, BARE, SHORT = 2, 8, 24
# Common words of English, French, German and Spanish that serve as anchors.
ANCHORS = sorted(
    set(
        """the of and to in a is that it was for on are as with his they at be this from have or by had not but what all were when we there can an your which their
        if will each about how up out them then she so would into has more her like him see time could no than been its who now did
        le la les de des du un une et est en que qui dans pour pas par sur au aux ce il elle ne se son sa ses avec plus mais ou nous vous ils je on cette sont
        der die das und ist von zu mit sich auf für nicht ein eine als auch dem er hat aus bei sie nach wie im um am sind noch einen wird über zum war
        el los las y con para una su al lo como más pero sus o fue este ha sí porque esta son entre está cuando muy sin sobre ser también me hasta hay""".split()
    )
)


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the set of spot signatures of column ``text`` as ``name``, an array of distinct ints."""
    common = ", ".join(f"'{w}'" for w in ANCHORS)
    df = with_words(df, text, "_w")
    df = df.withColumn("_p", F.expr(f"filter(case when size(_w) > 0 then sequence(0, size(_w) - 1) else cast(array() as array<int>) end, i -> _w[i] not in ({common}))"))
    before = "if(k = 0, 0, _p[greatest(k, 1) - 1] + 1)"
    bare = f"(k >= {BARE} and _p[k] - _p[greatest(k, {BARE}) - {BARE}] = {BARE} and pmod(hash(_w[_p[k]]), 2) = 0)"
    heads = f"filter(case when size(_p) >= {CHAIN} then sequence(0, size(_p) - {CHAIN}) else cast(array() as array<int>) end, k -> _p[k] > {before} or {bare})"
    chain = ", ".join(f"_w[_p[k + {j}]]" for j in range(CHAIN))
    own = f"if(_p[k] > {before}, transform(slice(_w, {before} + 1, _p[k] - {before}), a -> hash(a, {chain})), array(hash('', {chain})))"
    spots = f"array_distinct(concat(flatten(transform({heads}, k -> {own})), case when size(_w) < {SHORT} then transform(_w, x -> hash(x)) else cast(array() as array<int>) end))"
    df = df.withColumn("_s", F.expr(spots))
    whole = F.expr("case when size(_s) > 0 then _s when size(_w) > 0 then array(hash(array_join(_w, ' '))) else cast(array() as array<int>) end")
    return df.withColumn(name, whole).drop("_w", "_p", "_s")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two signature sets; two empty ones are alike, an empty one is like no other."""
    return F.expr(f"case when size({a}) = 0 and size({b}) = 0 then 1.0D when size({a}) = 0 or size({b}) = 0 then 0.0D else size(array_intersect({a}, {b})) / cast(size({a}) + size({b}) - size(array_intersect({a}, {b})) as double) end")


def as_string(name: str) -> Column:
    """A signature set in ascending order, eight hex digits each."""
    return F.expr(f"array_join(transform(array_sort({name}), s -> right(concat('0000000', lower(hex(cast(s as bigint) & 4294967295L))), 8)), ' ')")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, spots`` of every row; a null text is empty."""
    return with_signatures(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "spots").select("doc_id", "spots")


def near_duplicates(docs: DataFrame, threshold: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Links between fingerprints ``(a, b, likeness)`` by the smallest doc_id of each, and members ``(doc_id, rep)``.

    Equal fingerprints are one class and aren't paired; empty ones link with nothing and represent themselves. Classes are
    partitioned by set length, the bounds a factor ``threshold`` apart, so one meets its own partition and the next only;
    within these, classes meet over the signatures that are rarest in the corpus, as many of each as pigeonholes ask for,
    and pairs whose lengths exclude the threshold go before their sets are compared.
    """
    rows = fingerprints(docs).withColumn("spots", F.array_sort("spots")).withColumn("print", F.xxhash64("spots"))
    kinds = rows.where("size(spots) > 0").groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("spots").alias("spots"))
    members = rows.select("doc_id", "print", F.size("spots").alias("n")).join(kinds.select("print", "rep"), "print", "left").select("doc_id", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep"))
    spot = kinds.select("print", F.size("spots").alias("n"), F.explode("spots").alias("spot"))
    often = spot.groupBy("spot").agg(F.count("*").alias("df"))
    ranked = spot.join(often, "spot").groupBy("print", "n").agg(F.array_sort(F.collect_list(F.struct("df", "spot"))).alias("r"))
    early = ranked.select("print", "n", F.explode(F.slice("r", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int"))).alias("r"))
    early = early.where("r.df > 1").select("print", "n", "r.spot", F.floor(F.log(F.col("n")) / F.log(F.lit(1 / threshold)) if threshold < 1 else F.col("n")).alias("part"))
    left = early.select(F.col("print").alias("u"), F.col("n").alias("nu"), "spot", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    right = early.select(F.col("print").alias("v"), F.col("n").alias("nv"), "spot", "part")
    fits = (F.col("u") != F.col("v")) & (F.least("nu", "nv") >= F.greatest("nu", "nv") * threshold)
    pairs = left.join(right, ["spot", "part"]).where(fits).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    x, y = kinds.select(F.col("print").alias("u"), F.col("rep").alias("ru"), F.col("spots").alias("su")), kinds.select(F.col("print").alias("v"), F.col("rep").alias("rv"), F.col("spots").alias("sv"))
    links = pairs.join(x, "u").join(y, "v").select(F.least("ru", "rv").alias("a"), F.greatest("ru", "rv").alias("b"), likeness("su", "sv").alias("likeness"))
    return links.where(F.col("likeness") >= threshold), members


def edited(docs: DataFrame) -> DataFrame:
    """``doc_id, text, spots, next_text, next_spots, edited``: every row with the next one by descending doc_id.

    After the smallest doc_id comes the largest; a null doc_id counts as smallest, and rows that repeat a doc_id follow
    each other by a hash of their texts. ``edited`` has the last third of the code points, rounded down, replaced by as
    many from the next text's start, or by all of it. Texts cross the network once: a row meets its neighbour in its
    bucket of doc_ids, to which the last row of the bucket before is added.
    """
    at = order.bounds(docs, "doc_id")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("b", order.bucket(F.col("doc_id"), at)).withColumn("t", F.xxhash64("text"))
    last = rows.groupBy("b").agg(F.max(F.struct("doc_id", "t")).alias("last"))
    over = Window.orderBy("b")  # one row for each of at most order.MOST buckets
    last = last.select("b", F.col("last.doc_id").alias("last_id"), F.col("last.t").alias("last_t"), F.coalesce(F.lead("b").over(over), F.first("b").over(over)).alias("onto"))
    rows = rows.join(F.broadcast(last), "b")
    is_last = F.col("doc_id").eqNullSafe(F.col("last_id")) & (F.col("t") == F.col("last_t"))
    own = F.struct(F.col("b").alias("b"), F.lit(1).alias("own"))
    rows = rows.select("doc_id", "text", "t", F.explode(F.when(is_last, F.array(own, F.struct(F.col("onto").alias("b"), F.lit(0).alias("own")))).otherwise(F.array(own))).alias("x"))
    rows = with_signatures(rows.select("doc_id", "text", "t", "x.b", "x.own"), "text", "spots")
    by = Window.partitionBy("b").orderBy("own", F.col("doc_id").asc_nulls_first(), "t")
    rows = rows.select("doc_id", "text", "spots", "own", F.lag("text").over(by).alias("next_text"), F.lag("spots").over(by).alias("next_spots")).where("own = 1")
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    return rows.select("doc_id", "text", "spots", "next_text", "next_spots", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.substring(F.col("next_text"), F.lit(1), third)).alias("edited"))


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are; see ``edited`` for the order."""
    rows = with_signatures(edited(docs), "edited", "edited_spots")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string("spots").alias("fingerprint"),
        as_string("edited_spots").alias("edited_fingerprint"),
        likeness("spots", "edited_spots").alias("near_edited"),
        likeness("spots", "next_spots").alias("near_next"),
    )
