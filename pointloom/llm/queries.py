"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import block_html, chunk_dedup, dac_store, decontaminate, license_scan, ngram_join, packing, ppm_langid, ring_shards, spotsigs


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which license notices each document holds."""
    return license_scan.scan(_documents(spark, sf_dir))


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return spotsigs.edit_report(_documents(spark, sf_dir))


def op3_ppm_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return ppm_langid.identify(_documents(spark, sf_dir))


def op4_block_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return block_html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which test items each document holds."""
    return decontaminate.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards, by the law of bytes."""
    return ring_shards.shard(_documents(spark, sf_dir))


def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage that a document shares with an earlier one."""
    return chunk_dedup.repeats(_documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of at most 2048."""
    return packing.pack(_documents(spark, sf_dir))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under Jaccard similarity of 5-word shingles."""
    return ngram_join.ngram_components(_documents(spark, sf_dir))


def op10_dac_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, written in directly addressable codes and read back."""
    return dac_store.round_trip(_documents(spark, sf_dir), packing.default_tokenizer())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_spotsigs, op3_ppm_langid, op4_block_html, op5_decontaminate,
        op6_ring_shards, op7_chunk_dedup, op8_packing, op9_ngram_join, op10_dac_store,
    )
}

_SHINGLES = r"""
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM words)"""

_LETTER_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"


def _letter_sets(table: str, key: str) -> str:
    return f"""
  SELECT {key}, w, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM (SELECT {key}, {_LETTER_WORDS} AS w FROM {table})"""


_TEMPLATES = ", ".join(f"('{a}', '{b}')" for a, b in license_scan.TEMPLATES)

ORACLE: dict[str, str] = {
    "op1_license_scan": f"""
WITH templates(license_id, text) AS (VALUES {_TEMPLATES}),
known AS (SELECT license_id, len(w) AS m, least(len(w), 5) AS width, greatest(1, len(w) // 4) AS step, g FROM ({_letter_sets('templates', 'license_id')})),
shingles AS (SELECT license_id, m, width, step, len(g) AS size, unnest(g) AS s FROM known),
docs AS (SELECT doc_id, {_LETTER_WORDS} AS w FROM documents),
places AS (
  SELECT doc_id, width, i - 1 AS place, array_to_string(w[i:i + width - 1], ' ') AS s
  FROM (SELECT doc_id, width, w, unnest(range(1, len(w) - width + 2)) AS i FROM docs, (SELECT DISTINCT width FROM known))),
hits AS (SELECT doc_id, place, license_id, m, step, size, p.width, s FROM places p JOIN shingles USING (width, s)),
windows AS (
  SELECT *, unnest(range(CAST(greatest(0, ceil((place + width - m - step) / step)) AS BIGINT), CAST(floor((place + step) / step) AS BIGINT) + 1)) AS q
  FROM hits),
share AS (
  SELECT doc_id, license_id, q, count(DISTINCT s) / any_value(size) AS containment FROM windows
  WHERE place >= greatest(0, q * step - step) AND place + width <= q * step + m + step GROUP BY ALL)
SELECT doc_id, license_id, max(containment) AS containment FROM share WHERE containment >= 0.75 GROUP BY doc_id, license_id""",
    "op5_decontaminate": f"""
WITH docs AS ({_letter_sets('documents', 'doc_id')}),
items AS ({_letter_sets('benchmark', 'item_id')}),
wanted AS (SELECT item_id, w AS item, len(g) AS m, least(len(w), 5) AS width, unnest(g) AS s FROM (SELECT DISTINCT * FROM items)),
places AS (
  SELECT DISTINCT doc_id, width, array_to_string(w[i:i + width - 1], ' ') AS s
  FROM (SELECT doc_id, width, w, unnest(range(1, len(w) - width + 2)) AS i FROM docs, (SELECT DISTINCT width FROM wanted)))
SELECT DISTINCT doc_id, item_id, count(*) / m AS containment, count(*) AS matched, CAST(m AS BIGINT) AS item_shingles
FROM places JOIN wanted USING (width, s) GROUP BY doc_id, item_id, item, m HAVING count(*) >= 0.75 * m""",
    "op9_ngram_join": f"""
WITH RECURSIVE {_SHINGLES},
rows AS (SELECT doc_id, unnest(g) AS s FROM sets),
overlap AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM rows a JOIN rows b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM overlap JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * o >= 75 * (len(x.g) + len(y.g) - o)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, m.component_id
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = s.doc_id""",
}
