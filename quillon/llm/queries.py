"""The operators' registered queries, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, embed_dedup, html_extract, langid, minhash, mixing, packing, suffix_dedup, toxicity, warc
from .common import table


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def fold(n: int) -> Column:
    """crc32(doc_id as text) mod n; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(fold(4) != 2))
    return langid.predict(docs, model).withColumn("held_out", F.coalesce(fold(4) == 2, F.lit(False)))


def op3_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_merkle_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.fixity(table(spark, sf_dir, "pages"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> tuple:
    return toxicity.train(docs, labels.where(fold(5) != 0))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity_model(docs, labels))
    return scored.select("row.doc_id", "score", "predicted").withColumn("held_out", F.coalesce(fold(5) == 0, F.lit(False)))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.dedup(table(spark, sf_dir, "documents")).drop("k")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    keys = docs.select("doc_id", suffix_dedup.text_key(F.col("text")).alias("k"))
    return keys.join(suffix_dedup.remove_repeats(docs), "k").drop("k").withColumn("changed", F.col("n_removed") > 0)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_bpe())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


FIXITY_SQL = """
WITH r AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
  md5(concat_ws('|', CAST(page_id AS VARCHAR), url, coalesce(html, ''))) AS u FROM pages),
d AS (SELECT page_id, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Record-ID: <urn:uuid:',
  substr(u, 1, 8), '-', substr(u, 9, 4), '-', substr(u, 13, 4), '-', substr(u, 17, 4), '-', substr(u, 21, 12), '>', chr(13), chr(10),
  'WARC-Date: 2026-01-01T00:00:00Z', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10), 'Content-Type: text/html; charset=utf-8', chr(13), chr(10),
  'WARC-Payload-Digest: sha256:', sha256(html), chr(13), chr(10), 'Content-Length: ', CAST(strlen(html) AS VARCHAR), chr(13), chr(10), chr(13), chr(10),
  html, chr(13), chr(10), chr(13), chr(10)) AS data FROM r),
d2 AS (SELECT page_id, data, sha256(data) AS hash, n FROM (SELECT d.page_id, d.data, strlen(r.html) AS n FROM d JOIN r ON d.page_id = r.page_id) x),
b AS (SELECT page_id, sha256(CASE WHEN n % 97 = 5 THEN concat(substr(data, 1, 40), substr(data, 42)) ELSE data END) AS hash FROM d2 WHERE n % 991 <> 7)
SELECT d2.page_id, CAST(strlen(d2.data) AS BIGINT) AS length, d2.hash AS sha256, CASE WHEN b.page_id IS NULL THEN 'missing' WHEN b.hash <> d2.hash THEN 'changed' ELSE 'same' END AS status FROM d2 LEFT JOIN b ON b.page_id = d2.page_id
"""


def fixity_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit without places in files: SQL builds both replicas and compares their records."""
    return op5_merkle_fixity_audit(spark, sf_dir).select("page_id", "length", "sha256", "status")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_mix_sources, op2_language_id, op3_vantage_point_search, op4_html_main_text, op5_merkle_fixity_audit, fixity_digests, op6_embedding_near_dedup, op7_minhash_near_dedup, op8_toxicity, op9_suffix_array_dedup, op10_best_fit_packing, pipeline)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"fixity_digests": FIXITY_SQL}
