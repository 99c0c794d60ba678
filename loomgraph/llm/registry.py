"""Queries of the training-data operators, each with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import bpe, chat, embdedup, hnsw, langid, minhash, packing, quality, tokencount, warc
from loomgraph.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplicated archives of all pages; their manifest, less what depends on where and how they are stored."""
    manifest = warc.write_archives(warc.crawl_records(read(spark, sf_dir, "pages")))
    return manifest.select("record_id", "warc_type", "payload_digest", "refers_to", "payload_bytes")


OP1_SQL = """
WITH r AS (SELECT page_id AS record_id, sha1(coalesce(html, '')) AS payload_digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n
           FROM (SELECT page_id, min(html) AS html FROM pages WHERE page_id IS NOT NULL GROUP BY page_id)),
f AS (SELECT payload_digest, min(record_id) AS first FROM r GROUP BY payload_digest)
SELECT record_id, CASE WHEN record_id = first THEN 'response' ELSE 'revisit' END AS warc_type, payload_digest,
       CASE WHEN record_id <> first THEN first END AS refers_to, CASE WHEN record_id = first THEN n ELSE 0 END AS payload_bytes
FROM r JOIN f USING (payload_digest)
"""


def op2_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op3_embedding_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.classes(read(spark, sf_dir, "embeddings"))


OP3_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(min(embedding), lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL GROUP BY vec_id),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {embdedup.EmbeddingParams().threshold}),
reached(id, low) AS (SELECT a, a FROM links UNION SELECT l.b, r.low FROM reached r JOIN links l ON l.a = r.id),
class AS (SELECT id, min(low) AS low FROM reached GROUP BY id),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(low, v.vec_id) AS class_id, coalesce(n, 0) AS n_links
FROM v LEFT JOIN class ON id = v.vec_id LEFT JOIN degree ON a = v.vec_id
"""


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(read(spark, sf_dir, "documents"))


def op5_minhash_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.windows(read(spark, sf_dir, "conversations"))


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.neighbours(read(spark, sf_dir, "embeddings"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    import corpus_pipeline

    own = (op1_warc_revisits, op2_quality_knn, op3_embedding_int8, op4_token_counts, op5_minhash_chosen_path, op6_chat_windows, op7_hnsw, op8_byte_bpe, op9_language_id, op10_packing)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_revisits": OP1_SQL, "op3_embedding_int8": OP3_SQL}
