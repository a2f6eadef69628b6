"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querytide.llm import bpe, collocations, embedding_dedup, fingerprints, html_extract, langid, line_dedup, ngram_join, packing, secrets, sharding, topk_search, vector_codes


def table(sf_dir: str, spark: SparkSession, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(sf_dir, spark).select("doc_id", "text")
    return sharding.assign_shards(docs, ["doc_id"]).select("doc_id", "n_bytes", "shard_id", "depth", "shard_bytes", "oversized")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(sf_dir, spark).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))
    model = langid.train(docs.where("NOT held_out"), by=F.col("doc_id"))
    return langid.predict(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(sf_dir, spark)
    return secrets.find_secrets(docs, secrets.train(docs))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.encode_and_decode(table(sf_dir, spark), tokens)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_shared_lines(table(sf_dir, spark).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(table(sf_dir, spark)).select("doc_id", "n_shingles", "component_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(sf_dir, spark))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints.edited_pairs(table(sf_dir, spark), edited=lambda text: F.sha2(text.cast("binary"), 256))
    return made.select(
        "doc_id", "n_chars", F.col("edited").alias("edited_sha256"),
        fingerprints.fingerprint(F.col("sig")).alias("fingerprint"),
        fingerprints.fingerprint(F.col("edited_sig")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        fingerprints.likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(table(sf_dir, spark, "embeddings"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(sf_dir, spark, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(sf_dir, spark, "embeddings"))
    digest = F.lit(books.digest if books else None)
    return coded.select("vec_id", vector_codes.hex_code(F.col("codes")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.first_collocations(table(sf_dir, spark))


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(sf_dir, spark, "embeddings")
    return topk_search.top_k(vectors.where("vec_id % 50 = 0"), vectors)
