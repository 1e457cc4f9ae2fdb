"""Registered queries of the training-data operators, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm import earlier_copies, fingerprints, hard_negatives, language_id, line_dedup, near_dedup, oracles, packing, posting_lists, quality, sharding, token_counts, unigram, vector_codes
from talus.llm.common import fold, table

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 16
CONTEXT = 4096
PACK_TOKENIZER, PIECE_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(PACK_TOKENIZER))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold("doc_id", 3) == 1
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality.classify(docs, model, held_out)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold("doc_id", 4) == 2
    return language_id.identify(docs, language_id.fit(docs, ~held_out), held_out)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    now, grown = ({s: 1.0 for s in range(n)} for n in (SHARDS, SHARDS + 1))
    return sharding.shard_records(docs, now, grown=grown).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return posting_lists.search(posting_lists.build(vectors), vectors.filter("vec_id % 100 = 0"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL), CONTEXT)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabel = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, relabel)


def op12_earlier_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return earlier_copies.digests(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    import corpus_pipeline

    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """Of the operators that need no hash, model or tokenizer that SQL lacks; tests/llm holds brute-force
    versions of all."""
    return {"op11_hard_negatives": oracles.OP11, "op13_vector_codes": oracles.OP13}
