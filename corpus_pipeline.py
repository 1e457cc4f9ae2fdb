"""A corpus from raw documents to packed sequences, in stages that each write and reread a table.

A stage drops what its operator rejects and passes the other rows on with the columns of documents.
Rows with null or empty text are dropped by the first stage, as they have no language."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from talus.llm import language_id, line_dedup, near_dedup, packing, quality
from talus.llm.common import table
from talus.sources.gold import materialize

#: Documents whose best language holds less of the evidence than this are rejected.
LEAST_LANGUAGE_SCORE = 0.5
#: Documents with a quality score below this are rejected.
LEAST_QUALITY = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a recognised language; learned from the rows that name theirs."""
    predict = language_id.predictor(spark, language_id.fit(docs, F.lit(True)))
    found = docs.select(F.struct(*docs.columns).alias("d"), predict("text").alias("p"))
    return found.filter((F.col("p.lang_pred") != language_id.UNDETERMINED) & (F.col("p.score") >= LEAST_LANGUAGE_SCORE)).select("d.*")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts; learned from all labels of these rows."""
    score = quality.scores(spark, quality.fit(docs, table(spark, sf_dir, "labels"), F.lit(True)))
    found = docs.select(F.struct(*docs.columns).alias("d"), score("text").alias("s"))
    return found.filter(F.col("s") >= LEAST_QUALITY).select("d.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, one with the smallest id; rows without an id stay."""
    kept = near_dedup.grouped(docs).filter("kept AND doc_id IS NOT NULL")
    kept = kept.groupBy("doc_id", F.coalesce("root", F.hex("mark").cast("binary")).alias("root")).agg(F.min("mark").alias("mark")).select("doc_id", "mark")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"))
    equal = W.Window.partitionBy("doc_id", "mark").orderBy(F.xxhash64("row"))
    first = rows.join(kept, ["doc_id", "mark"]).withColumn("at", F.row_number().over(equal)).filter("at = 1")
    return first.select("row").unionByName(rows.filter("doc_id IS NULL").select("row")).select("row.*")


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the passages that an earlier document holds; rows that are nothing else go."""
    rest = line_dedup.strip_repeats(docs).filter(F.length(F.trim("text")) > 0)
    return rest.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with the sequence they lie in."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", known_language),
    ("quality classifier", good_quality),
    ("near-dedup", without_near_copies),
    ("substring dedup", without_repeated_passages),
    ("packing", packed),
]

#: Models and tokenizers are not expressible in SQL; tests/llm/test_pipeline.py has the plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each to what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
