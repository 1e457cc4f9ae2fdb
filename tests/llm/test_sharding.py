import math
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from talus.llm import sharding as S

SCHEMA = "doc_id long, text string, shard string, slot int, n int, k int"


def plain(key: int, weights: dict[int, float]) -> int:
    """The definition, with another implementation of the hash."""

    def score(s):
        h = xxhash.xxh64_intdigest(struct.pack("<i", s), seed=xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42))
        return weights[s] / -math.log(((h >> 11) + 0.5) * 2**-53)

    return max(weights, key=lambda s: (score(s), -s))


def even(n):
    return {s: 1.0 for s in range(n)}


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    docs = {r.doc_id: (r.text or "").encode() for r in df.collect()}
    rows = S.shard_records(df, even(16), grown=even(17)).collect()
    assert len(rows) == len(docs)
    slots = defaultdict(list)
    for r in rows:
        assert (r.size, r.text_crc32) == (len(docs[r.doc_id]) + 1, zlib.crc32(docs[r.doc_id]))
        assert r.shard == plain(r.doc_id, even(16)) and r.grown_shard in (r.shard, 16) and r.grown_shard == plain(r.doc_id, even(17))
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_weights_and_moves(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    weights = {0: 1.0, 1: 2.0, 2: 1.0}
    n = Counter(r.shard for r in S.shard_records(df, weights).collect())
    assert abs(n[1] / 20_000 - 0.5) < 0.02 and abs(n[0] - n[2]) < 400
    moved = S.shard_records(df, weights, grown={**weights, 3: 1.0}).filter("shard <> grown_shard").collect()
    assert {r.grown_shard for r in moved} == {3} and abs(len(moved) / 20_000 - 0.2) < 0.02


def test_nulls_repeated_rows_clashing_columns_empty_table(spark):
    rows = [(None, "a", "", 0, 0, 0), (7, None, "", 0, 0, 0), (7, "", "", 0, 0, 0)] + [(9, "same", "", 0, 0, 0)] * 500
    got = S.shard_records(spark.createDataFrame(rows, SCHEMA), even(4)).collect()
    assert len(got) == 503
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sorted(r.size for r in got if r.doc_id == 7) == [1, 1]
    assert S.shard_records(spark.createDataFrame([], SCHEMA), even(4)).count() == 0
    with pytest.raises(ValueError):
        S.rendezvous(F.lit(1), {0: 0.0})
