"""Rendezvous hashing: every record goes to the shard that scores highest for its key.

A record's score for a shard depends on the key and that shard alone, so adding a shard moves only the
records for which the new shard wins, and a shard of twice the weight gets twice the records. All of it
is column expressions; texts never cross the network.

Nulls: a null key is hashed like a key of its own (all such rows share a shard). A null text has no
bytes. Rows that are equal in key, size and checksum get distinct slots. An empty table gives an empty
result. Other columns are ignored."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Parts a shard is cut into for numbering its rows; the table of their sizes has shards x SLOT_PARTS rows.
SLOT_PARTS = 512


def uniform(key: Column, shard: int) -> Column:
    """A number in (0, 1) drawn from key and shard."""
    return (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) * F.lit(2.0**-53)


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard with the highest ``weight / -ln(u)``; ties go to the smaller shard."""
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("weights: at least one shard, all above zero")
    scored = [F.struct((F.lit(float(w)) / -F.log(uniform(key, s))).alias("score"), F.lit(-s).alias("s")) for s, w in sorted(weights.items())]
    best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    return (-best["s"]).cast("int")


def shard_records(df: DataFrame, weights: Mapping[int, float], key: str = "doc_id", text: str = "text", grown: Mapping[int, float] | None = None) -> DataFrame:
    """Key, size, checksum, shard, slot in the shard and the shard under the ``grown`` weights.

    Slots are numbered in two steps: each shard is cut into parts by the key's hash, parts are sized by
    a combinable count, and rows are numbered inside their part only. Equal rows are counted before
    they are numbered, so a key that holds a large share of the rows arrives as one row."""
    grown = grown or weights
    k = F.col(key)
    part = F.pmod(F.xxhash64(k, F.lit("slot")), F.lit(SLOT_PARTS)).cast("int")
    utf8 = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    placed = df.select(
        k.alias("k"), (F.octet_length(utf8).cast("long") + 1).alias("size"), F.crc32(utf8).alias("text_crc32"),
        rendezvous(k, weights).alias("shard"), rendezvous(k, grown).alias("grown_shard"), part.alias("part"),
    )
    sizes = df.select(rendezvous(k, weights).alias("shard"), part.alias("part")).groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = W.Window.partitionBy("shard").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    same = placed.groupBy("shard", "part", "k", "size", "text_crc32", "grown_shard").agg(F.count("*").alias("n"))
    inside = W.Window.partitionBy("shard", "part").orderBy("k", "size", "text_crc32").rowsBetween(W.Window.unboundedPreceding, -1)
    rows = same.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    # The starts have len(weights) x SLOT_PARTS rows at most, whatever the input.
    return rows.join(F.broadcast(starts), ["shard", "part"]).select(
        F.col("k").alias(key), "size", "text_crc32", "shard", (F.col("part_start") + F.col("first") + F.col("nth")).alias("slot"), "grown_shard",
    )
