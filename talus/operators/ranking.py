"""Exact ranks, deciles and running totals over all rows of a table, without a window that has no
partition.

Rows are dealt out by ranges of the order and written with the number of their part. What stands before
a part is the sum of one small row per part; inside a part a window counts on. Only the list of part
sums is in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.sources.gold import materialize


def running_over_all(rows: DataFrame, order: list[Column], amount: Column, out: str, total: str) -> DataFrame:
    """Adds ``out``, the sum of ``amount`` over all rows up to and including this one, and ``total`` over
    all. ``order`` must tell all rows apart, else equal ones have any order among them."""
    dealt = rows.repartitionByRange(*order).select("*", amount.cast("bigint").alias("_amount"), F.spark_partition_id().alias("_part"))
    dealt = materialize(dealt, "ranked-parts")
    sums = dealt.groupBy("_part").agg(F.sum("_amount").alias("_n"))
    # One row per part.
    listed = sums.agg(F.collect_list(F.struct("_part", "_n")).alias("all")).scalar()
    adding = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, s: a + s["_n"])
    parts = sums.withColumn("_all", listed).select(
        "_part", adding(F.filter("_all", lambda s: s["_part"] < F.col("_part"))).alias("_before"), adding(F.col("_all")).alias(total))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = dealt.withColumn("_own", F.sum("_amount").over(inside)).join(F.broadcast(parts), "_part")
    return counted.select(*rows.columns, (F.col("_own") + F.col("_before")).alias(out), total)


def global_rank(rows: DataFrame, order: list[Column], out: str = "rank", total: str = "of") -> DataFrame:
    """Adds ``out`` (1 for the first row in the order) and ``total``, the number of rows."""
    return running_over_all(rows, order, F.lit(1), out, total)


def tile(rank: Column, total: Column, n: int) -> Column:
    """The group of ``n`` that a rank falls into; the first groups have one row more if ``n`` doesn't
    divide the rows."""
    size = F.floor(total / n)
    more = total - size * n
    long = more * (size + 1)
    return F.when(rank <= long, F.ceil(rank / (size + 1))).otherwise(more + F.ceil((rank - long) / F.greatest(size, F.lit(1)))).cast("int")


def global_ntile(rows: DataFrame, order: list[Column], n: int, out: str = "tile") -> DataFrame:
    ranked = global_rank(rows, order, "_rank", "_of")
    return ranked.select(*rows.columns, tile(F.col("_rank"), F.col("_of"), n).alias(out))


def nth_values(rows: DataFrame, order: list[Column], value: str, places: list[int]) -> DataFrame:
    """(place, value) of the rows at given places, counted from 1; from the end, if negative. A place
    outside the table gives no row."""
    ranked = global_rank(rows, order, "_rank", "_of")
    at = F.array(*[F.struct(F.lit(p).alias("place"), (F.lit(p) if p > 0 else F.col("_of") + 1 + p).cast("bigint").alias("at")) for p in places])
    hit = F.filter(at, lambda x: x["at"] == F.col("_rank"))
    return ranked.select(value, F.inline(hit).alias("place", "at")).select("place", value)
