"""Running values over long event groups without putting a group into one task.

A plain running window sends all rows of a key through one task. Here a key is cut into time
buckets: rows scan inside their bucket, one row per bucket carries the last value over, and the
two meet by an equi join. A key that holds a third of all events is spread over as many tasks
as it has buckets; the only window per key runs over buckets, not events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_last(df: DataFrame, keys: list[str], ts: str, tie: str, values: dict[str, Column], bucket_seconds: int = 3600,
                 strict: bool = False, coarser: int | None = None) -> DataFrame:
    """Adds, for each name in ``values``, the last non-null value of its column over the rows
    of the same key up to this one (before it, when ``strict``), ordered by (ts, tie). ``coarser`` cuts
    the buckets' own scan into buckets of so many seconds, for keys with very many of them."""
    b = df.withColumn("_b", F.floor(F.unix_seconds(F.col(ts)) / bucket_seconds))
    for name, x in values.items():
        b = b.withColumn(f"_v_{name}", x)
    inside = Window.partitionBy(*keys, "_b").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    newest = lambda n: F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.struct(ts, tie)))
    per = b.groupBy(*keys, "_b").agg(*[newest(n).alias(f"_o_{n}") for n in values])
    if coarser:
        start = per.withColumn("_s", F.timestamp_seconds(F.col("_b") * bucket_seconds))
        carry = running_last(start.withColumnRenamed("_b", "_k"), keys, "_s", "_k", {f"_c_{n}": F.col(f"_o_{n}") for n in values}, coarser, strict=True)
        carry = carry.select(*keys, F.col("_k").alias("_b"), *[f"_c_{n}" for n in values])
    else:
        earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        carry = per.select(*keys, "_b", *[F.last(f"_o_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in values])
    own = b.select("*", *[F.last(f"_v_{n}", ignorenulls=True).over(inside).alias(f"_i_{n}") for n in values])
    return own.join(carry, [*keys, "_b"]).select(
        *df.columns, *[F.coalesce(f"_i_{n}", f"_c_{n}").alias(n) for n in values]
    )
