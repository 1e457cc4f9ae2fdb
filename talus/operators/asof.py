"""As-of joins without range joins.

Both sides shrink to one row per (key, date) first: the left by ``distinct``, the right by
contract. A hot key then costs at most one row per calendar day in its window, however many
left rows ask, and the answer goes back to them by an equi join (which AQE can split). Left and
right are sorted together once per direction; nothing is paired up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _scan(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    r = right.select(*keys, F.col("_d"), F.struct(F.col("_d").alias("d"), F.col(value).alias("v")).alias("_hit"), F.lit(0).alias("_left"))
    q = left.select(*keys, "_d").distinct().select(
        *keys, "_d", F.lit(None).cast(r.schema["_hit"].dataType).alias("_hit"), F.lit(1).alias("_left")
    )
    frame = lambda order: Window.partitionBy(*keys).orderBy(order, "_left").rowsBetween(Window.unboundedPreceding, 0)
    return (
        r.unionByName(q)
        .withColumn("_back", F.last("_hit", ignorenulls=True).over(frame(F.col("_d").asc())))
        .withColumn("_fwd", F.last("_hit", ignorenulls=True).over(frame(F.col("_d").desc())))
        .filter("_left = 1")
        .drop("_hit", "_left")
    )


def _dated(df: DataFrame, date: str) -> DataFrame:
    return df.filter(F.col(date).isNotNull()).withColumn("_d", F.col(date))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_date: str, right_date: str, value: str,
            out: str, tolerance: int) -> DataFrame:
    """Adds ``out``: the right value nearest in time, strictly closer than ``tolerance`` days;
    ties go to the earlier one. Null when there is none."""
    s = _scan(_dated(left, left_date), _dated(right, right_date), keys, value)
    back, fwd = F.datediff("_d", "_back.d"), F.datediff("_fwd.d", "_d")
    pick = F.when(F.col("_fwd").isNull() | (back <= fwd), F.col("_back")).otherwise(F.col("_fwd"))
    s = s.withColumn("_hit", pick).select(
        *keys, F.col("_d").alias(left_date),
        F.when(F.abs(F.datediff("_d", "_hit.d")) < tolerance, F.col("_hit.v")).alias(out),
    )
    return left.join(s, [*keys, left_date], "left")


def forward(left: DataFrame, right: DataFrame, keys: list[str], left_date: str, right_date: str, value: str,
            out: str) -> DataFrame:
    """Adds ``out``: the first right value on or after the left date, and ``{out}_date``."""
    s = _scan(_dated(left, left_date), _dated(right, right_date), keys, value).select(
        *keys, F.col("_d").alias(left_date), F.col("_fwd.v").alias(out), F.col("_fwd.d").alias(f"{out}_date")
    )
    return left.join(s, [*keys, left_date], "left")


def before(left: DataFrame, right: DataFrame, keys: list[str], left_date: str, right_date: str, value: str,
           out: str) -> DataFrame:
    """Adds ``out``: the last right value strictly before the left date."""
    day_before = left.withColumn("_prev", F.date_sub(left_date, 1))
    s = _scan(_dated(day_before, "_prev"), _dated(right, right_date), keys, value).select(
        *keys, F.date_add("_d", 1).alias(left_date), F.col("_back.v").alias(out)
    )
    return left.join(s, [*keys, left_date], "left")
