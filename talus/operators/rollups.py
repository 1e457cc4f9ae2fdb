"""Counts along several dimensions at once, and day sketches that add up to weeks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cube_of(rows: DataFrame, dims: Sequence[str], sets: Sequence[Sequence[str]], measures: Sequence[Column]) -> DataFrame:
    """``measures`` for every set of dimensions, in one pass over the rows. ``level`` tells the sets apart,
    also where a dimension is null in the data: bit by bit, the first dimension highest, 1 where it is
    summed over."""
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in dims]).agg(F.grouping_id().cast("bigint").alias("level"), *measures).select(
        "level", *dims, *[m for m in _names(rows, measures)])


def _names(rows: DataFrame, measures: Sequence[Column]) -> list[str]:
    return rows.agg(*measures).columns


def grade_cube(ledger: DataFrame) -> DataFrame:
    """Past calls by class, year and whether their kill-switches were graded: every pair, each alone, all."""
    rows = ledger.select("classification", F.year("run_date").cast("bigint").alias("year"), "graded", "valuation_error_pct", F.col("return_1y").isNotNull().alias("settled"))
    sets = [["classification", "year", "graded"], ["classification", "year"], ["classification", "graded"], ["classification"], ["year"], []]
    return cube_of(rows, ["classification", "year", "graded"], sets, [
        F.count("*").alias("calls"), F.count_if("settled").alias("settled"), F.count_if(F.col("valuation_error_pct") > 0).alias("too_low"), F.min("valuation_error_pct").alias("least_error"), F.max("valuation_error_pct").alias("largest_error")])


def funnel_cube(names: DataFrame, dims: Sequence[str], stages: dict[str, Column]) -> DataFrame:
    """The screen's funnel by every combination of ``dims`` from all of them to none, leaving out the last
    one first: names that pass each stage and all stages before it."""
    sets = [list(dims[:n]) for n in range(len(dims), -1, -1)]
    measures, so_far = [F.count("*").alias("names")], F.lit(True)
    for name, passes in stages.items():
        so_far = so_far & F.coalesce(passes, F.lit(False))
        measures.append(F.count_if(so_far).alias(name))
    return cube_of(names, dims, sets, measures)


# --- sketches --------------------------------------------------------------------------

#: Registers of a distinct-count sketch, as a power of two: a standard error of 1.6 %.
LG_REGISTERS = 12
#: Size of a quantile sketch: ranks are off by about 1.3 %.
QUANTILE_SIZE = 200


def day_sketches(events: DataFrame, keys: Sequence[str], who: str, value: str) -> DataFrame:
    """One row per key: rows, and the states of who was there (distinct) and of the values (quantiles).
    States are a few kilobytes whatever the traffic, are stored, and merge with others in any order."""
    return events.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.hll_sketch_agg(F.col(who), F.lit(LG_REGISTERS)).alias("who"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(QUANTILE_SIZE)).alias("spread"))


def merged_sketches(sketches: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
    """States of coarser keys from those of finer ones, without going back to the rows."""
    return sketches.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.hll_union_agg("who").alias("who"), F.kll_merge_agg_double("spread").alias("spread"))


def read_sketches(sketches: DataFrame, keys: Sequence[str], shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Estimated distinct count and quantiles of each state. A state that has seen its rows one by one also
    remembers their order and estimates by that; joined with itself it forgets it, so the count depends on
    who was there alone and is the same for merged states and for one state of all rows."""
    q = [F.kll_sketch_get_quantile_double("spread", F.lit(s)).alias(f"p{round(100 * s)}") for s in shares]
    return sketches.select(*keys, "rows", F.hll_sketch_estimate(F.hll_union("who", "who")).alias("distinct"), *q)
