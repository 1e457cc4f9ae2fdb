"""Joins of ranges that overlap, without comparing every range with every other.

A range belongs to the level whose cells (powers of two) are an eighth of its length or little more, so it
touches nine cells at most, there and on every coarser level. Two ranges that overlap share a cell on the
coarser of their two levels; they meet there by equality, and only there, and the exact test follows. A cell
then holds few finer ranges that miss the coarse one, whatever the mixture of lengths: no width has to be
chosen, and long ranges are not copied into thousands of cells. A crowded cell is cut into blocks of rows
that meet block by block, in groups of bounded size. Asking only whether a range is touched makes no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An open end, beyond every date, code or second.
OPEN = 2**40


#: How often a cell of a range's length is halved: less stands at the edges and meets the range without touching it.
FINER = 3


def _number(x: Column, kind: str) -> Column:
    return F.unix_date(x).cast("bigint") if kind == "date" else x.cast("bigint")


def _sides(df: DataFrame, lo: str, hi: str) -> DataFrame:
    kinds = dict(df.dtypes)
    begin = F.coalesce(_number(F.col(lo), kinds[lo]), F.lit(-OPEN))
    end = F.coalesce(_number(F.col(hi), kinds[hi]), F.lit(OPEN))
    whole = df.withColumn("_lo", begin).withColumn("_hi", end).filter("_lo <= _hi")
    # The number of binary digits of the length: a cell of that power would hold the range.
    return whole.withColumn("_level", F.when(F.col("_lo") == F.col("_hi"), 0).otherwise(F.greatest(F.length(F.bin(F.col("_hi") - F.col("_lo"))) - FINER, F.lit(0))))


def _cells(df: DataFrame, levels: list[int]) -> DataFrame:
    """Each range once per cell it touches, on its own level and the coarser ones of ``levels``."""
    at = df.withColumn("_at", F.explode(F.array_distinct(F.concat(F.array("_level"), F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x > F.col("_level"))))))
    first, last = F.expr("shiftright(_lo, _at)"), F.expr("shiftright(_hi, _at)")
    return at.withColumn("_first", first).withColumn("_cell", F.explode(F.sequence(first, last)))


#: Rows of one side that meet in one task's block: a pair of blocks makes twenty million pairs at most.
BLOCK = 4500


def _blocks(x: DataFrame, y: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_row`` and ``_col``: where a cell is crowded, its rows are dealt out to blocks by
    their hash, and each block of the one side meets each of the other in its own group. Whatever share
    of all rows a cell holds, a group keeps no more than about ``BLOCK`` rows of a side."""
    n = lambda df, name: df.groupBy(*on).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    crowd = n(x, "_rows").join(n(y, "_cols"), on).filter("_rows > 1 OR _cols > 1")
    deal = lambda df, mine: F.pmod(F.xxhash64(*[c for c in df.columns if c not in on]), F.coalesce(mine, F.lit(1))).cast("int")
    all_of = lambda theirs: F.explode(F.sequence(F.lit(0), F.coalesce(theirs, F.lit(1)) - 1))
    left = x.join(crowd, on, "left").withColumn("_row", deal(x, "_rows")).withColumn("_col", all_of("_cols"))
    right = y.join(crowd, on, "left").withColumn("_col", deal(y, "_cols")).withColumn("_row", all_of("_rows"))
    return left.drop("_rows", "_cols"), right.drop("_rows", "_cols")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_range: tuple[str, str], right_range: tuple[str, str], how: str = "inner") -> DataFrame:
    """Pairs of rows with equal ``keys`` whose ranges share at least one point, each pair once. Ranges
    include both ends; a null begin or end is open; an end before its begin holds nothing. ``how`` may
    be inner, left_semi or left_anti; the latter two make no pairs. Columns beside the keys must differ
    in name."""
    if how != "inner":
        return _reached(left, right, keys, left_range, right_range, how)
    a, b = _sides(left, *left_range), _sides(right, *right_range)
    # At most 42 levels each.
    mine, theirs = (sorted(r["_level"] for r in x.select("_level").distinct().collect()) for x in (a, b))
    x = _cells(a, theirs).withColumnsRenamed({c: f"{c}_l" for c in ("_lo", "_hi", "_level", "_first")})
    y = _cells(b, mine).withColumnsRenamed({c: f"{c}_r" for c in ("_lo", "_hi", "_level", "_first")})
    on = [*keys, "_at", "_cell"]
    x, y = _blocks(x, y, on)
    # Pairs are many where rows are few: dealt out by group whatever the size in bytes, never broadcast.
    group, parts = [*on, "_row", "_col"], int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = x.repartition(parts, *group).hint("merge").join(y.repartition(parts, *group), group).filter(
        (F.col("_at") == F.greatest("_level_l", "_level_r")) & (F.col("_lo_l") <= F.col("_hi_r")) & (F.col("_lo_r") <= F.col("_hi_l"))
        # Both may touch two cells in common: the first one counts.
        & (F.col("_cell") == F.greatest("_first_l", "_first_r")))
    return met.select(*left.columns, *[c for c in right.columns if c not in keys])


def _reached(left: DataFrame, right: DataFrame, keys: list[str], left_range: tuple[str, str], right_range: tuple[str, str], how: str) -> DataFrame:
    """Rows of ``left`` that some range of ``right`` touches, or that none does, without pairs: of the
    ranges that begin up to the end of a row, the one that reaches furthest decides.

    Both sides shrink to one row per begin or end; those are scanned inside runs of 4,096 numbers, and one
    row per run carries the furthest end over to the next ones, so a key that holds a third of all ranges
    is spread over tasks."""
    a = left.withColumn("_begin", F.coalesce(_number(F.col(left_range[0]), dict(left.dtypes)[left_range[0]]), F.lit(-OPEN)))
    a = a.withColumn("_end", F.coalesce(_number(F.col(left_range[1]), dict(left.dtypes)[left_range[1]]), F.lit(OPEN)))
    b = _sides(right, *right_range).dropna(subset=keys) if keys else _sides(right, *right_range)
    begins = b.groupBy(*keys, F.col("_lo").alias("_x")).agg(F.max("_hi").alias("_far")).withColumn("_ask", F.lit(0))
    asks = a.select(*keys, F.col("_end").alias("_x")).distinct().select(*keys, "_x", F.lit(None).cast("bigint").alias("_far"), F.lit(1).alias("_ask"))
    both = begins.unionByName(asks).withColumn("_run", F.expr("shiftright(_x, 12)"))
    far = F.max("_far")
    runs = both.groupBy(*keys, "_run").agg(far.alias("_far")).select(
        *keys, "_run", far.over(Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inside = Window.partitionBy(*keys, "_run").orderBy("_x", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    told = both.withColumn("_here", far.over(inside)).filter("_ask = 1").join(runs, [*keys, "_run"]).select(
        *keys, F.col("_x").alias("_end"), F.greatest("_here", "_before").alias("_far"))
    hit = (F.col("_begin") <= F.col("_end")) & F.coalesce(F.col("_far") >= F.col("_begin"), F.lit(False))
    return a.join(told, [*keys, "_end"], "left").filter(hit if how == "left_semi" else ~hit).select(*left.columns)


def valid_at(rows: DataFrame, periods: DataFrame, keys: list[str], at: str, period: tuple[str, str]) -> DataFrame:
    """Rows with what was valid for their key at their date (several rows if periods overlap)."""
    return overlap_join(rows, periods, keys, (at, at), period)
