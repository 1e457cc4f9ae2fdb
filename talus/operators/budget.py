"""What goes into a bundle under a budget of tokens, and what was left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 50_000


def estimated_tokens(text: Column | str, chars_per_token: int = 4) -> Column:
    return F.ceil(F.length(text) / chars_per_token).cast("bigint")


def running_total(rows: DataFrame, group: list[str], coarse: list[Column], fine: list[Column], amount: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` over the rows of the group up to and including this one, in the
    order of ``coarse``, then ``fine``. Rows are summed inside each value of ``coarse``, and one row per
    value carries the total of those before it, so a group with very many rows is spread over tasks."""
    names = [f"_c{i}" for i in range(len(coarse))]
    cut = rows.select("*", *[c.alias(n) for c, n in zip(coarse, names)])
    cell = [*group, *names]
    sums = cut.groupBy(*cell).agg(F.sum(amount).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*cell, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*cell).orderBy(*fine).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("_own", F.sum(amount).over(inside)).join(carry, cell).withColumn(out, F.col("_own") + F.col("_before")).select(*rows.columns, out)


def within_budget(pieces: DataFrame, budget: int = BUDGET, least_partial: int = 200) -> DataFrame:
    """Every piece with what is kept of it: status (kept, partial, dropped), kept_tokens, dropped_tokens.

    pieces: bundle_id, piece_id, tier (0 first), filed_at, tokens. The best tiers come first and the
    newest within a tier, so the oldest of the lowest tier go first. Whole pieces are kept as long as they
    fit; the one that crosses the budget is cut to what is left, unless that is less than
    ``least_partial`` tokens; everything after it is dropped, smaller pieces too, so nothing old
    overtakes something newer."""
    p = pieces.withColumn("tokens", F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).cast("bigint"))
    order = [F.col("tier"), -F.coalesce(F.year("filed_at") * 12 + F.month("filed_at"), F.lit(0))]
    t = running_total(p, ["bundle_id"], order, [F.col("filed_at").desc_nulls_last(), F.col("piece_id")], "tokens", "_upto")
    room = F.lit(budget) - (F.col("_upto") - F.col("tokens"))
    kept = F.when(F.col("_upto") <= budget, F.col("tokens")).when(room >= least_partial, room).otherwise(F.lit(0).cast("bigint"))
    status = F.when(F.col("_upto") <= budget, "kept").when(room >= least_partial, "partial").otherwise("dropped")
    return t.select(*pieces.columns, status.alias("status"), kept.alias("kept_tokens"), (F.col("tokens") - kept).alias("dropped_tokens"))


def budget_record(told: DataFrame) -> DataFrame:
    """Per bundle: tokens asked for, kept and dropped, pieces by status, and the tier where it ended."""
    n = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_pieces")
    return told.groupBy("bundle_id").agg(
        F.sum("tokens").alias("tokens"), F.sum("kept_tokens").alias("kept_tokens"), F.sum("dropped_tokens").alias("dropped_tokens"),
        n("kept"), n("partial"), n("dropped"), F.min(F.when(F.col("status") != "kept", F.col("tier"))).alias("first_cut_tier"))


def cut_texts(told: DataFrame, chars_per_token: int = 4) -> DataFrame:
    """Texts of the pieces that are not dropped, partial ones cut at the last white space that fits."""
    limit = F.col("kept_tokens") * chars_per_token
    head = F.substring("text", F.lit(1), limit.cast("int"))
    at_space = F.regexp_replace(head, r"\s+\S*$", "")
    return told.filter("status <> 'dropped'").withColumn("text", F.when(F.col("status") == "partial", at_space).otherwise(F.col("text")))
