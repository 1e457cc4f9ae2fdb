"""Quotes and price bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.functions.columns import ratio


def _number(c: str):
    x = F.col(c)
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.when(finite, x).otherwise(F.lit(0.0))


def quote_normalize(raw: DataFrame) -> DataFrame:
    """Eleven quote fields: unusable numbers become 0, missing strings '', the percent change a
    fraction; the 50-day average and the target stay null. Rows without a symbol go."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return raw.filter("symbol IS NOT NULL").select(
        "symbol",
        _number("price").alias("price"),
        (_number("change_pct") / 100).alias("day_change"),
        _number("market_cap").alias("market_cap"),
        _number("avg_volume").alias("avg_volume"),
        _number("high52").alias("high52"),
        "avg50", "target",
        text("quote_type").alias("quote_type"), text("market").alias("market"), text("currency").alias("currency"),
    )


def bars_clean(raw: DataFrame, as_of=None, lookback_days: int = 5 * 365) -> DataFrame:
    """Dated bars with a close, at day precision; with ``as_of`` only the last five years."""
    bars = raw.filter("close IS NOT NULL AND ts IS NOT NULL").select("symbol", F.col("ts").cast("date").alias("bar_date"), "close")
    if as_of is not None:
        bars = bars.filter(F.col("bar_date") >= F.date_sub(F.lit(as_of).cast("date"), lookback_days))
    return bars


def positive_lookup(survivors: DataFrame, targets: DataFrame) -> DataFrame:
    """Consensus target (null unless positive) and sector for the given symbols only."""
    return survivors.join(targets.select("symbol", "target", "sector"), "symbol", "left").select(
        "symbol", F.when(F.col("target") > 0, F.col("target")).alias("target"), "sector"
    )


def month_return(bars: DataFrame, as_of, days: int = 45, min_closes: int = 15, back: int = 22) -> DataFrame:
    """Return over about 21 trading days: last close against the ``back``-th from the end (or
    the first); null below ``min_closes``, infinite or NaN from a close of zero. A symbol has at most one bar a day in the window."""
    w = Window.partitionBy("symbol").orderBy(F.col("bar_date").desc())
    recent = bars.filter(
        F.col("close").isNotNull() & (F.col("bar_date") >= F.date_sub(F.lit(as_of).cast("date"), days))
    )
    return (
        recent.withColumn("rn", F.row_number().over(w))
        .groupBy("symbol")
        .agg(
            F.count("*").alias("n"),
            F.max(F.when(F.col("rn") == 1, F.col("close"))).alias("last"),
            F.max_by("close", F.when(F.col("rn") <= back, F.col("rn"))).alias("ref"),
        )
        .select("symbol", F.when(F.col("n") >= min_closes, ratio("last", "ref") - 1).alias("month_return"))
    )


def drawdown_from_high(bars: DataFrame, days: int = 365) -> DataFrame:
    """Each close against the highest close of the trailing window, 0 when that is not
    positive."""
    d = bars.withColumn("_day", F.datediff("bar_date", F.lit("1970-01-01").cast("date")))
    w = Window.partitionBy("symbol").orderBy("_day").rangeBetween(-days, 0)
    high = F.max("close").over(w)
    return d.withColumn("high", high).select(
        "symbol", "bar_date", "close", "high",
        F.when(F.col("high") > 0, F.col("close") / F.col("high") - 1).otherwise(F.lit(0.0)).alias("from_high"),
    )
