"""How much of a stock's move is its own: against the market, against its sector, and given its beta."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Returns are counted in millionths, so that sums don't depend on their order.
UNIT = 1_000_000


def daily_returns(bars: DataFrame) -> DataFrame:
    """symbol, bar_date, r: return since the bar before, in millionths."""
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("bar_date"))
    r = F.floor(F.try_divide("close", before) * UNIT - UNIT + 0.5).cast("bigint")
    return bars.select("symbol", "bar_date", r.alias("r")).filter("r IS NOT NULL")


def group_returns(returns: DataFrame, groups: DataFrame | None = None, out: str = "x") -> DataFrame:
    """The mean return of a day, over all symbols or per ``group`` (symbol, group)."""
    mean = F.floor(F.sum("r") / F.count("*")).cast("bigint").alias(out)
    return returns.groupBy("bar_date").agg(mean) if groups is None else returns.join(groups, "symbol").groupBy("group", "bar_date").agg(mean)


def moments(pairs: DataFrame, cell_days: int) -> DataFrame:
    """Per symbol and cell of ``cell_days`` days: the sums that a regression of r on x needs. Sums of cells
    are the sums of longer spans, so a day's bars are read once whatever the number of spans."""
    d = lambda e: F.sum((e).cast("decimal(38,0)"))
    cell = F.floor(F.unix_date("bar_date") / cell_days)
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    return pairs.groupBy("symbol", cell.alias("cell")).agg(
        F.count("*").alias("n"), d(wide("x")).alias("sx"), d(wide("r")).alias("sy"), d(wide("x") * wide("x")).alias("sxx"), d(wide("x") * wide("r")).alias("sxy"))


def rolling_beta(pairs: DataFrame, cell_days: int = 5, cells: int = 4, least: int = 3) -> DataFrame:
    """symbol, cell, n, beta, move, x_move, own: over the last ``cells`` cells up to each one, the slope of
    r on x, both moves (sums of returns, as fractions), and the move that the slope leaves unexplained.
    The slope is null below ``least`` days or if x stood still."""
    w = Window.partitionBy("symbol").orderBy("cell").rangeBetween(-(cells - 1), 0)
    m = moments(pairs, cell_days).select("symbol", "cell", *[F.sum(c).over(w).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")])
    real = lambda e: e.cast("double")
    n = F.col("n").cast("decimal(10,0)")
    over = real(F.col("sxx") * n - F.col("sx") * F.col("sx"))
    beta = F.when((F.col("n") >= least) & (over != 0), real(F.col("sxy") * n - F.col("sx") * F.col("sy")) / over)
    move, x_move = real(F.col("sy")) / UNIT, real(F.col("sx")) / UNIT
    return m.select("symbol", "cell", "n", beta.alias("beta"), move.alias("move"), x_move.alias("x_move"), (move - beta * x_move).alias("own"))


def moves(returns: DataFrame, market: DataFrame, sectors: DataFrame, as_of, days: int) -> DataFrame:
    """Per symbol over the ``days`` up to the day: its move, the market's and its sector's on the same days,
    and what is left against each. sectors: symbol, group; a symbol without one has no sector move."""
    day = F.lit(as_of).cast("date")
    recent = returns.filter((F.col("bar_date") <= day) & (F.col("bar_date") > F.date_sub(day, days)))
    known = sectors.filter(F.col("group").isNotNull())
    peers = group_returns(recent, known, "peer")
    both = recent.join(market.withColumnRenamed("x", "all"), "bar_date").join(known, "symbol", "left").join(peers, ["group", "bar_date"], "left")
    total = both.groupBy("symbol").agg(F.sum("r").alias("r"), F.sum("all").alias("all"), F.sum("peer").alias("peer"))
    part = lambda c: F.col(c) / F.lit(float(UNIT))
    return total.select("symbol", part("r").alias("move"), part("all").alias("market_move"), part("peer").alias("sector_move"),
                        ((F.col("r") - F.col("all")) / F.lit(float(UNIT))).alias("against_market"), ((F.col("r") - F.col("peer")) / F.lit(float(UNIT))).alias("against_sector"))
