"""Point-in-time valuation multiples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.functions.columns import js_round
from talus.functions.sqltext import jr
from talus.operators import asof
from talus.params import DEFAULTS, MultiplesParams

# metric -> (grid column, enterprise value?)
METRICS = {"EV/Sales": ("rev", True), "EV/EBITDA": ("ebitda", True), "P/E": ("ni", False), "P/FCF": ("fcf_raw", False)}
DATED = ("longTermDebt", "currentDebt", "cash", "shortTermInvestments", "sharesOutstanding", "weightedSharesDiluted")


def ttm_series(grid: DataFrame) -> DataFrame:
    """Trailing four-point sum per metric at each quarter end from the fourth point on.

    Historical free cash flow leaves stock compensation in; today's takes it out.
    """
    rows = ", ".join(f"struct('{m}' AS metric, {c} AS val, {str(ev).lower()} AS is_ev)" for m, (c, ev) in METRICS.items())
    w = Window.partitionBy("entity_id", "metric").orderBy("p_end").rowsBetween(-3, 0)
    return (
        grid.selectExpr("entity_id", "p_end", f"inline(array({rows}))").filter("val IS NOT NULL")
        .select("entity_id", "metric", "is_ev", "p_end", F.sum("val").over(w).alias("ttm"), F.count("*").over(w).alias("n"))
        .filter("n = 4").drop("n")
    )


def dated_balances(ends: DataFrame, instants: DataFrame, series: DataFrame, p: MultiplesParams = DEFAULTS.multiples) -> DataFrame:
    """For each (entity, quarter end) the nearest value of the six dated concepts, one column
    each. All six are answered by one as-of pass keyed by (entity, concept)."""
    asks = ends.select("entity_id", "p_end").distinct().select(
        "entity_id", "p_end", F.explode(F.array(*[F.lit(c) for c in DATED])).alias("concept")
    )
    pts = instants.filter(F.col("concept").isin(*DATED)).select("entity_id", "concept", F.col("p_end").alias("at"), "val").unionByName(
        series.filter("concept = 'weightedSharesDiluted'").select("entity_id", "concept", F.col("p_end").alias("at"), "val")
    )
    got = asof.nearest(asks, pts, ["entity_id", "concept"], "p_end", "at", "val", "near", p.instant_tolerance_days)
    cols = [F.expr(f"max(CASE WHEN concept = '{c}' THEN near END) AS {c}") for c in DATED]
    return got.groupBy("entity_id", "p_end").agg(*cols)


def net_debt_at(balances: DataFrame, now: DataFrame) -> DataFrame:
    """Net debt at each end; missing parts count as zero, and where neither debt nor cash is
    known the current figure stands in. ``now`` holds entity_id, net_debt, shares."""
    return balances.join(now, "entity_id").selectExpr(
        "*",
        """CASE WHEN longTermDebt IS NULL AND cash IS NULL THEN coalesce(net_debt, 0D)
           ELSE coalesce(longTermDebt, 0D) + coalesce(currentDebt, 0D) - coalesce(cash, 0D) - coalesce(shortTermInvestments, 0D)
           END AS net_debt_at""",
        "coalesce(sharesOutstanding, weightedSharesDiluted, shares) AS shares_at",
    )


def historical_multiples(ttm: DataFrame, balances: DataFrame, closes: DataFrame, now: DataFrame,
                         p: MultiplesParams = DEFAULTS.multiples) -> DataFrame:
    """One ratio per metric and quarter end with a positive denominator and a close nearby.
    ``closes``: symbol (= entity_id), bar_date, close, one row per day."""
    pts = net_debt_at(balances, now.filter("shares > 0").select("entity_id", "net_debt", "shares"))
    bars = closes.select(F.col("symbol").alias("entity_id"), "bar_date", "close")
    pts = asof.nearest(pts, bars, ["entity_id"], "p_end", "bar_date", "close", "close_at", p.close_tolerance_days)
    return (
        ttm.filter("ttm > 0").join(pts.filter("close_at IS NOT NULL"), ["entity_id", "p_end"])
        .selectExpr("entity_id", "metric", "p_end",
                    "(close_at * shares_at + CASE WHEN is_ev THEN net_debt_at ELSE 0D END) / ttm AS ratio")
    )


def multiple_bands(ratios: DataFrame, p: MultiplesParams = DEFAULTS.multiples) -> DataFrame:
    """Quartiles with linear interpolation, at 1 dp, from at least ``min_observations``."""
    q = F.percentile("ratio", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (
        ratios.groupBy("entity_id", "metric").agg(q.alias("q"), F.count("*").alias("n"))
        .filter(F.col("n") >= p.min_observations)
        .select("entity_id", "metric", *[js_round(F.col("q")[i], 1).alias(c) for i, c in enumerate(("p25", "p50", "p75"))], "n")
    )


def current_multiples(metrics: DataFrame, prices: DataFrame) -> DataFrame:
    """The same arithmetic at today's price; only positive denominators make a multiple."""
    denoms = {"EV/Sales": "revenue_ttm", "EV/EBITDA": "ebitda_ttm", "P/E": "net_income_ttm", "P/FCF": "fcf_ttm"}
    rows = ", ".join(
        f"struct('{m}' AS metric, {d} AS denom, {'coalesce(net_debt, 0D)' if METRICS[m][1] else '0D'} AS extra)" for m, d in denoms.items()
    )
    return (
        metrics.join(prices, "entity_id").filter("shares > 0 AND price > 0")
        .selectExpr("entity_id", "price * shares AS cap", f"inline(array({rows}))")
        .filter("denom > 0")
        .selectExpr("entity_id", "metric", f"{jr('(cap + extra) / denom', 1)} AS value")
    )


def last_close(bars: DataFrame) -> DataFrame:
    """Newest close per symbol as ``price`` by entity."""
    return bars.groupBy(F.col("symbol").alias("entity_id")).agg(F.max_by("close", "bar_date").alias("price"))
