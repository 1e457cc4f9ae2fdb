"""Zero-growth value, market-implied growth, street growth and return on capital."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.functions.sqltext import jr
from talus.params import DEFAULTS, EconomicsParams


def present_value_sql(f0: str, g: str, r: str, p: EconomicsParams = DEFAULTS.economics) -> str:
    """Value of ``f0`` growing at ``g`` for the fade years, then a Gordon terminal. The yearly
    sum is the geometric series in closed form, so a solver step costs a few operations."""
    n, gt = p.fade_years, f"{p.terminal_growth}D"
    x = f"((1D + {g}) / (1D + {r}))"
    total = f"CASE WHEN {x} = 1D THEN {n}D ELSE {x} * (pow({x}, {n}D) - 1D) / ({x} - 1D) END"
    return f"(({f0}) * (({total}) + pow({x}, {n}D) * (1D + {gt}) / ({r} - {gt})))"


def dcf_present_value(df: DataFrame, f0: str, g: str, r: str, out: str = "pv", p: EconomicsParams = DEFAULTS.economics) -> DataFrame:
    return df.withColumn(out, F.expr(present_value_sql(f0, g, r, p)))


def implied_growth_sql(f0: str, cap: str, r: str, p: EconomicsParams = DEFAULTS.economics) -> str:
    """Growth at which the present value equals the market value: bisection as a fold over a
    constant sequence, inside the JVM. Below the lowest value: the lower bound. Above the
    highest: null."""
    lo, hi = f"{p.growth_lo}D", f"{p.growth_hi}D"
    mid = "((acc.lo + acc.hi) / 2D)"
    below = f"{present_value_sql(f0, mid, r, p)} < ({cap})"
    fold = (
        f"aggregate(sequence(1, {p.halvings}), struct({lo} AS lo, {hi} AS hi), "
        f"(acc, i) -> CASE WHEN {below} THEN struct({mid} AS lo, acc.hi AS hi) ELSE struct(acc.lo AS lo, {mid} AS hi) END, "
        f"acc -> (acc.lo + acc.hi) / 2D)"
    )
    return (
        f"CASE WHEN {present_value_sql(f0, lo, r, p)} > ({cap}) THEN {lo} "
        f"WHEN {present_value_sql(f0, hi, r, p)} < ({cap}) THEN CAST(NULL AS DOUBLE) ELSE {fold} END"
    )


def implied_growth(df: DataFrame, f0: str, cap: str, r: str, out: str = "g", p: EconomicsParams = DEFAULTS.economics) -> DataFrame:
    return df.withColumn(out, F.expr(implied_growth_sql(f0, cap, r, p)))


def eps_growth(estimates: DataFrame) -> DataFrame:
    """Street estimates per (entity, period) to next-year revenue (if positive) and EPS growth
    in percent (only from a positive base)."""
    at = lambda c, per: f"max(CASE WHEN period = '{per}' THEN {c} END)"
    wide = estimates.filter("period IN ('0y', '+1y')").groupBy("entity_id").agg(
        F.expr(at("revenue", "+1y")).alias("rev1"), F.expr(at("eps", "0y")).alias("eps0"), F.expr(at("eps", "+1y")).alias("eps1")
    )
    return wide.selectExpr(
        "entity_id", "CASE WHEN rev1 > 0 THEN rev1 END AS street_revenue_1y",
        f"CASE WHEN eps0 > 0 THEN floor((eps1 / eps0 - 1) * 1000D + 0.5D) / 10D END AS eps_growth_pct",
    )


def economic_view(df: DataFrame, p: EconomicsParams = DEFAULTS.economics) -> DataFrame:
    """Adds the economic columns to rows that hold price, street_revenue_1y, eps_growth_pct and
    the entity's metrics. Null inputs give null results, never zero.

    discount_rate: base plus a step per risk marker (leverage, thin cash margin, small size), at
    most the maximum; with no marker and a large, profitable, unlevered company, a step less.
    """
    haircut, tax, step = f"{p.unprofitable_haircut}D", f"{1 - p.tax_rate}D", f"{p.marker_step}D"
    one = lambda c: f"CASE WHEN {c} THEN 1 ELSE 0 END"
    base = f"{p.discount_rate}D"
    d = df.selectExpr(
        "*",
        "CASE WHEN price <> 0 AND shares <> 0 THEN price * shares END AS market_cap",
        "CASE WHEN ebit_avg5y IS NULL THEN ebit_ttm ELSE CASE WHEN ebit_ttm IS NOT NULL THEN least(ebit_ttm, ebit_avg5y) END END AS norm_ebit",
        "CASE WHEN fcf_avg5y IS NULL THEN fcf_ttm ELSE CASE WHEN fcf_ttm IS NOT NULL THEN least(fcf_ttm, fcf_avg5y) END END AS norm_fcf",
        f"CASE WHEN street_revenue_1y <> 0 AND revenue_ttm > 0 THEN {jr('(street_revenue_1y / revenue_ttm - 1) * 100', 1)} END AS street_rev_growth_pct",
        "coalesce(net_income_ttm <= 0, false) AS unprofitable",
    ).selectExpr(
        "*",
        " + ".join([one(f"nd_to_ebitda > {p.leverage_marker}D"), one(f"fcf_pct < {p.thin_margin_pct}D"), one(f"market_cap < {p.small_cap}D")])
        + " AS risk_markers",
    )
    stable = f"market_cap > {p.mega_cap}D AND ebit_ttm > 0 AND (nd_to_ebitda IS NULL OR nd_to_ebitda < {p.leverage_marker}D)"
    d = d.selectExpr(
        "*",
        f"""CASE WHEN risk_markers > 0 THEN least({base} + {step} * risk_markers, {p.max_discount_rate}D)
            WHEN {stable} THEN {base} - {step} ELSE {base} END AS discount_rate""",
    )
    equity_value = f"((norm_ebit * {tax}) / discount_rate - coalesce(net_debt, 0D))"
    invested = "greatest(equity + total_debt - coalesce(cash_and_sti, 0D), coalesce(ppe, 0D))"
    haircut_growth = jr(f"street_rev_growth_pct * {haircut}", 1)
    return d.selectExpr(
        "*",
        f"{jr('discount_rate * 100', 1)} AS discount_rate_pct",
        f"""CASE WHEN shares > 0 AND norm_ebit > 0 THEN CASE WHEN {equity_value} > 0 THEN {jr(f'{equity_value} / shares', 2)} END
            WHEN shares > 0 AND norm_fcf > 0 THEN {jr('norm_fcf / discount_rate / shares', 2)} END AS epv_per_share""",
        f"CASE WHEN price > 0 AND shares > 0 AND norm_fcf > 0 THEN {implied_growth_sql('norm_fcf', 'market_cap', 'discount_rate', p)} END AS implied_growth",
        f"""CASE WHEN eps_growth_pct IS NOT NULL AND street_rev_growth_pct IS NOT NULL THEN least(eps_growth_pct, street_rev_growth_pct)
            WHEN eps_growth_pct IS NOT NULL THEN eps_growth_pct
            WHEN unprofitable THEN {haircut_growth} ELSE street_rev_growth_pct END AS street_growth_pct""",
        """CASE WHEN eps_growth_pct IS NOT NULL AND street_rev_growth_pct IS NOT NULL THEN 'min(revenue, eps)'
            WHEN eps_growth_pct IS NOT NULL THEN 'eps' WHEN street_rev_growth_pct IS NULL THEN NULL
            WHEN unprofitable THEN 'revenue-penalized' ELSE 'revenue' END AS growth_proxy""",
        f"""CASE WHEN norm_ebit IS NOT NULL AND equity IS NOT NULL AND total_debt IS NOT NULL AND {invested} > 0
            THEN {jr(f'norm_ebit * {tax} / {invested} * 100', 1)} END AS roic_pct""",
    ).selectExpr("*", f"{jr('implied_growth * 100', 1)} AS implied_growth_pct").selectExpr(
        "*", f"{jr('street_growth_pct - implied_growth_pct', 1)} AS expectations_gap_pts"
    )


ECONOMIC_COLUMNS = (
    "discount_rate_pct", "epv_per_share", "implied_growth_pct", "street_growth_pct", "expectations_gap_pts", "roic_pct", "growth_proxy",
)
