"""Digest admission: calibrated fair value, health and economic rules, every exclusion with its
reasons in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.columns import clamp, hits, js_round
from talus.operators.scenarios import entry_price
from talus.params import DEFAULTS, CalibrationParams, GateParams


def calibrated_fair(df: DataFrame, overall: DataFrame, per_class: DataFrame, p: CalibrationParams = DEFAULTS.calibration) -> DataFrame:
    """Adds ``fair_adjusted``, ``calibration_active``, ``calibration_scope``, ``calibration_n``.

    df: fair, classification. overall: one row (n, mean_error_pct), read as a scalar. per_class:
    classification, n, mean_error_pct. Inactive below ``min_samples``; a class error counts
    from its own minimum on, else the overall one.
    """
    state = overall.select(F.struct("n", "mean_error_pct").alias("s")).scalar()
    cls = per_class.select("classification", F.col("n").alias("_cn"), F.col("mean_error_pct").alias("_ce"))
    # One row for each label of a fixed list; the many rows of a label stay where they are.
    j = df.withColumn("_s", state).join(F.broadcast(cls), "classification", "left")
    active = F.coalesce(F.col("_s.n") >= p.min_samples, F.lit(False))
    by_class = F.coalesce(F.col("_cn") >= p.min_samples_per_class, F.lit(False))
    err = F.when(by_class, F.col("_ce")).otherwise(F.col("_s.mean_error_pct"))
    factor = clamp(F.lit(1.0) + err / 100, p.min_factor, p.max_factor)
    return j.select(
        *df.columns,
        F.when(active, js_round(F.col("fair") * factor, 2)).otherwise(F.col("fair")).alias("fair_adjusted"),
        active.alias("calibration_active"),
        F.when(~active, "none").when(by_class, "class").otherwise("global").alias("calibration_scope"),
        F.when(active & by_class, F.col("_cn")).otherwise(F.coalesce("_s.n", F.lit(0).cast("bigint"))).alias("calibration_n"),
    )


def fast_guard(state: DataFrame, p: CalibrationParams = DEFAULTS.calibration) -> DataFrame:
    """One row: the extra discount demanded while kill-switches fire at a high rate. ``state``:
    one row (fired_share, n)."""
    on = (F.col("n") >= p.guard_min_graded) & (F.col("fired_share") > p.guard_fired_share)
    return state.select("fired_share", "n", F.when(on, p.guard_extra_discount).otherwise(0.0).alias("extra_discount"))


def effective_fair() -> Column:
    """Tighten only: the correction may lower the gate's fair value, never raise it."""
    return F.when(F.col("calibration_active"), F.least("fair_adjusted", "fair")).otherwise(F.col("fair"))


def with_undervaluation(df: DataFrame, guard: DataFrame, p: GateParams = DEFAULTS.gate) -> DataFrame:
    """Adds ``effective``, ``required_discount``, ``undervaluation_pct``."""
    extra = F.coalesce(guard.select("extra_discount").scalar(), F.lit(0.0))
    out = df.withColumn("effective", effective_fair()).withColumn("required_discount", F.lit(p.required_discount) + extra)
    under = F.try_divide(F.col("effective") - F.col("price"), F.col("effective"))
    return out.withColumn("undervaluation_pct", F.floor(under * 1000.0 + 0.5).cast("double") / 10.0)


def rules(p: GateParams = DEFAULTS.gate) -> list[tuple[Column, str]]:
    """(condition that excludes, reason) in the order reasons are listed. A null condition
    does not exclude; where unknown must exclude, the rule says so itself."""
    c = F.col
    cheap_limit = c("effective") * (F.lit(1.0) - c("required_discount"))
    too_dear = c("price") > cheap_limit
    low_debt = F.coalesce(c("net_debt") <= 0, F.lit(False)) | F.coalesce(c("nd_to_ebitda") <= p.max_net_debt_to_ebitda, F.lit(False))
    has_view = c("has_economics") & c("price").isNotNull()
    below_epv = F.coalesce(c("price") < c("epv_per_share"), F.lit(False))
    gap_ok = F.coalesce(c("expectations_gap_pts") >= p.min_gap_pts, F.lit(False))
    bypass = F.coalesce(c("fcf_pct") >= p.roic_bypass_margin_pct, F.lit(False))
    return [
        (c("insufficient"), "insufficient_evidence"),
        (c("effective").isNull(), "no_fair_value"),
        (c("effective").isNotNull() & c("price").isNull(), "no_price"),
        (too_dear & (c("undervaluation_pct") < 0), "above_fair_value"),
        (too_dear & (c("undervaluation_pct") >= 0), "discount_too_small"),
        (~low_debt, "debt"),
        (~F.coalesce(c("fcf_ttm") > 0, F.lit(False)), "no_free_cash_flow"),
        (~F.coalesce(c("moat").isin(*p.accepted_moats), F.lit(False)), "moat"),
        (has_view & ~below_epv & ~gap_ok & c("expectations_gap_pts").isNotNull(), "no_expectations_gap"),
        (has_view & ~below_epv & ~gap_ok & c("expectations_gap_pts").isNull(), "economics_unknown"),
        (c("has_economics") & (c("roic_pct") < c("discount_rate_pct")) & ~bypass, "roic_below_cost"),
        ((c("street_target") > 0) & (c("effective") > c("street_target") * p.street_cap), "street_cap"),
        (c("share_cagr_pct") > p.max_share_cagr_pct, "serial_dilution"),
        ((c("fcf_quarters") >= p.min_fcf_quarters)
         & (F.try_divide(c("fcf_positive_quarters"), c("fcf_quarters")) < p.min_fcf_positive_share), "inconsistent_cash"),
        (c("confidence") == "degraded", "degraded_metrics"),
    ]


INPUTS = {
    "has_verdict": "true", "insufficient": "false", "fair": "CAST(NULL AS DOUBLE)", "fair_adjusted": "CAST(NULL AS DOUBLE)",
    "calibration_active": "false", "price": "CAST(NULL AS DOUBLE)", "net_debt": "CAST(NULL AS DOUBLE)", "nd_to_ebitda": "CAST(NULL AS DOUBLE)",
    "fcf_ttm": "CAST(NULL AS DOUBLE)", "moat": "CAST(NULL AS STRING)", "has_economics": "false", "epv_per_share": "CAST(NULL AS DOUBLE)",
    "expectations_gap_pts": "CAST(NULL AS DOUBLE)", "roic_pct": "CAST(NULL AS DOUBLE)", "discount_rate_pct": "CAST(NULL AS DOUBLE)",
    "fcf_pct": "CAST(NULL AS DOUBLE)", "street_target": "CAST(NULL AS DOUBLE)", "share_cagr_pct": "CAST(NULL AS DOUBLE)",
    "fcf_quarters": "CAST(NULL AS BIGINT)", "fcf_positive_quarters": "CAST(NULL AS BIGINT)", "confidence": "CAST(NULL AS STRING)",
}


def fill_inputs(df: DataFrame) -> DataFrame:
    """Adds what the rules read and ``df`` lacks, as unknown. Lets a caller run one rule on the
    few columns it needs."""
    return df.selectExpr("*", *[f"{x} AS {c}" for c, x in INPUTS.items() if c not in df.columns])


def gate_rule(df: DataFrame, names: tuple[str, ...], guard: DataFrame | None = None, p: GateParams = DEFAULTS.gate) -> DataFrame:
    """Whether each entity passes the named rules alone, with the reasons it fails for."""
    d = fill_inputs(df)
    if guard is not None:
        d = with_undervaluation(d, guard, p)
    else:
        d = d.withColumn("effective", effective_fair()).withColumn("required_discount", F.lit(p.required_discount)).withColumn(
            "undervaluation_pct", F.lit(None).cast("double"))
    found = hits([(cond, name) for cond, name in rules(p) if name in names])
    return d.select("entity_id", found.alias("reasons")).withColumn("pass", F.size("reasons") == 0)


def digest_gate(df: DataFrame, guard: DataFrame, p: GateParams = DEFAULTS.gate) -> DataFrame:
    """Adds ``reasons`` and ``pass``. Without a verdict that is the only reason."""
    d = with_undervaluation(fill_inputs(df), guard, p)
    reasons = F.when(~F.col("has_verdict"), F.array(F.lit("no_verdict"))).otherwise(hits(rules(p)))
    blank = lambda c: F.when(F.col("has_verdict"), F.col(c))
    d = d.withColumn("reasons", reasons)
    for name in ("fair", "fair_adjusted", "effective", "undervaluation_pct"):
        d = d.withColumn(name, blank(name))
    return d.withColumn("pass", F.size("reasons") == 0)


def exclusion_reasons(gated: DataFrame, n: int = 8, order: str = "entity_id") -> DataFrame:
    """First reason of each excluded name, ``n`` names."""
    return (
        gated.filter(~F.col("pass")).select("entity_id", F.element_at("reasons", 1).alias("reason"), F.col(order).alias("_o"))
        .orderBy("_o").limit(n).drop("_o")
    )


def digest_table(gated: DataFrame, ranking: DataFrame, targets: DataFrame, seen: DataFrame, p: GateParams = DEFAULTS.gate) -> DataFrame:
    """The digest as data: ranked, admitted names with fair value, targets per horizon and
    case, entry price and when they were last seen."""
    wide = targets.groupBy("entity_id").agg(
        *[F.expr(f"max(CASE WHEN horizon = '{h}' AND scenario_case = '{c}' THEN implied END) AS {c}_{h}y")
          for h in ("1", "3") for c in ("bear", "base", "bull")]
    )
    c = F.col
    show = F.coalesce(F.when(c("calibration_active"), c("fair_adjusted")), c("fair"))
    return (
        gated.filter("pass").join(ranking.select("entity_id", "rank"), "entity_id")
        .join(wide, "entity_id", "left")
        .join(seen.select("entity_id", "seen_date", "seen_up"), "entity_id", "left")
        .select(
            "rank", "entity_id", "moat", "price", "fair", "fair_adjusted", "calibration_active", "undervaluation_pct",
            "implied_growth_pct", "street_growth_pct", "epv_per_share", "street_target",
            *[f"{k}_{h}y" for h in ("1", "3") for k in ("bear", "base", "bull")],
            js_round(show * (1 - p.required_discount), 2).alias("recommended_entry"),
            entry_price(c("base_1y"), F.lit(1)).alias("entry_base_1y"),
            entry_price(c("base_3y"), F.lit(3)).alias("entry_base_3y"),
            "seen_date", "seen_up", "thesis",
        )
    )
