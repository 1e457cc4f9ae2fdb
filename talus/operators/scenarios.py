"""Scenario grids, votes and rankings: tables of outside judgment, merged by rule.

scenarios: entity_id, sample, horizon, scenario_case, weight, metric, multiple, value,
falsifier, justification; one row per (entity, sample, horizon, case).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus import params as P
from talus.functions.columns import js_round
from talus.functions.sqltext import jr
from talus.params import DEFAULTS

_in = lambda xs: ", ".join(f"'{x}'" for x in xs)

IMPLIED = f"""CASE WHEN shares > 0 AND multiple > 0 THEN
  CASE WHEN metric IN ({_in(P.EV_METRICS)}) THEN multiple * value - coalesce(net_debt, 0D)
       WHEN metric IN ({_in(P.EQUITY_METRICS)}) THEN multiple * value END / shares END"""

# Anchor metric -> column of metrics_wide that holds its trailing actual.
ACTUALS = {
    "EV/EBITDA": "ebitda_ttm", "EV/Sales": "revenue_ttm", "P/S": "revenue_ttm", "P/E": "net_income_ttm",
    "P/FCF": "fcf_ttm", "P/B": "equity",
}


def implied_price(scenarios: DataFrame, metrics: DataFrame) -> DataFrame:
    """Adds ``implied``: multiple times value, less net debt for enterprise metrics, per share
    at 2 dp; null when it cannot be priced or is not positive."""
    m = metrics.select("entity_id", "shares", "net_debt")
    return (
        scenarios.join(m, "entity_id", "left").withColumn("_raw", F.expr(IMPLIED))
        .withColumn("implied", F.expr(f"CASE WHEN _raw > 0 THEN {jr('_raw', 2)} END")).drop("_raw")
    )


def weighted_anchor(priced: DataFrame) -> DataFrame:
    """Weight-blended price per horizon over cases that priced with a positive weight. The
    three cases are summed in a fixed order, so the result is the same on any cluster."""
    part = lambda x: " + ".join(
        f"coalesce(max(CASE WHEN scenario_case = '{c}' AND implied IS NOT NULL AND weight > 0 THEN {x} END), 0D)" for c in P.CASES
    )
    return (
        priced.groupBy("entity_id", "sample", "horizon")
        .agg(F.expr(part("weight")).alias("w"), F.expr(part("weight * implied")).alias("wp"))
        .filter("w > 0")
        .selectExpr("entity_id", "sample", "horizon", f"{jr('wp / w', 2)} AS anchor")
    )


def entry_price(estimate: Column, years: Column, hurdle: float = DEFAULTS.gate.entry_hurdle) -> Column:
    """Price today at which reaching the estimate returns the hurdle each year."""
    return F.when(estimate > 0, js_round(estimate / F.pow(F.lit(1 + hurdle), years), 2))


def ttm_actuals(metrics: DataFrame) -> DataFrame:
    """One row per entity and anchor metric with its trailing actual."""
    rows = ", ".join(f"struct('{m}' AS metric, {c} AS actual)" for m, c in ACTUALS.items())
    return metrics.selectExpr("entity_id", f"inline(array({rows}))")


def scenario_pivot(priced: DataFrame) -> DataFrame:
    """Bear, base and bull price side by side per horizon."""
    return (
        priced.groupBy("entity_id", "sample", "horizon")
        .agg(*[F.expr(f"max(CASE WHEN scenario_case = '{c}' THEN implied END)").alias(c) for c in P.CASES])
    )


def ensemble_median(scenarios: DataFrame) -> DataFrame:
    """Per cell of the first sample the medians over the samples that use the same metric; a
    cell without a second such sample keeps its own numbers. At most a few samples per cell."""
    cell = Window.partitionBy("entity_id", "horizon", "scenario_case")
    base = lambda c: F.max(F.when(F.col("sample") == 1, F.col(c)))
    med = lambda c: js_round(F.median(c), 4)
    return (
        scenarios.withColumn("base_metric", base("metric").over(cell))
        .filter(F.col("metric") == F.col("base_metric"))
        .groupBy("entity_id", "horizon", "scenario_case", "metric")
        .agg(F.count("*").alias("n_peers"), *[med(c).alias(f"m_{c}") for c in ("weight", "multiple", "value")],
             *[base(c).alias(f"b_{c}") for c in ("weight", "multiple", "value")])
        .select(
            "entity_id", "horizon", "scenario_case", "metric", "n_peers",
            *[F.when(F.col("n_peers") < 2, F.col(f"b_{c}")).otherwise(F.col(f"m_{c}")).alias(c) for c in ("weight", "multiple", "value")],
        )
    )


def ensemble_sample_filter(scenarios: DataFrame, violations: DataFrame) -> DataFrame:
    """Drops later samples that raise any scenario rule; the first sample always stays."""
    bad = violations.filter("sample > 1").select("entity_id", "sample").distinct()
    return scenarios.join(bad, ["entity_id", "sample"], "left_anti")


def merged_scenarios(scenarios: DataFrame, verdicts: DataFrame, violations: DataFrame | None = None) -> DataFrame:
    """The first sample with the ensemble's numbers: later samples that break a rule are left out, and
    weight, multiple and value are the medians over the rest. Where the verdict lacks evidence, or
    there is none, the first draw stays."""
    kept = scenarios if violations is None else ensemble_sample_filter(scenarios, violations)
    cell, numbers = ["entity_id", "horizon", "scenario_case"], ("weight", "multiple", "value")
    med = ensemble_median(kept).select(*cell, *[F.col(c).alias(f"_m_{c}") for c in numbers])
    enough = verdicts.select("entity_id", (~F.coalesce("insufficient", F.lit(False))).alias("_enough"))
    first = scenarios.filter("sample = 1").join(med, cell, "left").join(enough, "entity_id", "left")
    use = F.coalesce("_enough", F.lit(False))
    return first.withColumns({c: F.when(use, F.coalesce(f"_m_{c}", c)).otherwise(F.col(c)) for c in numbers}).select(*scenarios.columns)


# --- votes -----------------------------------------------------------------------------


def vote_downgrade(votes: DataFrame, failures: DataFrame, label: str = "insufficient_evidence") -> DataFrame:
    """A vote that still fails its source check counts as insufficient evidence."""
    f = failures.select("vote_id", F.lit(True).alias("_failed")).distinct()
    return votes.join(f, "vote_id", "left").withColumn(
        "label", F.when(F.col("_failed"), F.lit(label)).otherwise(F.col("label"))
    ).drop("_failed")


def majority_vote(votes: DataFrame, keys: list[str]) -> DataFrame:
    """Modal label and its share; ties go to the label seen first. Two aggregates: votes shrink
    to one row per label before an entity is looked at as a whole."""
    per = votes.groupBy(*keys, "label").agg(F.count("*").alias("n"), F.min("vote_no").alias("first"))
    best = F.max_by(F.struct("label", "n"), F.struct("n", (-F.col("first")).alias("f")))
    return per.groupBy(*keys).agg(best.alias("b"), F.sum("n").alias("votes")).select(
        *keys, F.col("b.label").alias("winner"), (F.col("b.n") / F.col("votes")).alias("agreement"), F.col("votes").alias("votes")
    )


def winner_secondary(votes: DataFrame, keys: list[str]) -> DataFrame:
    """Secondary label of the first vote that names the winner; again per label first."""
    per = votes.groupBy(*keys, "label").agg(
        F.count("*").alias("n"), F.min("vote_no").alias("first"), F.min_by("secondary", "vote_no").alias("secondary")
    )
    best = F.max_by(F.struct("label", "secondary"), F.struct("n", (-F.col("first")).alias("f")))
    return per.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.label").alias("winner"), F.col("b.secondary").alias("secondary"))


def label_divergence(plain: DataFrame, masked: DataFrame, keys: list[str]) -> DataFrame:
    """Share of entities whose label is the same with and without the company's name."""
    j = plain.select(*keys, F.col("winner").alias("a")).join(masked.select(*keys, F.col("winner").alias("b")), keys)
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same")).select(
        "n", "same", js_round(F.try_divide(F.col("same"), F.col("n")), 4).alias("agreement")
    )


def agreement_health(analyses: DataFrame) -> DataFrame:
    """One row of run health: share of verdicts without evidence, mean vote agreement,
    validation failures, cache hits. ``agreement_hits`` / ``votes`` are counts, so the mean is
    taken over exact per-entity shares at 6 dp."""
    has = F.col("status") == "ok"
    return analyses.agg(
        F.count("*").alias("analyzed"),
        js_round(F.try_divide(F.count_if(has & F.col("insufficient")), F.count_if(has)), 4).alias("insufficient_rate"),
        js_round(F.sum(F.col("agreement").cast("decimal(12,6)")).cast("double") / F.count("*"), 4).alias("avg_agreement"),
        F.count_if(F.col("status") == "validation_failed").alias("validation_failed"),
        F.count_if("cache_hit").alias("cache_hits"),
    )


# Healthy ranges of the quality signals, lower and upper bound.
HEALTH_RANGES = (
    ("insufficient_rate", 0.25, 0.40),
    ("avg_agreement", 0.80, 1.00),
    ("sanity_trip_rate", 0.10, 0.20),
)


def health_ranges(health: DataFrame, sanity: DataFrame) -> DataFrame:
    """Each signal with its value, bounds and whether it lies inside them."""
    trip = sanity.agg(js_round(F.try_divide(F.count_if(F.col("confidence") == "degraded"), F.count("*")), 4).alias("x")).scalar()
    rows = ", ".join(f"struct('{n}' AS signal, {n} AS value, {lo}D AS low, {hi}D AS high)" for n, lo, hi in HEALTH_RANGES)
    return health.withColumn("sanity_trip_rate", trip).selectExpr(f"inline(array({rows}))").selectExpr(
        "*", "value BETWEEN low AND high AS healthy"
    )


def verdict_summary(verdicts: DataFrame, votes: DataFrame) -> DataFrame:
    """Compact fields of each verdict for ranking."""
    c = F.col
    pct_agree = js_round(c("agreement") * 100).cast("bigint")
    cause = F.concat(c("cause"), F.when(c("cause_secondary") != "none", F.concat(F.lit("+"), c("cause_secondary"))).otherwise(""))
    return verdicts.join(votes.select("entity_id", "agreement"), "entity_id", "left").select(
        "entity_id", cause.alias("cause"), pct_agree.alias("agreement_pct"), "insufficient", "thesis",
        F.when(F.size("anomalies") > 0, F.array_join("anomalies", "; ")).otherwise("none").alias("anomalies"),
        F.concat("guidance_change", F.lit(" ("), "guidance_timing", F.lit(")")).alias("guidance"),
        F.array_join("discrepancies", "; ").alias("discrepancies"),
    )


# --- rankings --------------------------------------------------------------------------


def _top(ranking: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("run", "pass").orderBy("pos")
    return ranking.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def rank_stability(ranking: DataFrame, n: int = DEFAULTS.memory.top_n, slack: int = 2) -> DataFrame:
    """Overlap of the top sets of the two passes; stable when at most ``slack`` are missing."""
    top = _top(ranking, n).groupBy("run", "entity_id").agg(
        F.bool_or(F.col("pass") == "forward").alias("f"), F.bool_or(F.col("pass") == "reversed").alias("r")
    )
    return top.groupBy("run").agg(F.count_if("f").alias("n_forward"), F.count_if(F.col("f") & F.col("r")).alias("overlap")).select(
        "run", "n_forward", "overlap", (F.col("n_forward") - F.col("overlap") <= slack).alias("stable")
    )


def rank_known_filter(ranking: DataFrame, known: DataFrame, n: int = DEFAULTS.memory.top_n) -> DataFrame:
    """Ranked names that exist in the input, the first ``n`` of the forward pass."""
    kept = ranking.filter(F.col("pass") == "forward").join(known.select("entity_id"), "entity_id", "left_semi")
    return _top(kept, n).select("run", "entity_id", "rn")
