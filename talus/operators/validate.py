"""Rule engine over verdict tables. Every rule gives rows (entity_id, sample, rule, detail); a
verdict is fine when it has none.

Two passes cover all scenario rules: one over the rows, one aggregate per (entity, sample).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus import params as P
from talus.operators.scenarios import implied_price, ttm_actuals


def valid_sources(documents: DataFrame, priors: DataFrame) -> DataFrame:
    """Everything an entity's verdict may cite: its documents' accessions, the concept names,
    'screen' and its earlier predictions."""
    fixed = [n for n, *_ in P.CONCEPTS] + ["screen"]
    names = documents.select("entity_id").distinct().select("entity_id", F.explode(F.array(*map(F.lit, fixed))).alias("source"))
    return own_sources(documents, priors).unionByName(names).distinct()


def own_sources(documents: DataFrame, priors: DataFrame) -> DataFrame:
    return documents.select("entity_id", F.col("accession").alias("source")).unionByName(
        priors.select("entity_id", F.concat(F.lit("prior:"), F.col("run_date").cast("string")).alias("source"))
    )


def val_citations(claims: DataFrame, documents: DataFrame, priors: DataFrame) -> DataFrame:
    """Cited ids that are not valid, each once. Names valid for everybody are a plain
    predicate; only the rest is looked up."""
    fixed = [n for n, *_ in P.CONCEPTS] + ["screen"]
    asked = claims.filter(~F.col("source").isin(*fixed)).filter(
        (F.col("kind") != "guidance") | ((F.col("guidance_change") != "none_given") & (F.col("source") != ""))
    )
    return (
        asked.select("entity_id", "source").distinct()
        .join(own_sources(documents, priors).distinct(), ["entity_id", "source"], "left_anti")
    )


def context(scenarios: DataFrame, verdicts: DataFrame, metrics: DataFrame | None = None, bands: DataFrame | None = None,
            prices: DataFrame | None = None, street: DataFrame | None = None) -> DataFrame:
    """Scenario rows with everything the rules look at; priced once. An input that is left out
    reads as unknown, so a caller that runs one rule joins only what that rule needs."""
    ctx = scenarios.join(verdicts.select("entity_id", "insufficient"), "entity_id", "left")
    unknown: list[str] = []
    if metrics is None:
        unknown += ["shares", "net_debt", "implied", "actual"]
    else:
        ctx = implied_price(ctx, metrics).join(ttm_actuals(metrics), ["entity_id", "metric"], "left")
    for df, keys, cols in (
        (bands, ["entity_id", "metric"], ["p25", "p75"]),
        (prices, ["entity_id"], ["price"]),
        (street, ["entity_id"], ["street_revenue_1y"]),
    ):
        if df is None:
            unknown += cols
        else:
            ctx = ctx.join(df.select(*keys, *cols), keys, "left")
    return ctx.selectExpr(
        "* EXCEPT (insufficient)", "coalesce(insufficient, false) AS insufficient", "concat(horizon, 'y ', scenario_case) AS label",
        *[f"CAST(NULL AS DOUBLE) AS {c}" for c in unknown],
    )


def _sql_text(p: str) -> str:
    return "r'" + p.replace("'", "\\'") + "'" if "'" not in p else "'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'"


ROW_RULES = {
    "vague": f"falsifier RLIKE {_sql_text('(?i)' + P.VAGUE_PATTERN)} OR length(falsifier) < 20",
    "guidance_bar": f"scenario_case IN ('base', 'bull') AND falsifier RLIKE {_sql_text('(?i)' + P.GUIDANCE_PATTERN)}",
    "priceable": "NOT insufficient AND shares <> 0 AND (metric = 'none' OR implied IS NULL)",
    "multiple_range": "metric <> 'none' AND (multiple <= 0 OR multiple > 500)",
    "ttm_tether": "metric <> 'none' AND actual > 0 AND (value / actual < 0.1D OR value / actual > 10D)",
    "band_low": "metric <> 'none' AND multiple < p25 * 0.6D AND length(trim(coalesce(justification, ''))) < 40",
    "band_high": "metric <> 'none' AND multiple > p75 * 1.6D",
    "street": """street_revenue_1y <> 0 AND horizon = '1' AND metric IN ('EV/Sales', 'P/S')
        AND (value < street_revenue_1y * 0.6D OR value > street_revenue_1y * 1.4D)""",
}


def row_rules(ctx: DataFrame, rules: dict[str, str] = ROW_RULES) -> DataFrame:
    """Rules a scenario can break on its own."""
    arr = ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in rules.items())
    return ctx.selectExpr("entity_id", "sample", f"explode(array_compact(array({arr}))) AS rule", "label AS detail")


def group_rules(ctx: DataFrame) -> DataFrame:
    """Rules about the grid as a whole: complete cells, weights that sum to one, a bear case
    that is one, multiples that fade, and horizons that tell one story."""
    at = lambda h, c, x: f"max(CASE WHEN horizon = '{h}' AND scenario_case = '{c}' THEN {x} END)"
    cols = [
        "size(collect_set(label)) AS n_labels",
        "size(collect_set(CASE WHEN horizon IN ('1', '3') AND scenario_case IN ('bear', 'base', 'bull') THEN label END)) AS n_expected",
        "bool_or(insufficient) AS insufficient", "max(price) AS price",
        *[f"coalesce(sum(CASE WHEN horizon = '{h}' THEN weight END), 0D) AS w{h}" for h in P.HORIZONS],
        *[f"{at(h, c, x)} AS {x}{h}_{c}" for h in P.HORIZONS for c in P.CASES for x in ("implied", "metric", "multiple")],
    ]
    g = ctx.groupBy("entity_id", "sample").agg(*[F.expr(c) for c in cols])
    flags = ["CASE WHEN n_labels <> 6 OR n_expected <> 6 THEN struct('grid' AS rule, CAST(n_expected AS STRING) AS detail) END"]
    flags += [f"CASE WHEN w{h} < 0.85D OR w{h} > 1.15D THEN struct('weights' AS rule, '{h}y' AS detail) END" for h in P.HORIZONS]
    flags += ["CASE WHEN NOT insufficient AND price <> 0 AND implied1_bear > price * 1.15D THEN struct('bear' AS rule, '1y bear' AS detail) END"]
    flags += [
        f"CASE WHEN metric1_{c} <> 'none' AND metric1_{c} = metric3_{c} AND multiple3_{c} > multiple1_{c} * 1.1D THEN struct('fade' AS rule, '{c}' AS detail) END"
        for c in P.CASES
    ]
    flags += [
        f"CASE WHEN NOT insufficient AND implied3_{c} < implied1_{c} * 0.7D THEN struct('coherence' AS rule, '{c}' AS detail) END" for c in P.CASES
    ]
    return g.selectExpr("entity_id", "sample", f"inline(array_compact(array({', '.join(flags)})))")


def verdict_rules(verdicts: DataFrame, quotes: DataFrame) -> DataFrame:
    """Rules about the verdict itself; they concern the first sample."""
    flags = """explode(array_compact(array(
        CASE WHEN cause <> 'insufficient_evidence' AND n_cause_sources = 0 THEN 'class_sources' END,
        CASE WHEN NOT insufficient AND n_key_facts = 0 THEN 'keyfacts' END))) AS rule"""
    per = verdicts.selectExpr("entity_id", "1 AS sample", flags, "'' AS detail")
    short = quotes.filter("length(trim(quote)) < 15").selectExpr("entity_id", "1 AS sample", "'quote' AS rule", "quote_id AS detail")
    return per.unionByName(short)


def scenario_violations(ctx: DataFrame) -> DataFrame:
    return row_rules(ctx).unionByName(group_rules(ctx))


def val_rollup(verdicts: DataFrame, violations: DataFrame, bad_sources: DataFrame) -> DataFrame:
    """Per verdict: ok flag, number of bad sources, and the problems as sorted text. What is
    collected is bounded by rules times cells (reconciliation quotes are only counted)."""
    first = violations.filter("sample = 1")
    listed = F.collect_set(F.when(F.col("rule") != "quote", F.concat("rule", F.lit(":"), "detail")))
    prob = first.groupBy("entity_id").agg(
        F.count("*").alias("n_problems"), F.array_join(F.array_sort(listed), ";").alias("problems")
    )
    bad = bad_sources.groupBy("entity_id").agg(F.count("*").alias("n_bad_sources"))
    zero = F.lit(0).cast("bigint")
    return (
        verdicts.select("entity_id").join(prob, "entity_id", "left").join(bad, "entity_id", "left")
        .select(
            "entity_id",
            (F.col("n_problems").isNull() & F.col("n_bad_sources").isNull()).alias("ok"),
            F.coalesce("n_bad_sources", zero).alias("n_bad_sources"),
            F.coalesce("n_problems", zero).alias("n_problems"),
            F.coalesce("problems", F.lit("")).alias("problems"),
        )
    )
