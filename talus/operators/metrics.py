"""Quarterly fundamentals.

``series`` / ``instants`` are the long rows of the series step (entity_id, concept, p_end, val,
accn, rn with 1 = newest). ``quarter_grid`` lays the duration concepts side by side per quarter
end, so every aligned operator (subtract, add, margins, windows) is arithmetic between columns
of one row: no joins. All steps are keyed by ``entity_id``, on which the series step already
partitioned the data, so the grid and everything on it need no further exchange. Group sizes
are bounded by the quarters kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.functions.columns import js_round, pct_change
from talus.functions.sqltext import cagr, jr, pct, years
from talus.params import DEFAULTS, SanityParams

DURATION = {
    "revenue": "rev", "costOfRevenue": "cost", "grossProfit": "gpd", "operatingIncome": "oi", "netIncome": "ni",
    "depreciationAmortization": "da", "cfo": "cfo", "capex": "capex", "sbc": "sbc", "interestExpense": "intr",
    "weightedSharesDiluted": "ws",
}
TRACKED = ("rev", "gp", "oi", "ni", "cfo", "capex", "fcf", "ebitda", "intr", "ws")
MARGINS = {"gross": "gp", "operating": "oi", "fcf": "fcf"}


# --- long rows -------------------------------------------------------------------------


def only(series: DataFrame, concept: str) -> DataFrame:
    return series.filter(F.col("concept") == concept)


def growth_lag(series: DataFrame, lag: int, name: str = "growth_pct", shift: int = 0) -> DataFrame:
    """Growth of the newest point (or ``shift`` points earlier) against ``lag`` points back, by
    position. No row where the series is too short."""
    a, b = 1 + shift, 1 + shift + lag
    at = lambda k: f"max(CASE WHEN rn = {k} THEN val END)"
    return (
        series.filter(F.col("rn").isin(a, b)).groupBy("entity_id", "concept")
        .agg(F.expr(pct(at(b), at(a))).alias(name), F.count("*").alias("n")).filter("n = 2").drop("n")
    )


def growth_decel(series: DataFrame, lag: int = 4) -> DataFrame:
    """Growth over ``lag`` points now minus the same one point earlier."""
    at = lambda k: f"max(CASE WHEN rn = {k} THEN val END)"
    ends = [1, 2, 1 + lag, 2 + lag]
    return (
        series.filter(F.col("rn").isin(*ends)).groupBy("entity_id", "concept")
        .agg(F.expr(jr(f"{pct(at(1 + lag), at(1))} - {pct(at(2 + lag), at(2))}", 1)).alias("decel_pts"),
             F.count("*").alias("n"))
        .filter("n = 4").drop("n")
    )


def change_steps(series: DataFrame) -> DataFrame:
    """Percent change from each point to the next one."""
    w = Window.partitionBy("entity_id", "concept").orderBy("p_end")
    return (
        series.withColumn("prev", F.lag("val").over(w))
        .filter("prev IS NOT NULL")
        .select("entity_id", "concept", "p_end", pct_change("prev", "val").alias("change_pct"))
    )


def ttm(series: DataFrame) -> DataFrame:
    """Sum of the four newest points; no row when there are fewer."""
    return (
        series.filter("rn <= 4").groupBy("entity_id", "concept").agg(F.sum("val").alias("ttm"), F.count("*").alias("n"))
        .filter("n = 4").drop("n")
    )


def avg_annualized(series: DataFrame, min_points: int = 12) -> DataFrame:
    """Mean quarterly value times four over all kept points."""
    return (
        series.groupBy("entity_id", "concept")
        .agg((F.sum("val") / F.count("*") * 4).alias("avg_annual"), F.count("*").alias("n"))
        .filter(F.col("n") >= min_points)
        .drop("n")
    )


def nearest_yoy(instants: DataFrame, target_days: int = 365, tolerance: int = 60) -> DataFrame:
    """Change against the point nearest to a year before the latest, per concept; null when
    even the nearest is more than ``tolerance`` days off."""
    w = Window.partitionBy("entity_id", "concept")
    return (
        instants.withColumn("last_end", F.max("p_end").over(w))
        .withColumn("off", F.abs(F.datediff("p_end", "last_end") + target_days))
        .groupBy("entity_id", "concept")
        .agg(
            F.min_by("val", F.struct("off", "p_end")).alias("ref"),
            F.min("off").alias("off"),
            F.max_by("val", "p_end").alias("cur"),
        )
        .select("entity_id", "concept", F.when(F.col("off") <= tolerance, pct_change("ref", "cur")).alias("yoy_pct"))
    )


def provenance(chosen_tags: DataFrame, series: DataFrame, instants: DataFrame) -> DataFrame:
    """Per concept the chosen tag and the newest accession."""
    accn = series.filter("rn = 1").select("entity_id", "concept", "accn").unionByName(
        instants.filter("rn = 1").select("entity_id", "concept", "accn")
    )
    return chosen_tags.select("entity_id", "concept", "tag").join(accn, ["entity_id", "concept"], "left")


def provenance_map(rows: DataFrame) -> DataFrame:
    """The same as one map per entity; its size is bounded by the concept dictionary."""
    entry = F.struct("concept", F.struct("tag", "accn"))
    return rows.groupBy("entity_id").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("provenance"))


# --- quarter grid ----------------------------------------------------------------------


def quarter_grid(series: DataFrame) -> DataFrame:
    """One row per entity and quarter end, concepts side by side, plus the derived series.

    ``gp`` is the reported gross profit where the entity reports any, else revenue minus cost,
    never mixed. ``fcf`` is operating cash flow minus capex minus stock compensation (missing
    compensation counts as zero); ``fcf_raw`` leaves compensation in. For each tracked series
    ``r_*`` is the position from the newest point; ``rm_*`` the same among quarters whose
    revenue is known and not zero; ``i_rev`` counts revenue from the oldest.
    """
    pick = [f"max(CASE WHEN concept = '{c}' THEN val END) AS {a}" for c, a in DURATION.items()]
    pick += [
        f"max(CASE WHEN concept = '{c}' THEN accn END) AS {DURATION[c]}_accn"
        for c in ("revenue", "cfo", "grossProfit", "operatingIncome", "weightedSharesDiluted")
    ]
    g = series.groupBy("entity_id", "p_end").agg(*map(F.expr, pick)).selectExpr(
        "*", "count(gpd) OVER (PARTITION BY entity_id) > 0 AS has_gp"
    ).selectExpr(
        "*",
        "CASE WHEN has_gp THEN gpd ELSE rev - cost END AS gp",
        "CASE WHEN has_gp THEN gpd_accn ELSE rev_accn END AS gp_accn",
        "cfo - capex - coalesce(sbc, 0D) AS fcf",
        "cfo - capex AS fcf_raw",
        "oi + da AS ebitda",
    )
    down = "OVER (PARTITION BY entity_id ORDER BY p_end DESC ROWS UNBOUNDED PRECEDING)"
    up = "OVER (PARTITION BY entity_id ORDER BY p_end ROWS UNBOUNDED PRECEDING)"
    matched = lambda s: f"CASE WHEN {s} IS NOT NULL AND rev <> 0 THEN 1 END"
    return g.selectExpr(
        "*",
        *[f"CASE WHEN {s} IS NOT NULL THEN count({s}) {down} END AS r_{s}" for s in TRACKED],
        *[f"CASE WHEN {matched(s)} = 1 THEN count({matched(s)}) {down} END AS rm_{s}" for s in MARGINS.values()],
        f"CASE WHEN rev IS NOT NULL THEN count(rev) {up} END AS i_rev",
    )


def align_subtract(grid: DataFrame, a: str, b: str) -> DataFrame:
    """a - b at quarter ends both have."""
    return grid.filter(f"{a} IS NOT NULL AND {b} IS NOT NULL").selectExpr(
        "entity_id", "p_end", f"{a} - {b} AS val", f"{a}_accn AS accn"
    )


def align_subtract_optional(grid: DataFrame, a: str, b: str) -> DataFrame:
    """a - b, where a missing b counts as zero."""
    return grid.filter(f"{a} IS NOT NULL").selectExpr(
        "entity_id", "p_end", f"{a} - coalesce({b}, 0D) AS val", f"{a}_accn AS accn"
    )


def align_add(grid: DataFrame, a: str, b: str) -> DataFrame:
    """a + b at quarter ends both have."""
    return grid.filter(f"{a} IS NOT NULL AND {b} IS NOT NULL").selectExpr(
        "entity_id", "p_end", f"{a} + {b} AS val", f"{a}_accn AS accn"
    )


def gross_profit(grid: DataFrame) -> DataFrame:
    return grid.filter("gp IS NOT NULL").selectExpr("entity_id", "p_end", "gp AS val", "gp_accn AS accn")


def owner_fcf(grid: DataFrame) -> DataFrame:
    return grid.filter("fcf IS NOT NULL").selectExpr("entity_id", "p_end", "fcf AS val", "cfo_accn AS accn")


def _at(s: str, k: int) -> str:
    return f"max(CASE WHEN r_{s} = {k} THEN {s} END)"


def _last4(s: str) -> str:
    return f"CASE WHEN count_if(r_{s} <= 4) = 4 THEN sum(CASE WHEN r_{s} <= 4 THEN {s} END) END"


def _margin(s: str, k: int) -> str:
    return f"max(CASE WHEN rm_{s} = {k} THEN {s} / rev * 100 END)"


def _margin_cols(s: str, prefix: str) -> list[str]:
    accn = {"gp": "gp_accn", "oi": "oi_accn", "fcf": "cfo_accn"}[s]
    bp = lambda k: f"CAST({jr(f'({_margin(s, 1)} - {_margin(s, k)}) * 100')} AS BIGINT)"
    return [
        f"{jr(_margin(s, 1), 1)} AS {prefix}_pct", f"{bp(2)} AS {prefix}_qoq_bp", f"{bp(5)} AS {prefix}_yoy_bp",
        f"max(CASE WHEN rm_{s} = 1 THEN {accn} END) AS {prefix}_accn",
    ]


def _window_margin(s: str) -> str:
    part = lambda k, v: f"sum(CASE WHEN {s} IS NOT NULL AND rev <> 0 AND {k} <= 4 THEN {v} END)"
    one = lambda k: f"try_divide({part(k, s)}, {part(k, 'rev')})"
    return f"CAST({jr(f'({one('r_rev')} - {one('i_rev')}) * 10000')} AS BIGINT)"


def _by_margin(names: list[str], cols: list[str]) -> str:
    """One output row per margin from columns that carry its name."""
    fields = ", ".join("struct(" + ", ".join([f"'{m}' AS margin", *[f"{m}_{c} AS {c}" for c in cols]]) + ")" for m in names)
    return f"inline(array({fields}))"


def margin_trend(grid: DataFrame) -> DataFrame:
    """Latest gross, operating and FCF margin and its move in basis points against 1 and 4
    matched points back."""
    cols = [x for m, s in MARGINS.items() for x in _margin_cols(s, m)]
    wide = grid.groupBy("entity_id").agg(*map(F.expr, cols))
    out = wide.selectExpr("entity_id", _by_margin(list(MARGINS), ["pct", "qoq_bp", "yoy_bp", "accn"]))
    return out.filter("pct IS NOT NULL").withColumnRenamed("pct", "latest_pct")


def margin_delta_window(grid: DataFrame) -> DataFrame:
    """Gross and operating margin over the first four revenue quarters against the last four,
    in basis points."""
    wide = grid.groupBy("entity_id").agg(
        F.expr(_window_margin("gp")).alias("gross_delta_bp"), F.expr(_window_margin("oi")).alias("operating_delta_bp")
    )
    return wide.selectExpr("entity_id", _by_margin(["gross", "operating"], ["delta_bp"])).filter("delta_bp IS NOT NULL")


_REV_END = "CASE WHEN rev IS NOT NULL THEN p_end END"
_WS_END = "CASE WHEN ws IS NOT NULL THEN p_end END"


def quarter_metrics(grid: DataFrame) -> DataFrame:
    """Everything that comes from the quarters alone; names with a leading underscore are
    inputs of ``metrics_wide``."""
    cols = [
        "max(CASE WHEN r_rev = 1 THEN p_end END) AS as_of_quarter",
        f"{_at('rev', 1)} AS revenue_latest",
        "max(CASE WHEN r_rev = 1 THEN rev_accn END) AS revenue_accn",
        f"{pct(_at('rev', 2), _at('rev', 1))} AS revenue_qoq_pct",
        f"{pct(_at('rev', 5), _at('rev', 1))} AS revenue_yoy_pct",
        jr(f"{pct(_at('rev', 5), _at('rev', 1))} - {pct(_at('rev', 6), _at('rev', 2))}", 1) + " AS revenue_decel_pts",
        *_margin_cols("gp", "gross"), *_margin_cols("oi", "op"), *_margin_cols("fcf", "fcf"),
        f"{_at('fcf', 1)} AS fcf_latest",
        *[f"{_last4(s)} AS {n}_ttm" for s, n in (
            ("cfo", "cfo"), ("capex", "capex"), ("rev", "revenue"), ("ebitda", "ebitda"), ("oi", "ebit"),
            ("ni", "net_income"), ("fcf", "fcf"), ("intr", "interest"))],
        *[f"CASE WHEN count({s}) >= 12 THEN sum({s}) / count({s}) * 4 END AS {n}_avg5y" for s, n in (("oi", "ebit"), ("fcf", "fcf"))],
        "CASE WHEN count_if(r_fcf <= 2) = 2 THEN sum(CASE WHEN r_fcf <= 2 THEN fcf END) / 2 END AS _burn",
        f"{_at('ws', 1)} AS _ws", f"{pct(_at('ws', 5), _at('ws', 1))} AS _ws_yoy",
        "max(CASE WHEN r_ws = 1 THEN ws_accn END) AS _ws_accn",
        f"min_by(ws, {_WS_END}) AS _ws0", f"{years(f'min({_WS_END})', f'max({_WS_END})')} AS _ws_yrs", "count(ws) AS _n_ws",
        "count(rev) AS _n_rev", f"{years(f'min({_REV_END})', f'max({_REV_END})')} AS _yrs",
        "sum(CASE WHEN i_rev <= 4 THEN rev END) AS _f4", "sum(CASE WHEN r_rev <= 4 THEN rev END) AS _l4",
        f"{_window_margin('gp')} AS _d_gp", f"{_window_margin('oi')} AS _d_oi",
        "count_if(fcf > 0) AS _fpos", "count(fcf) AS _fn",
    ]
    return grid.groupBy("entity_id").agg(*map(F.expr, cols))


def instant_metrics(instants: DataFrame) -> DataFrame:
    """Latest balances. Cash takes the short-term investments of its own date, long-term debt
    the current debt of its own date; a missing partner counts as zero."""
    newest = lambda n, a: f"max(CASE WHEN concept = '{n}' THEN p_end END) OVER (PARTITION BY entity_id) AS {a}"
    at = lambda n, k=1, v="val": f"max(CASE WHEN concept = '{n}' AND rn = {k} THEN {v} END)"
    on = lambda n, d: f"coalesce(max(CASE WHEN concept = '{n}' AND p_end = {d} THEN val END), 0D)"
    sh = "concept = 'sharesOutstanding'"
    sh_end = f"CASE WHEN {sh} THEN p_end END"
    cols = [
        f"{at('cash')} + {on('shortTermInvestments', '_cash_end')} AS cash_and_sti", f"{at('cash', 1, 'accn')} AS cash_and_sti_accn",
        f"{at('longTermDebt')} + {on('currentDebt', '_ltd_end')} AS total_debt", f"{at('longTermDebt', 1, 'accn')} AS total_debt_accn",
        f"{at('equity')} AS equity", f"{at('ppe')} AS ppe",
        f"{at('sharesOutstanding')} AS _sh", f"{at('sharesOutstanding', 1, 'accn')} AS _sh_accn",
        f"{pct(at('inventory', 2), at('inventory', 1))} AS inventory_qoq_pct",
        f"{at('inventory', 2)} AS _inv2",
        f"min_by(val, CASE WHEN {sh} THEN struct(_off, p_end) END) AS _sh_ref", f"min(CASE WHEN {sh} THEN _off END) AS _sh_off",
        f"count_if({sh}) AS _sh_n", f"min_by(val, {sh_end}) AS _sh0", f"{years(f'min({sh_end})', f'max({sh_end})')} AS _sh_yrs",
    ]
    return (
        instants.selectExpr("*", newest("cash", "_cash_end"), newest("longTermDebt", "_ltd_end"), newest("sharesOutstanding", "_sh_end"))
        .selectExpr("*", "abs(datediff(p_end, _sh_end) + 365) AS _off")
        .groupBy("entity_id").agg(*map(F.expr, cols))
    )


def metrics_wide(series: DataFrame, instants: DataFrame) -> DataFrame:
    """Every figure of an entity in one row. Select what you need: unused aggregates are
    pruned."""
    j = quarter_metrics(quarter_grid(series)).join(instant_metrics(instants), "entity_id", "full")
    j = j.selectExpr(
        "*", "_n_rev >= 12 AND _yrs >= 3 AS _long", "coalesce(_sh_n, 0) >= 2 AS _cover",
        "total_debt - cash_and_sti AS net_debt",
    ).selectExpr(
        "*",
        "CASE WHEN _cover THEN _sh0 WHEN _n_ws >= 2 THEN _ws0 END AS _s0",
        "CASE WHEN _cover THEN _sh WHEN _n_ws >= 2 THEN _ws END AS _s1",
        "CASE WHEN _cover THEN _sh_yrs WHEN _n_ws >= 2 THEN _ws_yrs END AS _sy",
    )
    over = lambda a, b: f"CASE WHEN {b} > 0 THEN {jr(f'{a} / {b}', 1)} END"
    if_long = lambda x: f"CASE WHEN _long THEN {x} END"
    return j.selectExpr(
        "entity_id", "as_of_quarter", "revenue_latest", "revenue_accn", "revenue_qoq_pct", "revenue_yoy_pct", "revenue_decel_pts",
        "gross_pct", "gross_qoq_bp", "gross_yoy_bp", "gross_accn", "op_pct", "op_qoq_bp", "op_yoy_bp", "op_accn",
        "fcf_pct", "fcf_qoq_bp", "fcf_yoy_bp", "fcf_accn", "fcf_latest", "cfo_ttm", "capex_ttm",
        f"CASE WHEN revenue_ttm > 0 THEN {jr('capex_ttm / revenue_ttm * 100', 1)} END AS capex_pct_revenue_ttm",
        "revenue_ttm", "ebitda_ttm", "ebit_ttm", "net_income_ttm", "fcf_ttm", "ebit_avg5y", "fcf_avg5y",
        "cash_and_sti", "cash_and_sti_accn", "total_debt", "total_debt_accn", "equity", "ppe", "net_debt",
        f"{over('net_debt', 'ebitda_ttm')} AS nd_to_ebitda", f"{over('ebit_ttm', 'interest_ttm')} AS interest_cover",
        f"CASE WHEN _burn < 0 THEN {jr('cash_and_sti / -_burn', 1)} END AS cash_runway_q",
        "coalesce(_sh, _ws) AS shares", "coalesce(_sh_accn, _ws_accn) AS shares_accn",
        f"CASE WHEN _sh IS NULL THEN _ws_yoy WHEN _sh_off <= 60 THEN {pct('_sh_ref', '_sh')} END AS shares_yoy_pct",
        "inventory_qoq_pct", "_inv2 IS NOT NULL AS has_inventory_pair",
        f"{if_long(jr('_yrs', 1))} AS span_years", f"{if_long(cagr('_f4', '_l4', '(_yrs - 0.75D)'))} AS revenue_cagr_pct",
        f"{if_long('_d_gp')} AS gross_delta_bp", f"{if_long('_d_oi')} AS op_delta_bp",
        f"{if_long('_fpos')} AS fcf_positive_quarters", f"{if_long('_fn')} AS fcf_quarters",
        f"CASE WHEN _long AND _sy >= 3 THEN {cagr('_s0', '_s1', '_sy')} END AS share_cagr_pct",
        f"CASE WHEN _sy >= 3 THEN {cagr('_s0', '_s1', '_sy')} END AS share_cagr_any_pct", "_s0 IS NOT NULL AS has_share_pair",
        "_fpos", "_fn",
    )


# --- data-quality rules -----------------------------------------------------------------


def sanity_balance(instants: DataFrame, p: SanityParams = DEFAULTS.sanity) -> DataFrame:
    """Assets against liabilities plus equity at one common latest date."""
    at = lambda n, x: F.max(F.when(F.col("concept") == n, F.col(x)))
    names = ("assets", "liabilities", "equity")
    w = (
        instants.filter(F.col("rn") == 1).filter(F.col("concept").isin(*names))
        .groupBy("entity_id")
        .agg(*[at(n, "val").alias(n) for n in names], *[at(n, "p_end").alias(f"{n}_end") for n in names])
        .filter("assets_end = liabilities_end AND assets_end = equity_end")
    )
    gap = F.try_divide(F.abs(F.col("assets") - (F.col("liabilities") + F.col("equity"))), F.abs("assets"))
    return (
        w.withColumn("gap", gap).filter(F.col("gap") > p.balance_tolerance)
        .select("entity_id", F.lit("balance-identity").alias("rule"), F.col("assets_end").alias("p_end"),
                js_round(F.col("gap") * 100, 1).alias("detail"))
    )


def sanity_bounds(metrics: DataFrame) -> DataFrame:
    """Gross margin outside +-100 %, and negative latest revenue."""
    flags = F.array_compact(F.array(
        F.when(F.abs("gross_pct") > 100, F.struct(F.lit("margin-bounds").alias("rule"), F.col("gross_pct").alias("detail"))),
        F.when(F.col("revenue_latest") < 0, F.struct(F.lit("sign").alias("rule"), F.col("revenue_latest").alias("detail"))),
    ))
    return metrics.select("entity_id", F.col("as_of_quarter").alias("p_end"), F.explode(flags).alias("f")).select(
        "entity_id", "f.rule", "p_end", "f.detail"
    )


def _recent_steps(series: DataFrame, p: SanityParams) -> DataFrame:
    w = Window.partitionBy("entity_id").orderBy("p_end")
    return (
        only(series, "revenue").filter(F.col("rn") <= p.recent_quarters)
        .withColumn("prev", F.lag("val").over(w)).withColumn("prev_end", F.lag("p_end").over(w))
        .filter("prev_end IS NOT NULL")
    )


def sanity_continuity(series: DataFrame, p: SanityParams = DEFAULTS.sanity) -> DataFrame:
    """Revenue moves beyond the jump limit in the recent quarters."""
    move = F.try_divide(F.abs(F.col("val") - F.col("prev")), F.abs("prev"))
    return _recent_steps(series, p).withColumn("move", move).filter(F.col("move") > p.revenue_jump).select(
        "entity_id", F.lit("continuity").alias("rule"), "p_end", js_round(F.col("move") * 100, 1).alias("detail")
    )


def sanity_alignment(series: DataFrame, p: SanityParams = DEFAULTS.sanity) -> DataFrame:
    """Gaps between recent quarter ends longer than a quarter."""
    return (
        _recent_steps(series, p).withColumn("gap", F.datediff("p_end", "prev_end")).filter(F.col("gap") > p.max_gap_days)
        .select("entity_id", F.lit("alignment").alias("rule"), "p_end", F.col("gap").cast("double").alias("detail"))
    )


def sanity_coverage(entities: DataFrame, chosen_tags: DataFrame, p: SanityParams = DEFAULTS.sanity) -> DataFrame:
    """Core concepts for which no tag matched. Each entity expands to the fixed list; no
    cross join."""
    want = entities.select("entity_id", F.explode(F.array(*[F.lit(x) for x in p.core_concepts])).alias("concept"))
    return want.join(chosen_tags.select("entity_id", "concept"), ["entity_id", "concept"], "left_anti")


def sanity_flags(entities: DataFrame, chosen_tags: DataFrame, series: DataFrame, instants: DataFrame, metrics: DataFrame,
                 p: SanityParams = DEFAULTS.sanity) -> DataFrame:
    """All rules as rows (entity_id, rule, p_end, detail)."""
    cover = sanity_coverage(entities, chosen_tags, p).select(
        "entity_id", F.concat(F.lit("coverage:"), "concept").alias("rule"), F.lit(None).cast("date").alias("p_end"),
        F.lit(None).cast("double").alias("detail"),
    )
    parts = [sanity_balance(instants, p), sanity_bounds(metrics), sanity_continuity(series, p), sanity_alignment(series, p), cover]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def sanity_confidence(entities: DataFrame, flags: DataFrame) -> DataFrame:
    """``high`` iff an entity raises no rule. Flags per entity are bounded by the rules and the
    recent quarters."""
    per = flags.groupBy("entity_id").agg(
        F.count("*").alias("n_flags"), F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules")
    )
    return entities.select("entity_id").join(per, "entity_id", "left").select(
        "entity_id",
        F.when(F.col("n_flags").isNull(), "high").otherwise("degraded").alias("confidence"),
        F.coalesce("n_flags", F.lit(0)).cast("bigint").alias("n_flags"),
        F.coalesce("rules", F.lit("")).alias("rules"),
    )
