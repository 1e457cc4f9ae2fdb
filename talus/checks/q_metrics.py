"""Quarterly fundamentals and data-quality rules."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from talus.checks.chains import avg_of, b, delta_of, facts_sql, growth_of, jr, margin_of, pct, ttm_of
from talus.checks.q_series import chosen
from talus.checks.registry import Tables, query
from talus.operators import metrics as M
from talus.operators import series as S
from talus.sources.gold import materialize


class Facts:
    """Series of one data folder, as one lazy plan."""

    def __init__(self, t: Tables):
        c = chosen(t)
        self.q, self.i, self.tags = S.quarterly_series(c), S.instant_series(c), S.tag_choice(c)

    @property
    def entities(self):
        return self.tags.select("entity_id").distinct()

    @property
    def grid(self):
        return M.quarter_grid(self.q)

    def metrics(self):
        return M.metrics_wide(self.q, self.i)


class Written(Facts):
    """The same with the series written once to the shared folder: for plans whose many
    branches would each compute them again. ``concepts`` are those that the result is made of."""

    def __init__(self, t: Tables, concepts: tuple[str, ...] | None = None):
        self.t, self.concepts = t, concepts

    @cached_property
    def parts(self):
        return S.split_points(materialize(S.series_points(chosen(self.t, self.concepts)), "series-points"))

    @cached_property
    def _metrics(self):
        return materialize(super().metrics(), "metrics")

    def metrics(self):
        """Written once as well: several branches of a plan read them."""
        return self._metrics

    q = property(lambda self: self.parts[0])
    i = property(lambda self: self.parts[1])
    tags = property(lambda self: self.parts[2])


FULL = "SELECT entity_id, p_end, {v} AS val, {a} AS accn FROM wide WHERE {v} IS NOT NULL"


@query("pct_change", facts_sql(f"""SELECT entity_id, concept, p_end, {pct('prev', 'val')} AS change_pct FROM (
    SELECT *, lag(val) OVER (PARTITION BY entity_id, concept ORDER BY p_end) AS prev FROM sq) WHERE prev IS NOT NULL"""))
def _(t):
    return M.change_steps(Facts(t).q)


@query("growth_lag", facts_sql(f"""SELECT a.entity_id, a.concept, {pct('b.val', 'a.val')} AS qoq_pct, {pct('c.val', 'a.val')} AS yoy_pct
    FROM sq a JOIN sq b ON b.entity_id = a.entity_id AND b.concept = a.concept AND b.rn = 2
    LEFT JOIN sq c ON c.entity_id = a.entity_id AND c.concept = a.concept AND c.rn = 5 WHERE a.rn = 1"""))
def _(t):
    q = Facts(t).q
    return M.growth_lag(q, 1, "qoq_pct").join(M.growth_lag(q, 4, "yoy_pct"), ["entity_id", "concept"], "left")


@query("growth_decel", facts_sql(f"SELECT entity_id, 'revenue' AS concept, {jr('a.v - b.v', 1)} AS decel_pts FROM yoy a JOIN yoy_prior b USING (entity_id)"))
def _(t):
    return M.growth_decel(M.only(Facts(t).q, "revenue"))


@query("align_subtract", facts_sql(FULL.format(v="cfo - capex", a="cfo_accn")))
def _(t):
    return M.align_subtract(Facts(t).grid, "cfo", "capex")


@query("align_subtract_optional", facts_sql(FULL.format(v="cfo - coalesce(sbc, 0)", a="cfo_accn")))
def _(t):
    return M.align_subtract_optional(Facts(t).grid, "cfo", "sbc")


@query("align_add", facts_sql(FULL.format(v="ebitda", a="oi_accn")))
def _(t):
    return M.align_add(Facts(t).grid, "oi", "da")


@query("gross_profit_fallback", facts_sql(FULL.format(v="gp", a="gp_accn")))
def _(t):
    return M.gross_profit(Facts(t).grid)


@query("owner_fcf", facts_sql(FULL.format(v="fcf", a="cfo_accn")))
def _(t):
    return M.owner_fcf(Facts(t).grid)


@query("margin_trend", facts_sql(f"SELECT 'gross' AS margin, * FROM ({margin_of('gp')}) UNION ALL SELECT 'operating', * FROM ({margin_of('oi')}) UNION ALL SELECT 'fcf', * FROM ({margin_of('fcf')})"))
def _(t):
    return M.margin_trend(Facts(t).grid)


@query("ttm", facts_sql("SELECT entity_id, concept, sum(val) AS ttm FROM sq WHERE rn <= 4 GROUP BY entity_id, concept HAVING count(*) = 4"))
def _(t):
    return M.ttm(Facts(t).q)


@query("avg_annualized", facts_sql("SELECT entity_id, concept, sum(val) / count(*) * 4 AS avg_annual FROM sq GROUP BY entity_id, concept HAVING count(*) >= 12"))
def _(t):
    return M.avg_annualized(Facts(t).q)


@query("capex_intensity", facts_sql("SELECT entity_id, capex_pct_revenue_ttm FROM mx WHERE capex_pct_revenue_ttm IS NOT NULL"))
def _(t):
    return Facts(t).metrics().filter("capex_pct_revenue_ttm IS NOT NULL").select("entity_id", "capex_pct_revenue_ttm")


@query("balance_aligned", facts_sql("""SELECT coalesce(c.entity_id, d.entity_id) AS entity_id, c.v AS cash_and_sti, c.accn AS cash_and_sti_accn,
    d.v AS total_debt, d.accn AS total_debt_accn, d.v - c.v AS net_debt FROM l_cash c FULL JOIN l_debt d ON c.entity_id = d.entity_id"""))
def _(t):
    cols = ["cash_and_sti", "cash_and_sti_accn", "total_debt", "total_debt_accn"]
    m = M.instant_metrics(Facts(t).i).filter("cash_and_sti IS NOT NULL OR total_debt IS NOT NULL")
    return m.select("entity_id", *cols, (F.col("total_debt") - F.col("cash_and_sti")).alias("net_debt"))


@query("net_debt_leverage", facts_sql("SELECT entity_id, net_debt, nd_to_ebitda, interest_cover FROM mx"))
def _(t):
    return Facts(t).metrics().select("entity_id", "net_debt", "nd_to_ebitda", "interest_cover")


@query("cash_runway", facts_sql("SELECT entity_id, v AS cash_runway_q FROM runway"))
def _(t):
    return Facts(t).metrics().filter("cash_runway_q IS NOT NULL").select("entity_id", "cash_runway_q")


@query("shares_fallback", facts_sql("SELECT entity_id, shares, accn AS shares_accn, yoy AS yoy_pct FROM sh WHERE shares IS NOT NULL"))
def _(t):
    m = Facts(t).metrics().filter("shares IS NOT NULL")
    return m.select("entity_id", "shares", "shares_accn", F.col("shares_yoy_pct").alias("yoy_pct"))


@query("nearest_yoy", facts_sql(f"""SELECT entity_id, concept, CASE WHEN dist <= 60 THEN {pct('ref', 'cur')} END AS yoy_pct FROM (
    SELECT c.entity_id, c.concept, arg_min(p.val, row(abs(p.p_end - (c.p_end - 365)), p.p_end)) AS ref, any_value(c.val) AS cur,
      min(abs(p.p_end - (c.p_end - 365))) AS dist
    FROM si c JOIN si p ON p.entity_id = c.entity_id AND p.concept = c.concept WHERE c.rn = 1 GROUP BY c.entity_id, c.concept)"""))
def _(t):
    return M.nearest_yoy(Facts(t).i)


@query("inventory_divergence", facts_sql("SELECT entity_id, inv.v AS inventory_qoq_pct, qoq.v AS revenue_qoq_pct FROM inv LEFT JOIN qoq USING (entity_id)"))
def _(t):
    m = Facts(t).metrics().filter("has_inventory_pair")
    return m.select("entity_id", "inventory_qoq_pct", "revenue_qoq_pct")


@query("revenue_cagr", facts_sql("SELECT entity_id, span_years, v AS revenue_cagr_pct FROM cagr"))
def _(t):
    return Facts(t).metrics().filter("span_years IS NOT NULL").select("entity_id", "span_years", "revenue_cagr_pct")


@query("margin_delta_window", facts_sql(f"SELECT 'gross' AS margin, entity_id, v AS delta_bp FROM ({delta_of('gp')}) UNION ALL SELECT 'operating', entity_id, v FROM ({delta_of('oi')})"))
def _(t):
    return M.margin_delta_window(Facts(t).grid)


@query("share_cagr", facts_sql("SELECT entity_id, v AS share_cagr_pct FROM sh_cagr"))
def _(t):
    m = Facts(t).metrics().filter("has_share_pair")
    return m.select("entity_id", F.col("share_cagr_any_pct").alias("share_cagr_pct"))


@query("fcf_consistency", facts_sql("SELECT entity_id, pos AS fcf_positive_quarters, n AS fcf_quarters FROM fpos"))
def _(t):
    m = Facts(t).metrics().filter("_fn > 0")
    return m.select("entity_id", F.col("_fpos").alias("fcf_positive_quarters"), F.col("_fn").alias("fcf_quarters"))


@query("provenance_map", facts_sql("""SELECT p.entity_id, p.concept, p.tag, coalesce(q.accn, i.accn) AS accn FROM picks p
    LEFT JOIN sq q ON q.entity_id = p.entity_id AND q.concept = p.concept AND q.rn = 1
    LEFT JOIN si i ON i.entity_id = p.entity_id AND i.concept = p.concept AND i.rn = 1"""))
def _(t):
    f = Facts(t)
    m = M.provenance_map(M.provenance(f.tags, f.q, f.i))
    return m.select("entity_id", F.explode("provenance").alias("concept", "v")).select(
        "entity_id", "concept", "v.tag", "v.accn"
    )


@query("metrics_wide", facts_sql("SELECT * FROM mx"))
def _(t):
    return Facts(t).metrics().drop(
        "revenue_accn", "gross_accn", "op_accn", "fcf_accn", "shares_accn", "cash_and_sti_accn", "total_debt_accn",
        "has_inventory_pair", "share_cagr_any_pct", "has_share_pair", "_fpos", "_fn",
    )


_BAL = f"""SELECT a.entity_id, 'balance-identity' AS rule, a.p_end, {jr('abs(a.val - (l.val + e.val)) / abs(a.val) * 100', 1)} AS detail
  FROM si a JOIN si l ON l.entity_id = a.entity_id AND l.concept = 'liabilities' AND l.rn = 1 AND l.p_end = a.p_end
  JOIN si e ON e.entity_id = a.entity_id AND e.concept = 'equity' AND e.rn = 1 AND e.p_end = a.p_end
  WHERE a.concept = 'assets' AND a.rn = 1 AND abs(a.val - (l.val + e.val)) / abs(a.val) > 0.02"""
_BOUNDS = """SELECT entity_id, 'margin-bounds' AS rule, as_of_quarter AS p_end, gross_pct AS detail FROM mx WHERE abs(gross_pct) > 100
  UNION ALL SELECT entity_id, 'sign', as_of_quarter, revenue_latest FROM mx WHERE revenue_latest < 0"""
_STEPS = """(SELECT a.entity_id, a.p_end, a.val, b.val AS prev, a.p_end - b.p_end AS gap FROM sq a JOIN sq b
  ON b.entity_id = a.entity_id AND b.concept = 'revenue' AND b.rn = a.rn + 1 WHERE a.concept = 'revenue' AND a.rn <= 7)"""
_CONT = f"SELECT entity_id, 'continuity' AS rule, p_end, {jr('abs(val - prev) / nullif(abs(prev), 0) * 100', 1)} AS detail FROM {_STEPS} WHERE abs(val - prev) / nullif(abs(prev), 0) > 0.5"
_ALIGN = f"SELECT entity_id, 'alignment' AS rule, p_end, cast(gap as double) AS detail FROM {_STEPS} WHERE gap > 100"
_COVER = """SELECT e.entity_id, c.concept FROM (SELECT DISTINCT entity_id FROM picks) e
  CROSS JOIN (VALUES ('revenue'), ('operatingIncome'), ('cfo'), ('assets')) c(concept)
  WHERE NOT EXISTS (SELECT 1 FROM picks p WHERE p.entity_id = e.entity_id AND p.concept = c.concept)"""
SANITY_ALL = f"""{_BAL} UNION ALL {_BOUNDS} UNION ALL {_CONT} UNION ALL {_ALIGN}
  UNION ALL SELECT entity_id, 'coverage:' || concept, NULL, NULL FROM ({_COVER})"""
SANITY_CONF = f"""SELECT e.entity_id, CASE WHEN f.n IS NULL THEN 'high' ELSE 'degraded' END AS confidence, coalesce(f.n, 0) AS n_flags,
  coalesce(f.rules, '') AS rules FROM (SELECT DISTINCT entity_id FROM picks) e LEFT JOIN (
  SELECT entity_id, count(*) AS n, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM ({SANITY_ALL}) GROUP BY entity_id) f USING (entity_id)"""


@query("sanity_balance", facts_sql(_BAL))
def _(t):
    return M.sanity_balance(Facts(t).i)


@query("sanity_bounds", facts_sql(_BOUNDS))
def _(t):
    return M.sanity_bounds(Facts(t).metrics())


@query("sanity_continuity", facts_sql(_CONT))
def _(t):
    return M.sanity_continuity(Facts(t).q)


@query("sanity_alignment", facts_sql(_ALIGN))
def _(t):
    return M.sanity_alignment(Facts(t).q)


@query("sanity_coverage", facts_sql(_COVER))
def _(t):
    f = Facts(t)
    return M.sanity_coverage(f.entities, f.tags)


@query("sanity_confidence", facts_sql(SANITY_CONF))
def _(t):
    # All concepts: who reports only what no rule looks at lacks the core ones, and is flagged for it.
    f = Written(t)
    return M.sanity_confidence(f.entities, M.sanity_flags(f.entities, f.tags, f.q, f.i, Facts.metrics(f)))
