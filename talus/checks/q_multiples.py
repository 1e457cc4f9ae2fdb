"""Point-in-time multiples and valuation economics."""

from __future__ import annotations

from talus.checks.chains import _LATER, facts_sql, jr
from talus.checks.q_metrics import Facts, Written
from talus.checks.q_series import chosen
from talus.checks.registry import query
from talus.checks.roles import with_roles
from talus.operators import asof
from talus.operators import economics as E
from talus.operators import metrics as M
from talus.operators import multiples as X
from talus.operators import series as S
from talus.params import EconomicsParams
from talus.sources.gold import materialize

# Size limits scaled to the role tables' market values.
ECO = EconomicsParams(small_cap=3e8, mega_cap=1e9)

_ttm = lambda s, m, ev: f"""SELECT entity_id, '{m}' AS metric, {ev} AS is_ev, p_end, sum(v) OVER w AS ttm, count(*) OVER w AS n FROM s_{s}
  WINDOW w AS (PARTITION BY entity_id ORDER BY p_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"""  # noqa: E731


def _near(left: str, right: str, keys: str, tol: int) -> str:
    """Range join plus arg_min, as the second opinion on the two-sort form."""
    return f"""SELECT l.*, (SELECT arg_min(r.val, row(abs(r.at - l.p_end), r.at)) FROM {right} r WHERE {keys} AND abs(r.at - l.p_end) < {tol}) AS near FROM {left} l"""


_LATER |= {
    "ts": f"""SELECT entity_id, metric, is_ev, p_end, ttm FROM ({_ttm('rev', 'EV/Sales', 'true')} UNION ALL {_ttm('ebitda', 'EV/EBITDA', 'true')}
        UNION ALL {_ttm('ni', 'P/E', 'false')} UNION ALL {_ttm('fcf_raw', 'P/FCF', 'false')}) WHERE n = 4""",
    "ends": "SELECT DISTINCT entity_id, p_end FROM ts",
    "pts": """SELECT entity_id, concept, p_end AS at, val FROM si UNION ALL SELECT entity_id, concept, p_end, val FROM sq WHERE concept = 'weightedSharesDiluted'""",
    "asks": "SELECT e.entity_id, e.p_end, c.concept FROM ends e CROSS JOIN (VALUES ('longTermDebt'), ('currentDebt'), ('cash'), ('shortTermInvestments'), ('sharesOutstanding'), ('weightedSharesDiluted')) c(concept)",
    "near6": _near("asks", "pts", "r.entity_id = l.entity_id AND r.concept = l.concept", 135),
    "bal": "SELECT entity_id, p_end, " + ", ".join(f"max(CASE WHEN concept = '{c}' THEN near END) AS {c}" for c in X.DATED) + " FROM near6 GROUP BY entity_id, p_end",
    "bars": "SELECT symbol AS entity_id, bar_date AS at, close AS val FROM fx_bars_m",
    "at_close": _near("ends", "bars", "r.entity_id = l.entity_id", 46),
    "now": "SELECT entity_id, net_debt, shares FROM mx",
    "nda": """SELECT b.*, CASE WHEN longTermDebt IS NULL AND cash IS NULL THEN coalesce(n.net_debt, 0)
        ELSE coalesce(longTermDebt, 0) + coalesce(currentDebt, 0) - coalesce(cash, 0) - coalesce(shortTermInvestments, 0) END AS net_debt_at,
        coalesce(sharesOutstanding, weightedSharesDiluted, n.shares) AS shares_at, n.shares FROM bal b JOIN now n USING (entity_id)""",
    "hm": """SELECT t.entity_id, t.metric, t.p_end, (c.near * a.shares_at + CASE WHEN t.is_ev THEN a.net_debt_at ELSE 0 END) / t.ttm AS ratio
        FROM ts t JOIN nda a USING (entity_id, p_end) JOIN at_close c USING (entity_id, p_end) WHERE t.ttm > 0 AND c.near IS NOT NULL AND a.shares > 0""",
    "bands": f"""SELECT entity_id, metric, {jr('quantile_cont(ratio, 0.25)', 1)} AS p25, {jr('quantile_cont(ratio, 0.5)', 1)} AS p50, {jr('quantile_cont(ratio, 0.75)', 1)} AS p75,
        count(*) AS n FROM hm GROUP BY entity_id, metric HAVING count(*) >= 4""",
    "px": "SELECT symbol AS entity_id, arg_max(close, bar_date) AS price FROM fx_bars_m GROUP BY symbol",
    "cur": f"""SELECT entity_id, metric, {jr('(price * shares + extra) / denom', 1)} AS value FROM (
        SELECT m.entity_id, p.price, m.shares, unnest(['EV/Sales', 'EV/EBITDA', 'P/E', 'P/FCF']) AS metric,
          unnest([revenue_ttm, ebitda_ttm, net_income_ttm, fcf_ttm]) AS denom, unnest([coalesce(net_debt, 0), coalesce(net_debt, 0), 0, 0]) AS extra
        FROM mx m JOIN px p USING (entity_id) WHERE m.shares > 0 AND p.price > 0) WHERE denom > 0""",
    "street": """SELECT entity_id, CASE WHEN rev1 > 0 THEN rev1 END AS street_revenue_1y, CASE WHEN eps0 > 0 THEN floor((eps1 / eps0 - 1) * 1000 + 0.5) / 10 END AS eps_growth_pct FROM (
        SELECT entity_id, max(revenue) FILTER (WHERE period = '+1y') AS rev1, max(eps) FILTER (WHERE period = '0y') AS eps0, max(eps) FILTER (WHERE period = '+1y') AS eps1
        FROM fx_estimates GROUP BY entity_id)""",
    "e1": f"""SELECT m.*, p.price, s.street_revenue_1y, s.eps_growth_pct, CASE WHEN p.price <> 0 AND m.shares <> 0 THEN p.price * m.shares END AS market_cap,
        CASE WHEN ebit_avg5y IS NULL OR ebit_ttm <= ebit_avg5y THEN ebit_ttm WHEN ebit_ttm IS NOT NULL THEN ebit_avg5y END AS norm_ebit,
        CASE WHEN fcf_avg5y IS NULL OR fcf_ttm <= fcf_avg5y THEN fcf_ttm WHEN fcf_ttm IS NOT NULL THEN fcf_avg5y END AS norm_fcf,
        CASE WHEN s.street_revenue_1y <> 0 AND revenue_ttm > 0 THEN {jr('(s.street_revenue_1y / revenue_ttm - 1) * 100', 1)} END AS srg
        FROM mx m LEFT JOIN px p USING (entity_id) LEFT JOIN street s USING (entity_id)""",
    "e2": """SELECT *, (coalesce(nd_to_ebitda > 1.5, false))::int + (coalesce(fcf_pct < 5, false))::int + (coalesce(market_cap < 3e8, false))::int AS risk_markers FROM e1""",
    "e3": """SELECT *, CASE WHEN risk_markers > 0 THEN least(1e-1 + 2e-2 * risk_markers, 16e-2)
        WHEN market_cap > 1e9 AND ebit_ttm > 0 AND (nd_to_ebitda IS NULL OR nd_to_ebitda < 1.5) THEN 1e-1 - 2e-2 ELSE 1e-1 END AS r FROM e2""",
    "eqv": "SELECT *, norm_ebit * 79e-2 / r - coalesce(net_debt, 0) AS eq, greatest(equity + total_debt - coalesce(cash_and_sti, 0), coalesce(ppe, 0)) AS invested FROM e3",
}


def pv(f0: str, g: str, r: str) -> str:
    x = f"((1 + {g}) / (1 + {r}))"
    return f"({f0}) * (list_sum(list_transform(range(1, 11), lambda k: pow({x}, k))) + pow({x}, 10) * (1 + 25e-3) / ({r} - 25e-3))"


SOLVE = f"""solve AS (SELECT entity_id, norm_fcf AS f0, market_cap AS cap, r, -9e-1 AS lo, 1e0 AS hi, 0 AS i FROM eqv
    WHERE price > 0 AND shares > 0 AND norm_fcf > 0
  UNION ALL SELECT entity_id, f0, cap, r, CASE WHEN {pv('f0', '((lo + hi) / 2)', 'r')} < cap THEN (lo + hi) / 2 ELSE lo END,
    CASE WHEN {pv('f0', '((lo + hi) / 2)', 'r')} < cap THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM solve WHERE i < 60)"""
_LATER |= {
    "implied": f"""SELECT entity_id, CASE WHEN {pv('f0', '(-9e-1)', 'r')} > cap THEN -9e-1 WHEN {pv('f0', '1e0', 'r')} < cap THEN NULL ELSE (lo + hi) / 2 END AS g
        FROM solve WHERE i = 60""",
    "eco": f"""SELECT q.*, {jr('r * 100', 1)} AS discount_rate_pct,
        CASE WHEN shares > 0 AND norm_ebit > 0 THEN CASE WHEN eq > 0 THEN {jr('eq / shares', 2)} END WHEN shares > 0 AND norm_fcf > 0 THEN {jr('norm_fcf / r / shares', 2)} END AS epv_per_share,
        {jr('i.g * 100', 1)} AS implied_growth_pct,
        CASE WHEN eps_growth_pct IS NOT NULL AND srg IS NOT NULL THEN least(eps_growth_pct, srg) WHEN eps_growth_pct IS NOT NULL THEN eps_growth_pct
          WHEN coalesce(net_income_ttm <= 0, false) THEN {jr('srg * 5e-1', 1)} ELSE srg END AS street_growth_pct,
        CASE WHEN eps_growth_pct IS NOT NULL AND srg IS NOT NULL THEN 'min(revenue, eps)' WHEN eps_growth_pct IS NOT NULL THEN 'eps' WHEN srg IS NULL THEN NULL
          WHEN coalesce(net_income_ttm <= 0, false) THEN 'revenue-penalized' ELSE 'revenue' END AS growth_proxy,
        CASE WHEN norm_ebit IS NOT NULL AND equity IS NOT NULL AND total_debt IS NOT NULL AND invested > 0 THEN {jr('norm_ebit * 79e-2 / invested * 100', 1)} END AS roic_pct
        FROM eqv q LEFT JOIN implied i USING (entity_id)""",
    "ecov": f"SELECT *, {jr('street_growth_pct - implied_growth_pct', 1)} AS expectations_gap_pts FROM eco",
}


def sql(body: str, *roles: str) -> str:
    text = facts_sql(body, "fx_bars_m", *roles)
    if " implied AS (" in text:  # the solver is recursive; it goes before its first reader
        text = text.replace("WITH ", "WITH RECURSIVE ", 1).replace(" implied AS (", f" {SOLVE}, implied AS (", 1)
    return text


class Val(Written):
    @property
    def closes(self):
        return self.t("fx_bars_m")

    def now(self):
        return self.metrics().select("entity_id", "net_debt", "shares")

    def balances(self):
        return X.dated_balances(X.ttm_series(self.grid), self.i, self.q)

    def ratios(self):
        return X.historical_multiples(X.ttm_series(self.grid), self.balances(), self.closes, self.now())

    def economics(self):
        base = self.metrics().join(X.last_close(self.closes), "entity_id", "left")
        return E.economic_view(base.join(E.eps_growth(self.t("fx_estimates")), "entity_id", "left"), ECO)


class Lean(Val):
    """For plans that read the metrics once: they are not written, so only what the result asks for is
    worked out. With ``concepts`` the others are not worked on; ``cash`` is always among them, as a
    supplier reports it with whatever else, so no entity is lost."""

    def metrics(self):
        return Facts.metrics(self)


TRAILING = ("revenue", "operatingIncome", "depreciationAmortization", "netIncome", "cfo", "capex")
OVER_TIME = (*TRAILING, *X.DATED)


def trailing(t):
    """Trailing sums from the concepts they are made of; the other concepts are not worked on."""
    return X.ttm_series(M.quarter_grid(S.quarterly_series(chosen(t, TRAILING))))


@query("ttm_series", sql("SELECT entity_id, metric, is_ev, p_end, ttm FROM ts"))
def _(t):
    return trailing(t)


@query("asof_nearest_instant", sql("SELECT entity_id, p_end, concept, near FROM near6"))
def _(t):
    v = Lean(t, OVER_TIME)
    b = v.balances()
    rows = ", ".join(f"struct('{c}' AS concept, {c} AS near)" for c in X.DATED)
    return b.selectExpr("entity_id", "p_end", f"inline(array({rows}))")


@query("asof_nearest_close", sql("SELECT entity_id, p_end, near AS close_at FROM at_close"))
def _(t):
    ends = materialize(trailing(t).select("entity_id", "p_end").distinct(), "ends")
    bars = t("fx_bars_m").selectExpr("symbol AS entity_id", "bar_date", "close")
    return asof.nearest(ends, bars, ["entity_id"], "p_end", "bar_date", "close", "close_at", 46)


@query("net_debt_at", sql("SELECT entity_id, p_end, net_debt_at FROM nda"))
def _(t):
    v = Lean(t, OVER_TIME)
    return X.net_debt_at(v.balances(), v.now()).select("entity_id", "p_end", "net_debt_at")


@query("shares_at", sql("SELECT entity_id, p_end, shares_at FROM nda"))
def _(t):
    v = Lean(t, OVER_TIME)
    return X.net_debt_at(v.balances(), v.now()).select("entity_id", "p_end", "shares_at")


@query("historical_multiples", sql("SELECT * FROM hm"))
def _(t):
    return Lean(t, OVER_TIME).ratios()


@query("multiple_bands", sql("SELECT * FROM bands"))
def _(t):
    return X.multiple_bands(Lean(t, OVER_TIME).ratios())


@query("current_multiples", sql("SELECT * FROM cur"))
def _(t):
    return X.current_multiples(Lean(t).metrics(), X.last_close(t("fx_bars_m")))


BALANCES = ("cash", "shortTermInvestments", "longTermDebt", "currentDebt")
FREE_CASH = ("cfo", "capex", "sbc")
#: What the discount rate depends on: leverage, cash margin, market value.
RISK = (*BALANCES, *FREE_CASH, "revenue", "operatingIncome", "depreciationAmortization", "sharesOutstanding", "weightedSharesDiluted")
RETURNS = (*BALANCES, "operatingIncome", "equity", "ppe")


def eco_query(name: str, cols: str, *concepts: str):
    names = [c.strip() for c in cols.split(",")]

    @query(name, sql(f"SELECT entity_id, {cols} FROM ecov", "fx_estimates"))
    def _(t):
        return Lean(t, concepts).economics().select("entity_id", *names)


eco_query("risk_tier_rate", "discount_rate_pct, risk_markers", *RISK)
eco_query("normalized_earnings", "norm_ebit, norm_fcf", "cash", *FREE_CASH, "operatingIncome")
eco_query("epv_floor", "epv_per_share", *RISK)
eco_query("implied_growth", "implied_growth_pct", *RISK)
eco_query("street_growth", "street_growth_pct, growth_proxy", "cash", "revenue", "netIncome")
eco_query("roic", "roic_pct", *RETURNS)
eco_query("expectations_gap", "street_growth_pct, implied_growth_pct, expectations_gap_pts", *RISK, "netIncome")


@query("eps_growth", sql("SELECT * FROM street", "fx_estimates"))
def _(t):
    return E.eps_growth(t("fx_estimates"))


@query("dcf_present_value", facts_sql(
    f"""SELECT entity_id, {jr("list_sum(list_transform(range(1, 11), lambda k: fcf_ttm * pow(1 + g, k) / pow(1 + 1e-1, k))) + fcf_ttm * pow(1 + g, 10) * (1 + 25e-3) / (1e-1 - 25e-3) / pow(1 + 1e-1, 10)")} AS pv
    FROM (SELECT entity_id, fcf_ttm, revenue_cagr_pct / 100 AS g FROM mx)"""))
def _(t):
    from talus.functions.columns import js_round

    m = Facts(t).metrics().selectExpr("entity_id", "fcf_ttm", "revenue_cagr_pct / 100 AS g")
    return E.dcf_present_value(m, "fcf_ttm", "g", "0.1D").select("entity_id", js_round("pv").alias("pv"))
