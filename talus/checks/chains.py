"""Shared CTE chains of the SQL twins: facts -> series -> wide -> metrics."""

from __future__ import annotations

from talus import params as P
from talus.checks.roles import with_roles


def jr(x: str, dp: int = 0) -> str:
    """Half toward +infinity, as the operators round."""
    s = 10**dp
    return f"(floor(({x}) * {s} + 0.5) / {s})" if s > 1 else f"floor(({x}) + 0.5)"


def pct(frm: str, to: str) -> str:
    return jr(f"(({to}) - ({frm})) / nullif(abs({frm}), 0) * 100", 1)


def b(x: str) -> str:
    return f"cast({x} as bigint)"


_VALUES = ", ".join(
    f"('{n}', '{tax}', '{unit}', '{kind}', '{tag}', {i})"
    for n, tax, unit, kind, tags in P.CONCEPTS
    for i, tag in enumerate(tags)
)

SERIES: dict[str, str] = {
    "ctab": f"SELECT * FROM (VALUES {_VALUES}) v(concept, taxonomy, pref, kind, tag, tag_rank)",
    "mapped": "SELECT f.*, c.concept, c.pref, c.kind, c.tag_rank FROM fx_facts f JOIN ctab c USING (taxonomy, tag)",
    "units": """SELECT entity_id, concept, tag, tag_rank, unit, max(p_end) AS newest,
        row_number() OVER (PARTITION BY entity_id, concept, tag ORDER BY unit <> any_value(pref), min(pos)) AS u
      FROM mapped GROUP BY entity_id, concept, tag, tag_rank, unit""",
    "picks": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, concept ORDER BY newest DESC, tag_rank) AS k
        FROM units WHERE u = 1) WHERE k = 1""",
    "chosen": """SELECT m.* FROM mapped m JOIN picks p USING (entity_id, concept, tag, unit)""",
    "dur": """SELECT entity_id, concept, p_start, p_end, val, accn, first_pos, p_end - p_start AS days FROM (
        SELECT *, min(pos) OVER w AS first_pos, row_number() OVER (PARTITION BY entity_id, concept, p_start, p_end ORDER BY filed DESC, pos) AS k
        FROM chosen WHERE kind = 'duration' AND p_start IS NOT NULL
        WINDOW w AS (PARTITION BY entity_id, concept, p_start, p_end)) WHERE k = 1""",
    "direct": """SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, concept, p_end ORDER BY first_pos DESC) AS k
        FROM dur WHERE days BETWEEN 80 AND 100) WHERE k = 1""",
    "diffs0": """SELECT entity_id, concept, p_end, accn, p_start AS gstart, min(first_pos) OVER (PARTITION BY entity_id, concept, p_start) AS gpos,
        val - lag(val) OVER s AS val, lag(p_end) OVER s AS prev_end
        FROM dur WHERE days BETWEEN 80 AND 380 WINDOW s AS (PARTITION BY entity_id, concept, p_start ORDER BY p_end)""",
    "diffs": """SELECT entity_id, concept, prev_end + 1 AS p_start, p_end, val, accn FROM (
        SELECT *, row_number() OVER (PARTITION BY entity_id, concept, p_end ORDER BY gpos) AS k FROM diffs0 d
        WHERE p_end - prev_end BETWEEN 80 AND 100
          AND NOT EXISTS (SELECT 1 FROM direct x WHERE x.entity_id = d.entity_id AND x.concept = d.concept AND x.p_end = d.p_end))
        WHERE k = 1""",
    "allq": """SELECT entity_id, concept, p_start, p_end, val, accn, 'direct' AS derived FROM direct
        UNION ALL SELECT entity_id, concept, p_start, p_end, val, accn, 'ytd-diff' FROM diffs""",
    "sq": """SELECT *, row_number() OVER (PARTITION BY entity_id, concept ORDER BY p_end) AS idx FROM (
        SELECT *, row_number() OVER (PARTITION BY entity_id, concept ORDER BY p_end DESC) AS rn FROM allq) WHERE rn <= 21""",
    "sa": """SELECT * FROM (SELECT entity_id, concept, p_start, p_end, val, accn,
        row_number() OVER (PARTITION BY entity_id, concept ORDER BY p_end DESC, first_pos DESC) AS rn
        FROM dur WHERE days BETWEEN 350 AND 380) WHERE rn <= 6""",
    "si": """SELECT * FROM (SELECT entity_id, concept, p_end, val, accn, row_number() OVER (PARTITION BY entity_id, concept ORDER BY p_end DESC) AS rn
        FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, concept, p_end ORDER BY filed DESC, pos) AS k
              FROM chosen WHERE kind = 'instant') WHERE k = 1) WHERE rn <= 21""",
}

_pick = lambda c, a, v="val": f"max(CASE WHEN concept = '{c}' THEN {v} END) AS {a}"

WIDE_CONCEPTS = {
    "revenue": "rev", "costOfRevenue": "cost", "grossProfit": "gpd", "operatingIncome": "oi", "netIncome": "ni",
    "depreciationAmortization": "da", "cfo": "cfo", "capex": "capex", "sbc": "sbc", "interestExpense": "intr",
    "weightedSharesDiluted": "ws",
}

METRICS: dict[str, str] = {
    "w0": "SELECT entity_id, p_end, "
    + ", ".join(_pick(c, a) for c, a in WIDE_CONCEPTS.items())
    + ", "
    + ", ".join(_pick(c, f"{a}_accn", "accn") for c, a in (("revenue", "rev"), ("cfo", "cfo"), ("grossProfit", "gpd"), ("operatingIncome", "oi"), ("weightedSharesDiluted", "ws")))
    + " FROM sq GROUP BY entity_id, p_end",
    "wide": """SELECT *, CASE WHEN has_gp THEN gpd ELSE rev - cost END AS gp, cfo - capex - coalesce(sbc, 0) AS fcf,
        cfo - capex AS fcf_raw, oi + da AS ebitda,
        CASE WHEN has_gp THEN gpd_accn WHEN cost IS NOT NULL THEN rev_accn END AS gp_accn
        FROM (SELECT *, count(gpd) OVER (PARTITION BY entity_id) > 0 AS has_gp FROM w0)""",
}
# One numbered list per derived series; r = 1 is the newest point.
for _s in ("rev", "gp", "oi", "ni", "cfo", "capex", "fcf", "fcf_raw", "ebitda", "intr", "ws"):
    METRICS[f"s_{_s}"] = (
        f"SELECT entity_id, p_end, {_s} AS v, row_number() OVER (PARTITION BY entity_id ORDER BY p_end DESC) AS r, "
        f"row_number() OVER (PARTITION BY entity_id ORDER BY p_end) AS i, count(*) OVER (PARTITION BY entity_id) AS n "
        f"FROM wide WHERE {_s} IS NOT NULL"
    )


def ttm_of(s: str) -> str:
    return f"SELECT entity_id, sum(v) AS v FROM s_{s} WHERE r <= 4 GROUP BY entity_id HAVING count(*) = 4"


def avg_of(s: str) -> str:
    return f"SELECT entity_id, sum(v) / count(*) * 4 AS v FROM s_{s} GROUP BY entity_id HAVING count(*) >= 12"


def growth_of(s: str, lag: int, shift: int = 0) -> str:
    return (
        f"SELECT a.entity_id, {pct('b.v', 'a.v')} AS v FROM s_{s} a JOIN s_{s} b "
        f"ON a.entity_id = b.entity_id AND a.r = {1 + shift} AND b.r = {1 + shift + lag}"
    )


def margin_of(s: str) -> str:
    """latest_pct, qoq_bp, yoy_bp over matched quarters with a non-zero denominator."""
    accn = {"gp": "gp_accn", "oi": "oi_accn", "fcf": "cfo_accn"}[s]
    return f"""SELECT entity_id, {jr('max(CASE WHEN r = 1 THEN p END)', 1)} AS latest_pct,
      {b(jr('(max(CASE WHEN r = 1 THEN p END) - max(CASE WHEN r = 2 THEN p END)) * 100'))} AS qoq_bp,
      {b(jr('(max(CASE WHEN r = 1 THEN p END) - max(CASE WHEN r = 5 THEN p END)) * 100'))} AS yoy_bp,
      max(CASE WHEN r = 1 THEN accn END) AS accn
      FROM (SELECT entity_id, {s} / rev * 100 AS p, {accn} AS accn, row_number() OVER (PARTITION BY entity_id ORDER BY p_end DESC) AS r
        FROM wide WHERE {s} IS NOT NULL AND rev IS NOT NULL AND rev <> 0) GROUP BY entity_id"""


def last_of(concept: str) -> str:
    return f"SELECT entity_id, p_end, val, accn FROM si WHERE concept = '{concept}' AND rn = 1"


def delta_of(s: str) -> str:
    """Margin over the first four and the last four revenue quarters."""
    one = lambda cond: f"""SELECT a.entity_id, sum(w.{s}) / nullif(sum(a.v), 0) AS m FROM s_rev a JOIN wide w
        ON w.entity_id = a.entity_id AND w.p_end = a.p_end AND w.{s} IS NOT NULL WHERE a.v <> 0 AND {cond} GROUP BY a.entity_id"""  # noqa: E731
    return f"SELECT f.entity_id, {b(jr('(l.m - f.m) * 10000'))} AS v FROM ({one('a.i <= 4')}) f JOIN ({one('a.r <= 4')}) l USING (entity_id)"


for _s in ("rev", "capex", "cfo", "oi", "ni", "fcf", "ebitda", "intr"):
    METRICS[f"t_{_s}"] = ttm_of(_s)
for _s in ("oi", "fcf"):
    METRICS[f"a_{_s}"] = avg_of(_s)
METRICS |= {
    "ents": "SELECT DISTINCT entity_id FROM sq UNION SELECT DISTINCT entity_id FROM si",
    "qoq": growth_of("rev", 1),
    "yoy": growth_of("rev", 4),
    "yoy_prior": growth_of("rev", 4, 1),
    "m_gp": margin_of("gp"),
    "m_oi": margin_of("oi"),
    "m_fcf": margin_of("fcf"),
    "l_cash": f"SELECT c.entity_id, c.val + coalesce(s.val, 0) AS v, c.accn FROM ({last_of('cash')}) c LEFT JOIN si s ON s.entity_id = c.entity_id AND s.concept = 'shortTermInvestments' AND s.p_end = c.p_end",
    "l_debt": f"SELECT c.entity_id, c.val + coalesce(s.val, 0) AS v, c.accn FROM ({last_of('longTermDebt')}) c LEFT JOIN si s ON s.entity_id = c.entity_id AND s.concept = 'currentDebt' AND s.p_end = c.p_end",
    "l_equity": last_of("equity"),
    "l_ppe": last_of("ppe"),
    "l_shares": last_of("sharesOutstanding"),
    "runway": f"SELECT f.entity_id, {jr('c.v / -f.m', 1)} AS v FROM (SELECT entity_id, sum(v) / 2 AS m FROM s_fcf WHERE r <= 2 GROUP BY entity_id HAVING count(*) = 2) f JOIN l_cash c USING (entity_id) WHERE f.m < 0",
    "near": """SELECT c.entity_id, arg_min(p.val, row(abs(p.p_end - (c.p_end - 365)), p.p_end)) AS ref, any_value(c.val) AS cur,
        min(abs(p.p_end - (c.p_end - 365))) AS dist FROM l_shares c JOIN si p ON p.entity_id = c.entity_id AND p.concept = 'sharesOutstanding' GROUP BY c.entity_id""",
    "near_yoy": f"SELECT entity_id, CASE WHEN dist <= 60 THEN {pct('ref', 'cur')} END AS v FROM near",
    "ws_yoy": growth_of("ws", 4),
    "sh": """SELECT e.entity_id, coalesce(l.val, w.v) AS shares, CASE WHEN l.entity_id IS NOT NULL THEN n.v ELSE y.v END AS yoy,
        coalesce(l.accn, x.ws_accn) AS accn FROM ents e LEFT JOIN l_shares l USING (entity_id)
        LEFT JOIN (SELECT entity_id, v, p_end FROM s_ws WHERE r = 1) w USING (entity_id) LEFT JOIN wide x ON x.entity_id = w.entity_id AND x.p_end = w.p_end
        LEFT JOIN near_yoy n ON n.entity_id = e.entity_id LEFT JOIN ws_yoy y ON y.entity_id = e.entity_id""",
    "inv": f"SELECT a.entity_id, {pct('b.val', 'a.val')} AS v FROM si a JOIN si b ON a.entity_id = b.entity_id AND a.concept = 'inventory' AND b.concept = 'inventory' AND a.rn = 1 AND b.rn = 2",
    "span": "SELECT entity_id, (max(p_end) - min(p_end)) / 365.25 AS yrs, sum(CASE WHEN i <= 4 THEN v END) AS f4, sum(CASE WHEN r <= 4 THEN v END) AS l4, count(*) AS n FROM s_rev GROUP BY entity_id HAVING count(*) >= 12",
    "cagr": f"SELECT entity_id, {jr('yrs', 1)} AS span_years, CASE WHEN f4 > 0 AND yrs - 0.75 > 0 THEN {jr('(pow(l4 / f4, 1 / (yrs - 0.75)) - 1) * 100', 1)} END AS v FROM span WHERE yrs >= 3",
    "d_gp": delta_of("gp"),
    "d_oi": delta_of("oi"),
    "fpos": "SELECT entity_id, count(*) FILTER (WHERE v > 0) AS pos, count(*) AS n FROM s_fcf GROUP BY entity_id",
    "sh_src": """SELECT entity_id, p_end, val FROM si WHERE concept = 'sharesOutstanding' AND entity_id IN (SELECT entity_id FROM si WHERE concept = 'sharesOutstanding' GROUP BY entity_id HAVING count(*) >= 2)
        UNION ALL SELECT entity_id, p_end, v FROM s_ws WHERE entity_id NOT IN (SELECT entity_id FROM si WHERE concept = 'sharesOutstanding' GROUP BY entity_id HAVING count(*) >= 2)""",
    "sh_cagr": f"""SELECT entity_id, CASE WHEN yrs >= 3 AND s0 > 0 THEN {jr('(pow(s1 / s0, 1 / yrs) - 1) * 100', 1)} END AS v FROM (
        SELECT entity_id, arg_min(val, p_end) AS s0, arg_max(val, p_end) AS s1, (max(p_end) - min(p_end)) / 365.25 AS yrs
        FROM sh_src GROUP BY entity_id HAVING count(*) >= 2)""",
    "mx": f"""SELECT e.entity_id, rq.p_end AS as_of_quarter, rq.v AS revenue_latest, qoq.v AS revenue_qoq_pct, yoy.v AS revenue_yoy_pct,
        {jr('yoy.v - yoy_prior.v', 1)} AS revenue_decel_pts,
        m_gp.latest_pct AS gross_pct, m_gp.qoq_bp AS gross_qoq_bp, m_gp.yoy_bp AS gross_yoy_bp,
        m_oi.latest_pct AS op_pct, m_oi.qoq_bp AS op_qoq_bp, m_oi.yoy_bp AS op_yoy_bp,
        m_fcf.latest_pct AS fcf_pct, m_fcf.qoq_bp AS fcf_qoq_bp, m_fcf.yoy_bp AS fcf_yoy_bp,
        fq.v AS fcf_latest, t_cfo.v AS cfo_ttm, t_capex.v AS capex_ttm,
        CASE WHEN t_rev.v > 0 THEN {jr('t_capex.v / t_rev.v * 100', 1)} END AS capex_pct_revenue_ttm,
        t_rev.v AS revenue_ttm, t_ebitda.v AS ebitda_ttm, t_oi.v AS ebit_ttm, t_ni.v AS net_income_ttm, t_fcf.v AS fcf_ttm,
        a_oi.v AS ebit_avg5y, a_fcf.v AS fcf_avg5y,
        l_cash.v AS cash_and_sti, l_debt.v AS total_debt, l_equity.val AS equity, l_ppe.val AS ppe,
        l_debt.v - l_cash.v AS net_debt,
        CASE WHEN t_ebitda.v > 0 THEN {jr('(l_debt.v - l_cash.v) / t_ebitda.v', 1)} END AS nd_to_ebitda,
        CASE WHEN t_intr.v > 0 THEN {jr('t_oi.v / t_intr.v', 1)} END AS interest_cover,
        runway.v AS cash_runway_q, sh.shares, sh.yoy AS shares_yoy_pct, inv.v AS inventory_qoq_pct,
        cagr.span_years, cagr.v AS revenue_cagr_pct,
        CASE WHEN cagr.entity_id IS NOT NULL THEN d_gp.v END AS gross_delta_bp, CASE WHEN cagr.entity_id IS NOT NULL THEN d_oi.v END AS op_delta_bp,
        CASE WHEN cagr.entity_id IS NOT NULL THEN coalesce(fpos.pos, 0) END AS fcf_positive_quarters,
        CASE WHEN cagr.entity_id IS NOT NULL THEN coalesce(fpos.n, 0) END AS fcf_quarters,
        CASE WHEN cagr.entity_id IS NOT NULL THEN sh_cagr.v END AS share_cagr_pct
        FROM ents e LEFT JOIN (SELECT * FROM s_rev WHERE r = 1) rq USING (entity_id) LEFT JOIN (SELECT * FROM s_fcf WHERE r = 1) fq USING (entity_id) """
    + " ".join(
        f"LEFT JOIN {x} USING (entity_id)"
        for x in "qoq yoy yoy_prior m_gp m_oi m_fcf t_cfo t_capex t_rev t_ebitda t_oi t_ni t_fcf t_intr a_oi a_fcf l_cash l_debt l_equity l_ppe runway sh inv cagr d_gp d_oi fpos sh_cagr".split()
    ),
}


def facts_sql(body: str, *roles: str, extra: dict[str, str] | None = None) -> str:
    return with_roles(body, "fx_facts", *roles, extra={**_needed(body, extra or {})})


def _needed(body: str, extra: dict[str, str]) -> dict[str, str]:
    """Only the chain members the text mentions, in order."""
    import re

    chain = {**SERIES, **METRICS, **_LATER, **extra}
    want: set[str] = set()
    todo = [body]
    while todo:
        words = set(re.findall(r"\b\w+\b", todo.pop()))
        for k in chain:
            if k in words and k not in want:
                want.add(k)
                todo.append(chain[k])
    return {k: v for k, v in chain.items() if k in want}


_LATER: dict[str, str] = {}
