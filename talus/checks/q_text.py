"""Texts: what changed between filings."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.checks.registry import query
from talus.checks.roles import with_roles
from talus.operators import alignment as A
from talus.operators import guidance as G

# The alignment told plainly: anchors stand once on either side; the longest rising run of them is grown
# from its end and walked from its front; gaps between its members are matched cell by cell.
DIFF = {
    "order_of": """SELECT *, lead(filing_no) OVER w AS next_no, lag(filing_no) OVER w AS prev_no FROM (SELECT DISTINCT entity_id, filing_no FROM fx_risk_parts)
        WINDOW w AS (PARTITION BY entity_id ORDER BY filing_no)""",
    "dp": """SELECT p.entity_id, p.filing_no, 1 AS side, p.pos, p.paragraph AS key FROM fx_risk_parts p JOIN order_of USING (entity_id, filing_no) WHERE prev_no IS NOT NULL
        UNION ALL SELECT p.entity_id, next_no, 0, p.pos, p.paragraph FROM fx_risk_parts p JOIN order_of USING (entity_id, filing_no) WHERE next_no IS NOT NULL""",
    "anchors": """SELECT entity_id, filing_no, min(pos) FILTER (WHERE side = 0) AS old_pos, min(pos) FILTER (WHERE side = 1) AS pos FROM dp
        GROUP BY entity_id, filing_no, key HAVING count(*) FILTER (WHERE side = 0) = 1 AND count(*) FILTER (WHERE side = 1) = 1""",
    "seqs": "SELECT entity_id, filing_no, list(old_pos ORDER BY pos) AS ps, list(pos ORDER BY pos) AS cs FROM anchors GROUP BY ALL",
    "grown": """SELECT * FROM (WITH RECURSIVE g AS (SELECT entity_id, filing_no, ps, cs, len(ps) AS i, [1] AS ls FROM seqs
        UNION ALL SELECT entity_id, filing_no, ps, cs, i - 1, list_prepend(1 + coalesce(list_max([ls[k] for k in range(1, len(ls) + 1) if ps[i - 1 + k] > ps[i - 1]]), 0), ls) FROM g WHERE i > 1) SELECT * FROM g) WHERE i = 1""",
    "walked": """SELECT * FROM (WITH RECURSIVE w AS (SELECT *, list_position(ls, list_max(ls)) AS z FROM grown
        UNION ALL SELECT entity_id, filing_no, ps, cs, i, ls, list_min([k for k in range(z + 1, len(ps) + 1) if ps[k] > ps[z] AND ls[k] = ls[z] - 1]) FROM w WHERE ls[z] > 1) SELECT * FROM w)""",
    "firm": "SELECT entity_id, filing_no, ps[z] AS old_pos, cs[z] AS pos FROM walked",
    "gaps": """SELECT d.*, (SELECT count(*) FROM firm f WHERE f.entity_id = d.entity_id AND f.filing_no = d.filing_no AND CASE WHEN side = 0 THEN f.old_pos ELSE f.pos END <= d.pos) AS gap
        FROM dp d WHERE NOT EXISTS (SELECT 1 FROM firm f WHERE f.entity_id = d.entity_id AND f.filing_no = d.filing_no AND CASE WHEN side = 0 THEN f.old_pos ELSE f.pos END = d.pos)""",
    "inside": """SELECT g.* FROM gaps g JOIN (SELECT entity_id, filing_no, gap, key FROM gaps GROUP BY ALL HAVING count(DISTINCT side) = 2) s USING (entity_id, filing_no, gap, key)""",
    "two": """SELECT entity_id, filing_no, gap, list(key ORDER BY pos) FILTER (WHERE side = 0) AS a, list(pos ORDER BY pos) FILTER (WHERE side = 0) AS ap,
        list(key ORDER BY pos) FILTER (WHERE side = 1) AS b, list(pos ORDER BY pos) FILTER (WHERE side = 1) AS bp FROM inside GROUP BY ALL""",
    "cells": """SELECT * FROM (WITH RECURSIVE c AS (SELECT *, len(a) + 1 AS i, [0 for k in range(len(b) + 1)] AS l FROM two
        UNION ALL SELECT entity_id, filing_no, gap, a, ap, b, bp, i - 1,
          [list_max([greatest(l[k], CASE WHEN k <= len(b) AND b[k] = a[i - 1] THEN l[k + 1] + 1 ELSE 0 END) for k in range(j, len(b) + 2)]) for j in range(1, len(b) + 2)] FROM c WHERE i > 1) SELECT * FROM c)""",
    "steps": """SELECT * FROM (WITH RECURSIVE s AS (SELECT entity_id, filing_no, gap, a, ap, b, bp, 1 AS i, 1 AS j, false AS hit, 0 AS hi, 0 AS hj FROM two
        UNION ALL SELECT s.entity_id, s.filing_no, s.gap, s.a, s.ap, s.b, s.bp,
          CASE WHEN s.a[s.i] = s.b[s.j] OR n.l[s.j] >= m.l[s.j + 1] THEN s.i + 1 ELSE s.i END,
          CASE WHEN s.a[s.i] = s.b[s.j] OR n.l[s.j] < m.l[s.j + 1] THEN s.j + 1 ELSE s.j END, s.a[s.i] = s.b[s.j], s.i, s.j
        FROM s JOIN cells m ON (m.entity_id, m.filing_no, m.gap, m.i) = (s.entity_id, s.filing_no, s.gap, s.i)
          JOIN cells n ON (n.entity_id, n.filing_no, n.gap, n.i) = (s.entity_id, s.filing_no, s.gap, s.i + 1) WHERE s.i <= len(s.a) AND s.j <= len(s.b)) SELECT * FROM s) WHERE hit""",
    "same": "SELECT entity_id, filing_no, old_pos, pos FROM firm UNION ALL SELECT entity_id, filing_no, ap[hi], bp[hj] FROM steps",
    "loose": """SELECT *, row_number() OVER (PARTITION BY entity_id, filing_no, side, key ORDER BY pos) AS k FROM dp d
        WHERE NOT EXISTS (SELECT 1 FROM same f WHERE f.entity_id = d.entity_id AND f.filing_no = d.filing_no AND CASE WHEN side = 0 THEN f.old_pos ELSE f.pos END = d.pos)""",
    "told_apart": """SELECT entity_id, filing_no, key, min(pos) FILTER (WHERE side = 0) AS old_pos, min(pos) FILTER (WHERE side = 1) AS pos FROM loose GROUP BY entity_id, filing_no, key, k
        UNION ALL SELECT s.entity_id, s.filing_no, NULL, s.old_pos, s.pos FROM same s""",
    "diff": """SELECT t.entity_id, t.filing_no, CASE WHEN key IS NULL THEN 'kept' WHEN old_pos IS NULL THEN 'added' WHEN t.pos IS NULL THEN 'removed' ELSE 'moved' END AS status,
        old_pos, t.pos, coalesce(key, p.paragraph) AS paragraph FROM told_apart t LEFT JOIN fx_risk_parts p ON key IS NULL AND p.entity_id = t.entity_id AND p.filing_no = t.filing_no AND p.pos = t.pos""",
}


@query("risk_factor_diff", with_roles("SELECT * FROM diff", "fx_risk_parts", extra=DIFF))
def _(t):
    return A.paragraph_diff(t("fx_risk_parts"))


_PLAIN = lambda x: f"concat(' ', trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
QUOTED = {
    "plain": f"SELECT e.*, {_PLAIN('quote')} AS q, {_PLAIN('coalesce(text, chr(32))')} AS t FROM fx_extractions e JOIN documents d ON d.doc_id = e.filing_no",
    "runs": "SELECT *, [concat(' ', array_to_string(w[i : i + 4], ' '), ' ') for i in range(1, greatest(len(w) - 3, 2))] AS rs FROM (SELECT *, string_split(trim(q), ' ') AS w FROM plain)",
    "checked": """SELECT * EXCLUDE (q, t, w, rs), CASE WHEN trim(q) = '' THEN 'missing' WHEN contains(t, q) THEN 'verbatim'
        WHEN len([r for r in rs if contains(t, r)]) / len(rs) >= 0.6 THEN 'loose' ELSE 'invented' END AS quoted FROM runs""",
    "nums": "SELECT entity_id, filing_no, lead(filing_no) OVER w AS next_no, lag(filing_no) OVER w AS prev_no FROM (SELECT DISTINCT entity_id, filing_no FROM checked) WINDOW w AS (PARTITION BY entity_id ORDER BY filing_no)",
    "one": "SELECT entity_id, filing_no, metric, period, low, high, quoted NOT IN ('invented', 'missing') AS sure, coalesce(low, high) AS lo, coalesce(high, low) AS hi FROM checked",
    "said": "SELECT o.*, prev_no FROM one o JOIN nums USING (entity_id, filing_no) WHERE prev_no IS NOT NULL",
    "past": "SELECT o.* REPLACE (next_no AS filing_no) FROM one o JOIN nums USING (entity_id, filing_no) WHERE next_no IS NOT NULL",
}


def _checked(t):
    texts = t("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("accession"), "text")
    return G.quote_check(t("fx_extractions"), texts)


@query("quote_check", with_roles("SELECT filing_no, metric, period, quoted FROM checked", "fx_extractions", extra=QUOTED))
def _(t):
    return _checked(t).select("filing_no", "metric", "period", "quoted")


@query("guidance_diff", with_roles(
    """SELECT coalesce(n.entity_id, o.entity_id) AS entity_id, coalesce(n.filing_no, o.filing_no) AS filing_no, coalesce(n.metric, o.metric) AS metric, coalesce(n.period, o.period) AS period,
    CASE WHEN n.metric IS NULL THEN 'withdrawn' WHEN o.metric IS NULL THEN 'new' WHEN NOT (n.sure AND o.sure) OR n.lo > n.hi OR o.lo > o.hi THEN 'unclear'
      WHEN n.lo = o.lo AND n.hi = o.hi THEN 'unchanged' WHEN n.lo >= o.lo AND n.hi >= o.hi THEN 'raised' WHEN n.lo <= o.lo AND n.hi <= o.hi THEN 'cut'
      WHEN n.lo >= o.lo AND n.hi <= o.hi THEN 'narrowed' ELSE 'widened' END AS status, o.low AS old_low, o.high AS old_high, n.low, n.high,
    CASE WHEN o.lo + o.hi <> 0 THEN ((n.lo + n.hi) / 2 - (o.lo + o.hi) / 2) / abs((o.lo + o.hi) / 2) * 100 END AS middle_change_pct
    FROM said n FULL JOIN past o ON n.entity_id = o.entity_id AND n.filing_no = o.filing_no AND n.metric = o.metric AND n.period = o.period""", "fx_extractions", extra=QUOTED))
def _(t):
    return G.guidance_diff(_checked(t))
