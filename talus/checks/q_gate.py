"""Digest gate, memory and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.checks.chains import _LATER, jr
from talus.checks.q_metrics import SANITY_CONF, Facts
from talus.checks.q_multiples import BALANCES, FREE_CASH, RETURNS, RISK, Lean
from talus.checks.q_multiples import sql as val_sql
from talus.checks.q_series import chosen
from talus.checks.q_scenarios import ANCHOR, SCEN_ALL, Scen, ensemble
from talus.checks.registry import query
from talus.checks.roles import with_roles
from talus.functions import text as T
from talus.operators import gate as G
from talus.operators import memory as R
from talus.operators import metrics as M
from talus.operators import multiples as X
from talus.operators import scenarios as S
from talus.operators import scoring as K
from talus.operators import series as S_
from talus.operators import validate as V
from talus.sources.gold import materialize

AS_OF = "2024-02-20"
RUN = "2024-02-05"
ROLES = ("fx_estimates", "fx_scenarios", "fx_verdicts", "fx_errors", "fx_grades")

_LATER |= {
    "cal_all": f"SELECT count(*) AS n, {jr('cast(sum(cast(valuation_error_pct as decimal(28, 4))) as double) / count(*)', 1)} AS mean_error_pct FROM fx_errors",
    "cal_cls": f"SELECT classification, count(*) AS n, {jr('cast(sum(cast(valuation_error_pct as decimal(28, 4))) as double) / count(*)', 6)} AS mean_error_pct FROM fx_errors GROUP BY classification",
    "kept_s": f"""SELECT * FROM fx_scenarios s WHERE sample = 1 OR NOT EXISTS (
        SELECT 1 FROM (SELECT DISTINCT entity_id, sample FROM ({SCEN_ALL})) v WHERE v.entity_id = s.entity_id AND v.sample = s.sample)""",
    "ens": ensemble("kept_s"),
    "merged": """SELECT s.* REPLACE (CASE WHEN ok THEN coalesce(e.weight, s.weight) ELSE s.weight END AS weight, CASE WHEN ok THEN coalesce(e.multiple, s.multiple) ELSE s.multiple END AS multiple,
        CASE WHEN ok THEN coalesce(e.value, s.value) ELSE s.value END AS value) FROM (SELECT * FROM fx_scenarios WHERE sample = 1) s
        LEFT JOIN (SELECT entity_id, horizon, scenario_case, weight, multiple, value FROM ens) e USING (entity_id, horizon, scenario_case)
        LEFT JOIN (SELECT entity_id, NOT coalesce(insufficient, false) AS ok FROM fx_verdicts) v USING (entity_id)""",
    "mpriced": f"""SELECT * EXCLUDE (rawp), CASE WHEN rawp > 0 THEN {jr('rawp', 2)} END AS implied FROM (SELECT s.*, CASE WHEN m.shares > 0 AND multiple > 0 AND metric <> 'none' THEN
        (multiple * value - CASE WHEN metric LIKE 'EV/%' THEN coalesce(m.net_debt, 0) ELSE 0 END) / m.shares END AS rawp FROM merged s LEFT JOIN mx m USING (entity_id))""",
    "anc": f"SELECT entity_id, anchor AS fair FROM ({ANCHOR.replace('FROM priced', 'FROM mpriced')}) WHERE horizon = '1'",
    "calf": f"""SELECT v.entity_id, v.cause AS classification, a.fair, (SELECT n FROM cal_all) >= 20 AS calibration_active,
        CASE WHEN (SELECT n FROM cal_all) < 20 THEN a.fair ELSE {jr('a.fair * least(15e-1, greatest(5e-1, 1e0 + CASE WHEN c.n >= 10 THEN c.mean_error_pct ELSE (SELECT mean_error_pct FROM cal_all) END / 100))', 2)} END AS fair_adjusted,
        CASE WHEN (SELECT n FROM cal_all) < 20 THEN 'none' WHEN c.n >= 10 THEN 'class' ELSE 'global' END AS calibration_scope,
        CASE WHEN (SELECT n FROM cal_all) >= 20 AND c.n >= 10 THEN c.n ELSE (SELECT n FROM cal_all) END AS calibration_n
        FROM fx_verdicts v LEFT JOIN anc a USING (entity_id) LEFT JOIN cal_cls c ON c.classification = v.cause""",
    "guard": f"""SELECT {jr("count(*) FILTER (WHERE status = 'fired') / count(*) FILTER (WHERE status IN ('fired', 'survived'))", 3)} AS fired_share,
        count(*) FILTER (WHERE status IN ('fired', 'survived')) AS n FROM fx_grades""",
    "guardx": "SELECT fired_share, n, CASE WHEN n >= 10 AND fired_share > 3e-1 THEN 5e-2 ELSE 0e0 END AS extra_discount FROM guard",
    "conf": SANITY_CONF,
    "gin": """SELECT c.*, v.insufficient, v.moat, v.thesis, v.status = 'ok' AS has_verdict, p.price, e.net_debt, e.nd_to_ebitda, e.fcf_ttm, e.fcf_pct, e.share_cagr_pct, e.fcf_quarters, e.fcf_positive_quarters,
        e.entity_id IS NOT NULL AS has_economics, e.epv_per_share, e.expectations_gap_pts, e.roic_pct, e.discount_rate_pct, e.implied_growth_pct, e.street_growth_pct,
        p.price * (60 + c.entity_id % 90) / 100 AS street_target, f.confidence,
        CASE WHEN c.calibration_active THEN least(c.fair_adjusted, c.fair) ELSE c.fair END AS effective, 2e-1 + (SELECT extra_discount FROM guardx) AS req
        FROM calf c JOIN fx_verdicts v USING (entity_id) LEFT JOIN px p USING (entity_id) LEFT JOIN ecov e USING (entity_id) LEFT JOIN conf f USING (entity_id)""",
    "gu": "SELECT *, floor((effective - price) / nullif(effective, 0) * 1000 + 0.5) / 10 AS undervaluation_pct FROM gin",
}
_PRED = {
    "insufficient_evidence": "insufficient",
    "no_fair_value": "effective IS NULL",
    "no_price": "effective IS NOT NULL AND price IS NULL",
    "above_fair_value": "price > effective * (1 - req) AND undervaluation_pct < 0",
    "discount_too_small": "price > effective * (1 - req) AND undervaluation_pct >= 0",
    "debt": "NOT (coalesce(net_debt <= 0, false) OR coalesce(nd_to_ebitda <= 25e-1, false))",
    "no_free_cash_flow": "fcf_ttm IS NULL OR fcf_ttm <= 0",
    "moat": "moat IS NULL OR moat NOT IN ('wide', 'narrow')",
    "no_expectations_gap": "has_economics AND price IS NOT NULL AND NOT coalesce(price < epv_per_share, false) AND expectations_gap_pts < 5",
    "economics_unknown": "has_economics AND price IS NOT NULL AND NOT coalesce(price < epv_per_share, false) AND expectations_gap_pts IS NULL",
    "roic_below_cost": "has_economics AND roic_pct < discount_rate_pct AND NOT coalesce(fcf_pct >= 15, false)",
    "street_cap": "street_target > 0 AND effective > street_target * 175e-2",
    "serial_dilution": "share_cagr_pct > 8",
    "inconsistent_cash": "fcf_quarters >= 8 AND fcf_positive_quarters / fcf_quarters < 5e-1",
    "degraded_metrics": "confidence = 'degraded'",
}
_reasons = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _PRED.items()) + ")"
_LATER["gated"] = f"SELECT * REPLACE (CASE WHEN has_verdict THEN undervaluation_pct END AS undervaluation_pct), CASE WHEN NOT has_verdict THEN 'no_verdict' ELSE {_reasons} END AS reasons FROM gu"


def sql(body: str, *roles: str) -> str:
    return val_sql(body, *ROLES, *roles)


class Gate(Scen):
    def merged(self):
        """The ensemble's scenarios, priced; written once, as the gate reads them twice."""
        if not hasattr(self, "_merged"):
            bad = V.scenario_violations(materialize(self.ctx(), "scenario-context"))
            self._merged = materialize(S.implied_price(S.merged_scenarios(self.t("fx_scenarios"), self.t("fx_verdicts"), bad), self.metrics()), "merged-scenarios")
        return self._merged

    def anchors(self):
        a = S.weighted_anchor(self.merged()).filter("horizon = '1'")
        return a.select("entity_id", F.col("anchor").alias("fair"))

    def calibrated(self):
        v = self.t("fx_verdicts").select("entity_id", F.col("cause").alias("classification")).join(self.anchors(), "entity_id", "left")
        e = self.t("fx_errors")
        return G.calibrated_fair(v, K.calibration_overall(e), K.calibration_by_class(e))

    def guard(self):
        return G.fast_guard(K.falsifier_rollup(self.t("fx_grades")))

    def prices(self):
        return X.last_close(self.closes)

    def targets(self):
        return self.prices().selectExpr("entity_id", "price", "price * (60 + entity_id % 90) / 100 AS street_target")

    def verdicts(self):
        return self.t("fx_verdicts").selectExpr("entity_id", "insufficient", "moat", "thesis", "status = 'ok' AS has_verdict")

    def inputs(self):
        m = self.economics().drop("price").withColumn("has_economics", F.lit(True))
        conf = M.sanity_confidence(self.entities, M.sanity_flags(self.entities, self.tags, self.q, self.i, m)).select("entity_id", "confidence")
        return (
            self.calibrated().join(self.verdicts(), "entity_id").join(self.targets(), "entity_id", "left").join(m, "entity_id", "left")
            .join(conf, "entity_id", "left").withColumn("has_economics", F.coalesce("has_economics", F.lit(False)))
        )

    def gated(self):
        return G.digest_gate(self.inputs(), self.guard())


@query("calibrated_fair", sql("SELECT entity_id, classification, fair, fair_adjusted, calibration_active, calibration_scope, calibration_n FROM calf"))
def _(t):
    return Gate(t).calibrated()


@query("fast_guard", sql("SELECT * FROM guardx"))
def _(t):
    return G.fast_guard(K.falsifier_rollup(t("fx_grades")))


@query("effective_fair", sql("SELECT entity_id, fair, CASE WHEN calibration_active THEN least(fair_adjusted, fair) ELSE fair END AS effective FROM calf"))
def _(t):
    return Gate(t).calibrated().select("entity_id", "fair", G.effective_fair().alias("effective"))


@query("undervaluation", sql(
    f"""SELECT entity_id, price, effective, required_discount, floor((effective - price) / nullif(effective, 0) * 1000 + 0.5) / 10 AS undervaluation_pct, coalesce(price > effective * (1 - required_discount), false) AS fails
    FROM (SELECT c.entity_id, p.price, CASE WHEN calibration_active THEN least(fair_adjusted, fair) ELSE fair END AS effective, 2e-1 + (SELECT extra_discount FROM guardx) AS required_discount
    FROM calf c LEFT JOIN px p USING (entity_id))"""))
def _(t):
    g = Gate(t)
    d = G.with_undervaluation(g.calibrated().join(g.prices(), "entity_id", "left"), g.guard())
    fails = F.coalesce(F.col("price") > F.col("effective") * (1 - F.col("required_discount")), F.lit(False))
    return d.select("entity_id", "price", "effective", "required_discount", "undervaluation_pct", fails.alias("fails"))


def rule(key: str, names: tuple[str, ...], build, src: str = "gin", concepts: tuple[str, ...] | None = None):
    cases = "concat_ws(',', " + ", ".join(f"CASE WHEN {_PRED[n]} THEN '{n}' END" for n in names) + ")"

    @query(key, sql(f"SELECT entity_id, {cases} AS reasons, {cases} = '' AS pass FROM {src}"))
    def _(t):
        return G.gate_rule(build(Lean(t, concepts) if concepts else Gate(t)), names).withColumn("reasons", F.array_join("reasons", ","))


_eco = lambda g: g.economics().withColumn("has_economics", F.lit(True))
rule("gate_debt", ("debt",), lambda g: g.metrics(), "mx", (*BALANCES, "operatingIncome", "depreciationAmortization"))
rule("gate_fcf", ("no_free_cash_flow",), lambda g: g.metrics(), "mx", ("cash", *FREE_CASH))
rule("gate_moat", ("moat",), lambda g: g.verdicts(), "fx_verdicts")
rule("gate_expectations", ("no_expectations_gap", "economics_unknown"), _eco, "(SELECT *, true AS has_economics FROM ecov)", (*RISK, "netIncome"))
rule("gate_roic", ("roic_below_cost",), _eco, "(SELECT *, true AS has_economics FROM ecov)", (*RISK, *RETURNS))
rule("gate_street_cap", ("street_cap",), lambda g: g.calibrated().join(g.targets(), "entity_id", "left"),
     "(SELECT c.entity_id, CASE WHEN calibration_active THEN least(fair_adjusted, fair) ELSE fair END AS effective, p.price * (60 + c.entity_id % 90) / 100 AS street_target FROM calf c LEFT JOIN px p USING (entity_id))")
rule("gate_dilution", ("serial_dilution",), lambda g: g.metrics(), "mx", ("cash", "revenue", "sharesOutstanding", "weightedSharesDiluted"))
rule("gate_fcf_consistency", ("inconsistent_cash",), lambda g: g.metrics(), "mx", ("cash", "revenue", *FREE_CASH))
rule("gate_evidence", ("insufficient_evidence", "degraded_metrics"),
     lambda g: g.verdicts().join(M.sanity_confidence(g.entities, M.sanity_flags(g.entities, g.tags, g.q, g.i, g.metrics())), "entity_id", "left"),
     "(SELECT * FROM fx_verdicts LEFT JOIN conf USING (entity_id))")

_GCOLS = "entity_id, price, undervaluation_pct, reasons"


@query("digest_gate", sql(
    f"SELECT {_GCOLS}, reasons = '' AS pass, CASE WHEN has_verdict THEN fair END AS fair, CASE WHEN has_verdict THEN fair_adjusted END AS fair_adjusted FROM gated"))
def _(t):
    g = Gate(t).gated().withColumn("reasons", F.array_join("reasons", ","))
    return g.select("entity_id", "price", "undervaluation_pct", "reasons", "pass", "fair", "fair_adjusted")


@query("exclusion_reasons", sql("SELECT entity_id, split_part(reasons, ',', 1) AS reason FROM gated WHERE reasons <> '' ORDER BY entity_id LIMIT 8"))
def _(t):
    return G.exclusion_reasons(Gate(t).gated())


_seen = "SELECT ticker AS entity_id, max(run_date) AS seen_date FROM fx_ledger GROUP BY ticker"
_lastv = """SELECT ticker, run_date, up, ts, first_seen FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, update_id DESC) AS k, min(update_id) OVER (PARTITION BY ticker) AS first_seen
    FROM fx_feedback WHERE run_date <> 'news') WHERE k = 1"""
_tgt = ", ".join(f"max(implied) FILTER (WHERE horizon = '{h}' AND scenario_case = '{c}') AS {c}_{h}y" for h in ("1", "3") for c in ("bear", "base", "bull"))


@query("digest_table", sql(
    f"""SELECT r.rank, g.entity_id, moat, price, fair, fair_adjusted, calibration_active, undervaluation_pct, implied_growth_pct, street_growth_pct, epv_per_share, street_target,
    bear_1y, base_1y, bull_1y, bear_3y, base_3y, bull_3y, {jr('CASE WHEN calibration_active THEN fair_adjusted ELSE fair END * 8e-1', 2)} AS recommended_entry,
    CASE WHEN base_1y > 0 THEN {jr('base_1y / pow(115e-2, 1)', 2)} END AS entry_base_1y, CASE WHEN base_3y > 0 THEN {jr('base_3y / pow(115e-2, 3)', 2)} END AS entry_base_3y, s.seen_date, v.up AS seen_up, thesis
    FROM gated g JOIN (SELECT s_suppkey AS entity_id, cast(floor(-s_acctbal * 100 + 0.5) as bigint) AS rank FROM supplier) r USING (entity_id)
    LEFT JOIN (SELECT entity_id, {_tgt} FROM mpriced GROUP BY entity_id) tg USING (entity_id)
    LEFT JOIN ({_seen}) s USING (entity_id) LEFT JOIN ({_lastv}) v ON v.ticker = g.entity_id AND s.seen_date IS NOT NULL WHERE reasons = ''""", "fx_ledger", "fx_feedback"))
def _(t):
    g = Gate(t)
    ranking = t("supplier").selectExpr("s_suppkey AS entity_id", "cast(floor(-s_acctbal * 100 + 0.5) as bigint) AS rank")
    seen = t("fx_ledger").groupBy(F.col("ticker").alias("entity_id")).agg(F.max("run_date").alias("seen_date")).join(
        R.last_vote(t("fx_feedback")).select(F.col("ticker").alias("entity_id"), F.col("up").alias("seen_up")), "entity_id", "left"
    )
    return G.digest_table(g.gated(), ranking, g.merged(), seen)


@query("performance_snapshot", sql(
    """SELECT entity_id, as_of_quarter, span_years, revenue_cagr_pct, share_cagr_pct, fcf_positive_quarters, fcf_quarters, gross_delta_bp, op_delta_bp, revenue_ttm, ebitda_ttm, ebit_ttm, net_income_ttm, fcf_ttm,
    discount_rate_pct, epv_per_share, implied_growth_pct, street_growth_pct, expectations_gap_pts, roic_pct, growth_proxy, DATE '2001-11-05' AS captured_at FROM ecov"""))
def _(t):
    g = Gate(t)
    return R.performance_snapshot(g.metrics(), g.economics(), "2001-11-05")


@query("feedback_ledger", with_roles("SELECT * FROM fx_feedback ORDER BY ts, update_id", "fx_feedback"))
def _(t):
    f = t("fx_feedback")
    cut = F.lit("2024-01-20").cast("timestamp")
    return R.feedback_ledger(f.filter(F.col("ts") < cut), f.filter(F.col("ts") >= cut))


@query("argument_context", sql(
    """SELECT t.ticker, p.run_date AS pred_date, p.classification, p.thesis, p.fair, p.ref_price, m.revenue_ttm, m.fcf_ttm, m.epv_per_share, m.implied_growth_pct, coalesce(a.n, 0) AS n_objections, a.notes, a.last_text, a.last_reply, k.kill_switches
    FROM (SELECT DISTINCT ticker FROM fx_ledger) t LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY run_date DESC) AS k FROM fx_ledger) WHERE k = 1) p USING (ticker)
    LEFT JOIN (SELECT entity_id AS ticker, revenue_ttm, fcf_ttm, epv_per_share, implied_growth_pct FROM ecov) m USING (ticker)
    LEFT JOIN (SELECT ticker, run_date, string_agg(label || ': ' || falsifier, ' | ' ORDER BY label || ': ' || falsifier) AS kill_switches FROM fx_ledger_scen GROUP BY ticker, run_date) k ON k.ticker = p.ticker AND k.run_date = p.run_date
    LEFT JOIN (SELECT ticker, count(*) AS n, string_agg(note, ' | ' ORDER BY k) AS notes, max(substring(user_text, 1, 400)) FILTER (WHERE k = 1) AS last_text, max(substring(ai_reply, 1, 600)) FILTER (WHERE k = 1) AS last_reply FROM (
      SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY created_at DESC, arg_id DESC) AS k FROM fx_arguments) WHERE k <= 3 GROUP BY ticker) a USING (ticker)""",
    "fx_ledger", "fx_arguments", "fx_ledger_scen"))
def _(t):
    perf = Gate(t).economics().select(F.col("entity_id").alias("ticker"), "revenue_ttm", "fcf_ttm", "epv_per_share", "implied_growth_pct")
    return R.argument_context(t("fx_ledger").select("ticker"), t("fx_ledger"), perf, t("fx_arguments"), t("fx_ledger_scen"))


def plain(body: str, *roles: str) -> str:
    return with_roles(body, *roles)


@query("last_vote", plain(_lastv, "fx_feedback"))
def _(t):
    return R.last_vote(t("fx_feedback"))


@query("news_muted", plain("SELECT DISTINCT ticker FROM fx_feedback WHERE run_date = 'news'", "fx_feedback"))
def _(t):
    return R.news_muted(t("fx_feedback"))


_fresh = lambda d, n: f"abs(DATE '{d}' - cast(ts as date)) < {n}"


@query("news_targets", plain(
    f"SELECT * FROM ({_lastv}) WHERE up AND {_fresh(AS_OF, 90)} AND ticker NOT IN (SELECT ticker FROM fx_feedback WHERE run_date = 'news') ORDER BY first_seen LIMIT 5", "fx_feedback"))
def _(t):
    return R.news_targets(t("fx_feedback"), AS_OF)


_lastp = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY run_date DESC) AS k FROM fx_user_preds) WHERE k = 1)"


@query("watchlist", plain(
    f"""SELECT w.ticker, p.hash AS prior_hash, h.hash FROM (SELECT * FROM ({_lastv}) WHERE up AND {_fresh(AS_OF, 90)} AND ticker NOT IN (SELECT pos FROM fx_quotes WHERE day_change <= -0.2)
    ORDER BY first_seen LIMIT 5) w JOIN {_lastp} p USING (ticker) JOIN fx_hashes h USING (ticker) WHERE h.hash <> p.hash""", "fx_feedback", "fx_user_preds", "fx_hashes", "fx_quotes"))
def _(t):
    today = t("fx_quotes").filter("day_change <= -0.2").select(F.col("pos").alias("ticker"))
    return R.watchlist(t("fx_feedback"), today, t("fx_user_preds"), t("fx_hashes"), AS_OF)


@query("cooldown_filter", plain(
    f"""SELECT e.* FROM fx_hashes e WHERE NOT EXISTS (SELECT 1 FROM fx_cooldown c WHERE c.ticker = e.ticker AND c.hash = e.hash AND abs(DATE '{RUN}' - c.last_digest_date) < 14)""",
    "fx_hashes", "fx_cooldown"))
def _(t):
    return R.cooldown_filter(t("fx_hashes"), t("fx_cooldown"), RUN)


@query("downvote_suppress", plain(
    f"""SELECT e.* FROM fx_hashes e WHERE NOT EXISTS (SELECT 1 FROM ({_lastv}) v JOIN fx_user_preds p ON p.ticker = v.ticker AND cast(p.run_date as varchar) = v.run_date
    WHERE NOT v.up AND {_fresh(RUN, 30)} AND v.ticker = e.ticker AND p.hash = e.hash)""", "fx_hashes", "fx_feedback", "fx_user_preds"))
def _(t):
    return R.downvote_suppress(t("fx_hashes"), t("fx_feedback"), t("fx_user_preds"), RUN)


_HASH = """SELECT f.entity_id, substring(sha256(cast(f.entity_id as varchar) || '|' || coalesce(d.acc, '') || '|' || f.facts || '|v14|'), 1, 24) AS hash FROM (
    SELECT entity_id, sha256(string_agg(line, chr(10) ORDER BY line)) AS facts FROM (
      SELECT entity_id, 'q|' || concept || '|' || p_end || '|' || cast(val as decimal(38, 4)) || '|' || accn AS line FROM sq
      UNION ALL SELECT entity_id, 'i|' || concept || '|' || p_end || '|' || cast(val as decimal(38, 4)) || '|' || accn FROM si
      UNION ALL SELECT entity_id, 'a|' || concept || '|' || p_end || '|' || cast(val as decimal(38, 4)) || '|' || accn FROM sa
      UNION ALL SELECT entity_id, 't|' || concept || '|' || tag FROM picks) GROUP BY entity_id) f
    LEFT JOIN (SELECT entity_id, string_agg(DISTINCT accession, ',' ORDER BY accession) AS acc FROM bundle_docs GROUP BY entity_id) d USING (entity_id)"""


def bundle_hashes(t):
    s = Scen(t)
    return R.bundle_hash(s.documents(), R.facts_fingerprint(s.q, s.i, S_.annual_series(chosen(t)), s.tags), "14")


@query("bundle_hash", sql(_HASH, "fx_filings"))
def _(t):
    return bundle_hashes(t)


@query("incremental_new", plain(
    "SELECT entity_id, hash FROM (SELECT s_suppkey AS entity_id, 'k' || (s_suppkey * 7 % 31) AS hash FROM supplier) WHERE hash NOT IN (SELECT 'k' || (o_orderkey % 13) FROM orders)"))
def _(t):
    hashes = t("supplier").selectExpr("s_suppkey AS entity_id", "concat('k', s_suppkey * 7 % 31) AS hash")
    return R.incremental_new(hashes, t("orders").selectExpr("concat('k', o_orderkey % 13) AS hash"))


_PRIOR = """entity_id, CASE WHEN entity_id % 5 = 0 THEN as_of_quarter - 92 ELSE as_of_quarter END AS as_of_quarter, price * (95 + entity_id % 11) / 100 AS price,
    revenue_ttm * (99 + entity_id % 3) / 100 AS revenue_ttm, gross_pct + (entity_id % 4) / 10 AS gross_pct, op_pct - (entity_id % 3) / 20 AS op_pct,
    CASE WHEN entity_id % 7 = 0 THEN NULL ELSE net_debt * (98 + entity_id % 5) / 100 END AS net_debt, shares AS shares"""


def _chg(name: str, cond: str, x: str) -> str:
    return f"SELECT entity_id, '{name}' AS change, cast({x} as double) AS delta FROM two WHERE {cond}"


_rel = lambda c: f"(({c} - p_{c}) / nullif(abs(p_{c}), 0))"
_p1 = lambda x: f"floor(({x}) * 1000 + 0.5) / 10"
_CHANGES = " UNION ALL ".join([
    _chg("new_filings", "has_new", "1"),
    _chg("quarter_rolled", "p_as_of_quarter <> as_of_quarter", "as_of_quarter - p_as_of_quarter"),
    _chg("price", "p_price <> 0 AND price <> 0", _p1("(price - p_price) / p_price")),
    _chg("revenue_ttm", f"abs({_rel('revenue_ttm')}) >= 5e-3", _p1(_rel("revenue_ttm"))),
    _chg("gross_margin_bp", "abs(floor((gross_pct - p_gross_pct) * 100 + 0.5)) >= 10", "floor((gross_pct - p_gross_pct) * 100 + 0.5)"),
    _chg("operating_margin_bp", "abs(floor((op_pct - p_op_pct) * 100 + 0.5)) >= 10", "floor((op_pct - p_op_pct) * 100 + 0.5)"),
    _chg("net_debt", f"abs({_rel('net_debt')}) >= 5e-3", _p1(_rel("net_debt"))),
    _chg("shares", f"abs({_rel('shares')}) >= 5e-3", _p1(_rel("shares"))),
])
_SNAP = ("as_of_quarter", "price", "revenue_ttm", "gross_pct", "op_pct", "net_debt", "shares")
_LATER |= {
    "snap": "SELECT entity_id, as_of_quarter, price, revenue_ttm, gross_pct, op_pct, net_debt, shares FROM mx LEFT JOIN px USING (entity_id)",
    "psnap": f"SELECT {_PRIOR} FROM snap",
    "two": f"SELECT s.*, {', '.join(f'p.{c} AS p_{c}' for c in _SNAP)}, s.entity_id % 6 = 2 AS has_new FROM snap s JOIN psnap p USING (entity_id)",
    "chg": _CHANGES,
}


@query("look_diff", sql("SELECT * FROM chg UNION ALL SELECT entity_id, 'none', NULL FROM two WHERE entity_id NOT IN (SELECT entity_id FROM chg)"))
def _(t):
    g = Gate(t)
    cur = g.metrics().join(g.prices(), "entity_id", "left").select("entity_id", *_SNAP)
    prior = cur.selectExpr(*[x.strip() for x in (
        "entity_id", "CASE WHEN entity_id % 5 = 0 THEN date_sub(as_of_quarter, 92) ELSE as_of_quarter END AS as_of_quarter",
        "price * (95 + entity_id % 11) / 100 AS price", "revenue_ttm * (99 + entity_id % 3) / 100 AS revenue_ttm",
        "gross_pct + (entity_id % 4) / 10 AS gross_pct", "op_pct - (entity_id % 3) / 20 AS op_pct",
        "CASE WHEN entity_id % 7 = 0 THEN NULL ELSE net_debt * (98 + entity_id % 5) / 100 END AS net_debt", "shares",
        "array('a') AS accessions")])
    now = cur.withColumn("accessions", F.expr("CASE WHEN entity_id % 6 = 2 THEN array('a', 'b') ELSE array('a') END"))
    return R.look_diff(prior, now)


_CNT = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("fired", "survived", "uncheckable"))


@query("ticker_history", plain(
    f"""SELECT l.ticker, l.run_date, l.classification, l.ref_price, cast(l.rn as integer) AS rn, g.fired, g.survived, g.uncheckable FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY run_date DESC) AS rn FROM fx_ledger) l
    LEFT JOIN (SELECT ticker, run_date, {_CNT} FROM fx_grades GROUP BY ticker, run_date) g USING (ticker, run_date) WHERE l.rn <= 3""", "fx_ledger", "fx_grades"))
def _(t):
    return R.ticker_history(t("fx_ledger"), t("fx_grades")).select("ticker", "run_date", "classification", "ref_price", "rn", "fired", "survived", "uncheckable")


@query("prior_seen", plain(
    f"""SELECT l.ticker, l.run_date, (SELECT max(p.run_date) FROM fx_ledger p WHERE p.ticker = l.ticker AND p.run_date < l.run_date) AS seen_date, v.up AS seen_up
    FROM fx_ledger l LEFT JOIN ({_lastv}) v USING (ticker)""", "fx_ledger", "fx_feedback").replace("v USING (ticker)", "v ON v.ticker = l.ticker"))
def _(t):
    return R.prior_seen(t("fx_ledger"), t("fx_ledger"), t("fx_feedback"))


_FRESH = """SELECT ticker, run_date, fair * 2 AS fair, hash FROM fx_ledger WHERE run_date >= DATE '2001-01-01'
    UNION ALL SELECT DISTINCT ticker, DATE '2001-11-05', 0e0, 'new' FROM fx_ledger"""


@query("ledger_upsert", plain(
    f"""WITH fresh AS ({_FRESH}) SELECT ticker, run_date, fair, hash FROM fx_ledger l WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.ticker = l.ticker AND f.run_date = l.run_date)
    UNION ALL SELECT * FROM fresh""".replace("WITH fresh AS", "SELECT * FROM (WITH fresh AS") + ")", "fx_ledger"))
def _(t):
    old = t("fx_ledger").select("ticker", "run_date", "fair", "hash")
    again = old.filter("run_date >= DATE '2001-01-01'").withColumn("fair", F.col("fair") * 2)
    new = old.select("ticker").distinct().selectExpr("ticker", "DATE '2001-11-05' AS run_date", "0D AS fair", "'new' AS hash")
    return R.ledger_upsert(old, again.unionByName(new))


@query("keyed_upsert", plain("SELECT k, version, v, s FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY version DESC) AS n FROM fx_kv) WHERE n = 1", "fx_kv"))
def _(t):
    kv = t("fx_kv")
    return R.keyed_upsert(kv.filter("s = 'F'"), kv.filter("s <> 'F'"), ["k"], "version")


@query("capped_log", """SELECT 'runs' AS log, * FROM ((SELECT event_id, ts, event_type FROM events WHERE event_type <> 'view' ORDER BY event_id DESC LIMIT 90) UNION ALL (SELECT event_id, ts, event_type FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-30'))
    UNION ALL SELECT 'news', * FROM ((SELECT event_id, ts, event_type FROM events WHERE event_type <> 'view' ORDER BY event_id DESC LIMIT 499) UNION ALL (SELECT event_id, ts, event_type FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-30'))""")
def _(t):
    e = t("events").select("event_id", "ts", "event_type")
    log, new = e.filter("event_type <> 'view'"), e.filter("event_type = 'view' AND ts >= TIMESTAMP_NTZ '2024-01-30 00:00:00'")
    runs = R.capped_log(log, new, "event_id", 90).withColumn("log", F.lit("runs"))
    return runs.unionByName(R.capped_log(log, new, "event_id", 499).withColumn("log", F.lit("news")))


@query("objections_latest", plain(
    "SELECT ticker, arg_id, note, cast(rn as integer) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY created_at DESC, arg_id DESC) AS rn FROM fx_arguments) WHERE rn <= 3", "fx_arguments"))
def _(t):
    return R.objections_latest(t("fx_arguments")).select("ticker", "arg_id", "note", "rn")


_TERMS = "[ticker, name] || list_filter(regexp_split_to_array(name, '[\\s,]+'), lambda w: length(w) > 3)"


@query("name_mask", plain(
    f"""SELECT id, list_reduce({_TERMS}, lambda acc, w: regexp_replace(acc, '(?i)' || regexp_replace(w, '([.*+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g'), 'Company A', 'g'), text) AS masked FROM fx_mask""", "fx_mask"))
def _(t):
    return t("fx_mask").select("id", T.name_mask("text", "ticker", "name").alias("masked"))


@query("price_vs_anchor", sql(f"SELECT entity_id, price, fair AS anchor, {jr('(price / fair - 1) * 100')} AS vs_anchor_pct FROM px JOIN anc USING (entity_id) WHERE fair > 0"))
def _(t):
    g = Gate(t)
    return R.price_vs_anchor(g.prices(), g.anchors().withColumnRenamed("fair", "anchor"))
