"""Scenarios, votes, rankings and the validation rules."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from talus import params as P
from talus.checks.chains import _LATER, jr
from talus.checks.q_metrics import SANITY_CONF
from talus.checks.q_multiples import Lean, Val, sql as val_sql
from talus.checks.registry import query
from talus.checks.roles import with_roles
from talus.operators import economics as E
from talus.operators import filings as FO
from talus.operators import metrics as M
from talus.operators import multiples as X
from talus.operators import scenarios as S
from talus.operators import validate as V
from talus.sources.gold import materialize

_FIXED = ", ".join(f"'{n}'" for n, *_ in P.CONCEPTS) + ", 'screen'"
_K = "(PARTITION BY entity_id ORDER BY pos)"
_LATER |= {
    "pr": f"""SELECT s.*, m.shares, m.net_debt, CASE WHEN m.shares > 0 AND multiple > 0 AND metric <> 'none' THEN
        (multiple * value - CASE WHEN metric LIKE 'EV/%' THEN coalesce(m.net_debt, 0) ELSE 0 END) / m.shares END AS rawp FROM fx_scenarios s LEFT JOIN mx m USING (entity_id)""",
    "priced": f"SELECT * EXCLUDE (rawp), CASE WHEN rawp > 0 THEN {jr('rawp', 2)} END AS implied FROM pr",
    "act": """SELECT entity_id, unnest(['EV/EBITDA', 'EV/Sales', 'P/S', 'P/E', 'P/FCF', 'P/B']) AS metric,
        unnest([ebitda_ttm, revenue_ttm, revenue_ttm, net_income_ttm, fcf_ttm, equity]) AS actual FROM mx""",
    "ctx": """SELECT p.*, coalesce(v.insufficient, false) AS insufficient, a.actual, b.p25, b.p75, px.price, st.street_revenue_1y, horizon || 'y ' || scenario_case AS label
        FROM priced p LEFT JOIN fx_verdicts v USING (entity_id) LEFT JOIN act a USING (entity_id, metric) LEFT JOIN bands b USING (entity_id, metric)
        LEFT JOIN px USING (entity_id) LEFT JOIN street st USING (entity_id)""",
    "bundle_docs": f"""SELECT entity_id, accession FROM (SELECT *, row_number() OVER {_K} AS k FROM fx_filings WHERE form = '8-K' AND filed_at >= DATE '2024-01-31' - 45) WHERE k <= 2
        UNION ALL SELECT coalesce(k.entity_id, q.entity_id), CASE WHEN k.entity_id IS NULL OR q.filed_at > k.filed_at THEN q.accession ELSE k.accession END
        FROM (SELECT * FROM (SELECT *, row_number() OVER {_K} AS n FROM fx_filings WHERE form = '10-K') WHERE n = 1) k
        FULL JOIN (SELECT * FROM (SELECT *, row_number() OVER {_K} AS n FROM fx_filings WHERE form = '10-Q') WHERE n = 1) q ON k.entity_id = q.entity_id""",
    "vsrc": f"""SELECT DISTINCT entity_id, source FROM (SELECT entity_id, accession AS source FROM bundle_docs UNION ALL SELECT entity_id, 'prior:' || run_date FROM fx_priors
        UNION ALL SELECT d.entity_id, unnest([{_FIXED}]) FROM (SELECT DISTINCT entity_id FROM bundle_docs) d)""",
    "badsrc": f"""SELECT DISTINCT entity_id, source FROM fx_claims c WHERE source NOT IN ({_FIXED}) AND (kind <> 'guidance' OR (guidance_change <> 'none_given' AND source <> ''))
        AND NOT EXISTS (SELECT 1 FROM vsrc v WHERE v.entity_id = c.entity_id AND v.source = c.source)""",
}

_row = lambda rule, cond: f"SELECT entity_id, sample, '{rule}' AS rule, label AS detail FROM ctx WHERE {cond}"
_cell = lambda h, c, x: f"max({x}) FILTER (WHERE horizon = '{h}' AND scenario_case = '{c}')"
_pair = lambda rule, cond: " UNION ALL ".join(
    f"""SELECT a.entity_id, a.sample, '{rule}' AS rule, '{c}' AS detail FROM ctx a JOIN ctx b ON a.entity_id = b.entity_id AND a.sample = b.sample
    AND a.scenario_case = '{c}' AND b.scenario_case = '{c}' AND a.horizon = '1' AND b.horizon = '3' WHERE {cond}"""
    for c in P.CASES
)
RULES = {
    "vague": _row("vague", f"regexp_matches(falsifier, '(?i){P.VAGUE_PATTERN}') OR length(falsifier) < 20"),
    "guidance_bar": _row("guidance_bar", "scenario_case IN ('base', 'bull') AND regexp_matches(falsifier, '(?i)" + P.GUIDANCE_PATTERN.replace("'", "''") + "')"),
    "priceable": _row("priceable", "NOT insufficient AND shares <> 0 AND (metric = 'none' OR implied IS NULL)"),
    "multiple_range": _row("multiple_range", "metric <> 'none' AND (multiple <= 0 OR multiple > 500)"),
    "ttm_tether": _row("ttm_tether", "metric <> 'none' AND actual > 0 AND (value / actual < 1e-1 OR value / actual > 10)"),
    "band": _row("band_low", "metric <> 'none' AND multiple < p25 * 6e-1 AND length(trim(justification)) < 40") + " UNION ALL "
    + _row("band_high", "metric <> 'none' AND multiple > p75 * 16e-1"),
    "street": _row("street", "street_revenue_1y <> 0 AND horizon = '1' AND metric IN ('EV/Sales', 'P/S') AND (value < street_revenue_1y * 6e-1 OR value > street_revenue_1y * 14e-1)"),
    "grid": """SELECT entity_id, sample, 'grid' AS rule, cast(e as varchar) AS detail FROM (SELECT entity_id, sample, count(DISTINCT label) AS n,
        count(DISTINCT label) FILTER (WHERE label IN ('1y bear', '1y base', '1y bull', '3y bear', '3y base', '3y bull')) AS e FROM ctx GROUP BY entity_id, sample) WHERE n <> 6 OR e <> 6""",
    "weights": """SELECT entity_id, sample, 'weights' AS rule, h || 'y' AS detail FROM (SELECT entity_id, sample, h, coalesce(sum(weight) FILTER (WHERE horizon = h), 0) AS w
        FROM ctx, (VALUES ('1'), ('3')) v(h) GROUP BY entity_id, sample, h) WHERE w < 85e-2 OR w > 115e-2""",
    "bear": _row("bear", "horizon = '1' AND scenario_case = 'bear' AND NOT insufficient AND price <> 0 AND implied > price * 115e-2"),
    "fade": _pair("fade", "a.metric <> 'none' AND a.metric = b.metric AND b.multiple > a.multiple * 11e-1"),
    "coherence": _pair("coherence", "NOT a.insufficient AND b.implied < a.implied * 7e-1"),
}
VERDICT_RULES = {
    "class_sources": "SELECT entity_id, 1 AS sample, 'class_sources' AS rule, '' AS detail FROM fx_verdicts WHERE cause <> 'insufficient_evidence' AND n_cause_sources = 0",
    "keyfacts": "SELECT entity_id, 1 AS sample, 'keyfacts' AS rule, '' AS detail FROM fx_verdicts WHERE NOT insufficient AND n_key_facts = 0",
    "quote": "SELECT entity_id, 1 AS sample, 'quote' AS rule, quote_id AS detail FROM fx_quotes_cited WHERE length(trim(quote)) < 15",
}
SCEN_ALL = " UNION ALL ".join(RULES.values())
ALL_RULES = SCEN_ALL + " UNION ALL " + " UNION ALL ".join(VERDICT_RULES.values())

ROLES = ("fx_estimates", "fx_scenarios", "fx_verdicts")


def sql(body: str, *roles: str) -> str:
    return val_sql(body, *ROLES, *roles)


class Scen(Val):
    @cached_property
    def closes(self):
        """Written once: bands and several prices read them."""
        return materialize(super().closes, "closes")

    def priced(self):
        return S.implied_price(self.t("fx_scenarios"), self.metrics())

    def ctx(self, *needs: str):
        make = {
            "metrics": self.metrics,
            "bands": lambda: X.multiple_bands(self.ratios()),
            "prices": lambda: X.last_close(self.closes),
            "street": lambda: E.eps_growth(self.t("fx_estimates")),
        }
        return V.context(self.t("fx_scenarios"), self.t("fx_verdicts"), **{k: make[k]() for k in needs or make})

    def documents(self):
        return FO.bundle_documents(self.t("fx_filings"), "2024-01-31")

    def bad_sources(self):
        return V.val_citations(self.t("fx_claims"), self.documents(), self.t("fx_priors"))


@query("bundle_documents", sql("SELECT * FROM bundle_docs", "fx_filings"))
def _(t):
    return Scen(t).documents()


@query("implied_price", sql("SELECT entity_id, sample, horizon, scenario_case, metric, implied FROM priced"))
def _(t):
    return Scen(t).priced().select("entity_id", "sample", "horizon", "scenario_case", "metric", "implied")


_PART = lambda x: " + ".join(f"coalesce(max({x}) FILTER (WHERE scenario_case = '{c}' AND implied IS NOT NULL AND weight > 0), 0)" for c in P.CASES)
ANCHOR = f"SELECT entity_id, sample, horizon, {jr('wp / w', 2)} AS anchor FROM (SELECT entity_id, sample, horizon, {_PART('weight')} AS w, {_PART('weight * implied')} AS wp FROM priced GROUP BY entity_id, sample, horizon) WHERE w > 0"


@query("weighted_anchor", sql(ANCHOR))
def _(t):
    return S.weighted_anchor(Scen(t).priced())


@query("entry_price", sql(f"SELECT entity_id, sample, horizon, anchor, CASE WHEN anchor > 0 THEN {jr('anchor / pow(115e-2, cast(horizon as integer))', 2)} END AS entry FROM ({ANCHOR})"))
def _(t):
    return S.weighted_anchor(Scen(t).priced()).withColumn("entry", S.entry_price(F.col("anchor"), F.col("horizon").cast("int")))


@query("ttm_actual_lookup", sql("SELECT entity_id, metric, actual FROM act"))
def _(t):
    return S.ttm_actuals(Val(t).metrics())


@query("scenario_pivot", sql("SELECT entity_id, sample, horizon, " + ", ".join(f"max(implied) FILTER (WHERE scenario_case = '{c}') AS {c}" for c in P.CASES) + " FROM priced GROUP BY entity_id, sample, horizon"))
def _(t):
    return S.scenario_pivot(Scen(t).priced())


_MED = lambda c: f"CASE WHEN count(*) < 2 THEN max(s.{c}) FILTER (WHERE s.sample = 1) ELSE {jr(f'median(s.{c})', 4)} END AS {c}"


def ensemble(src: str) -> str:
    return f"""SELECT s.entity_id, s.horizon, s.scenario_case, s.metric, count(*) AS n_peers, {_MED('weight')}, {_MED('multiple')}, {_MED('value')}
    FROM {src} s JOIN {src} b ON b.entity_id = s.entity_id AND b.horizon = s.horizon AND b.scenario_case = s.scenario_case AND b.sample = 1 AND b.metric = s.metric
    GROUP BY s.entity_id, s.horizon, s.scenario_case, s.metric"""


@query("ensemble_median", with_roles(ensemble("fx_scenarios"), "fx_scenarios"))
def _(t):
    return S.ensemble_median(t("fx_scenarios"))


@query("ensemble_sample_filter", sql(
    f"""SELECT entity_id, sample, horizon, scenario_case, metric FROM fx_scenarios s WHERE sample = 1 OR NOT EXISTS (
    SELECT 1 FROM (SELECT DISTINCT entity_id, sample FROM ({SCEN_ALL})) v WHERE v.entity_id = s.entity_id AND v.sample = s.sample)"""))
def _(t):
    s = Scen(t)
    return S.ensemble_sample_filter(t("fx_scenarios"), V.scenario_violations(s.ctx())).select(
        "entity_id", "sample", "horizon", "scenario_case", "metric"
    )


_KEYS = ["user_id", "day"]
MAJ = """SELECT user_id, day, label AS winner, n / votes AS agreement, votes, secondary FROM (
    SELECT *, sum(n) OVER (PARTITION BY user_id, day) AS votes, row_number() OVER (PARTITION BY user_id, day ORDER BY n DESC, first) AS k FROM (
      SELECT user_id, day, label, count(*) AS n, min(vote_no) AS first, arg_min(secondary, vote_no) AS secondary FROM {src} GROUP BY user_id, day, label)) WHERE k = 1"""


@query("majority_vote", with_roles(f"SELECT user_id, day, winner, agreement, cast(votes as bigint) AS votes FROM ({MAJ.format(src='fx_votes')})", "fx_votes"))
def _(t):
    return S.majority_vote(t("fx_votes"), _KEYS)


@query("winner_secondary", with_roles(f"SELECT user_id, day, winner, secondary FROM ({MAJ.format(src='fx_votes')})", "fx_votes"))
def _(t):
    return S.winner_secondary(t("fx_votes"), _KEYS)


_DOWN = "(SELECT * REPLACE (CASE WHEN v.vote_id IN (SELECT event_id FROM events WHERE value > 100) THEN 'insufficient_evidence' ELSE label END AS label) FROM fx_votes v)"


@query("vote_downgrade", with_roles(f"SELECT user_id, day, winner, agreement, cast(votes as bigint) AS votes FROM ({MAJ.format(src=_DOWN)})", "fx_votes"))
def _(t):
    failed = t("events").filter("value > 100").select(F.col("event_id").alias("vote_id"))
    return S.majority_vote(S.vote_downgrade(t("fx_votes"), failed), _KEYS)


_WIN = lambda c: f"""(SELECT entity_id, {c} AS w, n, votes FROM (SELECT *, sum(n) OVER (PARTITION BY entity_id) AS votes, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, first) AS k FROM (
    SELECT entity_id, {c}, count(*) AS n, min(vote_no) AS first FROM fx_entity_votes GROUP BY entity_id, {c})) WHERE k = 1)"""  # noqa: E731


@query("label_divergence", with_roles(
    f"SELECT count(*) AS n, count(*) FILTER (WHERE a.w = b.w) AS same, {jr('count(*) FILTER (WHERE a.w = b.w) / count(*)', 4)} AS agreement FROM {_WIN('label')} a JOIN {_WIN('masked_label')} b USING (entity_id)",
    "fx_entity_votes"))
def _(t):
    v = t("fx_entity_votes")
    return S.label_divergence(
        S.majority_vote(v, ["entity_id"]), S.majority_vote(v.withColumn("label", F.col("masked_label")), ["entity_id"]), ["entity_id"]
    )


_HEALTH = f"""SELECT count(*) AS analyzed, {jr("count(*) FILTER (WHERE status = 'ok' AND insufficient) / count(*) FILTER (WHERE status = 'ok')", 4)} AS insufficient_rate,
    {jr("cast(sum(cast(coalesce(w.n / w.votes, 0) as decimal(12, 6))) as double) / count(*)", 4)} AS avg_agreement, count(*) FILTER (WHERE status = 'validation_failed') AS validation_failed,
    count(*) FILTER (WHERE cache_hit) AS cache_hits FROM fx_verdicts v LEFT JOIN {_WIN('label')} w USING (entity_id)"""


def health(t):
    votes = S.majority_vote(t("fx_entity_votes"), ["entity_id"]).select("entity_id", "agreement")
    a = t("fx_verdicts").join(votes, "entity_id", "left").withColumn("agreement", F.coalesce("agreement", F.lit(0.0)))
    return S.agreement_health(a)


@query("agreement_health", with_roles(_HEALTH, "fx_verdicts", "fx_entity_votes"))
def _(t):
    return health(t)


@query("health_ranges", sql(
    f"""SELECT signal, value, low, high, value BETWEEN low AND high AS healthy FROM (
    SELECT 'insufficient_rate' AS signal, insufficient_rate AS value, 25e-2 AS low, 40e-2 AS high FROM ({_HEALTH}) UNION ALL
    SELECT 'avg_agreement', avg_agreement, 80e-2, 1e0 FROM ({_HEALTH}) UNION ALL
    SELECT 'sanity_trip_rate', {jr("count(*) FILTER (WHERE confidence = 'degraded') / count(*)", 4)}, 10e-2, 20e-2 FROM ({SANITY_CONF}))""", "fx_entity_votes"))
def _(t):
    f = Lean(t)
    conf = M.sanity_confidence(f.entities, M.sanity_flags(f.entities, f.tags, f.q, f.i, f.metrics()))
    return S.health_ranges(health(t), conf)


@query("verdict_summary", with_roles(
    f"""SELECT v.entity_id, cause || CASE WHEN cause_secondary <> 'none' THEN '+' || cause_secondary ELSE '' END AS cause, cast({jr('w.n / w.votes * 100')} as bigint) AS agreement_pct,
    insufficient, thesis, array_to_string(anomalies, '; ') AS anomalies, guidance_change || ' (' || guidance_timing || ')' AS guidance, array_to_string(discrepancies, '; ') AS discrepancies
    FROM fx_verdicts v LEFT JOIN {_WIN('label')} w USING (entity_id)""", "fx_verdicts", "fx_entity_votes"))
def _(t):
    return S.verdict_summary(t("fx_verdicts"), S.majority_vote(t("fx_entity_votes"), ["entity_id"]))


_TOP = lambda p: f"(SELECT run, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY pos) AS k FROM fx_rankings WHERE pass = '{p}') WHERE k <= 5)"


@query("rank_stability", with_roles(
    f"""SELECT run, n_forward, overlap, n_forward - overlap <= 2 AS stable FROM (SELECT f.run, count(*) AS n_forward, count(r.entity_id) AS overlap
    FROM {_TOP('forward')} f LEFT JOIN {_TOP('reversed')} r ON f.run = r.run AND f.entity_id = r.entity_id GROUP BY f.run)""", "fx_rankings"))
def _(t):
    return S.rank_stability(t("fx_rankings"))


@query("rank_known_filter", with_roles(
    """SELECT run, entity_id, cast(rn as integer) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY pos) AS rn FROM fx_rankings
    WHERE pass = 'forward' AND entity_id IN (SELECT s_suppkey FROM supplier)) WHERE rn <= 5""", "fx_rankings"))
def _(t):
    return S.rank_known_filter(t("fx_rankings"), t("supplier").select(F.col("s_suppkey").alias("entity_id")))


@query("valid_sources", sql("SELECT * FROM vsrc", "fx_filings", "fx_priors"))
def _(t):
    return V.valid_sources(Scen(t).documents(), t("fx_priors"))


@query("val_citations", sql("SELECT * FROM badsrc", "fx_filings", "fx_priors", "fx_claims"))
def _(t):
    return Scen(t).bad_sources()


def verdict_rule(name: str):
    @query(f"val_{name}", with_roles(VERDICT_RULES[name], "fx_verdicts", "fx_quotes_cited"))
    def _(t):
        return V.verdict_rules(t("fx_verdicts"), t("fx_quotes_cited")).filter(F.col("rule") == name)


def scenario_rule(name: str, *needs: str, group: bool = False):
    @query(f"val_{name}", sql(RULES[name]))
    def _(t):
        # Without needs the rule looks at the scenario rows alone.
        ctx = Scen(t).ctx(*needs) if needs else V.context(t("fx_scenarios"), t("fx_verdicts"))
        if group:
            return V.group_rules(ctx).filter(F.col("rule") == name)
        only = {k: c for k, c in V.ROW_RULES.items() if k == name or k.startswith(f"{name}_")}
        return V.row_rules(ctx, only)


for _n in VERDICT_RULES:
    verdict_rule(_n)
scenario_rule("vague")
scenario_rule("guidance_bar")
scenario_rule("priceable", "metrics")
scenario_rule("multiple_range")
scenario_rule("ttm_tether", "metrics")
scenario_rule("band", "bands")
scenario_rule("street", "street")
scenario_rule("grid", group=True)
scenario_rule("bear", "metrics", "prices", group=True)
scenario_rule("weights", group=True)
scenario_rule("fade", group=True)
scenario_rule("coherence", "metrics", group=True)


@query("val_rollup", sql(
    f"""SELECT v.entity_id, p.n IS NULL AND b.n IS NULL AS ok, coalesce(b.n, 0) AS n_bad_sources, coalesce(p.n, 0) AS n_problems, coalesce(p.problems, '') AS problems
    FROM fx_verdicts v LEFT JOIN (SELECT entity_id, count(*) AS n, string_agg(DISTINCT CASE WHEN rule <> 'quote' THEN rule || ':' || detail END, ';' ORDER BY CASE WHEN rule <> 'quote' THEN rule || ':' || detail END) AS problems
      FROM ({ALL_RULES}) WHERE sample = 1 GROUP BY entity_id) p USING (entity_id) LEFT JOIN (SELECT entity_id, count(*) AS n FROM badsrc GROUP BY entity_id) b USING (entity_id)""",
    "fx_filings", "fx_priors", "fx_claims", "fx_quotes_cited"))
def _(t):
    s = Scen(t)
    # Row and group rules read the same rows.
    ctx = materialize(s.ctx(), "scenario-context")
    viol = V.scenario_violations(ctx).unionByName(V.verdict_rules(t("fx_verdicts"), t("fx_quotes_cited")))
    return V.val_rollup(t("fx_verdicts"), viol, s.bad_sources())
