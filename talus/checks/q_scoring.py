"""Grading past predictions and rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.checks.chains import jr
from talus.checks.registry import query
from talus.checks.roles import with_roles
from talus.operators import filings as FO
from talus.operators import ranking as R
from talus.operators import scoring as K
from talus.sources.gold import materialize

AS_OF = "2001-11-05"
BENCH = 0

CHAIN = {
    "lastc": "SELECT symbol, arg_max(close, bar_date) AS last, max(bar_date) AS last_date FROM fx_bars_s GROUP BY symbol",
    "firstc": """SELECT a.symbol, a.since, b.close AS first, b.bar_date AS first_date FROM (SELECT DISTINCT ticker AS symbol, run_date AS since FROM fx_ledger
        UNION SELECT DISTINCT 0, run_date FROM fx_ledger) a ASOF JOIN fx_bars_s b ON a.symbol = b.symbol AND a.since <= b.bar_date""",
    "rets": "SELECT f.symbol, f.since, l.last / f.first - 1 AS ret FROM firstc f JOIN lastc l USING (symbol) WHERE f.first_date < l.last_date",
    "led": """SELECT l.*, s.ret AS stock_ret, b.ret AS bench_ret, DATE '2001-11-05' - l.run_date AS age FROM fx_ledger l
        LEFT JOIN rets s ON s.symbol = l.ticker AND s.since = l.run_date LEFT JOIN rets b ON b.symbol = 0 AND b.since = l.run_date""",
    "act": """SELECT l.ticker, l.run_date, CASE
        WHEN EXISTS (SELECT 1 FROM fx_filings f WHERE f.entity_id = l.ticker AND f.filed_at >= l.run_date AND f.form = '8-K' AND list_contains(string_split(f.items, ','), '1.03')) THEN 'bankruptcy'
        WHEN EXISTS (SELECT 1 FROM fx_filings f WHERE f.entity_id = l.ticker AND f.filed_at >= l.run_date AND f.form IN ('25', '25-NSE')) THEN 'delisted' END AS action FROM fx_ledger l""",
    "open": "SELECT l.*, a.action, (l.age >= 30 AND NOT has_drift30) OR (l.age >= 90 AND NOT has_drift90) AS looks FROM led l JOIN act a USING (ticker, run_date)",
    "dead": f"""SELECT ticker, run_date, action, CASE WHEN action = 'bankruptcy' AND NOT has_1y THEN -1e0 ELSE return_1y END AS return_1y,
        CASE WHEN action = 'bankruptcy' AND NOT has_1y AND fair <> 0 THEN -100e0 ELSE valuation_error_pct END AS valuation_error_pct,
        CASE WHEN action = 'bankruptcy' THEN '{K.AUTO_BANKRUPT}' ELSE coalesce(note, CASE WHEN action = 'delisted' THEN '{K.MANUAL_DELISTED}' ELSE '{K.MANUAL_GONE}' END) END AS note
        FROM open WHERE stock_ret IS NULL AND looks""",
    "err": f"""SELECT *, {jr('stock_ret - bench_ret', 4)} AS d, CASE WHEN has_1y THEN return_1y WHEN age >= 365 THEN {jr('stock_ret', 4)} ELSE return_1y END AS r1 FROM led""",
    "err2": f"""SELECT *, CASE WHEN has_1y OR age < 365 THEN valuation_error_pct WHEN r1 IS NOT NULL AND fair <> 0 THEN {jr('(ref_price * (1 + r1) / (1 + coalesce(bench_ret, 0)) - fair) / fair * 100', 4)} END AS e1 FROM err""",
    "drifts": """SELECT *, CASE WHEN has_drift30 OR age < 30 OR d IS NULL THEN drift30 ELSE d END AS d30, CASE WHEN has_drift90 OR age < 90 OR d IS NULL THEN drift90 ELSE d END AS d90 FROM err2""",
    "sc": """SELECT e.ticker, e.run_date, e.ok, e.classification, e.ref_price, e.fair, e.bear, e.bull, d30 AS drift30, d90 AS drift90,
        CASE WHEN d.action = 'bankruptcy' THEN d.return_1y ELSE e.r1 END AS return_1y, CASE WHEN d.action = 'bankruptcy' THEN d.valuation_error_pct ELSE e.e1 END AS valuation_error_pct,
        CASE WHEN d.ticker IS NOT NULL THEN d.note ELSE e.note END AS note FROM drifts e LEFT JOIN dead d USING (ticker, run_date)""",
}


def sql(body: str) -> str:
    return with_roles(body, "fx_ledger", "fx_bars_s", "fx_filings", "fx_grades", "fx_ledger_scen", "fx_feedback", "fx_overrides", extra=CHAIN)


def returns(t):
    return K.with_returns(t("fx_ledger"), t("fx_bars_s"), BENCH)


def actions(t):
    asks = t("fx_ledger").selectExpr("ticker", "run_date", "ticker AS entity_id", "run_date AS since")
    return FO.corporate_action_scan(asks, t("fx_filings")).select("ticker", "run_date", "action")


def ledger(t):
    return K.scored(t("fx_ledger"), t("fx_bars_s"), BENCH, actions(t), AS_OF)


@query("prediction_age", sql("SELECT ticker, run_date, cast(age as integer) AS age_days, age >= 30 AS due30, age >= 90 AS due90, age >= 365 AS due1y, age >= 1095 AS due3y FROM (SELECT *, DATE '2001-11-05' - run_date AS age FROM fx_ledger)"))
def _(t):
    return K.prediction_age(t("fx_ledger"), AS_OF).select("ticker", "run_date", "age_days", *K.GATES)


@query("grading_due", sql("SELECT ticker, run_date FROM fx_ledger WHERE DATE '2001-11-05' - run_date >= 90 AND NOT graded AND note IS NULL AND ticker IN (SELECT s_suppkey FROM supplier)"))
def _(t):
    known = t("supplier").select(F.col("s_suppkey").alias("ticker"))
    return K.grading_due(t("fx_ledger"), known, AS_OF).select("ticker", "run_date")


@query("return_since", sql("SELECT ticker, run_date, stock_ret AS ret FROM led"))
def _(t):
    asks = t("fx_ledger").selectExpr("ticker", "run_date", "ticker AS symbol", "run_date AS since")
    return K.return_since(asks, t("fx_bars_s")).select("ticker", "run_date", "ret")


@query("benchmark_drift", sql("SELECT ticker, run_date, d30 AS drift30, d90 AS drift90, has_drift30 OR (age >= 30 AND d IS NOT NULL) AS has_drift30 FROM drifts"))
def _(t):
    return K.benchmark_drift(returns(t), AS_OF).select("ticker", "run_date", "drift30", "drift90", "has_drift30")


@query("dead_ticker_resolution", sql("SELECT * FROM dead"))
def _(t):
    return K.dead_ticker_resolution(returns(t), actions(t), AS_OF)


@query("market_adjusted_error", sql("SELECT ticker, run_date, r1 AS return_1y, e1 AS valuation_error_pct FROM err2"))
def _(t):
    return K.market_adjusted_error(returns(t), AS_OF).select("ticker", "run_date", "return_1y", "valuation_error_pct")


@query("return_3y", sql(f"SELECT ticker, run_date, CASE WHEN has_3y OR age < 1095 THEN return_3y ELSE {jr('stock_ret', 4)} END AS return_3y FROM led"))
def _(t):
    return K.return_3y(returns(t), AS_OF).select("ticker", "run_date", "return_3y")


@query("manual_resolution", sql(
    f"""SELECT l.ticker, l.run_date, CASE WHEN ref_price > 0 THEN {jr('o.price / ref_price - 1', 4)} END AS return_1y,
    CASE WHEN fair > 0 THEN floor((o.price / (1 + coalesce(bench_ret, 0)) - fair) / fair * 1000 + 0.5) / 10 END AS valuation_error_pct,
    coalesce(o.note, 'manually resolved at $' || cast(cast(o.price as decimal(20, 2)) as varchar)) AS note FROM led l JOIN fx_overrides o USING (ticker, run_date)"""))
def _(t):
    return K.manual_resolution(returns(t), t("fx_overrides"))


_MEAN = lambda c, k: f"floor(cast(sum(cast({c} as decimal(28, 4))) as double) / count({c}) * {k} + 0.5) / {k}"
_DRIFT = "SELECT classification, count(*) AS n, floor(cast(sum(cast(coalesce(drift90, drift30) as decimal(28, 4))) as double) / count(*) * 1000 + 0.5) / 10 AS avg_pct FROM sc WHERE coalesce(drift90, drift30) IS NOT NULL GROUP BY classification"


@query("class_drift", sql(_DRIFT))
def _(t):
    return K.class_drift(ledger(t))


@query("base_rate", sql(f"SELECT l.ticker, l.run_date, l.classification, d.n AS base_n, d.avg_pct AS base_rate_pct FROM fx_ledger l LEFT JOIN ({_DRIFT}) d ON d.classification = l.classification AND d.n >= 10"))
def _(t):
    return K.base_rate(t("fx_ledger").select("ticker", "run_date", "classification"), K.class_drift(ledger(t)))


_RATE = "SELECT count(*) AS taps, count(*) FILTER (WHERE up) AS ups, floor(count(*) FILTER (WHERE up) / count(*) * 100 + 0.5) AS up_pct FROM fx_feedback"


@query("feedback_rate", sql(_RATE))
def _(t):
    return K.feedback_rate(t("fx_feedback"))


_FR = f"""SELECT count(*) AS graded, count(*) FILTER (WHERE status = 'fired') AS fired, count(*) FILTER (WHERE status = 'survived') AS survived, count(*) FILTER (WHERE status = 'uncheckable') AS uncheckable,
    count(*) FILTER (WHERE status IN ('fired', 'survived')) AS n, {jr("count(*) FILTER (WHERE status = 'fired') / count(*) FILTER (WHERE status IN ('fired', 'survived'))", 3)} AS fired_share FROM fx_grades"""


@query("falsifier_rollup", sql(_FR))
def _(t):
    return K.falsifier_rollup(t("fx_grades"))


@query("falsifier_align", sql(
    """SELECT s.ticker, s.run_date, s.label, s.falsifier, coalesce(g.status, 'uncheckable') AS status FROM fx_ledger_scen s LEFT JOIN (
    SELECT * FROM (SELECT *, trim(regexp_replace(scenario, '[\\[\\]]', '', 'g')) AS label, row_number() OVER (PARTITION BY ticker, run_date, trim(regexp_replace(scenario, '[\\[\\]]', '', 'g')) ORDER BY pos DESC) AS k FROM fx_grades) WHERE k = 1) g
    USING (ticker, run_date, label)"""))
def _(t):
    return K.falsifier_align(t("fx_ledger_scen"), t("fx_grades"))


@query("calibration_rollup", sql(
    f"""SELECT NULL AS classification, count(*) AS n, {_MEAN('valuation_error_pct', 10)} AS mean_error_pct, {jr('max(v) FILTER (WHERE k = n2)', 1)} AS median_error_pct FROM (
      SELECT valuation_error_pct, valuation_error_pct AS v, row_number() OVER (ORDER BY valuation_error_pct) AS k, cast(floor(count(*) OVER () / 2) as bigint) + 1 AS n2 FROM sc WHERE valuation_error_pct IS NOT NULL)
    UNION ALL SELECT classification, count(*), {_MEAN('valuation_error_pct', 1000000)}, NULL FROM sc WHERE valuation_error_pct IS NOT NULL GROUP BY classification"""))
def _(t):
    return K.calibration_rollup(materialize(ledger(t), "ledger"))


@query("band_hit_rate", sql("SELECT count(*) AS n, count(*) FILTER (WHERE ref_price * (1 + coalesce(return_1y, 0)) BETWEEN bear AND bull) AS in_band FROM sc WHERE valuation_error_pct IS NOT NULL"))
def _(t):
    return K.band_hit_rate(ledger(t))


@query("unresolved_count", sql("SELECT count(*) FILTER (WHERE contains(note, 'manual')) AS unresolved FROM sc"))
def _(t):
    return K.unresolved_count(ledger(t))


@query("scoring_summary", sql(
    f"""SELECT count(*) AS predictions, count(*) FILTER (WHERE contains(note, 'manual')) AS unresolved, count(valuation_error_pct) AS calibrated, {_MEAN('valuation_error_pct', 10)} AS mean_error_pct,
    count(*) FILTER (WHERE valuation_error_pct IS NOT NULL AND ref_price * (1 + coalesce(return_1y, 0)) BETWEEN bear AND bull) AS in_band,
    (SELECT graded FROM ({_FR})) AS graded, (SELECT uncheckable FROM ({_FR})) AS uncheckable, (SELECT fired_share FROM ({_FR})) AS fired_share, (SELECT up_pct FROM ({_RATE})) AS up_pct FROM sc"""))
def _(t):
    return K.scoring_summary(ledger(t), t("fx_grades"), t("fx_feedback"))


_P1 = lambda c: f"{jr(f'{c} * 100', 1)} AS {c}_pct"


@query("audit_ledger", sql(
    f"""SELECT s.run_date, s.ticker, classification, ref_price, fair, {_P1('drift30')}, {_P1('drift90')}, {_P1('return_1y')}, valuation_error_pct, g.fired, g.survived, g.uncheckable, coalesce(note, '') AS note
    FROM sc s LEFT JOIN (SELECT ticker, run_date, count(*) FILTER (WHERE status = 'fired') AS fired, count(*) FILTER (WHERE status = 'survived') AS survived, count(*) FILTER (WHERE status = 'uncheckable') AS uncheckable
    FROM fx_grades GROUP BY ticker, run_date) g USING (ticker, run_date) ORDER BY run_date, ticker"""))
def _(t):
    return K.audit_ledger(ledger(t), t("fx_grades"))


_GAP = "SELECT ticker, run_date, fair / ref_price - 1 AS gap FROM fx_ledger"


@query("gap_deciles", with_roles(
    f"SELECT ticker, run_date, gap, cast(ntile(10) OVER (ORDER BY gap, ticker, run_date) as integer) AS decile, row_number() OVER (ORDER BY gap, ticker, run_date) AS rank FROM ({_GAP})", "fx_ledger"))
def _(t):
    gaps = t("fx_ledger").selectExpr("ticker", "run_date", "fair / ref_price - 1 AS gap")
    ranked = R.global_rank(gaps, [F.col("gap"), F.col("ticker"), F.col("run_date")])
    return ranked.select("ticker", "run_date", "gap", R.tile(F.col("rank"), F.col("of"), 10).alias("decile"), "rank")


@query("gap_extremes", with_roles(
    f"""SELECT place, gap FROM (SELECT gap, row_number() OVER (ORDER BY gap, ticker, run_date) AS k, count(*) OVER () AS n FROM ({_GAP})) x JOIN (SELECT unnest([1, 2, 100, -1, -50])::INT AS place) p
    ON k = CASE WHEN place > 0 THEN place ELSE n + 1 + place END""", "fx_ledger"))
def _(t):
    gaps = t("fx_ledger").selectExpr("ticker", "run_date", "fair / ref_price - 1 AS gap")
    return R.nth_values(gaps, [F.col("gap"), F.col("ticker"), F.col("run_date")], "gap", [1, 2, 100, -1, -50])
