"""Market-wide drop screen."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus import params as P
from talus.checks.registry import query
from talus.checks.roles import with_roles
from talus.operators import filings as FO
from talus.operators import intervals as V
from talus.operators import prices as Q
from talus.operators import screen as S

AS_OF = "2024-01-31"

FLOORS = """quote_type = 'EQUITY' AND market = 'us_market' AND currency = 'USD' AND market_cap > 2000000000 AND price > 5 AND avg_volume > 500000"""
CHAIN = {
    "passed": f"SELECT * FROM fx_quotes WHERE {FLOORS}",
    "flagged": "SELECT * FROM passed WHERE avg50 <> 0 AND price / avg50 - 1 <= -0.15",
    "rankd": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_date DESC) AS rn, count(*) OVER (PARTITION BY symbol) AS cnt FROM fx_bars_d WHERE bar_date >= DATE '2024-01-31' - 45",
    "months": "SELECT a.symbol, CASE WHEN a.cnt >= 15 THEN a.close / b.close - 1 END AS month_return FROM rankd a JOIN rankd b ON a.symbol = b.symbol AND a.rn = 1 AND b.rn = least(b.cnt, 22)",
    "uni": "SELECT cik, ticker, title FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY pos) AS k FROM fx_universe WHERE regexp_matches(ticker, '^[A-Z]{1,5}(-[A-Z])?$')) WHERE k = 1",
    "meas": """SELECT p.*, CASE WHEN f.symbol IS NOT NULL THEN m.month_return END AS month_change, CASE WHEN p.high52 > 0 THEN p.price / p.high52 - 1 ELSE 0 END AS from_high
        FROM passed p LEFT JOIN flagged f USING (symbol) LEFT JOIN months m USING (symbol)""",
    "hit": """SELECT m.*, coalesce(u.title, '') AS title, coalesce(u.cik, 0) AS cik, market_cap / 1e9 AS market_cap_b,
        concat_ws(',', CASE WHEN day_change <= -0.2 THEN 'dayDrop' END, CASE WHEN month_change <= -0.25 THEN 'monthDrop' END, CASE WHEN from_high <= -0.4 THEN 'from52WeekHigh' END) AS triggers
        FROM meas m LEFT JOIN uni u ON u.ticker = m.symbol WHERE day_change <= -0.2 OR coalesce(month_change <= -0.25, false) OR from_high <= -0.4""",
    "sev": """SELECT h.*, split_part(triggers, ',', 1) AS primary_trigger, CASE WHEN day_change <= -0.2 THEN 0 WHEN month_change <= -0.25 THEN 1 ELSE 2 END AS rank,
        CASE WHEN day_change <= -0.2 THEN day_change WHEN month_change <= -0.25 THEN month_change ELSE from_high END AS severity, s.sector
        FROM hit h LEFT JOIN fx_sectors s USING (symbol)""",
    "kept": "SELECT *, row_number() OVER (ORDER BY rank, severity, pos) AS place FROM sev WHERE sector IS NULL OR sector NOT IN ('Financial Services', 'Real Estate')",
}


def sql(body: str) -> str:
    return with_roles(body, "fx_quotes", "fx_sectors", "fx_bars_d", "fx_universe", extra=CHAIN)


QCOLS = "symbol, price, day_change, market_cap, avg_volume, high52, avg50, target, quote_type, market, currency, pos"


def triggers(t):
    months = Q.month_return(t("fx_bars_d"), AS_OF)
    return S.drop_triggers(t("fx_quotes"), months, FO.universe_dedup(t("fx_universe")))


def kept(t):
    return S.sector_exclude(triggers(t), t("fx_sectors"))


def flat(df):
    return df.withColumn("triggers", F.array_join("triggers", ","))


@query("liquidity_floors", sql(f"SELECT {QCOLS} FROM passed"))
def _(t):
    return S.liquidity_floors(t("fx_quotes"))


@query("month_prefilter", sql("SELECT symbol, price, avg50, row_number() OVER (ORDER BY pos) <= 200 AS checked FROM flagged"))
def _(t):
    return S.month_prefilter(t("fx_quotes")).select("symbol", "price", "avg50", "checked")


@query("month_return", sql("SELECT symbol, month_return FROM months"))
def _(t):
    return Q.month_return(t("fx_bars_d"), AS_OF)


@query("drawdown_from_high", sql("""SELECT symbol, bar_date, close, high, CASE WHEN high > 0 THEN close / high - 1 ELSE 0 END AS from_high FROM (
    SELECT symbol, bar_date, close, max(close) OVER (PARTITION BY symbol ORDER BY bar_date RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND CURRENT ROW) AS high FROM fx_bars_d)"""))
def _(t):
    return Q.drawdown_from_high(t("fx_bars_d"))


HIT = "symbol, title, cik, price, market_cap_b, day_change, month_change, from_high, target, triggers, pos"


@query("drop_triggers", sql(f"SELECT {HIT} FROM hit"))
def _(t):
    return flat(triggers(t))


@query("trigger_rank", sql("SELECT symbol, triggers, primary_trigger, rank, severity FROM sev"))
def _(t):
    return flat(S.with_severity(triggers(t))).select("symbol", "triggers", "primary_trigger", "rank", "severity")


@query("sector_exclude", sql("SELECT symbol, sector, coalesce(sector IN ('Financial Services', 'Real Estate'), false) AS excluded FROM sev"))
def _(t):
    return S.with_sector(triggers(t), t("fx_sectors")).select("symbol", "sector", "excluded")


@query("severity_topk", sql(f"SELECT {HIT}, sector, primary_trigger, rank, severity FROM kept WHERE place <= 30"))
def _(t):
    return flat(S.severity_topk(kept(t)))


@query("overflow_report", sql("SELECT symbol, primary_trigger, rank, severity FROM kept WHERE place > 30"))
def _(t):
    return S.overflow_report(kept(t)).select("symbol", "primary_trigger", "rank", "severity")


@query("screen_funnel", sql("""SELECT (SELECT count(*) FROM uni) AS universe, (SELECT count(*) FROM fx_quotes) AS quoted, (SELECT count(*) FROM passed) AS passed_floors,
    (SELECT least(count(*), 200) FROM flagged) AS month_checked, (SELECT greatest(count(*) - 200, 0) FROM flagged) AS month_check_skipped,
    (SELECT count(*) FROM sev) AS triggered, (SELECT count(*) FROM sev WHERE sector IN ('Financial Services', 'Real Estate')) AS sector_excluded,
    (SELECT greatest(count(*) - 30, 0) FROM kept) AS overflow_dropped"""))
def _(t):
    hit = S.with_sector(triggers(t), t("fx_sectors"))
    return S.screen_funnel(FO.universe_dedup(t("fx_universe")), t("fx_quotes"), hit)


_OVERLAP = "s.holder = b.holder AND s.since <= b.b_to AND (s.until IS NULL OR b.b_from <= s.until) AND (s.until IS NULL OR s.since <= s.until)"


@query("interval_overlap", with_roles(
    f"""SELECT s.holder, count(*) AS pairs, min(s.span_id) AS least_span, max(b.blackout_id) AS last_blackout, cast(sum((s.span_id * 31 + b.blackout_id) % 1000003) as bigint) AS checksum
    FROM fx_spans s JOIN fx_blackouts b ON {_OVERLAP} GROUP BY s.holder""", "fx_spans", "fx_blackouts"))
def _(t):
    pairs = V.overlap_join(t("fx_spans"), t("fx_blackouts"), ["holder"], ("since", "until"), ("b_from", "b_to"))
    return pairs.groupBy("holder").agg(F.count("*").alias("pairs"), F.min("span_id").alias("least_span"), F.max("blackout_id").alias("last_blackout"),
                                       F.sum((F.col("span_id") * 31 + F.col("blackout_id")) % 1000003).alias("checksum"))


@query("interval_free", with_roles(
    f"SELECT s.span_id FROM fx_spans s WHERE NOT EXISTS (SELECT 1 FROM fx_blackouts b WHERE {_OVERLAP})", "fx_spans", "fx_blackouts"))
def _(t):
    return V.overlap_join(t("fx_spans"), t("fx_blackouts"), ["holder"], ("since", "until"), ("b_from", "b_to"), "left_anti").select("span_id")


@query("sic_exclude", with_roles(
    """SELECT symbol FROM fx_quotes q WHERE NOT EXISTS (SELECT 1 FROM fx_codes c WHERE c.symbol = q.symbol AND c.valid_from <= DATE '2024-01-31'
    AND (c.valid_to IS NULL OR c.valid_to >= DATE '2024-01-31') AND c.sic BETWEEN 6000 AND 6799)""", "fx_quotes", "fx_codes"))
def _(t):
    ranges = t.spark.createDataFrame(list(P.EXCLUDED_SIC), "sic_from int, sic_to int")
    return S.sic_exclude(t("fx_quotes").select("symbol"), t("fx_codes"), ranges, "2024-01-31")
