"""Insiders, sessions of the exchange, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.checks.registry import query
from talus.checks.roles import with_roles
from talus.functions.columns import ratio
from talus.operators import budget as B
from talus.operators import insiders as I
from talus.operators import relative as M
from talus.operators import rollups as U
from talus.operators import sessions as C

BUYERS = {
    "days": "SELECT DISTINCT entity_id, day FROM fx_form4_buys",
    "met": "SELECT d.entity_id, d.day, count(DISTINCT b.owner) AS insiders, sum(b.shares * b.price) AS value FROM days d JOIN fx_form4_buys b ON b.entity_id = d.entity_id AND b.day BETWEEN d.day - 29 AND d.day GROUP BY ALL",
}


@query("form4_explode", with_roles(
    """SELECT concat('a', cast(o_orderkey as string)) AS accession, line, cast(floor(o_custkey / 15) as bigint) AS entity_id, o_custkey AS owner, concat('Owner ', cast(o_custkey as string)) AS owner_name,
    o_custkey % 3 = 0 AS is_director, true AS is_officer, cast(o_orderdate as date) + line * 20 AS day,
    CASE WHEN line = 1 OR o_orderkey % 4 < 2 THEN 'P' WHEN o_orderkey % 4 = 2 THEN 'S' ELSE 'A' END AS code,
    cast(CASE WHEN line = 0 THEN o_orderkey % 500 WHEN o_orderkey % 3 = 0 THEN 10 ELSE 0 END as double) AS shares, cast(o_orderkey % 90 + 1 as double) AS price,
    CASE WHEN line = 0 AND o_orderkey % 4 = 2 THEN 'D' ELSE 'A' END AS acquired FROM orders, (SELECT unnest([0, 1])::INT AS line)"""))
def _(t):
    return I.form4_explode(t("fx_form4"))


@query("insider_clusters", with_roles(
    """SELECT entity_id, insiders, peak_day, value, insiders >= 3 AS cluster FROM (SELECT entity_id, insiders, day AS peak_day, value,
    row_number() OVER (PARTITION BY entity_id ORDER BY insiders DESC, day) AS k FROM met) WHERE k = 1""", "fx_form4_buys", extra=BUYERS))
def _(t):
    return I.insider_clusters(I.insider_buys(I.form4_explode(t("fx_form4"))))


@query("insider_flags", with_roles(
    """SELECT l_orderkey, l_linenumber, l_suppkey AS entity_id, cast(l_shipdate as date) AS day, (SELECT count(DISTINCT owner) FROM fx_form4_buys b WHERE b.entity_id = l_suppkey AND b.day BETWEEN cast(l_shipdate as date) - 29 AND cast(l_shipdate as date)) AS insiders,
    (SELECT count(DISTINCT owner) FROM fx_form4_buys b WHERE b.entity_id = l_suppkey AND b.day BETWEEN cast(l_shipdate as date) - 29 AND cast(l_shipdate as date)) >= 3 AS cluster FROM lineitem""", "fx_form4_buys"))
def _(t):
    asks = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("entity_id"), F.col("l_shipdate").cast("date").alias("day"))
    return I.insider_flags(asks, I.insider_buys(I.form4_explode(t("fx_form4"))))


# The calendar told by scanning days: what makes a day a holiday is asked of each day.
CALENDAR = {
    "all_days": """SELECT d::DATE AS day, year(d) AS y, month(d) AS m, day(d) AS dd, isodow(d) - 1 AS wd FROM range(DATE '1990-01-01', DATE '2026-01-01', INTERVAL 1 DAY) r(d)""",
    "moons": """SELECT y, (19 * (y % 19) + y // 100 - y // 400 - (8 * (y // 100) + 13) // 25 + 15) % 30 AS a FROM range(1990, 2026) r(y)""",
    "easters": """SELECT y, max(day) AS sunday FROM (SELECT m.y, d.day, row_number() OVER (PARTITION BY m.y ORDER BY d.day) AS k FROM moons m JOIN all_days d ON d.wd = 6
        AND d.day > make_date(m.y, 3, 21) + (a - CASE WHEN a = 29 OR a = 28 AND m.y % 19 > 10 THEN 1 ELSE 0 END)::INT) WHERE k = 1 GROUP BY y""",
    "off": """SELECT d.day FROM all_days d JOIN easters e USING (y) WHERE wd >= 5 OR d.day = e.sunday - 2
        OR wd = 0 AND m = 1 AND dd BETWEEN 15 AND 21 AND y >= 1998 OR wd = 0 AND m = 2 AND dd BETWEEN 15 AND 21 OR wd = 0 AND m = 5 AND dd >= 25 OR wd = 0 AND m = 9 AND dd <= 7
        OR wd = 3 AND m = 11 AND dd BETWEEN 22 AND 28 OR m = 1 AND (dd = 1 OR dd = 2 AND wd = 0)
        OR (m = 7 AND dd = 4 OR m = 12 AND dd = 25 OR m = 6 AND dd = 19 AND y >= 2022) OR wd = 4 AND (m = 7 AND dd = 3 OR m = 12 AND dd = 24 OR m = 6 AND dd = 18 AND y >= 2022)
        OR wd = 0 AND (m = 7 AND dd = 5 OR m = 12 AND dd = 26 OR m = 6 AND dd = 20 AND y >= 2022)
        OR d.day BETWEEN DATE '2001-09-11' AND DATE '2001-09-14' OR d.day BETWEEN DATE '2012-10-29' AND DATE '2012-10-30'
        OR d.day IN (DATE '1994-04-27', DATE '2004-06-11', DATE '2007-01-02', DATE '2018-12-05', DATE '2025-01-09')""",
    "open_days": "SELECT day, row_number() OVER (ORDER BY day) AS no FROM all_days WHERE day NOT IN (SELECT day FROM off)",
    "known": "SELECT d.day, (SELECT min(day) FROM open_days o WHERE o.day >= d.day) AS next_day, (SELECT max(day) FROM open_days o WHERE o.day <= d.day) AS last_day FROM all_days d",
    "placed": "SELECT k.day, n.no AS next_no, l.no AS last_no FROM known k LEFT JOIN open_days n ON n.day = k.next_day LEFT JOIN open_days l ON l.day = k.last_day",
}


@query("session_arithmetic", with_roles(
    """SELECT l_orderkey, l_linenumber, a.day AS next_session, b.day AS settled, c.day AS day_before, y.last_no - x.last_no AS sessions_to_receipt, q.day AS due
    FROM lineitem JOIN placed x ON x.day = cast(l_shipdate as date) JOIN placed y ON y.day = cast(l_shipdate as date) + l_linenumber * 3 LEFT JOIN open_days a ON a.no = x.next_no LEFT JOIN open_days b ON b.no = x.next_no + 2
    LEFT JOIN open_days c ON c.no = x.next_no - 1 JOIN placed z ON z.day = (cast(l_shipdate as date) + INTERVAL 3 MONTH)::DATE LEFT JOIN open_days q ON q.no = z.next_no""", extra=CALENDAR))
def _(t):
    cal = C.calendar(t.spark, 1990, 2025)
    d = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("day"), F.expr("date_add(cast(l_shipdate as date), cast(l_linenumber * 3 as int))").alias("got"))
    for n, out in ((0, "next_session"), (2, "settled"), (-1, "day_before")):
        d = C.sessions_later(d, cal, "day", n, out)
    return C.months_later(C.sessions_between(d, cal, "day", "got", "sessions_to_receipt"), cal, "day", 3, "due").drop("day", "got")


@query("session_calendar", with_roles(
    """SELECT cast(o_orderdate as date) AS day, count(*) AS orders, bool_and(day NOT IN (SELECT day FROM off)) AS session FROM orders, (SELECT 1) GROUP BY cast(o_orderdate as date)""".replace("bool_and(day", "bool_and(cast(o_orderdate as date)"), extra=CALENDAR))
def _(t):
    cal = C.calendar(t.spark, 1990, 2025).select("day", "session")
    return t("orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("orders")).join(F.broadcast(cal), "day")


TOTALS = {"upto": """SELECT *, sum(tokens) OVER (PARTITION BY bundle_id ORDER BY tier, filed_at DESC, piece_id ROWS UNBOUNDED PRECEDING) AS total FROM fx_pieces"""}
_ROOM = "50000 - (total - tokens)"
_KEPT = f"CASE WHEN total <= 50000 THEN tokens WHEN {_ROOM} >= 200 THEN {_ROOM} ELSE 0 END"


@query("token_budget", with_roles(
    f"""SELECT bundle_id, piece_id, tier, filed_at, tokens, CASE WHEN total <= 50000 THEN 'kept' WHEN {_ROOM} >= 200 THEN 'partial' ELSE 'dropped' END AS status,
    cast({_KEPT} as bigint) AS kept_tokens, cast(tokens - {_KEPT} as bigint) AS dropped_tokens FROM upto""", "fx_pieces", extra=TOTALS))
def _(t):
    return B.within_budget(t("fx_pieces"))


@query("grade_cube", with_roles(
    """SELECT grouping(classification, year, graded)::BIGINT AS level, classification, year, graded, count(*) AS calls, count(*) FILTER (WHERE return_1y IS NOT NULL) AS settled,
    count(*) FILTER (WHERE valuation_error_pct > 0) AS too_low, min(valuation_error_pct) AS least_error, max(valuation_error_pct) AS largest_error
    FROM (SELECT *, year(run_date) AS year FROM fx_ledger) GROUP BY GROUPING SETS ((classification, year, graded), (classification, year), (classification, graded), (classification), (year), ())""", "fx_ledger"))
def _(t):
    return U.grade_cube(t("fx_ledger"))


@query("funnel_cube", with_roles(
    """SELECT grouping(sector, quote_type, currency)::BIGINT AS level, sector, quote_type, currency, count(*) AS names, count(*) FILTER (WHERE big) AS large, count(*) FILTER (WHERE big AND dropped) AS fell, count(*) FILTER (WHERE big AND dropped AND priced) AS priced
    FROM (SELECT s.sector, quote_type, currency, coalesce(market_cap > 2000000000, false) AS big, coalesce(price / high52 - 1 <= -0.4, false) AS dropped, coalesce(price > 5, false) AS priced
      FROM fx_quotes q LEFT JOIN fx_sectors s USING (symbol)) GROUP BY ROLLUP (sector, quote_type, currency)""", "fx_quotes", "fx_sectors"))
def _(t):
    names = t("fx_quotes").drop("target").join(t("fx_sectors").select("symbol", "sector"), "symbol", "left")
    return U.funnel_cube(names, ["sector", "quote_type", "currency"], {
        "large": F.col("market_cap") > 2_000_000_000, "fell": ratio("price", "high52") - 1 <= -0.4, "priced": F.col("price") > 5})


@query("weekly_sketches", """SELECT date_trunc('week', ts)::DATE AS week, count(*) AS rows, count(DISTINCT user_id) AS readers, true AS distinct_close, true AS median_close, true AS merge_is_whole
    FROM events GROUP BY 1""")
def _(t):
    """Days' states merged to weeks, beside the exact counts: estimates within 5 %, the median's rank within 3 %,
    and merged days no other than the state of the whole week."""
    ev = t("events").withColumn("day", F.to_date("ts")).withColumn("week", F.to_date(F.date_trunc("week", "ts")))
    merged = U.read_sketches(U.merged_sketches(U.day_sketches(ev, ["week", "day"], "user_id", "value"), ["week"]), ["week"])
    whole = U.read_sketches(U.day_sketches(ev, ["week"], "user_id", "value"), ["week"]).select("week", F.col("distinct").alias("at_once"))
    exact = ev.groupBy("week").agg(F.countDistinct("user_id").alias("readers"))
    below = ev.join(merged.select("week", "p50"), "week").groupBy("week").agg((F.count_if(F.col("value") <= F.col("p50")) / F.count("value")).alias("upto"), (F.count_if(F.col("value") < F.col("p50")) / F.count("value")).alias("under"))
    return merged.join(whole, "week").join(exact, "week").join(below, "week").select(
        "week", "rows", "readers", (F.abs(F.col("distinct") - F.col("readers")) <= 0.05 * F.col("readers")).alias("distinct_close"),
        ((F.col("upto") >= 0.47) & (F.col("under") <= 0.53)).alias("median_close"), (F.col("distinct") == F.col("at_once")).alias("merge_is_whole"))


RETURNS = {
    "rets": """SELECT symbol, bar_date, cast(floor(close / prev * 1000000 - 1000000 + 0.5) as bigint) AS r FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY bar_date) AS prev FROM fx_bars_d) WHERE prev <> 0 AND close IS NOT NULL""",
    "mkt": "SELECT bar_date, cast(floor(sum(r) / count(*)) as bigint) AS x FROM rets GROUP BY bar_date",
    "xy": "SELECT symbol, bar_date, r, x, cast(floor((bar_date - DATE '1970-01-01') / 5) as bigint) AS cell FROM rets JOIN mkt USING (bar_date)",
    "spans": "SELECT DISTINCT symbol, cell FROM xy",
    "fits": """SELECT s.symbol, s.cell, count(*) AS n, CASE WHEN count(*) >= 3 AND max(x) > min(x) THEN regr_slope(r, x) END AS beta, cast(sum(r) as double) / 1000000 AS move, cast(sum(x) as double) / 1000000 AS x_move
        FROM spans s JOIN xy ON xy.symbol = s.symbol AND xy.cell BETWEEN s.cell - 3 AND s.cell GROUP BY ALL""",
    "recent": "SELECT * FROM rets JOIN mkt USING (bar_date) LEFT JOIN (SELECT symbol, sector FROM fx_sectors) USING (symbol) WHERE bar_date <= DATE '2024-01-25' AND bar_date > DATE '2024-01-25' - 10",
    "peers": "SELECT sector, bar_date, cast(floor(sum(r) / count(*)) as bigint) AS peer FROM recent WHERE sector IS NOT NULL GROUP BY ALL",
}


@query("rolling_beta", with_roles(
    "SELECT symbol, cell, n, round(beta, 6) AS beta, move, x_move, round(move - beta * x_move, 6) AS own FROM fits", "fx_bars_d", extra=RETURNS))
def _(t):
    r = M.daily_returns(t("fx_bars_d"))
    return M.rolling_beta(r.join(M.group_returns(r), "bar_date")).withColumns({"beta": F.round("beta", 6), "own": F.round("own", 6)})


@query("sector_moves", with_roles(
    """SELECT symbol, sum(r) / 1000000 AS move, sum(x) / 1000000 AS market_move, sum(peer) / 1000000 AS sector_move, (sum(r) - sum(x)) / 1000000 AS against_market, (sum(r) - sum(peer)) / 1000000 AS against_sector
    FROM recent LEFT JOIN peers USING (sector, bar_date) GROUP BY symbol""", "fx_bars_d", "fx_sectors", extra=RETURNS))
def _(t):
    r = M.daily_returns(t("fx_bars_d"))
    return M.moves(r, M.group_returns(r), t("fx_sectors").select("symbol", F.col("sector").alias("group")), "2024-01-25", 10)
