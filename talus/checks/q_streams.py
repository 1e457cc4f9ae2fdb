"""Streams: each key runs the streaming job over the landed events and returns its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.checks.dialect import SPARK
from talus.checks.registry import query
from talus.checks.roles import CHAT, MESSAGE_TEXT, TAP_DATA, with_roles
from talus.operators import debate as D
from talus.sources.gold import workspace
from talus.streaming import jobs as J


def events(t):
    # A glob, because a file source takes folders and patterns.
    return J.read_files(t.spark, f"{t.sf_dir}/events.parque[t]")


def updates(t):
    """Every tenth tap is delivered twice."""
    twice = F.explode(F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return events(t).selectExpr("event_id AS update_id", "ts", f"{TAP_DATA()} AS data", "event_id").select(
        "update_id", "ts", "data", twice.alias("_again")
    )


def ntz(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


TAPS = """SELECT update_id, ts, split_part(data, '|', 2) AS run_date, split_part(data, '|', 3) AS ticker, split_part(data, '|', 4) = '1' AS up
    FROM fx_updates WHERE starts_with(data, 'fb|') AND split_part(data, '|', 3) <> ''"""


def sql(body: str, *roles: str) -> str:
    return with_roles(body, "fx_updates", *roles, extra={"taps": TAPS})


@query("stream_feedback_ingest", sql("SELECT * FROM taps"))
def _(t):
    return ntz(J.feedback_ingest(updates(t), workspace(t.spark, "feedback")), "ts")


@query("stream_last_vote", sql(
    """SELECT ticker, arg_max(run_date, row(ts, update_id)) FILTER (WHERE run_date <> 'news') AS run_date, arg_max(up, row(ts, update_id)) FILTER (WHERE run_date <> 'news') AS up,
    max(ts) FILTER (WHERE run_date <> 'news') AS ts, bool_or(run_date = 'news') AS muted FROM taps GROUP BY ticker"""))
def _(t):
    votes = J.last_vote(J.parse_taps(updates(t)))
    return ntz(J.run_epochs(votes, workspace(t.spark, "last-vote"), ["ticker"]), "ts")


_W = "count(*) AS taps, count(*) FILTER (WHERE up) AS ups, count(*) FILTER (WHERE up) / count(*) AS rate"


@query("stream_vote_rate_windows", sql(
    f"""SELECT 'day' AS kind, date_trunc('day', ts) AS w_start, date_trunc('day', ts) + INTERVAL 1 DAY AS w_end, {_W} FROM taps GROUP BY ALL
    UNION ALL SELECT 'week', w_start, w_start + INTERVAL 7 DAY, {_W} FROM (SELECT up, date_trunc('day', ts) - k * INTERVAL 1 DAY AS w_start FROM taps, range(7) r(k)) GROUP BY ALL"""))
def _(t):
    taps = J.feedback_ingest(updates(t), workspace(t.spark, "rate-taps"))
    day = J.vote_rate_windows(taps).withColumn("kind", F.lit("day"))
    week = J.vote_rate_windows(taps, "7 days", "1 day").withColumn("kind", F.lit("week"))
    return ntz(day.unionByName(week), "w_start", "w_end")


@query("stream_news_fresh", "SELECT event_id, ts - (event_id % 5) * INTERVAL 1 DAY >= ts - INTERVAL 48 HOUR AS fresh FROM events")
def _(t):
    items = events(t).withColumn("pub_ts", F.expr("ts - make_dt_interval(cast(event_id % 5 as int))")).select("event_id", "ts", "pub_ts")
    return J.run_append(J.news_fresh(items), workspace(t.spark, "news")).select("event_id", "fresh")


@query("stream_killswitch_alert", "SELECT event_id, ts, user_id FROM events WHERE event_type = 'error' AND value > 100")
def _(t):
    reads = events(t).withColumn("impact", F.expr("CASE WHEN event_type = 'error' AND value > 100 THEN 'killswitch_trigger' ELSE 'noise' END"))
    return ntz(J.run_append(J.killswitch_alert(reads).select("event_id", "ts", "user_id"), workspace(t.spark, "alerts")), "ts")


MSG = {
    "known": "SELECT DISTINCT symbol AS ticker FROM fx_quotes",
    "msgs": "SELECT * FROM fx_messages WHERE length(text) > 10 AND NOT starts_with(text, '/')",
    "men": """SELECT m.*, (SELECT arg_min(k.ticker, x.p) FROM (SELECT unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS p FROM (
        SELECT list_transform(regexp_extract_all(upper(m.text), '\\$?\\b[A-Z]{1,5}\\b'), lambda z: replace(z, '$', '')) AS toks)) x JOIN known k ON k.ticker = x.tok) AS explicit FROM msgs m""",
    "gaps": "SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS brk FROM men WINDOW w AS (PARTITION BY chat ORDER BY ts, msg_id)",
    "sess": "SELECT *, sum(brk) OVER (PARTITION BY chat ORDER BY ts, msg_id) AS sid FROM gaps",
    "g1": "SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts, msg_id) < INTERVAL 24 HOUR THEN 0 ELSE 1 END AS pause FROM men",
    "g2": "SELECT *, sum(pause) OVER (ORDER BY ts, msg_id) AS stretch FROM g1",
    "g3": "SELECT *, bool_or(explicit IS NOT NULL) OVER (PARTITION BY stretch ORDER BY ts, msg_id) AS settled FROM g2",
    "g4": """SELECT *, coalesce(ts - own_ts < INTERVAL 6 HOUR, false) AS near FROM (SELECT *, lag(msg_id) OVER (PARTITION BY chat ORDER BY ts, msg_id) AS own,
        lag(ts) OVER (PARTITION BY chat ORDER BY ts, msg_id) AS own_ts, lag(msg_id) OVER (ORDER BY ts, msg_id) AS newest FROM g3 WHERE settled)""",
    "told": """SELECT * FROM (WITH RECURSIVE r AS (SELECT msg_id, explicit AS name FROM g4 WHERE explicit IS NOT NULL
        UNION ALL SELECT g.msg_id, r.name FROM g4 g JOIN r ON r.msg_id = CASE WHEN g.near THEN g.own ELSE g.newest END WHERE g.explicit IS NULL) SELECT * FROM r)""",
    "settle": """SELECT m.msg_id, m.chat, m.explicit, CASE WHEN m.explicit IS NOT NULL OR g.near THEN t.name END AS ticker, CASE WHEN m.explicit IS NULL AND NOT g.near THEN t.name END AS fallback
        FROM men m LEFT JOIN g4 g USING (msg_id) LEFT JOIN told t USING (msg_id)""",
    "res": """SELECT *, last_value(explicit IGNORE NULLS) OVER (PARTITION BY chat, sid ORDER BY ts, msg_id ROWS UNBOUNDED PRECEDING) AS ticker FROM sess""",
}


def msql(body: str) -> str:
    return with_roles(body, "fx_messages", "fx_quotes", extra=MSG)


def known(t):
    return t("fx_quotes").select(F.col("symbol").alias("ticker")).distinct()


def messages(t):
    m = t("fx_messages").withColumn("ts", F.col("ts").cast("timestamp"))
    return D.mention_extract(D.countable(m), known(t))


@query("known_tickers", with_roles("SELECT symbol AS ticker FROM fx_quotes UNION SELECT ticker FROM fx_universe", "fx_quotes", "fx_universe"))
def _(t):
    return D.known_tickers(t("fx_quotes").select(F.col("symbol").alias("ticker")), t("fx_universe"))


@query("mention_extract", msql("SELECT msg_id, explicit FROM men"))
def _(t):
    return messages(t).select("msg_id", "explicit")


@query("stream_debate_session", msql("SELECT * FROM settle"))
def _(t):
    stream = events(t).selectExpr(f"{CHAT} AS chat", "event_id AS msg_id", "ts", f"{MESSAGE_TEXT(SPARK)} AS text")
    out = J.debate_sessions(stream, known(t), workspace(t.spark, "debate"))
    return out.select("msg_id", "chat", "explicit", "ticker", "fallback")


@query("debate_session_batch", msql("SELECT msg_id, chat, explicit, ticker FROM res"))
def _(t):
    return D.debate_session(messages(t)).select("msg_id", "chat", "explicit", "ticker")


@query("debate_fallback_24h", msql("SELECT msg_id, ticker, fallback FROM settle"))
def _(t):
    return D.debate_settle(messages(t)).select("msg_id", "ticker", "fallback")
