"""Universe, quotes, bars, filings, documents and news."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus import params as P
from talus.checks.chains import jr
from talus.checks.registry import query
from talus.checks.roles import with_roles
from talus.functions import text as T
from talus.operators import filings as O
from talus.operators import news as N
from talus.operators import prices as Q
from talus.sources.gold import spread

AS_OF_LINES, AS_OF_FILINGS = "2001-11-05", "2024-01-31"
NOW = "TIMESTAMP '2024-01-31 00:00:00'"


@query("universe_dedup", with_roles(
    f"""SELECT cik, ticker, title FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY pos) AS k FROM fx_universe
    WHERE regexp_matches(ticker, '{P.TICKER_PATTERN}')) WHERE k = 1""", "fx_universe"))
def _(t):
    return O.universe_dedup(t("fx_universe"))


_num = lambda c: f"CASE WHEN {c} IS NULL OR isnan({c}) OR isinf({c}) THEN 0 ELSE {c} END"


@query("quote_normalize", with_roles(
    f"""SELECT symbol, {_num('price')} AS price, {_num('change_pct')} / 100 AS day_change, {_num('market_cap')} AS market_cap,
    {_num('avg_volume')} AS avg_volume, {_num('high52')} AS high52, avg50, target, coalesce(quote_type, '') AS quote_type,
    coalesce(market, '') AS market, coalesce(currency, '') AS currency FROM fx_raw_quotes WHERE symbol IS NOT NULL""", "fx_raw_quotes"))
def _(t):
    return Q.quote_normalize(t("fx_raw_quotes"))


@query("bars_clean", with_roles(
    """SELECT 'daily' AS kind, symbol, cast(ts as date) AS bar_date, close FROM fx_bars_raw WHERE close IS NOT NULL AND ts IS NOT NULL
    UNION ALL SELECT 'monthly', symbol, cast(ts as date), close FROM fx_bars_m_raw WHERE close IS NOT NULL AND cast(ts as date) >= DATE '2001-11-05' - 1825""",
    "fx_bars_raw", "fx_bars_m_raw"))
def _(t):
    daily = Q.bars_clean(t("fx_bars_raw")).withColumn("kind", F.lit("daily"))
    monthly = Q.bars_clean(t("fx_bars_m_raw"), AS_OF_LINES).withColumn("kind", F.lit("monthly"))
    return daily.unionByName(monthly)


@query("positive_lookup", with_roles(
    """SELECT q.symbol, CASE WHEN s.target > 0 THEN s.target END AS target, s.sector FROM fx_quotes q LEFT JOIN fx_sectors s USING (symbol)
    WHERE q.day_change <= -0.2""", "fx_sectors"))
def _(t):
    return Q.positive_lookup(t("fx_quotes").filter("day_change <= -0.2").select("symbol"), t("fx_sectors"))


@query("filings_explode", with_roles(
    """SELECT entity_id, accession_number[i] AS accession, form[i] AS form, cast(filing_date[i] as date) AS filed_at,
    primary_document[i] AS primary_document, array_to_string(list_filter(string_split(items[i], ','), lambda x: x <> ''), ';') AS items,
    cast(i - 1 as integer) AS pos FROM fx_filing_arrays, range(1, 4) r(i)""", "fx_filing_arrays"))
def _(t):
    return O.filings_explode(t("fx_filing_arrays")).withColumn("items", F.array_join("items", ";"))


@query("domestic_filer", with_roles(
    """SELECT entity_id, count(*) FILTER (WHERE form IN ('10-K', '10-Q')) > 0 AND count(*) FILTER (WHERE form IN ('20-F', '6-K')) = 0 AS is_domestic
    FROM fx_filings GROUP BY entity_id""", "fx_filings"))
def _(t):
    return O.domestic_filer(t("fx_filings"))


_F = "entity_id, accession, form, filed_at, primary_document, items"
_newest = lambda cond: f"(SELECT {_F} FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY pos) AS k FROM fx_filings WHERE {cond}) WHERE k = 1)"


@query("latest_filing", with_roles(
    f"SELECT 'any' AS which, * FROM {_newest(chr(102) + 'orm = ' + chr(39) + '8-K' + chr(39))} UNION ALL "
    f"SELECT 'since', * FROM {_newest(chr(102) + 'orm = ' + chr(39) + '10-Q' + chr(39) + ' AND filed_at >= DATE ' + chr(39) + '2023-11-01' + chr(39))}",
    "fx_filings"))
def _(t):
    f = t("fx_filings")
    a = O.latest_filing(f, "8-K").withColumn("which", F.lit("any"))
    return a.unionByName(O.latest_filing(f, "10-Q", F.lit("2023-11-01").cast("date")).withColumn("which", F.lit("since")))


@query("filings_since", with_roles(f"SELECT {_F}, pos FROM fx_filings WHERE form = '8-K' AND filed_at >= DATE '2023-12-01' ORDER BY filed_at DESC", "fx_filings"))
def _(t):
    return O.filings_since(t("fx_filings"), "8-K", F.lit("2023-12-01").cast("date")).orderBy(F.col("filed_at").desc())


@query("recent_8k_topn", with_roles(
    f"""SELECT {_F}, cast(rn as integer) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY pos) AS rn FROM fx_filings
    WHERE form = '8-K' AND filed_at >= DATE '2024-01-31' - 45) WHERE rn <= 2""", "fx_filings"))
def _(t):
    return O.recent_8k_topn(t("fx_filings"), AS_OF_FILINGS).drop("pos")


@query("periodic_report_pick", with_roles(
    f"""SELECT coalesce(k.entity_id, q.entity_id) AS entity_id, CASE WHEN k.entity_id IS NULL OR q.filed_at > k.filed_at THEN q.accession ELSE k.accession END AS accession,
    CASE WHEN k.entity_id IS NULL OR q.filed_at > k.filed_at THEN q.form ELSE k.form END AS form
    FROM {_newest(chr(102) + "orm = '10-K'")} k FULL JOIN {_newest(chr(102) + "orm = '10-Q'")} q ON k.entity_id = q.entity_id""", "fx_filings"))
def _(t):
    return O.periodic_report_pick(t("fx_filings")).select("entity_id", "accession", "form")


@query("corporate_action_scan", with_roles(
    """SELECT c.c_custkey AS ask_id, c.entity_id, c.since, CASE
      WHEN EXISTS (SELECT 1 FROM fx_filings f WHERE f.entity_id = c.entity_id AND f.filed_at >= c.since AND f.form = '8-K' AND list_contains(string_split(f.items, ','), '1.03')) THEN 'bankruptcy'
      WHEN EXISTS (SELECT 1 FROM fx_filings f WHERE f.entity_id = c.entity_id AND f.filed_at >= c.since AND f.form IN ('25', '25-NSE')) THEN 'delisted' END AS action
    FROM (SELECT c_custkey, c_custkey % 150 AS entity_id, DATE '2023-06-01' + cast(c_custkey % 240 as integer) AS since FROM customer) c""", "fx_filings"))
def _(t):
    asks = t("customer").selectExpr("c_custkey AS ask_id", "c_custkey % 150 AS entity_id", "date_add(DATE '2023-06-01', cast(c_custkey % 240 as int)) AS since")
    return O.corporate_action_scan(asks, t("fx_filings"))


_EX = P.EXHIBIT_PATTERN


@query("exhibit_pick", with_roles(
    f"""SELECT d.doc_id, coalesce(e.name, nullif(d.primary_document, '')) AS file, CASE WHEN e.name IS NOT NULL THEN 'press-release' ELSE 'primary' END AS kind
    FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 4 THEN '' ELSE concat('form', doc_id, '.htm') END AS primary_document FROM documents) d LEFT JOIN (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM fx_files WHERE regexp_matches(name, '(?i){_EX}')
        AND regexp_matches(name, '(?i)\\.html?$') AND NOT regexp_matches(name, '(?i)index')) WHERE k = 1) e USING (doc_id)""", "fx_files"))
def _(t):
    docs = t("documents").selectExpr("doc_id", "CASE WHEN doc_id % 9 = 4 THEN '' ELSE concat('form', doc_id, '.htm') END AS primary_document")
    return O.exhibit_pick(t("fx_files"), docs)


def _rr(x: str, *pairs: tuple[str, str]) -> str:
    for pat, to in pairs:
        x = f"regexp_replace({x}, '{pat}', '{to}', 'g')"
    return x


_TXT = _rr(
    "html", (r"(?i)<script[\s\S]*?</script>|<style[\s\S]*?</style>", " "), (r"(?i)<(?:br|/p|/div|/tr|/h[1-6]|/li)[^>]*>", "' || chr(10) || '"),
    (r"<[^>]+>", " "), ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), (r"[ \t]+", " "),
    (rf"{T.WS}*\n{T.WS}*", "' || chr(10) || '"), (r"\n{3,}", "' || chr(10) || chr(10) || '"), (rf"^{T.WS}+|{T.WS}+$", ""),
)


@query("html_to_text", f"SELECT page_id, {_TXT} AS text FROM pages")
def _(t):
    return spread(t("pages")).select("page_id", T.html_to_text("html").alias("text"))


_S, _E = r"the\s+of\s|\sde\s+la\s|\sder\s+die\s", r"\sand\s+in\s|\squi\s|\sund\s"
_OPT = dict(start_pattern=_S, end_pattern=_E, min_tail=500, min_body=100, fallback_chars=600)


@query("section_extract", f"""WITH a AS (SELECT doc_id, text, regexp_extract_all(text, '(?i){_S}') AS heads, regexp_split_to_array(text, '(?i){_S}') AS pieces FROM documents),
  b AS (SELECT *, list_transform(range(1, len(heads) + 1), lambda i: cast(list_sum(list_transform(pieces[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(heads[1:i - 1], lambda h: length(h))), 0) as bigint)) AS starts FROM a),
  c AS (SELECT *, coalesce(list_max(list_filter(starts, lambda s: length(text) - s > 500)), -1) AS start FROM b),
  d AS (SELECT *, substring(text, start + 41) AS rest FROM c),
  e AS (SELECT *, length(regexp_split_to_array(rest, '(?i){_E}')[1]) AS cut, regexp_matches(rest, '(?i){_E}') AS has_end FROM d)
  SELECT doc_id, cast(start as integer) AS start, start >= 0 AS found, CASE WHEN start >= 0 THEN substring(text, start + 1, 40) || CASE WHEN has_end AND cut > 100 THEN substring(rest, 1, cut) ELSE rest END
    ELSE substring(text, 1, 600) END AS section FROM e""")
def _(t):
    s = spread(t("documents")).select("doc_id", T.section_extract("text", **_OPT).alias("s"))
    return s.select("doc_id", "s.start", "s.found", F.col("s.text").alias("section"))


@query("text_cap", "SELECT doc_id, substring(text, 1, 3000) AS text, length(text) > 3000 AS truncated FROM documents")
def _(t):
    return t("documents").select("doc_id", T.text_cap("text", 3000).alias("c")).select("doc_id", "c.text", "c.truncated")


def _dpick(tag: str) -> str:
    ws = T.WS
    return f"regexp_replace(regexp_extract(block, '<{tag}[^>]*>(?:<!\\[CDATA\\[)?([\\s\\S]*?)(?:\\]\\]>)?</{tag}>', 1), '^{ws}+|{ws}+$', '', 'g')"


def _ddec(x: str) -> str:
    for a, c in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#8212;", "—"), ("&quot;", '"'), ("&apos;", "''")):
        x = f"replace({x}, '{a}', '{c}')"
    return x


NEWS = f"""SELECT entity_id, feed_id, cast(pos as integer) AS pos, title, link, source, pub_date, pub_ts,
    substring(regexp_replace(regexp_replace(regexp_replace(descr, '<[^>]+>', ' ', 'g'), '[\\s\\x{{a0}}]+', ' ', 'g'), '^{T.WS}+|{T.WS}+$', '', 'g'), 1, 300) AS snippet FROM (
    SELECT entity_id, feed_id, pos - 1 AS pos, {_ddec(_dpick('title'))} AS title, {_dpick('link')} AS link, {_ddec(_dpick('source'))} AS source,
      {_dpick('pubDate')} AS pub_date, try_strptime({_dpick('pubDate')}, '%a, %d %b %Y %H:%M:%S GMT') AS pub_ts, {_ddec(_dpick('description'))} AS descr
    FROM (SELECT entity_id, feed_id, unnest(bs) AS block, unnest(range(1, len(bs) + 1)) AS pos FROM (
      SELECT entity_id, feed_id, regexp_extract_all(xml, '<item>([\\s\\S]*?)</item>', 1) AS bs FROM fx_feeds)))"""
_BANNED = " AND ".join(f"NOT contains(lower(source), '{s.lower()}')" for s in P.BANNED_SOURCES)
FRESH = f"""SELECT * REPLACE (CASE WHEN source = '' THEN 'unknown' ELSE source END AS source) FROM ({NEWS}) WHERE title <> '' AND link <> ''
    AND (pub_ts IS NULL OR pub_ts >= {NOW} - INTERVAL 48 HOUR) AND {_BANNED} AND NOT regexp_matches(title, '(?i){P.LAW_FIRM_PATTERN}')"""


@query("news_parse", with_roles(NEWS, "fx_feeds"))
def _(t):
    return N.news_parse(spread(t("fx_feeds")))


def fresh_news(t):
    return N.news_filter(N.news_parse(spread(t("fx_feeds"))), F.expr(NOW))


@query("news_filter", with_roles(FRESH, "fx_feeds"))
def _(t):
    return fresh_news(t)


@query("news_topn", with_roles(
    f"SELECT entity_id, feed_id, pos, title, cast(rn as integer) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY feed_id, pos) AS rn FROM ({FRESH})) WHERE rn <= 4",
    "fx_feeds"))
def _(t):
    return N.news_topn(fresh_news(t)).select("entity_id", "feed_id", "pos", "title", "rn")


@query("short_name", with_roles(
    f"""SELECT id, regexp_replace(regexp_replace(regexp_replace(name, '(?i),?{T.WS}*(inc|corp|corporation|ltd|plc|co|llc)\\.?$', ''), '[,.]', '', 'g'), '^{T.WS}+|{T.WS}+$', '', 'g') AS short
    FROM fx_names""", "fx_names"))
def _(t):
    return t("fx_names").select("id", T.short_name("name").alias("short"))
