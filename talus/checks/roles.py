"""Role tables: how the driver's tables stand in for filings, prices, votes and the rest.

Each role is one SELECT over driver tables and other roles, valid in both engines. Every role
reads its whole table. What a role lacks (a concept, a quarter, a cell) is expressed by naming
it differently, never by dropping rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talus.checks.dialect import DUCK, SPARK, Dialect

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

AS_OF = "DATE '2001-11-05'"
AS_OF_EVENTS = "DATE '2024-01-31'"

ROLES: dict[str, tuple[list[str], Callable[[Dialect], str]]] = {}


def role(name: str, *deps: str):
    def put(fn: Callable[[Dialect], str]):
        ROLES[name] = (list(deps), fn)
        return fn

    return put


@role("li_q", "lineitem")
def li_q(d):
    return f"""
SELECT entity_id, y, q, count(*) AS n,
  cast(sum({d.cents('l_extendedprice')}) as bigint) AS price_c,
  cast(sum({d.cents('l_extendedprice * (1 - l_discount)')}) as bigint) AS net_c,
  cast(sum({d.cents('l_extendedprice * l_tax')}) as bigint) AS tax_c,
  cast(sum({d.cents('l_extendedprice * l_discount')}) as bigint) AS disc_c,
  cast(sum({d.cents('l_quantity')}) as bigint) AS qty_c
FROM (SELECT l_suppkey AS entity_id, cast(year(l_shipdate) as bigint) AS y,
        cast(quarter(l_shipdate) as bigint) AS q, l_extendedprice, l_discount, l_tax, l_quantity FROM lineitem) t
GROUP BY entity_id, y, q"""


@role("cells", "li_q")
def cells(d):
    return """
SELECT entity_id, y, q, n, y * 4 + q AS qn, y * 4 + q - 7981 AS qi,
  last_day(make_date(cast(y as int), cast(q * 3 as int), 1)) AS qend,
  make_date(cast(y as int), cast(q * 3 - 2 as int), 1) AS qstart,
  make_date(cast(y as int), 1, 1) AS ystart,
  price_c, tax_c, disc_c, qty_c,
  price_c AS rev, net_c - 8 * tax_c AS cost, price_c - net_c + 8 * tax_c AS gp,
  (entity_id % 7) * tax_c + disc_c - cast(floor(price_c / 6) as bigint) AS oi,
  cast(floor(((entity_id % 7) * tax_c + disc_c - cast(floor(price_c / 6) as bigint)) * 79 / 100) as bigint)
    - cast(floor(tax_c / 4) as bigint) AS ni,
  cast(floor(disc_c / 2) as bigint) AS da,
  (entity_id % 7) * tax_c + disc_c - cast(floor(price_c / 6) as bigint)
    + cast(floor(disc_c / 2) as bigint) + tax_c AS cfo,
  cast(floor(disc_c / 3) as bigint) AS capex, cast(floor(tax_c / 4) as bigint) AS sbc,
  cast(floor(tax_c / 20) as bigint) AS intr,
  100 * (100 + (y * 4 + q - 7981) * (CASE WHEN entity_id % 11 = 7 THEN 4 ELSE 1 END)) AS ws,
  (entity_id + y * 4 + q) % 7 = 0 AS restated
FROM li_q"""


@role("cells_y", "cells")
def cells_y(d):
    cum = ", ".join(
        f"cast(sum({c}) OVER (PARTITION BY entity_id, y ORDER BY q ROWS UNBOUNDED PRECEDING) as bigint) AS {c}_ytd"
        for c in ("rev", "cost", "oi", "da", "cfo", "capex", "sbc")
    )
    return f"SELECT *, {cum} FROM cells"


@role("cells_t", "cells_y")
def cells_t(d):
    """Which tag each supplier reports under, and the periods its facts cover."""
    return f"""SELECT *,
  CASE entity_id % 4 WHEN 0 THEN 'RevenueFromContractWithCustomerExcludingAssessedTax' WHEN 1 THEN 'Revenues'
    WHEN 2 THEN 'SalesRevenueNet' ELSE 'RevenueFromContractWithCustomerIncludingAssessedTax' END AS rev_tag,
  CASE WHEN entity_id % 8 = 1 AND y <= 1998 THEN 'RevenueFromContractWithCustomerExcludingAssessedTax'
    WHEN entity_id % 8 = 2 THEN 'Revenues' ELSE 'LegacyRevenue' END AS older_tag,
  CASE WHEN entity_id % 13 = 4 THEN 'CAD' ELSE 'USD' END AS rev_unit,
  CASE WHEN entity_id % 3 = 0 THEN 'CostOfRevenue' ELSE 'CostOfGoodsSold' END AS cost_tag,
  CASE WHEN entity_id % 2 = 0 THEN 'GrossProfit' ELSE 'OtherGross' END AS gp_tag,
  CASE WHEN entity_id % 17 = 9 THEN 'OtherCash' ELSE 'NetCashProvidedByUsedInOperatingActivities' END AS cfo_tag,
  CASE WHEN entity_id % 3 = 0 THEN 'OtherNoncash' ELSE 'ShareBasedCompensation' END AS sbc_tag,
  CASE WHEN entity_id % 6 = 0 THEN 'OtherShortTerm' ELSE 'ShortTermInvestments' END AS sti_tag,
  CASE WHEN entity_id % 19 = 11 THEN 'OtherAssets' ELSE 'Assets' END AS assets_tag,
  CASE WHEN entity_id % 9 = 4 THEN 'OtherShares' ELSE 'EntityCommonStockSharesOutstanding' END AS shares_tag,
  CASE WHEN n < 8 THEN {d.add('qend', '-60')} ELSE qstart END AS thin_start,
  CASE WHEN q = 4 THEN ystart ELSE qstart END AS step_start,
  CASE WHEN q = 4 THEN cost_ytd ELSE cost END AS cost_step,
  CASE WHEN q = 4 THEN oi_ytd ELSE oi END AS oi_step,
  CASE WHEN q = 4 THEN da_ytd ELSE da END AS da_step,
  CASE WHEN restated THEN cast(floor(rev * 95 / 100) as bigint) ELSE rev END AS rev_again,
  CASE WHEN restated THEN cast(floor(cfo_ytd * 95 / 100) as bigint) ELSE cfo_ytd END AS cfo_again,
  cast(floor(price_c / 2) as bigint) AS cash,
  CASE WHEN restated THEN cast(floor(price_c * 95 / 200) as bigint) ELSE cast(floor(price_c / 2) as bigint) END AS cash_again,
  CASE WHEN entity_id % 10 = 3 THEN cast(floor(price_c * 27 / 10) as bigint) ELSE price_c * 3 END AS equity,
  price_c * (entity_id % 5) AS ltd, tax_c * 2 AS cd, qty_c * 50 AS inv, price_c * 2 AS ppe, price_c * 6 AS assets,
  price_c * 3 AS liabilities, cast(floor(ni * 9 / 10) as bigint) AS ni_eur, cast(floor(rev / 2) as bigint) AS rev_half,
  cast(null as date) AS no_start
FROM cells_y"""


# (tag, unit, start, value, filed again later?) of the facts one supplier-quarter reports. The
# last quarter of a stepped concept is visible only in the full year. A thin quarter covers 60
# days, which is neither quarter nor year. What a second filing repeats, it may restate.
FACT_ROWS = [
    ("'NetIncomeLoss'", "'EUR'", "qstart", "ni_eur", 0),
    ("rev_tag", "rev_unit", "thin_start", "rev", 0),
    ("rev_tag", "rev_unit", "thin_start", "rev_again", 1),
    ("rev_tag", "rev_unit", "ystart", "rev_ytd", 0),
    ("older_tag", "'USD'", "qstart", "rev_half", 0),
    ("cost_tag", "'USD'", "step_start", "cost_step", 0),
    ("cost_tag", "'USD'", "ystart", "cost_ytd", 0),
    ("gp_tag", "'USD'", "qstart", "gp", 0),
    ("'OperatingIncomeLoss'", "'USD'", "step_start", "oi_step", 0),
    ("'OperatingIncomeLoss'", "'USD'", "ystart", "oi_ytd", 0),
    ("'NetIncomeLoss'", "'USD'", "qstart", "ni", 0),
    ("'DepreciationDepletionAndAmortization'", "'USD'", "step_start", "da_step", 0),
    ("'DepreciationDepletionAndAmortization'", "'USD'", "ystart", "da_ytd", 0),
    ("cfo_tag", "'USD'", "ystart", "cfo_ytd", 0),
    ("cfo_tag", "'USD'", "ystart", "cfo_again", 1),
    ("'PaymentsToAcquirePropertyPlantAndEquipment'", "'USD'", "ystart", "capex_ytd", 0),
    ("sbc_tag", "'USD'", "ystart", "sbc_ytd", 0),
    ("'InterestExpense'", "'USD'", "qstart", "intr", 0),
    ("'WeightedAverageNumberOfDilutedSharesOutstanding'", "'shares'", "qstart", "ws", 0),
    ("'CashAndCashEquivalentsAtCarryingValue'", "'USD'", "no_start", "cash", 0),
    ("'CashAndCashEquivalentsAtCarryingValue'", "'USD'", "no_start", "cash_again", 1),
    ("sti_tag", "'USD'", "no_start", "disc_c", 0),
    ("'LongTermDebtNoncurrent'", "'USD'", "no_start", "ltd", 0),
    ("'LongTermDebtCurrent'", "'USD'", "no_start", "cd", 0),
    ("'InventoryNet'", "'USD'", "no_start", "inv", 0),
    ("'PropertyPlantAndEquipmentNet'", "'USD'", "no_start", "ppe", 0),
    ("assets_tag", "'USD'", "no_start", "assets", 0),
    ("'Liabilities'", "'USD'", "no_start", "liabilities", 0),
    ("'StockholdersEquity'", "'USD'", "no_start", "equity", 0),
    ("shares_tag", "'shares'", "no_start", "ws", 0),
]


@role("fx_facts_raw", "cells_t")
def fx_facts_raw(d):
    rows = [(t, u, s, v, str(slot), str(again)) for slot, (t, u, s, v, again) in enumerate(FACT_ROWS)]
    return d.rows("cells_t", ["entity_id", "qend", "q", "qn", "restated"],
                  ["tag", "unit", "p_start", "v", "slot", "again"], rows)


@role("fx_facts", "fx_facts_raw")
def fx_facts(d):
    lag = "CASE WHEN again = 1 AND restated THEN 100 ELSE 40 END"
    return f"""SELECT entity_id, CASE WHEN tag = 'EntityCommonStockSharesOutstanding' THEN 'dei' ELSE 'us-gaap' END AS taxonomy,
  tag, unit, p_start, qend AS p_end, cast(v as double) AS val,
  concat(cast(entity_id as string), '-', cast(qend as string), CASE WHEN again = 1 THEN '-b' ELSE '-a' END) AS accn,
  CASE WHEN q = 4 THEN '10-K' ELSE '10-Q' END AS form, {d.add('qend', lag)} AS filed, qn * 100 + slot AS pos
FROM fx_facts_raw"""


@role("fx_payloads", "cells_y")
def fx_payloads(d):
    """One nested filing document per supplier and quarter."""

    def fact(start, val, form):
        s = f"'\"start\":\"', cast({start} as string), '\",', " if start else ""
        return (
            f"'{{', {s}'\"end\":\"', cast(qend as string), '\",\"val\":', cast({val} as string), "
            f"',\"accn\":\"', cast(entity_id as string), '-', cast(qn as string), '\",\"form\":\"{form}\",\"filed\":\"', "
            f"cast({d.add('qend', '40')} as string), '\"}}'"
        )

    return f"""SELECT entity_id, concat('{{"us-gaap":{{"Revenues":{{"units":{{"USD":[', {fact('qstart', 'rev', '10-Q')}, ',',
      {fact('ystart', 'rev_ytd', '10-Q')}, ']}}}},"Assets":{{"units":{{"USD":[', {fact(None, 'price_c', '10-Q')}, '],"EUR":[',
      {fact(None, 'tax_c', '10-Q')}, ']}}}}}},"dei":{{"EntityCommonStockSharesOutstanding":{{"units":{{"shares":[',
      {fact(None, 'ws', '10-Q')}, ']}}}}}}}}') AS payload FROM cells_y"""


def _order(name: str, seen: list[str]) -> list[str]:
    if name in ROLES and name not in seen:
        for dep in ROLES[name][0]:
            _order(dep, seen)
        seen.append(name)
    return seen


_cache: dict[tuple[str, str], dict[str, DataFrame]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Driver table or role as a DataFrame."""
    frames = _cache.setdefault((spark.sparkContext.applicationId, sf_dir), {})
    if name in frames:
        return frames[name]
    if name not in ROLES:
        frames[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    else:
        deps, fn = ROLES[name]
        parents = {dep: table(spark, sf_dir, dep) for dep in deps}
        for dep, df in parents.items():
            df.createOrReplaceTempView(dep)
        frames[name] = spark.sql(fn(SPARK))
    return frames[name]


def with_roles(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """DuckDB text: the roles as CTEs, then more CTEs, then ``body``."""
    order: list[str] = []
    for n in names:
        _order(n, order)
    ctes = [f"{n} AS ({ROLES[n][1](DUCK)})" for n in order]
    ctes += [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    return (f"WITH {', '.join(ctes)} " if ctes else "") + body


def spell(k: str) -> str:
    """A ticker of four letters spelled from a number, five from 26^4 on: distinct up to 26^5."""
    letter = lambda i: f"chr(cast(65 + cast(floor({k} / {26**i}) as bigint) % 26 as int))"
    return "concat(" + ", ".join(map(letter, range(4))) + f", CASE WHEN {k} >= {26**4} THEN {letter(4)} ELSE '' END)"


@role("fx_universe", "customer")
def fx_universe(d):
    return f"""SELECT cast(floor(c_custkey / 2) as bigint) AS cik,
  CASE WHEN c_custkey % 11 = 5 THEN concat({spell('c_custkey')}, '.1') WHEN c_custkey % 7 = 3 THEN concat({spell('c_custkey')}, '-A')
    ELSE {spell('c_custkey')} END AS ticker, c_name AS title, c_custkey AS pos FROM customer"""


@role("fx_names", "customer")
def fx_names(d):
    return """SELECT c_custkey AS id, concat(c_name, CASE c_custkey % 9 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' CORP' WHEN 2 THEN ' Co., Ltd.'
  WHEN 3 THEN ' plc' WHEN 4 THEN ', LLC' WHEN 5 THEN ' Holdings Corporation' WHEN 6 THEN ' & Co.' ELSE '' END) AS name FROM customer"""


@role("fx_raw_quotes", "orders")
def fx_raw_quotes(d):
    nan = "cast('NaN' as double)"
    return f"""SELECT CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'P' THEN NULL ELSE concat('Q', cast(o_orderkey as string)) END AS symbol,
  CASE WHEN o_orderpriority = '5-LOW' THEN {nan} ELSE o_totalprice END AS price,
  cast(o_orderkey % 61 - 40 as double) AS change_pct,
  CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN cast('Infinity' as double) ELSE o_totalprice * 1000 END AS market_cap,
  CASE WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE cast(o_custkey as double) END AS avg_volume,
  o_totalprice * 1.25 AS high52, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_totalprice END AS avg50,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice / 2 END AS target,
  CASE WHEN o_custkey % 10 = 9 THEN NULL ELSE 'EQUITY' END AS quote_type, 'us_market' AS market,
  CASE WHEN o_custkey % 12 = 11 THEN NULL ELSE 'USD' END AS currency FROM orders"""


@role("fx_bars_raw", "events")
def fx_bars_raw(d):
    return """SELECT user_id AS symbol, CASE WHEN event_type = 'signup' THEN NULL ELSE ts END AS ts,
  CASE WHEN event_type = 'error' THEN NULL ELSE value END AS close FROM events"""


@role("fx_bars_m_raw", "lineitem")
def fx_bars_m_raw(d):
    return """SELECT l_suppkey AS symbol, l_shipdate AS ts, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_extendedprice END AS close FROM lineitem"""


@role("fx_bars_m", "lineitem")
def fx_bars_m(d):
    """Last line price of a supplier's month."""
    return f"""SELECT symbol, max(bar_date) AS bar_date,
  {d.max_by('price', 'bar_date', 'ok', 'ln', 'pk', 'price')} AS close
FROM (SELECT l_suppkey AS symbol, cast(l_shipdate as date) AS bar_date, l_extendedprice AS price, l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk
  FROM lineitem) t GROUP BY symbol, year(bar_date), month(bar_date)"""


@role("fx_bars_d", "events")
def fx_bars_d(d):
    """Last value of a user's day."""
    return f"""SELECT user_id AS uid, {spell('user_id')} AS symbol, cast(ts as date) AS bar_date, {d.max_by('value', 'ts', 'event_id')} AS close,
  count(*) AS n FROM events GROUP BY user_id, cast(ts as date)"""


@role("fx_quotes", "fx_bars_d")
def fx_quotes(d):
    return f"""SELECT symbol, price, {d.ratio('price', 'prev')} - 1 AS day_change, price * n * 1000000 AS market_cap, cast(n * 10000 as double) AS avg_volume,
  high AS high52, cents / days / 100 AS avg50, price * (80 + uid % 60) / 100 AS target,
  CASE WHEN uid % 10 = 9 THEN 'ETF' ELSE 'EQUITY' END AS quote_type, CASE WHEN uid % 15 = 14 THEN 'de_market' ELSE 'us_market' END AS market,
  CASE WHEN uid % 12 = 11 THEN 'CAD' ELSE 'USD' END AS currency, uid AS pos
FROM (SELECT uid, symbol, max(CASE WHEN rn = 1 THEN close END) AS price, max(CASE WHEN rn = 2 THEN close END) AS prev, max(close) AS high,
    cast(sum(n) as bigint) AS n, cast(sum({d.cents('close')}) as double) AS cents, count(*) AS days
  FROM (SELECT uid, symbol, close, n, row_number() OVER (PARTITION BY uid ORDER BY bar_date DESC) AS rn FROM fx_bars_d) r GROUP BY uid, symbol) g"""


@role("fx_sectors", "fx_quotes")
def fx_sectors(d):
    return """SELECT symbol, CASE pos % 6 WHEN 0 THEN 'Technology' WHEN 1 THEN 'Financial Services' WHEN 3 THEN 'Real Estate' WHEN 4 THEN 'Healthcare'
  WHEN 5 THEN 'Energy' END AS sector, CASE WHEN pos % 4 = 1 THEN -target ELSE target END AS target FROM fx_quotes"""


@role("fx_filings", "documents")
def fx_filings(d):
    """One filing per document; ``pos`` counts newest first within a company."""
    return f"""SELECT entity_id, concat(lpad(cast(entity_id as string), 10, '0'), '-', lpad(cast(doc_id as string), 6, '0')) AS accession,
  CASE WHEN entity_id % 4 = 3 THEN CASE WHEN k % 2 = 0 THEN '20-F' ELSE '6-K' END WHEN k % 16 = 15 THEN '6-K' ELSE
    CASE k % 8 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' WHEN 2 THEN '8-K' WHEN 3 THEN '8-K' WHEN 4 THEN '10-Q' WHEN 5 THEN '25' WHEN 6 THEN '8-K' ELSE '25-NSE' END END AS form,
  {d.add("DATE '2023-06-01'", 'doc_id * 37 % 240')} AS filed_at,
  CASE doc_id % 5 WHEN 0 THEN '2.02,9.01' WHEN 1 THEN '1.03' WHEN 2 THEN '' WHEN 3 THEN '5.02,,8.01' ELSE '9.01' END AS items,
  CASE WHEN doc_id % 9 = 4 THEN '' ELSE concat('form', cast(doc_id as string), '.htm') END AS primary_document,
  (240 - doc_id * 37 % 240) * 1000000000 + doc_id AS pos
FROM (SELECT doc_id, doc_id % 120 AS entity_id, cast(floor(doc_id / 120) as bigint) AS k FROM documents) t"""


@role("fx_filing_arrays", "documents")
def fx_filing_arrays(d):
    """Submissions as the source delivers them: parallel arrays, here three filings a row."""
    ids = [f"concat('a', cast(doc_id * 3 + {i} as string))" for i in range(3)]
    forms = ["'8-K'", "CASE WHEN lang = 'en' THEN '10-Q' ELSE '6-K' END", "source"]
    dates = [f"cast({d.add(chr(68) + 'ATE ' + chr(39) + '2023-06-01' + chr(39), f'(doc_id + {i}) % 200')} as string)" for i in range(3)]
    docs = ["'a.htm'", "''", "concat(lang, '.htm')"]
    items = ["'2.02,9.01'", "''", "'5.02,,8.01'"]
    return f"""SELECT doc_id AS entity_id, {d.arr(*ids)} AS accession_number, {d.arr(*forms)} AS form, {d.arr(*dates)} AS filing_date,
  {d.arr(*docs)} AS primary_document, {d.arr(*items)} AS items FROM documents"""


@role("fx_files", "documents")
def fx_files(d):
    """File listing of each filing: 8-K body, perhaps an exhibit under one of several namings."""
    rows = [
        ("0", "concat(cast(doc_id as string), '-index.htm')"),
        ("1", "concat('form8k_', cast(doc_id as string), '.htm')"),
        ("2", "CASE doc_id % 6 WHEN 0 THEN 'a8-kex991_q4.htm' WHEN 1 THEN 'exhibit_99-1.HTML' WHEN 2 THEN 'ex99.pdf' WHEN 3 THEN 'earningsrelease.htm' "
              "WHEN 4 THEN 'd1991x.htm' ELSE 'q3-991-results.htm' END"),
        ("3", "CASE WHEN doc_id % 4 = 0 THEN 'pressroom.htm' ELSE 'logo.jpg' END"),
    ]
    return d.rows("documents", ["doc_id"], ["pos", "name"], rows)


@role("fx_feeds", "pages")
def fx_feeds(d):
    """One news feed per page: two items, plain and CDATA."""
    title = "regexp_extract(html, '<title>(.*?)</title>', 1)"
    when = """CASE page_id % 6 WHEN 0 THEN 'Tue, 30 Jan 2024 10:00:00 GMT' WHEN 1 THEN 'Mon, 29 Jan 2024 08:30:00 GMT' WHEN 2 THEN 'Sat, 27 Jan 2024 23:59:59 GMT'
      WHEN 3 THEN 'yesterday' WHEN 4 THEN 'Tue, 30 Jan 2024 23:15:00 GMT' ELSE 'Sun, 28 Jan 2024 23:59:59 GMT' END"""
    source = """CASE page_id % 7 WHEN 0 THEN 'The Motley Fool' WHEN 1 THEN 'Reuters' WHEN 2 THEN 'zacks.com' WHEN 3 THEN '' WHEN 4 THEN 'AT&amp;T News' WHEN 5 THEN 'MARKETBEAT' ELSE 'Wire &#8212; One' END"""
    extra = """CASE page_id % 9 WHEN 0 THEN 'Class Action notice' WHEN 4 THEN 'Investor Rights alert' ELSE '' END"""
    return f"""SELECT page_id % 60 AS entity_id, page_id AS feed_id,
  concat('<rss><channel><item><title>', {title}, '</title><link>', url, '</link><pubDate>', {when}, '</pubDate><source url="x">', {source},
    '</source><description>&lt;a href="x"&gt;', {title}, '&lt;/a&gt;&amp;nbsp; more ', lang_of, '</description></item><item><title><![CDATA[', {extra}, ' ', {title},
    ']]></title><link>', CASE WHEN page_id % 8 = 7 THEN '' ELSE concat(url, '#2') END, '</link><pubDate>', {when},
    '</pubDate><source>Agency &quot;A&quot;</source><description><![CDATA[<b>', {title}, '</b>  text]]></description></item></channel></rss>') AS xml
FROM (SELECT page_id, url, html, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang_of FROM pages) p"""


@role("fx_estimates", "cells")
def fx_estimates(d):
    """Street estimates: the last full year and a year on; some lack revenue, some EPS."""
    rows = [
        ("'0y'", "cast(rev as double)", "ni / cast(ws as double)"),
        ("'+1y'", "CASE WHEN entity_id % 11 = 4 THEN NULL ELSE cast(rev as double) * (90 + entity_id % 40) / 100 END",
         "CASE WHEN entity_id % 9 = 2 THEN NULL ELSE ni / cast(ws as double) * (95 + entity_id % 30) / 100 END"),
    ]
    src = """(SELECT entity_id, cast(sum(CASE WHEN y = 2000 THEN rev END) as bigint) AS rev, cast(sum(CASE WHEN y = 2000 THEN ni END) as bigint) AS ni,
      max(ws) AS ws FROM cells GROUP BY entity_id) c"""
    return d.rows(src, ["entity_id"], ["period", "revenue", "eps"], rows)


@role("scen_cells", "lineitem")
def scen_cells(d):
    """Lines folded into scenario cells: supplier, sample by return flag, cell by line number."""
    return f"""SELECT entity_id, sample, cell, count(*) AS n, cast(sum({d.cents('price')}) as bigint) AS price_c, cast(sum({d.cents('qty')}) as bigint) AS qty_c
FROM (SELECT l_suppkey AS entity_id, CASE l_returnflag WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS sample, (l_linenumber - 1) % 6 AS cell,
  l_extendedprice AS price, l_quantity AS qty FROM lineitem) t GROUP BY entity_id, sample, cell"""


@role("fx_scenarios", "scen_cells")
def fx_scenarios(d):
    return """SELECT entity_id, sample, CASE WHEN cell = 5 AND entity_id % 12 = 5 THEN '5' WHEN cell < 3 THEN '1' ELSE '3' END AS horizon,
  CASE cell % 3 WHEN 0 THEN 'bear' WHEN 1 THEN 'base' ELSE 'bull' END AS scenario_case,
  cast(CASE WHEN cell % 3 = 1 THEN 50 ELSE 25 END + n % 5 - 2 as double) * CASE WHEN entity_id % 9 = 4 THEN 2 ELSE 1 END / 100 AS weight,
  CASE kind WHEN 0 THEN 'EV/EBITDA' WHEN 1 THEN 'EV/Sales' WHEN 2 THEN 'P/E' WHEN 3 THEN 'P/S' WHEN 4 THEN 'P/FCF' WHEN 5 THEN 'P/B' ELSE 'none' END AS metric,
  CASE WHEN entity_id % 23 = 7 AND cell = 2 THEN 600.0e0 WHEN entity_id % 29 = 3 AND cell = 4 THEN 0e0
    WHEN entity_id % 4 = 0 THEN cast(1 + cell % 3 as double) / 10 ELSE cast((10 + n % 40) * CASE cell % 3 WHEN 0 THEN 7 WHEN 1 THEN 10 ELSE 14 END as double) / CASE WHEN kind IN (1, 3, 5) THEN 200 ELSE 20 END END AS multiple,
  CASE WHEN entity_id % 4 = 0 THEN floor(price_c * 80 / n) ELSE cast(price_c as double) END * CASE WHEN n % 31 = 0 AND entity_id % 4 <> 0 THEN 1000 ELSE 1 END * CASE WHEN entity_id % 4 = 0 THEN 1 WHEN kind IN (1, 3, 5) THEN 3 ELSE 0.25e0 END AS value,
  CASE CASE WHEN entity_id % 4 = 0 THEN 4 ELSE n % 6 END WHEN 0 THEN 'Investor sentiment improves over the next two quarters' WHEN 1 THEN 'Revenue falls below the prior-year quarter'
    WHEN 2 THEN 'Misses management guidance for the full year' WHEN 3 THEN 'too short' WHEN 4 THEN 'Gross margin drops under 30 percent in Q2'
    ELSE 'Stock price recovers to its prior high in 90 days' END AS falsifier,
  CASE WHEN n % 3 = 0 THEN 'The licensing arm was sold and will not come back to earlier levels' ELSE 'cheaper' END AS justification
FROM (SELECT *, CASE WHEN entity_id % 4 = 0 THEN 3 ELSE (entity_id + cell % 3 + CASE WHEN sample = 3 AND n % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN cell >= 3 AND entity_id % 5 = 2 THEN 1 ELSE 0 END) % 7 END AS kind
  FROM scen_cells) s"""


@role("fx_verdicts", "supplier")
def fx_verdicts(d):
    return f"""SELECT s_suppkey AS entity_id, s_suppkey % 13 = 6 AS insufficient,
  CASE s_suppkey % 5 WHEN 0 THEN 'sentiment' WHEN 1 THEN 'mechanical' WHEN 2 THEN 'thesis_breaking' WHEN 3 THEN 'sentiment' ELSE 'insufficient_evidence' END AS cause,
  CASE WHEN s_suppkey % 3 = 0 THEN 'none' ELSE 'mechanical' END AS cause_secondary, s_suppkey % 6 AS n_cause_sources, s_suppkey % 10 - 9 + 9 * (CASE WHEN s_suppkey % 10 = 9 THEN 0 ELSE 1 END) AS n_key_facts,
  concat('thesis of ', s_name) AS thesis, CASE s_suppkey % 4 WHEN 0 THEN 'wide' WHEN 1 THEN 'narrow' WHEN 2 THEN 'none' ELSE 'wide' END AS moat,
  CASE s_suppkey % 3 WHEN 0 THEN 'raised' WHEN 1 THEN 'none_given' ELSE 'lowered' END AS guidance_change, CASE WHEN s_acctbal > 5000 THEN 'timing' ELSE 'demand' END AS guidance_timing,
  CASE WHEN s_suppkey % 7 = 0 THEN {d.arr("'inventory up'", "'cash down'")} WHEN s_suppkey % 7 = 3 THEN {d.arr("'margin gap'")} ELSE {d.arr("s_name")} END AS anomalies,
  CASE WHEN s_suppkey % 4 = 1 THEN {d.arr("'fact against quote'", "s_name")} ELSE {d.arr("'timing'")} END AS discrepancies,
  CASE WHEN s_suppkey % 8 = 5 THEN 'validation_failed' ELSE 'ok' END AS status, s_suppkey % 3 = 1 AS cache_hit FROM supplier"""


@role("fx_quotes_cited", "documents")
def fx_quotes_cited(d):
    """Reconciliation quotes: the opening words of a document, sometimes only a stub."""
    return """SELECT doc_id % 120 AS entity_id, cast(doc_id as string) AS quote_id, CASE WHEN doc_id % 11 = 2 THEN '   n/a  ' ELSE text END AS quote FROM documents"""


@role("fx_claims", "documents", "fx_verdicts")
def fx_claims(d):
    return """SELECT c.entity_id, c.kind, c.source, coalesce(v.guidance_change, 'none_given') AS guidance_change FROM (
  SELECT doc_id % 120 AS entity_id, CASE doc_id % 6 WHEN 0 THEN 'cause' WHEN 1 THEN 'key_fact' WHEN 2 THEN 'language' WHEN 3 THEN 'recon_fact' WHEN 4 THEN 'recon_quote' ELSE 'guidance' END AS kind,
    CASE WHEN doc_id % 9 = 0 THEN concat('bogus-', cast(doc_id % 40 as string)) WHEN doc_id % 13 = 1 THEN 'revenue' WHEN doc_id % 13 = 2 THEN 'screen' WHEN doc_id % 13 = 3 THEN 'prior:1998-07-01' WHEN doc_id % 13 = 4 THEN ''
      ELSE concat(lpad(cast(doc_id % 120 as string), 10, '0'), '-', lpad(cast(doc_id as string), 6, '0')) END AS source FROM documents) c
LEFT JOIN fx_verdicts v ON v.entity_id = c.entity_id"""


@role("fx_priors", "orders", "supplier")
def fx_priors(d):
    """Earlier predictions: a run every half year for the suppliers an order month names."""
    return """SELECT DISTINCT o_custkey % 120 AS entity_id, make_date(cast(year(o_orderdate) as int), cast(CASE WHEN quarter(o_orderdate) < 3 THEN 1 ELSE 7 END as int), 1) AS run_date
FROM orders"""


@role("fx_votes", "events")
def fx_votes(d):
    """Every event of a user's day is one vote on that day's case."""
    return """SELECT event_id AS vote_id, user_id, cast(ts as date) AS day, event_id AS vote_no,
  CASE event_type WHEN 'view' THEN 'sentiment' WHEN 'click' THEN 'mechanical' WHEN 'error' THEN 'thesis_breaking' WHEN 'signup' THEN 'sentiment' ELSE 'insufficient_evidence' END AS label,
  CASE event_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'mechanical' WHEN 2 THEN 'sentiment' WHEN 3 THEN 'none' ELSE 'thesis_breaking' END AS secondary FROM events"""


@role("fx_entity_votes", "events")
def fx_entity_votes(d):
    return """SELECT event_id AS vote_id, user_id AS entity_id, event_id AS vote_no,
  CASE event_type WHEN 'view' THEN 'sentiment' WHEN 'click' THEN 'mechanical' WHEN 'error' THEN 'thesis_breaking' WHEN 'signup' THEN 'sentiment' ELSE 'insufficient_evidence' END AS label,
  CASE WHEN value < 10 THEN 'mechanical' WHEN value < 50 THEN 'sentiment' ELSE 'thesis_breaking' END AS masked_label FROM events"""


@role("fx_rankings", "supplier")
def fx_rankings(d):
    rows = [
        ("'forward'", "cast(floor(-s_acctbal * 100 + 0.5) as bigint)"),
        ("'reversed'", "cast(floor(-s_acctbal * 100 + 0.5) as bigint) + s_suppkey % 7 * 70000"),
    ]
    src = "(SELECT s_nationkey AS run, CASE WHEN s_suppkey % 8 = 3 THEN s_suppkey + 1000000 ELSE s_suppkey END AS entity_id, s_suppkey, s_acctbal FROM supplier) s"
    return f"SELECT run, entity_id, pass, pos FROM ({d.rows(src, ['run', 'entity_id'], ['pass', 'pos'], rows)}) r"


@role("fx_bars_s", "lineitem")
def fx_bars_s(d):
    """Last line price of a supplier's day; some suppliers trade under a name no ledger knows."""
    return f"""SELECT CASE WHEN sk % 20 = 13 THEN -sk ELSE sk END AS symbol, bar_date, {d.max_by('price', 'ok', 'ln', 'pk', 'price')} AS close
FROM (SELECT l_suppkey AS sk, cast(l_shipdate as date) AS bar_date, l_extendedprice AS price, l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk
  FROM lineitem) t GROUP BY sk, bar_date"""


@role("fx_ledger", "orders")
def fx_ledger(d):
    """One prediction per ticker and day, from the day's last order; fifteen customers share a ticker,
    as there are fifteen to a supplier. Earlier runs have graded part of the rows: a grade that was
    given may be null, and a flag says that it was given."""
    return """SELECT ticker, run_date, ok, CASE st WHEN 'F' THEN 'thesis_breaking' WHEN 'O' THEN 'sentiment' ELSE 'mechanical' END AS classification,
  ref_price, ref_price * (90 + ok % 41) / 100 AS fair, ref_price * (60 + ok % 41) / 100 AS bear, ref_price * (120 + ok % 41) / 100 AS bull,
  concat('h', cast(ok % 5 as string)) AS hash, st = 'F' AS graded, CASE WHEN pri = '5-LOW' AND st = 'P' THEN 'acquired, check manually' END AS note,
  concat('thesis ', cast(ok as string)) AS thesis,
  ok % 3 = 0 AS has_drift30, CASE WHEN ok % 3 = 0 THEN (ok % 201 - 100) / 1000 END AS drift30,
  ok % 9 = 0 AS has_drift90, CASE WHEN ok % 9 = 0 THEN (ok % 301 - 150) / 1000 END AS drift90,
  ok % 5 = 0 AS has_1y, CASE WHEN ok % 5 = 0 AND ok % 2 = 0 THEN (ok % 401 - 200) / 1000 END AS return_1y,
  CASE WHEN ok % 5 = 0 AND ok % 2 = 0 THEN (ok % 101 - 50) / 2 END AS valuation_error_pct, CASE WHEN ok % 10 = 0 THEN 125 / 1000 END AS bench_return_1y,
  ok % 7 = 0 AS has_3y, CASE WHEN ok % 14 = 0 THEN (ok % 901 - 300) / 1000 END AS return_3y
FROM (SELECT cast(floor(o_custkey / 15) as bigint) AS ticker, cast(o_orderdate as date) AS run_date, max(o_orderkey) AS ok, max_by(o_orderstatus, o_orderkey) AS st,
    max_by(o_orderpriority, o_orderkey) AS pri, floor(max_by(o_totalprice, o_orderkey) * 20) / 100 AS ref_price
  FROM orders GROUP BY cast(floor(o_custkey / 15) as bigint), cast(o_orderdate as date)) t"""


LEDGER_CELLS = ["1y bear", "1y base", "1y bull", "3y bear", "3y base", "3y bull"]


@role("fx_grades", "fx_ledger")
def fx_grades(d):
    rows = [
        (f"CASE WHEN (ok + {i}) % 5 = 4 THEN 'other' WHEN ok % 2 = 0 THEN '[{c}]' ELSE '{c}' END",
         f"CASE (ok + {i}) % 4 WHEN 0 THEN 'fired' WHEN 3 THEN 'uncheckable' ELSE 'survived' END", str(i))
        for i, c in enumerate(LEDGER_CELLS)
    ]
    return d.rows("(SELECT * FROM fx_ledger WHERE graded) g", ["ticker", "run_date"], ["scenario", "status", "pos"], rows)


@role("fx_ledger_scen", "fx_ledger")
def fx_ledger_scen(d):
    rows = [(f"'{c}'", f"concat('falsifier ', cast(ok + {i} as string))") for i, c in enumerate(LEDGER_CELLS)]
    return d.rows("(SELECT * FROM fx_ledger WHERE graded) g", ["ticker", "run_date"], ["label", "falsifier"], rows)


@role("fx_overrides", "fx_ledger")
def fx_overrides(d):
    return """SELECT ticker, run_date, floor(ref_price * (ok % 3) * 50) / 100 AS price, CASE WHEN ok % 2 = 0 THEN 'acquired' END AS note
FROM fx_ledger WHERE note IS NOT NULL"""


@role("fx_feedback", "events")
def fx_feedback(d):
    return """SELECT event_id AS update_id, ts, user_id AS ticker, CASE WHEN event_type = 'error' AND value > 150 THEN 'news' ELSE cast(cast(ts as date) as string) END AS run_date,
  event_type IN ('purchase', 'click') AS up FROM events"""


@role("fx_user_preds", "events")
def fx_user_preds(d):
    """One prediction per user and day."""
    return """SELECT user_id AS ticker, cast(ts as date) AS run_date, concat('h', cast(max(event_id) % 3 as string)) AS hash, cast(count(*) as bigint) AS n FROM events
GROUP BY user_id, cast(ts as date)"""


@role("fx_hashes", "fx_quotes")
def fx_hashes(d):
    return "SELECT pos AS ticker, concat('h', cast(pos % 3 as string)) AS hash, price FROM fx_quotes"


@role("fx_cooldown", "events")
def fx_cooldown(d):
    return """SELECT user_id AS ticker, max(cast(ts as date)) AS last_digest_date, concat('h', cast(max(event_id) % 3 as string)) AS hash
FROM events GROUP BY user_id"""


@role("fx_arguments", "conversations")
def fx_arguments(d):
    """Reader turns of a conversation as objections."""
    return """SELECT conv_id * 1000 + turn AS arg_id, cast(floor(conv_id / 2) as bigint) AS ticker, text AS user_text, concat('note ', cast(conv_id as string), '/', cast(turn as string)) AS note,
  concat('reply to ', text) AS ai_reply, conv_id * 1000 + turn AS created_at FROM conversations WHERE role = 'user'"""


@role("fx_kv", "orders")
def fx_kv(d):
    return "SELECT o_custkey AS k, o_orderkey AS version, o_totalprice AS v, o_orderstatus AS s FROM orders"


@role("fx_errors", "orders")
def fx_errors(d):
    """Graded errors by cause label."""
    return """SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'thesis_breaking' WHEN o_orderstatus = 'F' THEN 'sentiment' ELSE 'mechanical' END AS classification,
  cast(o_orderkey % 83 - 55 as double) + cast(o_custkey % 10000 as double) / 10000 AS valuation_error_pct FROM orders"""


@role("fx_mask", "fx_names")
def fx_mask(d):
    return f"""SELECT id, {spell('id')} AS ticker, name, concat('Shares of ', name, ' (', {spell('id')}, ') fell; ', upper(name), ' and Holdings said so. ', lower({spell('id')}), '!') AS text
FROM fx_names"""


def MESSAGE_TEXT(d: Dialect) -> str:
    return f"""CASE event_type WHEN 'purchase' THEN concat('what about $', {spell('user_id')}, ' and ', {spell('(user_id + 1)')}, ' now?')
  WHEN 'click' THEN concat('please revisit ', lower({spell('(user_id * 3)')}), ' margins') WHEN 'view' THEN 'and the corrected estimate?'
  WHEN 'error' THEN '/reset the whole thing' ELSE 'ok thanks' END"""


#: Fifteen users talk in one chat.
CHAT = "cast(floor(user_id / 15) as bigint)"


@role("fx_messages", "events")
def fx_messages(d):
    return f"SELECT {CHAT} AS chat, event_id AS msg_id, ts, {MESSAGE_TEXT(d)} AS text FROM events"


def TAP_DATA() -> str:
    return """CASE WHEN event_type = 'view' THEN concat('zz|', cast(user_id as string)) ELSE concat('fb|', CASE WHEN event_type = 'error' AND value > 150 THEN 'news' ELSE cast(cast(ts as date) as string) END,
  '|', CASE WHEN event_type = 'signup' AND value < 5 THEN '' ELSE cast(user_id as string) END, '|', CASE WHEN event_type IN ('purchase', 'click') THEN '1' ELSE '0' END) END"""


@role("fx_updates", "events")
def fx_updates(d):
    return f"SELECT event_id AS update_id, ts, {TAP_DATA()} AS data FROM events"


@role("fx_sentences", "documents")
def fx_sentences(d):
    return d.parts("documents", ["doc_id"], "coalesce(text, '')", ". ", "sentence", "pos")


@role("fx_risk_parts", "fx_sentences")
def fx_risk_parts(d):
    """Three versions of each document's sentences, as three filings of one company: some sentences are
    missing, reworded or further down in a version, and a line of stars stands in many places."""
    rows = [
        (f"{v + 1}", f"CASE WHEN (doc_id + pos * 7 + {v * 5}) % 11 = 0 THEN '' WHEN (doc_id + pos + {v}) % 9 = 0 THEN concat(sentence, ' (version {v})') ELSE sentence END",
         f"pos * 4 + CASE WHEN (doc_id + pos) % 13 = {v} THEN 22 ELSE 0 END")
        for v in range(3)
    ] + [(f"{v + 1}", f"CASE WHEN (pos + doc_id) % 5 = {v} THEN '* * *' ELSE '' END", "pos * 4 + 1") for v in range(3)]
    return f"""SELECT doc_id AS entity_id, filing_no, place AS pos, paragraph FROM ({d.rows('fx_sentences', ['doc_id'], ['filing_no', 'paragraph', 'place'], rows)}) r
WHERE paragraph <> ''"""


@role("fx_codes", "fx_quotes")
def fx_codes(d):
    """Industry codes over time: one until a day, another from the next one on; some companies have none."""
    rows = [("CASE WHEN pos % 9 = 4 THEN NULL ELSE 1000 + pos * 37 % 8000 END", "DATE '2020-01-01'", d.add("DATE '2023-06-01'", "pos % 365")),
            ("1000 + pos * 53 % 8000", d.add("DATE '2023-06-02'", "pos % 365"), "cast(null as date)")]
    return d.rows("fx_quotes", ["symbol"], ["sic", "valid_from", "valid_to"], rows)


@role("fx_spans", "orders")
def fx_spans(d):
    """Time ranges of very different lengths per customer group: holdings and blackout periods. A third of
    the orders fall to one group."""
    key = "CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_custkey END"
    return f"""SELECT o_orderkey AS span_id, {key} AS holder, cast(o_orderdate as date) AS since,
  CASE WHEN o_orderkey % 97 = 5 THEN NULL ELSE {d.add('cast(o_orderdate as date)', 'CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 40 WHEN 3 THEN -2 ELSE 700 END')} END AS until
FROM orders WHERE o_orderkey % 2 = 0"""


@role("fx_blackouts", "orders")
def fx_blackouts(d):
    key = "CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_custkey END"
    return f"""SELECT o_orderkey AS blackout_id, {key} AS holder, {d.add('cast(o_orderdate as date)', 'o_orderkey % 50')} AS b_from,
  {d.add('cast(o_orderdate as date)', 'o_orderkey % 50 + CASE WHEN o_orderkey % 7 = 1 THEN 20 ELSE 1 END')} AS b_to FROM orders WHERE o_orderkey % 2 = 1"""


def FORM4_XML(d: Dialect) -> str:
    """One ownership filing per order: fifteen customers are the insiders of one company."""
    t = lambda code, day, shares, way: (
        f"'<nonDerivativeTransaction><transactionDate><value>', cast({day} as string), '</value></transactionDate><transactionCoding><transactionFormType>4</transactionFormType><transactionCode>', {code}, "
        f"'</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>', cast({shares} as string), '</value></transactionShares><transactionPricePerShare><value>', cast(o_orderkey % 90 + 1 as string), "
        f"'</value></transactionPricePerShare><transactionAcquiredDisposedCode><value>', {way}, '</value></transactionAcquiredDisposedCode></transactionAmounts></nonDerivativeTransaction>'")
    day = "cast(o_orderdate as date)"
    return f"""concat('<?xml version="1.0"?><ownershipDocument><issuer><issuerCik>', cast(cast(floor(o_custkey / 15) as bigint) as string), '</issuerCik><issuerTradingSymbol>T</issuerTradingSymbol></issuer>',
  '<reportingOwner><reportingOwnerId><rptOwnerCik>', cast(o_custkey as string), '</rptOwnerCik><rptOwnerName> Owner ', cast(o_custkey as string), '</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>',
  CASE WHEN o_custkey % 3 = 0 THEN 'true' ELSE '0' END, '</isDirector><isOfficer>1</isOfficer></reportingOwnerRelationship></reportingOwner><nonDerivativeTable>',
  {t("CASE o_orderkey % 4 WHEN 0 THEN 'P' WHEN 1 THEN 'P' WHEN 2 THEN 'S' ELSE 'A' END", day, "o_orderkey % 500", "CASE WHEN o_orderkey % 4 = 2 THEN 'D' ELSE 'A' END")},
  {t("'P'", d.add(day, "20"), "CASE WHEN o_orderkey % 3 = 0 THEN 10 ELSE 0 END", "'A'")}, '</nonDerivativeTable></ownershipDocument>')"""


@role("fx_form4", "orders")
def fx_form4(d):
    return f"SELECT concat('a', cast(o_orderkey as string)) AS accession, {FORM4_XML(d)} AS xml FROM orders"


@role("fx_form4_buys", "orders")
def fx_form4_buys(d):
    """What the filings hold, without going through XML."""
    who = "cast(floor(o_custkey / 15) as bigint) AS entity_id, o_custkey AS owner"
    return f"""SELECT {who}, cast(o_orderdate as date) AS day, cast(o_orderkey % 500 as double) AS shares, cast(o_orderkey % 90 + 1 as double) AS price FROM orders WHERE o_orderkey % 4 < 2 AND o_orderkey % 500 > 0
UNION ALL SELECT {who}, {d.add('cast(o_orderdate as date)', '20')}, 10, cast(o_orderkey % 90 + 1 as double) FROM orders WHERE o_orderkey % 3 = 0"""


@role("fx_pieces", "documents")
def fx_pieces(d):
    """Texts of a bundle: eight documents each, releases first, then reports, then the rest. A third of all
    documents fall into one bundle."""
    return f"""SELECT CASE WHEN doc_id % 3 = 0 THEN -1 ELSE cast(floor(doc_id / 8) as bigint) END AS bundle_id, doc_id AS piece_id, cast(doc_id % 4 as int) AS tier,
  {d.add("DATE '2023-06-01'", 'doc_id * 37 % 240')} AS filed_at, cast(coalesce(length(text), 0) * 5 as bigint) AS tokens FROM documents"""


@role("fx_extractions", "documents")
def fx_extractions(d):
    """Guidance figures drawn from each document, eight documents to a company: a range per metric, with a
    quote that is the text's own, shortened or made up."""
    rows = [(f"'{m}'", f"'{p}'", f"cast(100 + {a} as double)", f"cast(100 + {b} as double)", q) for m, p, a, b, q in (
        ("revenue", "FY", "doc_id % 7 * 5", "doc_id % 7 * 5 + doc_id % 3 * 4", "substr(t, 21, 120)"),
        ("eps", "FY", "doc_id % 5 * 3", "doc_id % 5 * 3", "CASE WHEN doc_id % 6 = 1 THEN 'we expect a record year in every segment' ELSE substr(t, 1, 60) END"),
        ("revenue", "Q", "doc_id % 4 - doc_id % 9", "doc_id % 4 + 2", "CASE WHEN doc_id % 4 = 2 THEN '' ELSE concat(substr(t, 11, 200), ' and more') END"))]
    src = "(SELECT doc_id, coalesce(text, '') AS t FROM documents) s"
    return f"""SELECT cast(floor(doc_id / 8) as bigint) AS entity_id, doc_id AS filing_no, concat('d', cast(doc_id as string)) AS accession, CASE WHEN period = 'Q' AND doc_id % 3 = 0 THEN 'H1' ELSE period END AS period, metric,
  CASE WHEN doc_id % 11 = 3 THEN NULL ELSE low END AS low, high, quote FROM ({d.rows(src, ['doc_id'], ['metric', 'period', 'low', 'high', 'quote'], rows)}) r"""
