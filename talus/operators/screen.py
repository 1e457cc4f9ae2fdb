"""Market-wide drop screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.columns import hits
from talus.operators.intervals import overlap_join
from talus.params import DEFAULTS, ScreenParams

TRIGGERS = ("dayDrop", "monthDrop", "from52WeekHigh")


def floors(p: ScreenParams = DEFAULTS.screen) -> Column:
    """All strict: exactly at a floor does not pass."""
    c = F.col
    return (
        (c("quote_type") == p.quote_type) & (c("market") == p.market) & (c("currency") == p.currency)
        & (c("market_cap") > p.min_market_cap) & (c("price") > p.min_price) & (c("avg_volume") > p.min_avg_volume)
    )


def liquidity_floors(quotes: DataFrame, p: ScreenParams = DEFAULTS.screen) -> DataFrame:
    return quotes.filter(floors(p))


def needs_month_check(p: ScreenParams = DEFAULTS.screen) -> Column:
    gap = F.try_divide(F.col("price"), F.col("avg50")) - 1
    return F.coalesce((F.col("avg50") != 0) & (gap <= p.month_prefilter), F.lit(False))


def month_prefilter(quotes: DataFrame, p: ScreenParams = DEFAULTS.screen) -> DataFrame:
    """Names far enough under their 50-day average; ``checked`` marks the first
    ``max_month_checks`` in quote order, the rest are kept and counted."""
    flagged = liquidity_floors(quotes, p).filter(needs_month_check(p))
    first = flagged.orderBy("pos").limit(p.max_month_checks).select("symbol", F.lit(True).alias("checked"))
    return flagged.join(F.broadcast(first), "symbol", "left").withColumn(
        "checked", F.coalesce("checked", F.lit(False))
    )


def from_high(price: Column, high: Column) -> Column:
    return F.when(high > 0, price / F.when(high > 0, high) - 1).otherwise(F.lit(0.0))


def drop_triggers(quotes: DataFrame, months: DataFrame, universe: DataFrame, p: ScreenParams = DEFAULTS.screen) -> DataFrame:
    """Floor-passing names that fell hard by any measure, with all measures hit, freshest
    event first. The month measure counts only for names the prefilter flags."""
    c = F.col
    q = liquidity_floors(quotes, p).withColumn("flagged", needs_month_check(p))
    j = q.join(months, "symbol", "left").withColumn("month_change", F.when(c("flagged"), c("month_return")))
    j = j.withColumn("from_high", from_high(c("price"), c("high52")))
    trig = hits([
        (c("day_change") <= p.day_drop, TRIGGERS[0]),
        (c("month_change") <= p.month_drop, TRIGGERS[1]),
        (c("from_high") <= p.from_high, TRIGGERS[2]),
    ])
    hit = j.withColumn("triggers", trig).filter(F.size("triggers") > 0)
    named = hit.join(universe.select(c("ticker").alias("symbol"), "cik", "title"), "symbol", "left")
    return named.select(
        "symbol", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("cik", F.lit(0)).alias("cik"),
        "price", (c("market_cap") / 1e9).alias("market_cap_b"), "day_change", "month_change", "from_high",
        "target", "triggers", "pos",
    )


def trigger_rank(first: Column) -> Column:
    r = F.lit(len(TRIGGERS))
    for i, name in reversed(list(enumerate(TRIGGERS))):
        r = F.when(first == name, i).otherwise(r)
    return r


def with_severity(hit: DataFrame) -> DataFrame:
    """Primary trigger, its rank and its size (more negative = worse)."""
    first = F.element_at("triggers", 1)
    size = (
        F.when(first == TRIGGERS[0], F.col("day_change"))
        .when(first == TRIGGERS[1], F.coalesce("month_change", F.lit(0.0)))
        .otherwise(F.col("from_high"))
    )
    return hit.withColumn("primary_trigger", first).withColumn("rank", trigger_rank(first)).withColumn("severity", size)


def with_sector(hit: DataFrame, sectors: DataFrame, p: ScreenParams = DEFAULTS.screen) -> DataFrame:
    """Adds sector and whether it is excluded; an unknown sector is kept."""
    return hit.join(sectors.select("symbol", "sector"), "symbol", "left").withColumn(
        "excluded", F.coalesce(F.col("sector").isin(*p.exclude_sectors), F.lit(False))
    )


def sector_exclude(hit: DataFrame, sectors: DataFrame, p: ScreenParams = DEFAULTS.screen) -> DataFrame:
    return with_sector(hit, sectors, p).filter(~F.col("excluded")).drop("excluded")


ORDER = ("rank", "severity", "pos")


def severity_topk(kept: DataFrame, p: ScreenParams = DEFAULTS.screen) -> DataFrame:
    """The worst ``max_candidates``: fresh events before stale states, then by size."""
    return with_severity(kept).orderBy(*ORDER).limit(p.max_candidates)


def overflow_report(kept: DataFrame, p: ScreenParams = DEFAULTS.screen) -> DataFrame:
    """Names past the cap. The cap bounds the broadcast side; no global ranking is needed."""
    top = severity_topk(kept, p).select("symbol")
    return with_severity(kept).join(F.broadcast(top), "symbol", "left_anti")


def screen_funnel(universe: DataFrame, quotes: DataFrame, hit: DataFrame, p: ScreenParams = DEFAULTS.screen) -> DataFrame:
    """Counts at each stage, one row. Every stage sends one partial count per task."""
    passed = floors(p)
    q = quotes.agg(
        F.count("*").alias("quoted"), F.count_if(passed).alias("passed_floors"), F.count_if(passed & needs_month_check(p)).alias("flagged")
    )
    h = hit.agg(F.struct(
        F.count("*").alias("triggered"), F.count_if("excluded").alias("sector_excluded"), F.count_if(~F.col("excluded")).alias("kept")
    ).alias("s"))
    u = universe.agg(F.count("*").alias("n"))
    cap = F.lit(p.max_month_checks).cast("bigint")
    return q.select(
        u.scalar().alias("universe"), "quoted", "passed_floors",
        F.least("flagged", cap).alias("month_checked"),
        F.greatest(F.col("flagged") - cap, F.lit(0).cast("bigint")).alias("month_check_skipped"),
        h.scalar().alias("h"),
    ).select("*", "h.triggered", "h.sector_excluded", F.greatest(F.col("h.kept") - p.max_candidates, F.lit(0)).alias("overflow_dropped")).drop("h")


def sic_exclude(candidates: DataFrame, codes: DataFrame, ranges: DataFrame, as_of) -> DataFrame:
    """Candidates but those whose industry code on the day lies in an excluded range; a company without
    a code stays.

    codes: symbol, sic, valid_from, valid_to (null: until today). ranges: sic_from, sic_to."""
    day = F.lit(as_of).cast("date")
    now = codes.filter(F.col("sic").isNotNull() & (F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day))).select("symbol", "sic")
    out = overlap_join(now, ranges, [], ("sic", "sic"), ("sic_from", "sic_to")).select("symbol").distinct()
    return candidates.join(out, "symbol", "left_anti")
