"""News feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus import params as P
from talus.functions.text import decode_feed, strip
from talus.params import DEFAULTS, MemoryParams


def _pick(block: Column, tag: str) -> Column:
    return strip(F.regexp_extract(block, rf"<{tag}[^>]*>(?:<!\[CDATA\[)?([\s\S]*?)(?:\]\]>)?</{tag}>", 1))


def pub_time(text: Column) -> Column:
    """RFC 822 date to a timestamp; null when it does not parse."""
    core = F.regexp_extract(text, r"(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    offset = F.regexp_extract(text, r"([+-]\d{4})\s*$", 1)
    minutes = F.when(
        offset != "",
        F.concat(F.substring(offset, 1, 1), F.lit("1")).cast("int")
        * (F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, 4, 2).cast("int")),
    ).otherwise(0)
    at = F.try_to_timestamp(core, F.lit("d MMM yyyy HH:mm:ss"))
    return at - F.make_dt_interval(mins=minutes)


def news_parse(feeds: DataFrame, p: MemoryParams = DEFAULTS.memory) -> DataFrame:
    """Feed documents to items: title, link, source, date text, publication time, and a snippet of
    ``snippet_chars``."""
    blocks = F.regexp_extract_all("xml", F.lit(r"<item>([\s\S]*?)</item>"), F.lit(1))
    items = feeds.select("entity_id", "feed_id", F.posexplode(blocks).alias("pos", "block"))
    plain = F.regexp_replace(decode_feed(_pick(F.col("block"), "description")), r"<[^>]+>", " ")
    snippet = F.substring(strip(F.regexp_replace(plain, r"[\s\x{a0}]+", " ")), 1, p.snippet_chars)
    return items.select(
        "entity_id", "feed_id", "pos",
        decode_feed(_pick(F.col("block"), "title")).alias("title"),
        _pick(F.col("block"), "link").alias("link"),
        decode_feed(_pick(F.col("block"), "source")).alias("source"),
        _pick(F.col("block"), "pubDate").alias("pub_date"),
        pub_time(_pick(F.col("block"), "pubDate")).alias("pub_ts"),
        snippet.alias("snippet"),
    )


def news_filter(items: DataFrame, now: Column, fresh_hours: int = 48, banned: tuple[str, ...] = P.BANNED_SOURCES,
                law_firm: str = P.LAW_FIRM_PATTERN) -> DataFrame:
    """Fresh items from readable sources. An unparseable date counts as fresh; the banned list
    is fixed by the code, so it is a plain predicate and no join."""
    src = F.lower("source")
    is_banned = F.lit(False)
    for name in banned:
        is_banned = is_banned | src.contains(name.lower())
    old = F.col("pub_ts") < now - F.make_dt_interval(hours=F.lit(fresh_hours))
    return items.filter(
        (F.col("title") != "") & (F.col("link") != "") & ~F.coalesce(old, F.lit(False)) & ~is_banned
        & ~F.col("title").rlike(f"(?i){law_firm}")
    ).withColumn("source", F.when(F.col("source") == "", "unknown").otherwise(F.col("source")))


def news_topn(items: DataFrame, n: int = 4) -> DataFrame:
    """First ``n`` items per company in feed order."""
    w = Window.partitionBy("entity_id").orderBy("feed_id", "pos")
    return items.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
