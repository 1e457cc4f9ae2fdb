"""Which company a reader's message is about.

messages: chat, msg_id, ts, text. Messages of up to ten characters and commands do not count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.functions.text import mentions
from talus.operators.scan import running_last
from talus.sources.gold import materialize


def countable(messages: DataFrame, min_chars: int = 10) -> DataFrame:
    return messages.filter((F.length("text") > min_chars) & ~F.col("text").startswith("/"))


def known_tickers(performance: DataFrame, cards: DataFrame) -> DataFrame:
    return performance.select("ticker").union(cards.select("ticker")).distinct()


def mention_extract(messages: DataFrame, known: DataFrame) -> DataFrame:
    """First known ticker named in each message, null when there is none."""
    tokens = messages.select("msg_id", F.posexplode(F.array_distinct(mentions("text"))).alias("p", "ticker"))
    hit = tokens.join(known.select("ticker"), "ticker").groupBy("msg_id").agg(F.min_by("ticker", "p").alias("explicit"))
    return messages.join(hit, "msg_id", "left")


def debate_session(mentioned: DataFrame, gap_hours: int = 6, bucket_seconds: int = 3600) -> DataFrame:
    """Adds ``ticker``: the one the message names, else the chat's while the talk goes on, that
    is while no pause reaches ``gap_hours``. Null when the talk has not named one yet.

    A pause starts a new talk; the last explicit ticker counts when it is not older than the
    last start. Unresolved messages do not keep a talk alive, and need not be told apart: before
    the first explicit one of a talk there is nothing to carry.
    """
    prev = running_last(mentioned, ["chat"], "ts", "msg_id", {"_prev": F.col("ts")}, bucket_seconds, strict=True)
    starts = F.col("_prev").isNull() | (F.unix_micros(F.col("ts")) - F.unix_micros(F.col("_prev")) >= gap_hours * 3_600_000_000)
    at = F.struct(F.col("ts"), F.col("msg_id").alias("id"))
    marks = running_last(
        prev, ["chat"], "ts", "msg_id",
        {"_start": F.when(starts, at), "_named": F.when(F.col("explicit").isNotNull(), F.struct("ts", F.col("msg_id").alias("id"), "explicit"))},
        bucket_seconds,
    )
    alive = F.struct(F.col("_named.ts"), F.col("_named.id")) >= F.struct(F.col("_start.ts"), F.col("_start.id"))
    return marks.select(*mentioned.columns, F.when(alive, F.col("_named.explicit")).alias("ticker"))


def debate_settle(mentioned: DataFrame, gap_hours: int = 6, fallback_hours: int = 24, bucket_seconds: int = 3600) -> DataFrame:
    """Adds ``ticker`` (named, or carried by the chat's talk) and ``fallback``: for a message the talk
    does not settle, the newest company settled in any chat within ``fallback_hours``.

    A message settled by the fallback counts for the ones after it, as the context of its chat and as
    the newest of all. So a message is settled if one that names a company comes before it and no
    pause of ``fallback_hours`` lies between them, in all chats together. A settled message that names
    none takes the company of the settled one before it: in its chat if that is near enough, else of
    all. Talks (runs in a chat without a long pause) are settled from inside; only what the first
    message of a talk points to has to be followed from talk to talk, by doubling.
    """
    at = lambda *more: F.struct("ts", "msg_id", *more)
    # Every scan reads its input twice, so what scans are built on is written in between.
    wide = materialize(mentioned.withColumn("_all", F.lit(0)), "debate-named")
    scan = lambda df, keys, values, strict=False: running_last(df, keys, "ts", "msg_id", values, bucket_seconds, strict)
    micros = lambda c: F.unix_micros(F.col(c))
    pause = lambda prev, hours: F.col(prev).isNull() | (micros("ts") - micros(prev) >= hours * 3_600_000_000)
    # Which messages are settled: a named one since the last long pause of all.
    g = global_last(wide, {"_before": F.col("ts")}, strict=True)
    g = global_last(g, {"_pause": F.when(pause("_before", fallback_hours), at()), "_said": F.when(F.col("explicit").isNotNull(), at())})
    done = materialize(g.withColumn("_settled", F.coalesce(F.col("_said") >= F.col("_pause"), F.lit(False))), "debate-settled")
    # The settled message before it: of its chat, and of all.
    mine = F.when(F.col("_settled"), F.struct("ts", F.col("msg_id").alias("id")))
    done = scan(done, ["chat"], {"_own": mine}, strict=True)
    done = global_last(done, {"_any": F.when(F.col("_settled"), F.struct("ts", F.col("msg_id").alias("id")))}, strict=True)
    done = materialize(done, "debate-before")
    near = F.col("_own").isNotNull() & (micros("ts") - F.unix_micros("_own.ts") < gap_hours * 3_600_000_000)
    # Inside a talk: the last named one, else the talk's first message and what it points to.
    named = F.when(F.col("explicit").isNotNull(), at("explicit"))
    first = F.when(F.col("_settled") & ~near, at(F.col("_any.id").alias("to")))
    done = scan(done, ["chat"], {"_named": named, "_first": first})
    inside = F.col("_named").isNotNull() & (F.col("_first").isNull() | (F.struct("_named.ts", "_named.msg_id") >= F.struct("_first.ts", "_first.msg_id")))
    done = done.withColumn("_own_name", F.when(F.col("_settled") & inside, F.col("_named.explicit")))
    done = done.withColumn("_next", F.when(F.col("_settled") & F.col("_own_name").isNull(), F.col("_first.to"))).withColumn("_near", near)
    keep = materialize(done.select(*mentioned.columns, "_settled", "_own_name", "_next", "_near"), "debate-pointers")
    names = followed(keep.filter("_settled").select("msg_id", F.col("_own_name").alias("name"), F.col("_next").alias("next")))
    out = keep.join(names, "msg_id", "left")
    by_talk = F.col("explicit").isNotNull() | F.col("_near")
    return out.select(*mentioned.columns, F.when(by_talk, F.col("name")).alias("ticker"), F.when(~by_talk, F.col("name")).alias("fallback"))


def global_last(df: DataFrame, values: dict, strict: bool = False) -> DataFrame:
    """Running values over all rows: scanned inside seconds, the seconds inside hours, and the hours in
    one task, so no task holds more rows than there are seconds in an hour or hours in all."""
    return running_last(df, ["_all"], "ts", "msg_id", values, 1, strict, coarser=3600)


def followed(links: DataFrame) -> DataFrame:
    """(msg_id, name): the name at the end of each chain of ``next``, in as many rounds as the logarithm
    of the longest one."""
    while True:
        links = materialize(links, "debate-links")
        if not links.filter("name IS NULL AND next IS NOT NULL").limit(1).count():
            return links.select("msg_id", "name")
        to = links.select(F.col("msg_id").alias("next"), F.col("name").alias("_name"), F.col("next").alias("_next"))
        links = links.join(to, "next", "left").select(
            "msg_id", F.coalesce("name", "_name").alias("name"), F.when(F.coalesce("name", "_name").isNull(), F.col("_next")).alias("next")
        )
