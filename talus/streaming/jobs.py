"""Reader events as Structured Streaming jobs.

Each job reads landed files, keeps its offsets and state in the shared checkpoint folder, and
writes parquet. Results that change (latest vote, windows) are written per micro-batch under
``epoch=N``: writing an epoch again after a failure replaces it, and a reader takes the newest
row per key. Nothing goes through a driver-side sink.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from talus.operators import debate as D
from talus.operators.memory import NEWS

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def read_files(spark: SparkSession, path: str, schema: T.StructType = EVENTS, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """Landed files as a stream with a fixed schema; event time as TIMESTAMP, which watermarks
    need."""
    r = spark.readStream.format(fmt).schema(schema)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.load(path).withColumn("ts", F.col("ts").cast("timestamp"))


def run_append(stream: DataFrame, where: str) -> DataFrame:
    """Run what is available into an append-only table and return it."""
    spark = stream.sparkSession
    q = (
        stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", f"{where}/checkpoint").start(f"{where}/table")
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/table")


def run_epochs(stream: DataFrame, where: str, keys: list[str], mode: str = "update", each: Callable[[DataFrame, int], DataFrame] | None = None,
               schema: str | T.StructType | None = None) -> DataFrame:
    """Run what is available, writing each micro-batch's changed rows under its epoch; returns
    the newest row per key. ``schema`` is that of the rows ``each`` makes, so a run that finds
    nothing new still knows its table."""
    spark = stream.sparkSession
    rows_schema = spark.createDataFrame([], schema).schema if schema else stream.schema

    def sink(batch: DataFrame, epoch: int) -> None:
        rows = each(batch, epoch) if each else batch
        rows.write.mode("overwrite").parquet(f"{where}/table/epoch={epoch}")

    q = (
        stream.writeStream.outputMode(mode).trigger(availableNow=True).foreachBatch(sink)
        .option("checkpointLocation", f"{where}/checkpoint").start()
    )
    q.awaitTermination()
    rows = spark.read.schema(T.StructType([*rows_schema.fields, T.StructField("epoch", T.LongType())])).parquet(f"{where}/table")
    cols = [c for c in rows.columns if c not in (*keys, "epoch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), "epoch").alias("r")).select(*keys, "r.*")


def run_once(stream: DataFrame, where: str, key: str) -> DataFrame:
    """Run what is available into a table that holds each ``key`` once, however late or often it is
    delivered; returns the table. A micro-batch is checked against what earlier ones landed, of which
    the range of the batch's keys is read; written again after a failure it gives the same rows."""
    spark = stream.sparkSession
    landed_schema = T.StructType([*stream.schema.fields, T.StructField("epoch", T.LongType())])

    def sink(batch: DataFrame, epoch: int) -> None:
        rows = batch.dropDuplicates([key])
        span = batch.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
        if epoch > 0 and span["lo"] is not None:
            landed = spark.read.schema(landed_schema).parquet(f"{where}/table").filter(F.col(key).between(span["lo"], span["hi"]) & (F.col("epoch") < epoch))
            rows = rows.join(landed.select(key), key, "left_anti")
        rows.select(*stream.columns).write.mode("overwrite").parquet(f"{where}/table/epoch={epoch}")

    q = (
        stream.writeStream.outputMode("append").trigger(availableNow=True).foreachBatch(sink)
        .option("checkpointLocation", f"{where}/checkpoint").start()
    )
    q.awaitTermination()
    return spark.read.schema(landed_schema).parquet(f"{where}/table").drop("epoch")


# --- feedback --------------------------------------------------------------------------


def parse_taps(updates: DataFrame) -> DataFrame:
    """``fb|date|ticker|vote`` to columns; anything else is ignored."""
    part = F.split("data", r"\|")
    at = lambda i: F.coalesce(F.get(part, F.lit(i)), F.lit(""))
    return (
        updates.filter(F.col("data").startswith("fb|"))
        .select("update_id", "ts", at(1).alias("run_date"), at(2).alias("ticker"), (at(3) == "1").alias("up"))
        .filter("run_date <> '' AND ticker <> ''")
    )


def feedback_ingest(updates: DataFrame, where: str) -> DataFrame:
    """The table of taps, each once; the checkpoint is the offset, and no tap is too late."""
    return run_once(parse_taps(updates), where, "update_id")


def last_vote(taps: DataFrame) -> DataFrame:
    """Live latest vote per ticker and whether its news is muted; a tap that comes twice changes
    nothing."""
    is_vote = F.col("run_date") != NEWS
    newest = F.when(is_vote, F.struct("ts", "update_id"))
    return taps.groupBy("ticker").agg(
        F.max_by(F.struct("run_date", "up", "ts"), newest).alias("v"), F.bool_or(~is_vote).alias("muted")
    ).select("ticker", "v.run_date", "v.up", "v.ts", "muted")


def vote_rate_windows(taps: DataFrame, length: str = "1 day", slide: str | None = None) -> DataFrame:
    """Vote rate per tumbling or sliding window, over the landed taps: a late one counts in its own
    window."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (
        taps.groupBy(w.alias("w")).agg(F.count("*").alias("taps"), F.count_if("up").alias("ups"))
        .select(F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), "taps", "ups", (F.col("ups") / F.col("taps")).alias("rate"))
    )


# --- news ------------------------------------------------------------------------------


def news_fresh(items: DataFrame, hours: int = 48) -> DataFrame:
    """Marks items published less than ``hours`` before they arrived; late ones are kept aside
    under ``fresh = false``, not lost. Stateless."""
    old = F.col("pub_ts") < F.col("ts") - F.make_dt_interval(hours=F.lit(hours))
    return items.withColumn("fresh", ~F.coalesce(old, F.lit(False)))


def killswitch_alert(reads: DataFrame) -> DataFrame:
    """Reads that say a kill-switch tripped."""
    return reads.filter(F.col("impact") == "killswitch_trigger")


# --- debate ----------------------------------------------------------------------------

MESSAGES = "chat bigint, msg_id bigint, ts timestamp, text string"
SETTLED = f"{MESSAGES}, explicit string, ticker string, fallback string"
CONTEXT = "chat bigint, msg_id bigint, ts timestamp, ticker string"


#: Groups of chats that share a state per bucket of time.
CHAT_GROUPS = 64


def in_order(messages: DataFrame, lateness: str, bucket_seconds: int = 3600) -> DataFrame:
    """Messages held back until no earlier one is expected: the stream of ``MESSAGES`` with ``late``.

    State is kept per bucket of time and group of chats, and holds the messages of that hour, however busy a
    chat: so there are no more states than groups and open hours, however many chats there are, and a call
    into Python serves a group's hour. When a bucket ends does not depend on the chat. A bucket is released as a whole when the watermark (the newest message less ``lateness``)
    has passed its end, so what one micro-batch releases lies behind all that the next ones release. A
    message whose bucket has been released already is late: it comes out at once, marked. Spark drops rows
    whose watermarked time lies behind the watermark, so that column is null in the rows that go to the
    state; it comes from a second branch, which only watches the time and passes no rows on.
    """

    def hold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        _, bucket = key
        rows = ([], [], [], [])
        if state.hasTimedOut:
            rows, late = state.get, False
            state.remove()
        else:
            new = pd.concat(list(frames), ignore_index=True)
            # At most the messages of one group of chats in one bucket.
            rows = tuple(list(x) + y for x, y in zip(state.getOption or rows, ([None if pd.isna(c) else int(c) for c in new["chat"]], new["msg_id"].tolist(), new["micros"].tolist(), new["text"].tolist())))
            late = False
            try:
                state.setTimeoutTimestamp((int(bucket) + 1) * bucket_seconds * 1000)
            except ValueError:
                late = True
            else:
                state.update(rows)
                return
        yield pd.DataFrame({"chat": pd.array(rows[0], dtype="Int64"), "msg_id": rows[1], "micros": rows[2], "text": rows[3], "late": late})

    never = F.lit("0001-01-01 00:00:00").cast("timestamp")
    none = lambda kind: F.lit(None).cast(kind)
    clock = messages.withWatermark("ts", lateness).filter(F.col("ts") < never).select(
        none("bigint").alias("chat"), none("bigint").alias("msg_id"), none("string").alias("text"), none("bigint").alias("micros"), none("bigint").alias("bucket"), none("bigint").alias("slot"), "ts")
    rows = messages.filter("ts IS NOT NULL").select(
        "chat", "msg_id", "text", F.unix_micros("ts").alias("micros"), F.floor(F.unix_seconds("ts") / bucket_seconds).alias("bucket"), F.pmod(F.xxhash64("chat"), F.lit(CHAT_GROUPS)).alias("slot"), none("timestamp").alias("ts"))
    keyed = clock.union(rows)
    out = keyed.groupBy("slot", "bucket").applyInPandasWithState(
        hold, "chat bigint, msg_id bigint, micros bigint, text string, late boolean", "chats array<bigint>, ids array<bigint>, times array<bigint>, texts array<string>", "append", "EventTimeTimeout")
    return out.select("chat", "msg_id", F.timestamp_micros("micros").alias("ts"), "text", "late")


def held_back(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The messages that ``in_order`` still holds, read from the state of its last micro-batch."""
    state = spark.read.format("statestore").load(checkpoint).select(F.arrays_zip("value.groupState.chats", "value.groupState.ids", "value.groupState.times", "value.groupState.texts").alias("rows"))
    return state.select(F.inline("rows").alias("chat", "msg_id", "micros", "text")).select("chat", "msg_id", F.timestamp_micros("micros").alias("ts"), "text")


def settle_after(rows: DataFrame, context: DataFrame, known: DataFrame, gap_hours: int, fallback_hours: int) -> DataFrame:
    """Messages settled behind the stored contexts of their chats: ``SETTLED`` and ``new``, which is false
    for the contexts themselves. A context counts as a message that names its company."""
    named = D.mention_extract(D.countable(rows), known).select("chat", "msg_id", "ts", "text", "explicit")
    old = context.select("chat", "msg_id", "ts", F.lit(None).cast("string").alias("text"), F.col("ticker").alias("explicit"))
    both = named.withColumn("new", F.lit(True)).unionByName(old.withColumn("new", F.lit(False)))
    return D.debate_settle(both, gap_hours, fallback_hours).select(*[c.split()[0] for c in SETTLED.split(", ")], "new")


def debate_sessions(messages: DataFrame, known: DataFrame, where: str, gap_hours: int = 6, fallback_hours: int = 24, lateness: str = "6 hours") -> DataFrame:
    """Per-message company over a stream of messages, the fallback included, whatever order they arrive
    in. Returns ``SETTLED`` with ``final``.

    ``in_order`` releases messages in the order of their time. Each micro-batch's are settled with the
    batch operator behind the stored chat contexts, and the contexts are stored for the next; so a chat
    with very many messages is still spread over tasks. Messages that wait for their hour to close are
    settled as things stand, with ``final`` false, and again when they are released. Those that come
    after their hour was released change nothing that was said; ``late_messages`` lists them.

    A context is the newest settled message of a chat; it is kept while it can still settle one, that
    is for ``fallback_hours`` after the newest message. Two copies are kept in turn, so a batch that
    is run again finds the contexts it began with."""
    spark = messages.sparkSession

    def context(epoch: int) -> DataFrame:
        return spark.read.schema(CONTEXT).parquet(f"{where}/context/turn={epoch % 2}") if epoch >= 0 else spark.createDataFrame([], CONTEXT)

    def each(batch: DataFrame, epoch: int) -> DataFrame:
        # Written first: what the state lets go is computed once.
        batch.write.mode("overwrite").parquet(f"{where}/released/turn={epoch % 2}")
        rows = spark.read.schema(batch.schema).parquet(f"{where}/released/turn={epoch % 2}")
        rows.filter("late").drop("late").write.mode("overwrite").parquet(f"{where}/late/epoch={epoch}")
        if rows.filter("NOT late").isEmpty():
            context(epoch - 1).write.mode("overwrite").parquet(f"{where}/context/turn={epoch % 2}")
            return spark.createDataFrame([], SETTLED)
        done = settle_after(rows.filter("NOT late"), context(epoch - 1), known, gap_hours, fallback_hours)
        done.write.mode("overwrite").parquet(f"{where}/settled/turn={epoch % 2}")
        done = spark.read.schema(done.schema).parquet(f"{where}/settled/turn={epoch % 2}")
        settled = done.withColumn("ticker", F.coalesce("ticker", "fallback")).filter("ticker IS NOT NULL")
        newest = settled.groupBy("chat").agg(F.max_by(F.struct("msg_id", "ts", "ticker"), F.struct("ts", "msg_id")).alias("c")).select("chat", "c.*")
        end = done.agg(F.max("ts")).scalar()
        alive = F.unix_micros(end) - F.unix_micros("ts") < fallback_hours * 3_600_000_000
        newest.filter(alive).write.mode("overwrite").parquet(f"{where}/context/turn={epoch % 2}")
        return done.filter("new").drop("new")

    final = run_epochs(in_order(messages, lateness), where, ["msg_id"], mode="append", each=each, schema=SETTLED)
    last = spark.read.schema("epoch bigint").parquet(f"{where}/table").agg(F.max("epoch")).first()[0]
    # Nothing may have been released yet; then there is no context either.
    waiting = settle_after(held_back(spark, f"{where}/checkpoint"), context(-1 if last is None else last), known, gap_hours, fallback_hours).filter("new").drop("new")
    return final.withColumn("final", F.lit(True)).unionByName(waiting.withColumn("final", F.lit(False)))


def late_messages(spark: SparkSession, where: str) -> DataFrame:
    """Messages that came after their hour had been released, with the micro-batch that brought them."""
    return spark.read.schema(f"{MESSAGES}, epoch bigint").parquet(f"{where}/late")
