import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from talus.operators import debate as D
from talus.operators.scan import running_last
from talus.streaming import jobs as J

T0 = datetime(2026, 1, 1)


def simulate(msgs, gap=timedelta(hours=6)):
    """One message at a time, as a chat handler would."""
    ctx, out = {}, {}
    for mid, chat, ts, explicit in sorted(msgs, key=lambda m: (m[2], m[0])):
        t = explicit
        if t is None and chat in ctx and ts - ctx[chat][1] < gap:
            t = ctx[chat][0]
        if t is not None:
            ctx[chat] = (t, ts)
        out[mid] = t
    return out


def random_messages(seed, n=400):
    rnd = random.Random(seed)
    t, out = T0, []
    for i in range(n):
        t += timedelta(minutes=rnd.choice([1, 20, 90, 350, 360, 370]))
        out.append((i, 0 if rnd.random() < 0.5 else rnd.randrange(1, 4), t, rnd.choice([None, None, "AA", "BB"])))
    return out


def frame(spark, msgs):
    return spark.createDataFrame(msgs, "msg_id int, chat int, ts timestamp, explicit string")


def test_session_equals_one_at_a_time(spark):
    for seed in (1, 2):
        msgs = random_messages(seed)
        got = {r.msg_id: r.ticker for r in D.debate_session(frame(spark, msgs)).collect()}
        assert got == simulate(msgs)


def simulate_all(msgs, gap=timedelta(hours=6), day=timedelta(hours=24)):
    """One message at a time, with the fallback: what it settles is a context like any other."""
    ctx, newest, out = {}, None, {}
    for mid, chat, ts, explicit in sorted(msgs, key=lambda m: (m[2], m[0])):
        ticker, fallback = explicit, None
        if ticker is None and chat in ctx and ts - ctx[chat][1] < gap:
            ticker = ctx[chat][0]
        if ticker is None and newest and ts - newest[1] < day:
            fallback = newest[0]
        settled = ticker or fallback
        if settled:
            ctx[chat] = newest = (settled, ts)
        out[mid] = (ticker, fallback)
    return out


def test_fallback_settles_the_ones_after_it(spark):
    h = lambda x: T0 + timedelta(hours=x)
    rows = [(1, 1, h(0), "AA"), (2, 2, h(20), None), (3, 3, h(40), None), (4, 3, h(41), None), (5, 4, h(65), None), (6, 3, h(70), "BB"), (7, 1, h(71), None)]
    got = {r.msg_id: (r.ticker, r.fallback) for r in D.debate_settle(frame(spark, rows)).collect()}
    assert got == {1: ("AA", None), 2: (None, "AA"), 3: (None, "AA"), 4: ("AA", None), 5: (None, None), 6: ("BB", None), 7: (None, "BB")}
    assert got == simulate_all(rows)


def test_settling_equals_one_at_a_time(spark):
    for seed, steps in ((1, [1, 20, 90, 350, 360, 370]), (2, [300, 400, 800, 1439, 1440, 1500]), (3, [1, 2, 3, 500])):
        rnd, t, msgs = random.Random(seed), T0, []
        for i in range(300):
            t += timedelta(minutes=rnd.choice(steps))
            msgs.append((i, rnd.randrange(5), t, rnd.choice([None, None, None, None, "AA", "BB"])))
        got = {r.msg_id: (r.ticker, r.fallback) for r in D.debate_settle(frame(spark, msgs)).collect()}
        assert got == simulate_all(msgs)


def test_running_last_equals_a_plain_scan(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice("ab"), T0 + timedelta(seconds=rnd.randrange(40_000)), rnd.choice([None, None, i])) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, k string, ts timestamp, v int")
    for strict in (False, True):
        got = {r.id: r.last for r in running_last(df, ["k"], "ts", "id", {"last": F.col("v")}, 600, strict).collect()}
        for key in "ab":
            cur = None
            for i, _, _, v in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])):
                if not strict and v is not None:
                    cur = v
                assert got[i] == cur
                if strict and v is not None:
                    cur = v


def land(spark, rows, path, n):
    """Rows as ``n`` landed files, oldest first."""
    size = -(-len(rows) // n)
    for i in range(n):
        part = spark.createDataFrame(rows[i * size:(i + 1) * size], "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
        part.coalesce(1).write.mode("append").parquet(f"{path}/part{i}")


def debate_stream(spark, folder):
    return J.read_files(spark, str(folder / "part*"), per_trigger=1).selectExpr(
        "cast(user_id as bigint) AS chat", "event_id AS msg_id", "ts", "concat('a long message ', coalesce(event_type, '')) AS text")


def as_events(msgs):
    return [(mid, ts, chat, ex, 0.0, "") for mid, chat, ts, ex in msgs]


def known(spark):
    return spark.createDataFrame([("AA",), ("BB",)], "ticker string")


def settled(df):
    return {r.msg_id: (r.ticker, r.fallback) for r in df.collect()}


def test_debate_stream_in_any_order_inside_the_watermark(spark, tmp_path):
    """Messages arrive up to five hours after others that are newer, in many files, with a restart in
    between; the table is that of one message at a time."""
    msgs, rnd = random_messages(9, 240), random.Random(4)
    arrival = sorted(msgs, key=lambda m: m[2] + timedelta(minutes=rnd.randrange(300)))
    assert arrival != msgs
    where = str(tmp_path / "out")
    land(spark, as_events(arrival[:140]), str(tmp_path / "in"), 4)
    some = J.debate_sessions(debate_stream(spark, tmp_path / "in"), known(spark), where)
    seen = sorted(arrival[:140], key=lambda m: (m[2], m[0]))
    assert settled(some) == simulate_all(seen)
    held = some.filter("NOT final").count()
    assert 0 < held < 70
    size = 100 // 5
    for i in range(5):
        spark.createDataFrame(as_events(arrival[140 + i * size : 140 + (i + 1) * size]), "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part{4 + i}"))
    out = J.debate_sessions(debate_stream(spark, tmp_path / "in"), known(spark), where)
    assert settled(out) == simulate_all(msgs)
    assert J.late_messages(spark, where).count() == 0
    assert len(list((tmp_path / "out" / "context").glob("turn=*"))) == 2
    # What was final stays, and nothing new changes nothing.
    first = {r.msg_id: (r.ticker, r.fallback) for r in some.filter("final").collect()}
    assert first.items() <= settled(out).items()
    assert settled(J.debate_sessions(debate_stream(spark, tmp_path / "in"), known(spark), where)) == simulate_all(msgs)


def test_late_messages_are_listed_and_change_nothing(spark, tmp_path):
    msgs = random_messages(3, 120)
    land(spark, as_events(msgs), str(tmp_path / "in"), 3)
    where = str(tmp_path / "out")
    before = settled(J.debate_sessions(debate_stream(spark, tmp_path / "in"), known(spark), where))
    assert before == simulate_all(msgs)
    end = msgs[-1][2]
    more = [(900, 1, end - timedelta(days=3), "BB"), (901, 1, msgs[0][2], None), (902, 2, end + timedelta(minutes=5), None)]
    land(spark, as_events(more), str(tmp_path / "in2"), 1)
    spark.read.parquet(str(tmp_path / "in2" / "part0")).write.mode("append").parquet(str(tmp_path / "in" / "part3"))
    out = J.debate_sessions(debate_stream(spark, tmp_path / "in"), known(spark), where)
    assert settled(out) == simulate_all([*msgs, more[2]])
    late = J.late_messages(spark, where)
    assert sorted((r.msg_id, r.chat, r.ts) for r in late.collect()) == [(900, 1, more[0][2]), (901, 1, more[1][2])]


def test_one_busy_chat_is_held_by_the_hour(spark, tmp_path):
    msgs = [(i, 7, T0 + timedelta(minutes=i), "AA" if i == 0 else None) for i in range(300)]
    land(spark, as_events(msgs), str(tmp_path / "in"), 1)
    out = J.debate_sessions(debate_stream(spark, tmp_path / "in"), known(spark), str(tmp_path / "out"), lateness="1 hour")
    assert {r.ticker for r in out.collect()} == {"AA"}
    state = spark.read.format("statestore").load(str(tmp_path / "out" / "checkpoint"))
    assert {r.n for r in state.selectExpr("size(value.groupState.ids) AS n").collect()} == {60}


def test_very_many_chats_share_states(spark, tmp_path):
    """Two thousand chats in two hours: as many states as groups and hours, and each chat its own company."""
    msgs = [(i, i % 2000, T0 + timedelta(seconds=i), ("AA", "BB")[i % 2] if i < 2000 else None) for i in range(4000)]
    land(spark, as_events(msgs), str(tmp_path / "in"), 1)
    out = J.debate_sessions(debate_stream(spark, tmp_path / "in"), known(spark), str(tmp_path / "out"))
    assert settled(out) == simulate_all(msgs)
    state = spark.read.format("statestore").load(str(tmp_path / "out" / "checkpoint"))
    assert 0 < state.count() <= 2 * J.CHAT_GROUPS


def test_taps_are_taken_once_however_late(spark, tmp_path):
    rows = [(i, T0 + timedelta(minutes=i), i % 3, f"fb|2026-01-0{1 + i % 3}|T{i % 3}|{i % 2}", 0.0, "") for i in range(30)]
    land(spark, rows, str(tmp_path / "in"), 1)
    where = str(tmp_path / "out")

    def run():
        s = J.read_files(spark, str(tmp_path / "in" / "part*")).selectExpr("event_id AS update_id", "ts", "event_type AS data")
        return J.feedback_ingest(s, where)

    def add(more, name):
        land(spark, more, str(tmp_path / name), 1)
        spark.read.parquet(str(tmp_path / name / "part0")).write.mode("append").parquet(str(tmp_path / "in" / "part0"))

    assert run().count() == 30
    assert run().count() == 30  # nothing new
    add([(29, *rows[29][1:]), (30, T0 + timedelta(minutes=31), 0, "fb|news|T0|1", 0.0, ""), (31, T0 + timedelta(minutes=32), 0, "xx|y", 0.0, "")], "in2")
    assert run().count() == 31  # one repeat and one foreign update are ignored
    add([(7, *rows[7][1:]), (32, T0 - timedelta(days=5), 0, "fb|2025-12-27|T9|1", 0.0, "")], "in3")
    taps = run()
    assert taps.count() == 32 and taps.filter("ticker = 'T9'").count() == 1  # five days late, and kept
    days = {(str(r.w_start), r.taps) for r in J.vote_rate_windows(taps).collect()}
    assert days == {("2025-12-27 00:00:00", 1), ("2026-01-01 00:00:00", 31)}


def test_last_vote_stream_updates_by_key(spark, tmp_path):
    rows = [(i, T0 + timedelta(minutes=i), 0, f"fb|{'news' if i == 7 else '2026-01-01'}|T{i % 2}|{int(i > 5)}", 0.0, "") for i in range(10)]
    land(spark, rows, str(tmp_path / "in"), 5)
    s = J.read_files(spark, str(tmp_path / "in" / "part*"), per_trigger=1).selectExpr("event_id AS update_id", "ts", "event_type AS data")
    out = {r.ticker: (r.up, r.muted) for r in J.run_epochs(J.last_vote(J.parse_taps(s)), str(tmp_path / "out"), ["ticker"]).collect()}
    assert out == {"T0": (True, False), "T1": (True, True)}
    again = J.run_epochs(J.last_vote(J.parse_taps(s)), str(tmp_path / "out"), ["ticker"])
    assert again.count() == 2  # a restart with nothing new
