"""Grouping sets, sketches, relative moves and guidance, against plain counts."""

import random
import statistics
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from talus.operators import guidance as G
from talus.operators import relative as M
from talus.operators import rollups as U

D0 = date(2024, 1, 1)


def test_funnel_by_every_prefix_in_one_scan(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(rnd.choice(["tech", "bank", None]), rnd.choice(["a", "b"]), rnd.random(), rnd.choice([1, 2, None])) for _ in range(400)]
    spark.createDataFrame(rows, "sector string, kind string, v double, n int").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    cube = U.funnel_cube(df, ["sector", "kind"], {"high": F.col("v") > 0.5, "one": F.col("n") == 1})
    got = {(r.level, r.sector, r.kind): (r.names, r.high, r.one) for r in cube.collect()}
    want = defaultdict(lambda: [0, 0, 0])
    for s, k, v, n in rows:
        for key in ((0, s, k), (1, s, None), (3, None, None)):
            want[key][0] += 1
            want[key][1] += v > 0.5
            want[key][2] += v > 0.5 and n == 1
    assert got == {k: tuple(v) for k, v in want.items()}
    # A sector that is unknown is not the sum over sectors.
    assert got[1, None, None] != got[3, None, None]
    plan = cube._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and "Expand" in plan and "Union" not in plan


def test_sketches_merge_in_any_order(spark):
    rnd = random.Random(2)
    rows = [(d, rnd.randrange(3000), rnd.gauss(0, 1)) for d in range(14) for _ in range(1500)]
    days = U.day_sketches(spark.createDataFrame(rows, "day int, who int, v double"), ["day"], "who", "v")
    week = F.floor(F.col("day") / 7).alias("week")
    merged = {r.week: r for r in U.read_sketches(U.merged_sketches(days, [week]), ["week"]).collect()}
    again = {r.week: r.distinct for r in U.read_sketches(U.merged_sketches(days.orderBy(F.desc("day")).repartition(5), [week]), ["week"]).collect()}
    for w, r in merged.items():
        mine = [x for x in rows if x[0] // 7 == w]
        exact = len({x[1] for x in mine})
        assert r.rows == len(mine) and abs(r.distinct - exact) <= 0.05 * exact and r.distinct == again[w]
        ordered = sorted(x[2] for x in mine)
        for p, share in ((r.p25, 0.25), (r.p50, 0.5), (r.p75, 0.75)):
            assert abs(sum(v <= p for v in ordered) / len(ordered) - share) < 0.03


def bars(spark, closes):
    return spark.createDataFrame([(s, D0 + timedelta(d), c) for s, xs in closes.items() for d, c in enumerate(xs) if c is not None], "symbol string, bar_date date, close double")


@pytest.mark.parametrize("people", [40, 900, 6000, 30000])
def test_merged_days_count_like_the_whole_week(spark, people):
    ev = spark.range(3 * people).selectExpr(f"id * 7919 % {people} AS user_id", "id % 7 AS day", "cast(id % 100 as double) AS value", "id % 2 AS week")
    for parts in (1, 5):
        e = ev.coalesce(1) if parts == 1 else ev.repartition(parts)
        merged = {r.week: r.distinct for r in U.read_sketches(U.merged_sketches(U.day_sketches(e, ["week", "day"], "user_id", "value"), ["week"]), ["week"]).collect()}
        whole = {r.week: r.distinct for r in U.read_sketches(U.day_sketches(e, ["week"], "user_id", "value"), ["week"]).collect()}
        exact = {r.week: r.n for r in e.groupBy("week").agg(F.countDistinct("user_id").alias("n")).collect()}
        assert merged == whole and all(abs(merged[w] - exact[w]) <= 0.05 * exact[w] for w in exact)


def test_beta_of_any_span_and_what_is_left(spark):
    rnd = random.Random(3)
    closes = {s: [100.0] for s in "ABCD"}
    for _ in range(60):
        m = rnd.gauss(0, 0.02)
        for s, b in zip("ABCD", (0.5, 1.0, 2.0, -1.0)):
            closes[s].append(closes[s][-1] * (1 + b * m + rnd.gauss(0, 0.001)))
    r = M.daily_returns(bars(spark, closes))
    mkt = M.group_returns(r)
    x = {v.bar_date: v.x for v in mkt.collect()}
    y = {(v.symbol, v.bar_date): v.r for v in r.collect()}
    for row in M.rolling_beta(r.join(mkt, "bar_date"), cell_days=7, cells=3).collect():
        days = [d for s, d in y if s == row.symbol and row.cell - 3 < (d - date(1970, 1, 1)).days // 7 <= row.cell]
        assert row.n == len(days)
        if len(days) >= 3:
            slope = statistics.linear_regression([x[d] for d in days], [y[row.symbol, d] for d in days]).slope
            assert abs(row.beta - slope) < 1e-9
            assert abs(row.own - (sum(y[row.symbol, d] for d in days) - slope * sum(x[d] for d in days)) / 1e6) < 1e-9
        else:
            assert row.beta is None


def test_moves_against_market_and_sector(spark):
    closes = {"A": [100, 110], "B": [100, 90], "C": [100, 100], "D": [None, 50]}
    r = M.daily_returns(bars(spark, {k: [c and float(c) for c in v] for k, v in closes.items()}))
    sectors = spark.createDataFrame([("A", "x"), ("B", "x"), ("C", None)], "symbol string, group string")
    got = {v.symbol: v for v in M.moves(r, M.group_returns(r), sectors, "2024-01-02", 5).collect()}
    assert set(got) == {"A", "B", "C"}
    assert (got["A"].move, got["A"].market_move, got["A"].sector_move, got["A"].against_sector) == (0.1, 0.0, 0.0, 0.1)
    assert got["C"].sector_move is None and got["C"].against_market == 0.0
    assert M.moves(r, M.group_returns(r), sectors, "2020-01-01", 5).count() == 0


GUIDE = "entity_id string, filing_no int, accession string, metric string, period string, low double, high double, quote string"


def test_ranges_against_each_other(spark):
    steps = [(100, 110), (102, 112), (102, 112), (104, 110), (100, 120), (90, 95), (None, 95), (None, None), (96, 96), (99, 97)]
    rows = [("T", n, f"a{n}", "revenue", "FY", lo and float(lo), hi and float(hi), "q") for n, (lo, hi) in enumerate(steps)]
    rows += [("T", 0, "a0", "eps", "FY", 1.0, 2.0, "q"), ("T", 3, "a3", "eps", "Q1", -4.0, -2.0, "q"), ("T", 4, "a4", "eps", "Q1", -2.0, None, "q"), ("U", 0, "b", "eps", "FY", 1.0, 1.0, "q")]
    found = {(r.metric, r.period, r.filing_no): r for r in G.guidance_diff(spark.createDataFrame(rows, GUIDE)).collect()}
    told = [found["revenue", "FY", n].status for n in range(1, len(steps))]
    assert told == ["raised", "unchanged", "narrowed", "widened", "cut", "raised", "unclear", "unclear", "unclear"]
    assert found["eps", "FY", 1].status == "withdrawn" and ("eps", "FY", 2) not in found
    assert found["eps", "Q1", 3].status == "new" and found["eps", "Q1", 4].status == "raised" and found["eps", "Q1", 5].status == "withdrawn"
    assert found["eps", "Q1", 4].middle_change_pct == pytest.approx(100 / 3) and not any(r.entity_id == "U" for r in found.values())


def test_quotes_must_stand_in_the_filing(spark):
    text = "Revenue for fiscal 2025 is expected to be between $1.0 and $1.2 billion, excluding currency effects."
    quotes = {"verbatim": "revenue for fiscal 2025 is EXPECTED to be  between $1.0", "loose": "Revenue for fiscal 2025 is expected to be between $1.0 and $1.2 million dollars", "invented": "we will double sales in two years",
              "missing": " -- "}
    rows = [("T", n, "a" if n < 4 else "none", "m", "FY", 1.0, 2.0, q) for n, q in enumerate([*quotes.values(), quotes["verbatim"], None, "expected"])]
    texts = spark.createDataFrame([("a", text), ("z", None)], "accession string, text string")
    rows[6] = (*rows[6][:2], "a", *rows[6][3:])
    checked = G.quote_check(spark.createDataFrame(rows, GUIDE), texts)
    assert [r.quoted for r in checked.orderBy("filing_no").collect()] == [*quotes, "invented", "missing", "verbatim"]
    assert {r.filing_no: r.status for r in G.guidance_diff(checked).collect()} == {1: "unchanged", 2: "unclear", 3: "unclear", 4: "unclear", 5: "unclear", 6: "unclear"}
