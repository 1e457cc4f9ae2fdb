"""Joins of overlapping ranges against every pair."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from talus.operators import intervals as V
from talus.operators import screen as S


def overlap(a, b):
    lo = max(x for x in (a[0], b[0], -10**15) if x is not None)
    hi = min(x for x in (a[1], b[1], 10**15) if x is not None)
    whole = all(None in r or r[0] <= r[1] for r in (a, b))
    return whole and lo <= hi


def made(seed, n, key=lambda r: r.choice([1, 1, 1, 2, None])):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lo = rnd.choice([rnd.randrange(-2000, 2000), rnd.randrange(-5, 5), None if rnd.random() < 0.1 else 0])
        size = rnd.choice([0, 0, 1, 2, 7, 8, 9, 300, 4000, -1])
        out.append((i, key(rnd), lo, None if rnd.random() < 0.05 or lo is None and rnd.random() < 0.5 else (lo or 0) + size))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_every_pair(spark, seed):
    left, right = made(seed, 150), made(seed + 50, 150)
    a = spark.createDataFrame(left, "a int, k int, a_lo int, a_hi int")
    b = spark.createDataFrame(right, "b int, k int, b_lo bigint, b_hi bigint")
    want = sorted((x[0], y[0]) for x in left for y in right if x[1] is not None and x[1] == y[1] and overlap(x[2:], y[2:]))
    joined = V.overlap_join(a, b, ["k"], ("a_lo", "a_hi"), ("b_lo", "b_hi"))
    assert joined.columns == ["a", "k", "a_lo", "a_hi", "b", "b_lo", "b_hi"]
    assert sorted((r.a, r.b) for r in joined.collect()) == want
    hit = {x for x, _ in want}
    assert sorted(r.a for r in V.overlap_join(a, b, ["k"], ("a_lo", "a_hi"), ("b_lo", "b_hi"), "left_semi").collect()) == sorted(hit)
    rest = V.overlap_join(a, b, ["k"], ("a_lo", "a_hi"), ("b_lo", "b_hi"), "left_anti")
    assert sorted(r.a for r in rest.collect()) == sorted({x[0] for x in left} - hit)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_crowded_cell_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 10)
    left, right = made(7, 120, lambda r: 1), made(57, 90, lambda r: 1)
    a = spark.createDataFrame(left, "a int, k int, a_lo int, a_hi int")
    b = spark.createDataFrame(right, "b int, k int, b_lo int, b_hi int")
    got = sorted((r.a, r.b) for r in V.overlap_join(a, b, ["k"], ("a_lo", "a_hi"), ("b_lo", "b_hi")).collect())
    assert got == sorted((x[0], y[0]) for x in left for y in right if overlap(x[2:], y[2:]))
    mine = lambda df, lo, hi: V._cells(V._sides(df, lo, hi), [12])
    x, y = V._blocks(mine(a, "a_lo", "a_hi"), mine(b, "b_lo", "b_hi"), ["k", "_at", "_cell"])
    group = ["k", "_at", "_cell", "_row", "_col"]
    assert max(r["count"] for df in (x, y) for r in df.groupBy(*group).count().collect()) <= 40


def test_touched_or_not_makes_no_pairs(spark):
    """A thousand long ranges a side share one key: a million pairs, of which none is made."""
    a = spark.range(1000).selectExpr("id AS a", "1 AS k", "id AS a_lo", "id + 100000 AS a_hi").unionByName(spark.range(1).selectExpr("-1L AS a", "1 AS k", "-50L AS a_lo", "-40L AS a_hi"))
    b = spark.range(1000).selectExpr("id AS b", "1 AS k", "id AS b_lo", "id + 100000 AS b_hi")
    free = V.overlap_join(a, b, ["k"], ("a_lo", "a_hi"), ("b_lo", "b_hi"), "left_anti")
    assert [r.a for r in free.collect()] == [-1]
    assert "Generate explode" not in free._jdf.queryExecution().optimizedPlan().toString()


def test_dates_open_ends_and_no_keys(spark):
    d = date(2024, 1, 1)
    a = spark.createDataFrame([(1, d, d), (2, d, None), (3, d + timedelta(400), d + timedelta(401)), (4, None, d - timedelta(1))], "a int, f date, t date")
    b = spark.createDataFrame([(1, d - timedelta(9), d), (2, d + timedelta(400), None)], "b int, bf date, bt date")
    got = {(r.a, r.b) for r in V.overlap_join(a, b, [], ("f", "t"), ("bf", "bt")).collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (3, 2), (4, 1)}
    rows = spark.createDataFrame([("x", d), ("x", d + timedelta(30)), ("y", d)], "k string, day date")
    periods = spark.createDataFrame([("x", "old", None, d + timedelta(10)), ("x", "new", d + timedelta(11), None)], "k string, name string, vf date, vt date")
    assert sorted((r.k, r.day.day, r.name) for r in V.valid_at(rows, periods, ["k"], "day", ("vf", "vt")).collect()) == [("x", 1, "old"), ("x", 31, "new")]


def test_few_candidates_whatever_the_lengths(spark):
    """Long ranges are not copied into many cells: a range has at most two cells on each level there is."""
    rnd = random.Random(3)
    rows = [(i, lo := rnd.randrange(10**9), lo + rnd.choice([0, 5, 10**4, 10**8])) for i in range(300)]
    a = spark.createDataFrame(rows, "a bigint, lo bigint, hi bigint")
    levels = [0, 3, 14, 27]
    assert V._cells(V._sides(a, "lo", "hi"), levels).count() <= 300 * 2 * (len(levels) + 1)


def test_what_meets_is_mostly_pairs(spark):
    """Long ranges among short ones of one key: few meet that don't overlap."""
    rnd = random.Random(4)
    longs, shorts = ([(i, lo := rnd.randrange(2500), lo + size) for i in range(400)] for size in (700, 20))
    sides = [V._sides(spark.createDataFrame(rows, "a int, lo int, hi int"), "lo", "hi") for rows in (longs, shorts)]
    levels = [x.select("_level").distinct().collect()[0][0] for x in sides]
    x, y = (V._cells(s, [level]).filter(F.col("_at") == max(levels)) for s, level in zip(sides, reversed(levels)))
    met = x.groupBy("_cell").agg(F.count("*").alias("n")).join(y.groupBy("_cell").agg(F.count("*").alias("m")), "_cell").agg(F.sum(F.col("n") * F.col("m"))).collect()[0][0]
    pairs = sum(overlap(a[1:], b[1:]) for a in longs for b in shorts)
    assert pairs <= met <= 1.4 * pairs


def test_industry_ranges(spark):
    c = spark.createDataFrame([("A",), ("B",), ("C",), ("D",), ("E",)], "symbol string")
    d = date(2020, 1, 1)
    codes = spark.createDataFrame([("A", 6000, d, None), ("B", 6799, d, date(2021, 1, 1)), ("B", 3571, date(2021, 1, 2), None), ("C", 5999, d, None), ("D", 6799, d, None), ("E", None, d, None)],
                                  "symbol string, sic int, valid_from date, valid_to date")
    ranges = spark.createDataFrame([(6000, 6799)], "sic_from int, sic_to int")
    kept = lambda day: sorted(r.symbol for r in S.sic_exclude(c, codes, ranges, day).collect())
    assert kept("2024-01-31") == ["B", "C", "E"]
    assert kept("2020-06-01") == ["C", "E"]
