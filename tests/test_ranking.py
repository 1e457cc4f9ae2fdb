import random

from pyspark.sql import functions as F

from talus.operators import ranking as R


def test_ranks_and_tiles_over_parts(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([0.5, 0.5, 0.5, rnd.random(), -rnd.random()])) for i in range(997)]
    df = spark.createDataFrame(rows, "id int, v double").repartition(7)
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    got = {r.id: (r.rank, r.of) for r in R.global_rank(df, [F.col("v"), F.col("id")]).collect()}
    assert got == {i: (k, 997) for k, (i, _) in enumerate(order, 1)}
    for n in (1, 10, 996, 997, 2000):
        tiles = {r.id: r.tile for r in R.global_ntile(df, [F.col("v"), F.col("id")], n).collect()}
        want, sizes = {}, [997 // n + (k < 997 % n) for k in range(n)]
        at = 0
        for k, size in enumerate(sizes, 1):
            want.update({i: k for i, _ in order[at : at + size]})
            at += size
        assert tiles == want
    down = {r.id: r.rank for r in R.global_rank(df, [F.col("v").desc(), F.col("id").desc()]).collect()}
    assert down == {i: 998 - k for k, (i, _) in enumerate(order, 1)}


def test_places_and_running_totals(spark):
    df = spark.createDataFrame([(i, 100 - i) for i in range(100)], "id int, v int")
    got = {r.place: r.v for r in R.nth_values(df, [F.col("v")], "v", [1, 50, -1, 101, -101]).collect()}
    assert got == {1: 1, 50: 50, -1: 100}
    totals = {r.v: (r.upto, r.all) for r in R.running_over_all(df, [F.col("v")], F.col("v"), "upto", "all").collect()}
    assert totals == {v: (v * (v + 1) // 2, 5050) for v in range(1, 101)}
    assert R.global_rank(df.limit(0), [F.col("v")]).count() == 0


def test_no_window_without_a_partition(spark):
    plan = R.global_rank(spark.range(50), [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window " in x]
    assert windows and all("_part" in w for w in windows) and "NestedLoop" not in plan


def test_calibration_reads_its_ledger_few_times(spark, sf):
    import __spark_entry__ as E

    plan = E.queries()["calibration_rollup"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    assert plan.count("Exchange ") < 20
    assert all("_part" in w for w in plan.splitlines() if "Window " in w)
