"""Grading past predictions and the rollups that feed the next run.

predictions: ticker, run_date (unique together), classification, ref_price, fair, bear, bull,
graded, note, and what earlier runs have recorded: drift30, drift90, return_1y, bench_return_1y,
valuation_error_pct, return_3y, with has_drift30, has_drift90, has_1y and has_3y telling that the
grade was given, be it null. A grade is given once; a run fills only what is due and still open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.columns import exact_avg, js_round
from talus.operators import asof, ranking

GATES = {"due30": 30, "due90": 90, "due1y": 365, "due3y": 1095}


def prediction_age(predictions: DataFrame, as_of) -> DataFrame:
    age = F.datediff(F.lit(as_of).cast("date"), "run_date")
    return predictions.withColumn("age_days", age).select("*", *[(F.col("age_days") >= d).alias(n) for n, d in GATES.items()])


def grading_due(predictions: DataFrame, universe: DataFrame, as_of) -> DataFrame:
    """Old enough, not graded, not resolved otherwise, and still in the universe."""
    due = prediction_age(predictions, as_of).filter(F.col("due90") & ~F.col("graded") & F.col("note").isNull())
    return due.join(universe.select("ticker"), "ticker", "left_semi")


def returns_of(pairs: DataFrame, bars: DataFrame, out: str = "ret", until=None) -> DataFrame:
    """Return of each (symbol, since): first close on or after ``since`` to the newest close (up to
    ``until``, where given); no
    row with fewer than two closes. Bars hold one row per symbol and day. The newest close is
    one row per symbol and the first one comes from a forward as-of join, so dates and bars are
    never paired up."""
    if until is not None:
        bars = bars.filter(F.col("bar_date") <= F.lit(until).cast("date"))
    last = bars.groupBy("symbol").agg(F.max_by("close", "bar_date").alias("_last"), F.max("bar_date").alias("_last_date"))
    first = asof.forward(pairs, bars, ["symbol"], "since", "bar_date", "close", "_first")
    return first.join(last, "symbol").filter("_first_date < _last_date").select(
        "symbol", "since", (F.col("_last") / F.col("_first") - 1).alias(out)
    )


def return_since(asks: DataFrame, bars: DataFrame, out: str = "ret") -> DataFrame:
    """Adds the return since ``since`` of ``symbol``. The distinct pairs are answered first and
    go back by both keys, which spreads a symbol asked about very often over its dates."""
    answers = returns_of(asks.select("symbol", "since").distinct(), bars, out)
    return asks.join(answers, ["symbol", "since"], "left").select(*asks.columns, out)


def with_returns(predictions: DataFrame, bars: DataFrame, benchmark, until=None) -> DataFrame:
    """Adds ``stock_ret`` and ``bench_ret``, up to ``until`` where given. One as-of pass answers the tickers and the
    benchmark, the latter once per run date."""
    both = F.explode(F.array(F.col("ticker"), F.lit(benchmark).cast(predictions.schema["ticker"].dataType)))
    answers = returns_of(predictions.select(both.alias("symbol"), F.col("run_date").alias("since")).distinct(), bars, until=until)
    stock = answers.select(F.col("symbol").alias("ticker"), F.col("since").alias("run_date"), F.col("ret").alias("stock_ret"))
    bench = answers.groupBy(F.col("since").alias("run_date")).agg(
        F.max(F.when(F.col("symbol") == benchmark, F.col("ret"))).alias("bench_ret")
    )
    return (
        predictions.join(stock, ["ticker", "run_date"], "left").join(bench, "run_date", "left")
        .select(*predictions.columns, "stock_ret", "bench_ret")
    )


GRADED = {
    "drift30": "double", "drift90": "double", "return_1y": "double", "bench_return_1y": "double", "valuation_error_pct": "double", "return_3y": "double",
    "has_drift30": "boolean", "has_drift90": "boolean", "has_1y": "boolean", "has_3y": "boolean",
}


def with_grades(predictions: DataFrame) -> DataFrame:
    """Adds the columns of grades that a fresh ledger lacks; unknown flags mean open."""
    missing = {c: F.lit(None).cast(t) for c, t in GRADED.items() if c not in predictions.columns}
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c, t in GRADED.items() if t == "boolean"}
    return predictions.withColumns(missing).withColumns(flags)


def _open_drift() -> Column:
    return (F.col("due30") & ~F.col("has_drift30")) | (F.col("due90") & ~F.col("has_drift90"))


def benchmark_drift(returns: DataFrame, as_of) -> DataFrame:
    """Stock minus benchmark, filled once at 30 and at 90 days. Returns run to the newest close; where
    one of them is missing the grade stays open."""
    drift = js_round(F.col("stock_ret") - F.col("bench_ret"), 4)
    out = prediction_age(with_grades(returns), as_of)
    for days in (30, 90):
        due = F.col(f"due{days}") & ~F.col(f"has_drift{days}") & drift.isNotNull()
        out = out.withColumn(f"drift{days}", F.when(due, drift).otherwise(F.col(f"drift{days}"))).withColumn(f"has_drift{days}", F.col(f"has_drift{days}") | due)
    return out


MANUAL_DELISTED = "delisting form found, resolve the deal price manually"
MANUAL_GONE = "no price history, resolve manually"
AUTO_BANKRUPT = "auto: bankruptcy filing, realized zero"


def _resolution() -> tuple[Column, Column]:
    """(settled at zero by a bankruptcy, note) of a name without price history."""
    broke = F.coalesce(F.col("action") == "bankruptcy", F.lit(False))
    note = F.when(broke, AUTO_BANKRUPT).otherwise(
        F.coalesce("note", F.when(F.col("action") == "delisted", MANUAL_DELISTED).otherwise(MANUAL_GONE))
    )
    return broke, note


def dead_ticker_resolution(returns: DataFrame, actions: DataFrame, as_of) -> DataFrame:
    """Names without price history while a drift is open: a bankruptcy filing settles them at -100 %,
    unless the year is graded already; a delisting or nothing leaves a note for manual work.
    ``actions``: ticker, run_date, action."""
    dead = prediction_age(with_grades(returns), as_of).filter(_open_drift() & F.col("stock_ret").isNull())
    j = dead.join(actions.select("ticker", "run_date", "action"), ["ticker", "run_date"], "left")
    broke, note = _resolution()
    settles = broke & ~F.col("has_1y")
    return j.select(
        "ticker", "run_date", "action",
        F.when(settles, -1.0).otherwise(F.col("return_1y")).alias("return_1y"),
        F.when(settles & (F.col("fair") != 0), -100.0).otherwise(F.col("valuation_error_pct")).alias("valuation_error_pct"),
        note.alias("note"),
    )


def _error(realized: Column) -> Column:
    return (realized - F.col("fair")) / F.col("fair")


def market_adjusted_error(returns: DataFrame, as_of, zero_is_null: bool = False) -> DataFrame:
    """One-year return and the error of the fair value after taking the market's move out, given once
    when the year is over; an unknown benchmark counts as flat, an unknown return is a null grade.
    ``zero_is_null`` drops an exactly flat return."""
    r = js_round("stock_ret", 4)
    if zero_is_null:
        r = F.nullif(r, F.lit(0.0))
    due = F.col("due1y") & ~F.col("has_1y")
    aged = prediction_age(with_grades(returns), as_of).withColumn("return_1y", F.when(due, r).otherwise(F.col("return_1y")))
    adj = F.col("ref_price") * (1 + F.col("return_1y")) / (1 + F.coalesce("bench_ret", F.lit(0.0)))
    ok = F.col("return_1y").isNotNull() & (F.col("fair") != 0)
    return aged.withColumns({
        "valuation_error_pct": F.when(due, F.when(ok, js_round(_error(adj) * 100, 4))).otherwise(F.col("valuation_error_pct")),
        "bench_return_1y": F.when(due, F.when(ok, js_round("bench_ret", 4))).otherwise(F.col("bench_return_1y")),
        "has_1y": F.col("has_1y") | due,
    })


def return_3y(returns: DataFrame, as_of) -> DataFrame:
    aged = prediction_age(with_grades(returns), as_of)
    due = F.col("due3y") & ~F.col("has_3y")
    return aged.withColumn("return_3y", F.when(due, js_round("stock_ret", 4)).otherwise(F.col("return_3y"))).withColumn("has_3y", F.col("has_3y") | due)


def manual_resolution(returns: DataFrame, overrides: DataFrame) -> DataFrame:
    """Apply realised prices given by hand: ticker, run_date, price, note."""
    o = overrides.select("ticker", "run_date", F.col("price").alias("_p"), F.col("note").alias("_n"))
    j = returns.join(o, ["ticker", "run_date"])
    adj = F.col("_p") / (1 + F.coalesce("bench_ret", F.lit(0.0)))
    return j.select(
        "ticker", "run_date",
        F.when(F.col("ref_price") > 0, js_round(F.col("_p") / F.col("ref_price") - 1, 4)).alias("return_1y"),
        F.when(F.col("fair") > 0, F.floor(_error(adj) * 1000 + 0.5).cast("double") / 10).alias("valuation_error_pct"),
        F.coalesce("_n", F.concat(F.lit("manually resolved at $"), F.col("_p").cast("decimal(20,2)").cast("string"))).alias("note"),
    )


def scored(predictions: DataFrame, bars: DataFrame, benchmark, actions: DataFrame, as_of, until=None) -> DataFrame:
    """The ledger with every open and due outcome filled in, in one pass: the columns of the
    predictions and all grades, each once. Running it again changes nothing that was given."""
    ledger = with_grades(predictions)
    base = with_returns(ledger, bars, benchmark, until).join(actions.select("ticker", "run_date", "action"), ["ticker", "run_date"], "left")
    # A bankruptcy settles the year first; what it settles is then no longer open.
    dead = _open_drift() & F.col("stock_ret").isNull()
    broke, note = _resolution()
    settles = dead & broke & ~F.col("has_1y")
    aged = prediction_age(base, as_of).withColumn("_settles", settles).withColumns({
        "note": F.when(dead, note).otherwise(F.col("note")),
        "return_1y": F.when(F.col("_settles"), -1.0).otherwise(F.col("return_1y")),
        "valuation_error_pct": F.when(F.col("_settles") & (F.col("fair") != 0), -100.0).otherwise(F.col("valuation_error_pct")),
        "bench_return_1y": F.when(F.col("_settles"), F.col("bench_ret")).otherwise(F.col("bench_return_1y")),
        "has_1y": F.col("has_1y") | F.col("_settles"),
    }).drop("age_days", *GATES)
    for step in (benchmark_drift, market_adjusted_error, return_3y):
        aged = step(aged, as_of).drop("age_days", *GATES)
    return aged.select(*ledger.columns)


# --- rollups ---------------------------------------------------------------------------


def class_drift(ledger: DataFrame) -> DataFrame:
    """Per class the count and mean drift in percent."""
    d = F.coalesce("drift90", "drift30")
    return (
        ledger.filter(d.isNotNull()).groupBy("classification")
        .agg(F.count("*").alias("n"), (F.floor(exact_avg(d, 4) * 1000 + 0.5).cast("double") / 10).alias("avg_pct"))
    )


def base_rate(analyses: DataFrame, drift: DataFrame, min_n: int = 10) -> DataFrame:
    """The class mean beside each analysis, only from enough samples."""
    shown = drift.filter(F.col("n") >= min_n).select("classification", F.col("n").alias("base_n"), F.col("avg_pct").alias("base_rate_pct"))
    # One row for each label of a fixed list.
    return analyses.join(F.broadcast(shown), "classification", "left")


def feedback_rate(feedback: DataFrame) -> DataFrame:
    up = F.count_if("up")
    return feedback.agg(F.count("*").alias("taps"), up.alias("ups"), js_round(F.try_divide(up, F.count("*")) * 100).alias("up_pct"))


def falsifier_rollup(grades: DataFrame) -> DataFrame:
    """Counts by status and the fired share among decided grades."""
    n = lambda s: F.count_if(F.col("status") == s)
    decided = n("fired") + n("survived")
    return grades.agg(
        F.count("*").alias("graded"), n("fired").alias("fired"), n("survived").alias("survived"), n("uncheckable").alias("uncheckable"),
        decided.alias("n"), js_round(F.try_divide(n("fired"), decided), 3).alias("fired_share"),
    )


def falsifier_align(scenarios: DataFrame, grades: DataFrame) -> DataFrame:
    """Each scenario with the grade given under its label, brackets ignored; a scenario the
    judge did not return is uncheckable. Of several grades the last counts."""
    label = F.trim(F.regexp_replace("scenario", r"[\[\]]", ""))
    g = grades.withColumn("label", label).groupBy("ticker", "run_date", "label").agg(F.max_by("status", "pos").alias("_s"))
    return scenarios.join(g, ["ticker", "run_date", "label"], "left").select(
        *scenarios.columns, F.coalesce("_s", F.lit("uncheckable")).alias("status")
    )


def upper_median(df: DataFrame, value: str, out: str = "median") -> DataFrame:
    """One row: the exact element at floor(n/2) of the sorted values, null for no values. Equal values
    shrink to counts, and the counts are added up along ranges of values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    upto = ranking.running_over_all(counts, [F.col("v")], F.col("c"), "upto", "n")
    return upto.filter(F.col("upto") > F.floor(F.col("n") / 2)).agg(F.min("v").alias(out))


def calibration_overall(ledger: DataFrame) -> DataFrame:
    """One row: n, mean error and upper median at 1 dp."""
    done = ledger.filter("valuation_error_pct IS NOT NULL")
    med = upper_median(done, "valuation_error_pct")
    return done.agg(F.count("*").alias("n"), js_round(exact_avg(F.col("valuation_error_pct"), 4), 1).alias("mean_error_pct")).withColumn(
        "median_error_pct", js_round(med.scalar(), 1)
    )


def calibration_by_class(ledger: DataFrame) -> DataFrame:
    return ledger.filter("valuation_error_pct IS NOT NULL").groupBy("classification").agg(
        F.count("*").alias("n"), js_round(exact_avg(F.col("valuation_error_pct"), 4), 6).alias("mean_error_pct")
    )


def calibration_rollup(ledger: DataFrame) -> DataFrame:
    """Overall and per-class rows; the overall one has no class."""
    overall = calibration_overall(ledger).withColumn("classification", F.lit(None).cast("string"))
    per = calibration_by_class(ledger).withColumn("median_error_pct", F.lit(None).cast("double"))
    return overall.unionByName(per)


def band_hit_rate(ledger: DataFrame) -> DataFrame:
    """How many realised prices fell between bear and bull; no return counts as flat."""
    realized = F.col("ref_price") * (1 + F.coalesce("return_1y", F.lit(0.0)))
    done = ledger.filter("valuation_error_pct IS NOT NULL")
    return done.agg(F.count("*").alias("n"), F.count_if(realized.between(F.col("bear"), F.col("bull"))).alias("in_band"))


def unresolved_count(ledger: DataFrame, fixed: bool = False) -> DataFrame:
    """Notes that mention manual work. ``fixed`` leaves out the ones already resolved."""
    hit = F.contains(F.col("note"), F.lit("manual"))
    if fixed:
        hit = hit & ~F.contains(F.col("note"), F.lit("manually resolved"))
    return ledger.agg(F.count_if(hit).alias("unresolved"))


def scoring_summary(ledger: DataFrame, grades: DataFrame, feedback: DataFrame) -> DataFrame:
    """One-row rollup of a scoring run; the parts meet as scalars, not as a join."""
    fr = falsifier_rollup(grades).select(F.struct("graded", "uncheckable", "fired_share").alias("s")).scalar()
    fb = feedback_rate(feedback).select("up_pct").scalar()
    hit = F.contains(F.col("note"), F.lit("manual"))
    realized = F.col("ref_price") * (1 + F.coalesce("return_1y", F.lit(0.0)))
    err = F.col("valuation_error_pct")
    return ledger.agg(
        F.count("*").alias("predictions"), F.count_if(hit).alias("unresolved"), F.count(err).alias("calibrated"),
        js_round(exact_avg(err, 4), 1).alias("mean_error_pct"),
        F.count_if(err.isNotNull() & realized.between(F.col("bear"), F.col("bull"))).alias("in_band"),
    ).select("*", fr.alias("_f"), fb.alias("up_pct")).select("*", "_f.*").drop("_f")


def audit_ledger(ledger: DataFrame, grades: DataFrame) -> DataFrame:
    """All predictions with outcomes and graded counts, by date."""
    counts = grades.groupBy("ticker", "run_date").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("fired", "survived", "uncheckable")]
    )
    pct = lambda c: js_round(F.col(c) * 100, 1).alias(f"{c}_pct")
    return (
        ledger.join(counts, ["ticker", "run_date"], "left")
        .select("run_date", "ticker", "classification", "ref_price", "fair", pct("drift30"), pct("drift90"), pct("return_1y"),
                "valuation_error_pct", "fired", "survived", "uncheckable", F.coalesce("note", F.lit("")).alias("note"))
        .orderBy("run_date", "ticker")
    )
