"""The exchange calendar, from its rules, and arithmetic in sessions.

A calendar is one row per day between two years, so its size is fixed by the years asked for. Sessions
are numbered without gaps; "n sessions later" is then an addition and an equi join.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Holidays of the US exchanges and the first year each was kept. A holiday on a Sunday is
# kept on Monday, one on a Saturday on Friday, except New Year's Day, which is not moved back into the old year.
FIXED = (("New Year's Day", 1, 1, 0), ("Juneteenth", 6, 19, 2022), ("Independence Day", 7, 4, 0), ("Christmas Day", 12, 25, 0))
# (name, month, weekday counted from Monday, which one: 1 to 4, or -1 for the last, first year)
FLOATING = (("Martin Luther King Jr. Day", 1, 0, 3, 1998), ("Washington's Birthday", 2, 0, 3, 0), ("Memorial Day", 5, 0, -1, 0),
            ("Labor Day", 9, 0, 1, 0), ("Thanksgiving Day", 11, 3, 4, 0))
# Unscheduled closures, as (first day, last day).
CLOSURES = ((date(1994, 4, 27), date(1994, 4, 27)), (date(2001, 9, 11), date(2001, 9, 14)), (date(2004, 6, 11), date(2004, 6, 11)), (date(2007, 1, 2), date(2007, 1, 2)),
            (date(2012, 10, 29), date(2012, 10, 30)), (date(2018, 12, 5), date(2018, 12, 5)), (date(2025, 1, 9), date(2025, 1, 9)))


def easter(year: int) -> date:
    """Sunday after the first full moon of spring: the moon from the 19-year cycle and the century's
    corrections, then on to Sunday."""
    century, golden = year // 100, year % 19
    skipped, lunar = century - century // 4, (8 * century + 13) // 25
    age = (19 * golden + skipped - lunar + 15) % 30
    age -= (age == 29) or (age == 28 and golden > 10)
    moon = date(year, 3, 21) + timedelta(age)
    return moon + timedelta(6 - moon.weekday() or 7)


def nth(year: int, month: int, weekday: int, n: int) -> date:
    if n < 0:
        end = date(year + month // 12, month % 12 + 1, 1) - timedelta(1)
        return end - timedelta((end.weekday() - weekday) % 7)
    first = date(year, month, 1)
    return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))


def holidays(year: int) -> dict[date, str]:
    """Weekdays without trading, by rule."""
    out = {easter(year) - timedelta(2): "Good Friday"}
    for name, month, weekday, n, since in FLOATING:
        if year >= since:
            out[nth(year, month, weekday, n)] = name
    for name, month, day, since in FIXED:
        on = date(year, month, day)
        if year < since or on.weekday() == 5 and (month, day) == (1, 1):
            continue
        out[on + timedelta({5: -1, 6: 1}.get(on.weekday(), 0))] = name
    return out


def calendar(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """day, session (whether there is trading), holiday (name or null), and the number of the last
    session up to the day and of the first one from it on; numbers begin with 0 at the first session."""
    named = {d: n for y in range(first_year, last_year + 1) for d, n in holidays(y).items()}
    for a, b in CLOSURES:
        named.update({a + timedelta(i): "closed" for i in range((b - a).days + 1) if first_year <= a.year <= last_year})
    # One row per holiday, at most a dozen a year.
    closed = spark.createDataFrame(sorted(named.items()), "day date, holiday string")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(date(first_year, 1, 1)), F.lit(date(last_year, 12, 31)))).alias("day"))
    marked = days.join(F.broadcast(closed), "day", "left").withColumn("session", (F.weekday("day") < 5) & F.col("holiday").isNull())
    # Sessions are numbered inside their year, and years by what came before: a row per year.
    years = marked.groupBy(F.year("day").alias("y")).agg(F.count_if("session").alias("n"), F.sort_array(F.collect_list(F.struct("day", "session", "holiday"))).alias("days"))
    sizes = F.sort_array(F.collect_list(F.struct("y", "n")))
    before = F.aggregate(F.filter(F.col("sizes"), lambda s: s["y"] < F.col("y")), F.lit(0).cast("bigint"), lambda a, s: a + s["n"])
    numbered = years.join(F.broadcast(years.agg(sizes.alias("sizes"))), F.lit(True)).select("days", before.alias("before"))
    placed = numbered.select("days", "before", F.posexplode("days").alias("i", "d"))
    upto = F.size(F.filter(F.slice("days", 1, F.col("i") + 1), lambda x: x["session"])) + F.col("before")
    return placed.select("d.day", "d.session", "d.holiday", (upto - 1).alias("last_no"), (upto - F.when(F.col("d.session"), 1).otherwise(0)).alias("next_no"))


def session_days(cal: DataFrame) -> DataFrame:
    return cal.filter("session").select(F.col("last_no").alias("session_no"), F.col("day").alias("session_day"))


def _number(df: DataFrame, cal: DataFrame, day: str, which: str, out: str) -> DataFrame:
    return df.join(F.broadcast(cal.select(F.col("day").alias("_day"), F.col(which).alias(out))), F.col(day) == F.col("_day"), "left").drop("_day")


def _day(df: DataFrame, cal: DataFrame, number: Column, out: str) -> DataFrame:
    days = F.broadcast(session_days(cal).select(F.col("session_no").alias("_no"), F.col("session_day").alias(out)))
    return df.withColumn("_want", number).join(days, F.col("_want") == F.col("_no"), "left").drop("_want", "_no")


def sessions_later(df: DataFrame, cal: DataFrame, day: str, n: int, out: str) -> DataFrame:
    """Adds ``out``: the session ``n`` sessions after the day (before it, if negative). 0 is the day itself,
    or the first session after a day without one; -1 the last session before. Null outside the calendar."""
    d = _number(df, cal, day, "next_no", "_from")
    return _day(d, cal, F.col("_from") + n, out).drop("_from")


def sessions_between(df: DataFrame, cal: DataFrame, start: str, end: str, out: str) -> DataFrame:
    """Adds ``out``: the sessions after ``start`` up to and including ``end``; negative if end lies before."""
    d = _number(_number(df, cal, start, "last_no", "_a"), cal, end, "last_no", "_b")
    return d.withColumn(out, F.col("_b") - F.col("_a")).drop("_a", "_b")


def months_later(df: DataFrame, cal: DataFrame, day: str, months: int, out: str) -> DataFrame:
    """Adds ``out``: the first session from the day ``months`` calendar months later on (the last day of
    a shorter month)."""
    return sessions_later(df.withColumn("_then", F.add_months(day, months)), cal, "_then", 0, out).drop("_then")


def is_session(day: date) -> bool:
    """Whether there is trading on a day."""
    return day.weekday() < 5 and day not in holidays(day.year) and not any(a <= day <= b for a, b in CLOSURES)
