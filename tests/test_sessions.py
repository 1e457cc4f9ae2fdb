from datetime import date, timedelta

import pytest

from talus.operators import sessions as C
from talus.plans import flows

# Weekdays without trading, as the exchange has published them.
CLOSED = {
    2001: "01-01 01-15 02-19 04-13 05-28 07-04 09-03 09-11 09-12 09-13 09-14 11-22 12-25",
    2021: "01-01 01-18 02-15 04-02 05-31 07-05 09-06 11-25 12-24",
    2022: "01-17 02-21 04-15 05-30 06-20 07-04 09-05 11-24 12-26",
    2023: "01-02 01-16 02-20 04-07 05-29 06-19 07-04 09-04 11-23 12-25",
    2024: "01-01 01-15 02-19 03-29 05-27 06-19 07-04 09-02 11-28 12-25",
    2025: "01-01 01-09 01-20 02-17 04-18 05-26 06-19 07-04 09-01 11-27 12-25",
}


@pytest.fixture(scope="module")
def cal(spark):
    return C.calendar(spark, 2001, 2025).cache()


def test_published_years(cal):
    rows = {r.day: r for r in cal.collect()}
    for year, days in CLOSED.items():
        want = {date.fromisoformat(f"{year}-{d}") for d in days.split()}
        assert {d for d, r in rows.items() if d.year == year and d.weekday() < 5 and not r.session} == want
        assert all(C.is_session(date(year, 1, 1) + timedelta(i)) == rows[date(year, 1, 1) + timedelta(i)].session for i in range(365))


def test_easter():
    assert [C.easter(y) for y in (1954, 1981, 2000, 2008, 2011, 2038, 2049, 2076)] == [date(1954, 4, 18), date(1981, 4, 19), date(2000, 4, 23), date(2008, 3, 23), date(2011, 4, 24),
                                                                                      date(2038, 4, 25), date(2049, 4, 18), date(2076, 4, 19)]


def test_sessions_have_numbers_without_gaps(cal):
    days = sorted((r.session_day, r.session_no) for r in C.session_days(cal).collect())
    assert [n for _, n in days] == list(range(len(days)))
    assert {y: sum(d.year == y for d, _ in days) for y in (2022, 2023, 2024)} == {2022: 251, 2023: 250, 2024: 252}


def test_arithmetic(spark, cal):
    df = spark.createDataFrame([(1, date(2024, 3, 28), date(2024, 4, 1)), (2, date(2024, 3, 29), date(2024, 3, 28)), (3, date(2024, 7, 3), date(2024, 7, 8)), (4, date(1990, 1, 1), None)], "id int, a date, b date")
    later = {r.id: r.x for r in C.sessions_later(df, cal, "a", 1, "x").collect()}
    assert later == {1: date(2024, 4, 1), 2: date(2024, 4, 2), 3: date(2024, 7, 5), 4: None}
    assert {r.id: r.x for r in C.sessions_later(df, cal, "a", -1, "x").collect()}[2] == date(2024, 3, 28)
    assert {r.id: r.x for r in C.sessions_between(df, cal, "a", "b", "x").collect()} == {1: 1, 2: 0, 3: 2, 4: None}
    assert {r.id: r.x for r in C.months_later(df, cal, "a", 3, "x").collect()}[1] == date(2024, 6, 28)


def test_a_closed_day_ends_the_run_before_it_reads():
    def run():
        raise AssertionError("read on a holiday")

    assert flows.on_session("2024-03-29", run) == {} and flows.on_session(date(2024, 6, 1), run) == {}
    assert flows.on_session("2024-03-28", lambda: {"digest": 1}) == {"digest": 1}
