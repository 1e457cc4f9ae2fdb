"""A close of zero: what divides by it is infinite or no number, as in the SQL twins, and ends no run."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E

KEYS = ("drop_triggers", "liquidity_floors", "month_return", "overflow_report", "positive_lookup", "screen_funnel",
        "sector_exclude", "severity_topk", "trigger_rank", "watchlist", "month_prefilter", "funnel_cube")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v if math.isinf(v) else round(v, 9) + 0.0
    return float(v) if hasattr(v, "as_tuple") else str(v) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def zeros(sf, tmp_path_factory):
    """The given events over fewer users; some users' closes are zero on the day before the last, on the
    first day of the month's window, on all days."""
    where = tmp_path_factory.mktemp("zeros")
    for f in os.listdir(sf):
        if f != "events.parquet":
            os.symlink(f"{sf}/{f}", where / f)
    con = duckdb.connect()
    con.execute(f"""COPY (WITH e AS (SELECT * REPLACE (event_id % 20 AS user_id) FROM '{sf}/events.parquet'),
        d AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY ts::DATE DESC) AS k, dense_rank() OVER (PARTITION BY user_id ORDER BY ts::DATE) AS f FROM e)
        SELECT event_id, ts, user_id, event_type, CASE WHEN user_id % 5 = 1 AND k = 2 OR user_id % 5 = 2 AND k BETWEEN 18 AND 40 OR user_id = 13 OR user_id % 5 = 4 AND k <= 2 THEN 0.0 ELSE value END AS value, props
        FROM d) TO '{where}/events.parquet' (FORMAT parquet)""")
    for t in E.registry.importlib.import_module("talus.checks.roles").TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet'")
    return str(where), con


@pytest.mark.parametrize("key", KEYS)
def test_zero_close(spark, zeros, key):
    where, con = zeros
    df = E.queries()[key](spark, where)
    got = sorted((tuple(map(plain, r)) for r in df.collect()), key=str)
    want = sorted((tuple(map(plain, r)) for r in con.execute(f"SELECT {', '.join(df.columns)} FROM ({E.oracle_sql()[key]})").fetchall()), key=str)
    assert got == want


def test_zero_close_is_reached(spark, zeros):
    where, _ = zeros
    odd = [r["day_change"] for r in E.registry.Tables(spark, where)("fx_quotes").collect() if r["day_change"] is not None]
    assert any(math.isinf(x) for x in odd) and any(math.isnan(x) for x in odd)
