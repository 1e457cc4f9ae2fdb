"""Landed files to results, and the loop from scoring back to the gate."""

import json

from talus.checks.registry import Tables
from talus.operators import filings as FO
from talus.operators import prices as Q
from talus.operators import series as S
from talus.plans import flows
from talus.sources import gold, landing


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_readers(spark, tmp_path):
    uni = put(tmp_path / "u.json", json.dumps({"0": {"cik_str": 1, "ticker": "AA", "title": "A"}, "1": {"cik_str": 1, "ticker": "AA-B", "title": "A"}, "2": {"cik_str": 2, "ticker": "bad", "title": "B"}}))
    assert [tuple(r) for r in FO.universe_dedup(landing.read_universe(spark, uni)).collect()] == [(1, "AA", "A")]

    fact = {"start": "2025-01-01", "end": "2025-03-31", "val": 5, "accn": "x", "form": "10-Q", "filed": "2025-05-01", "fy": 2025}
    doc = {"cik": 7, "entityName": "E", "facts": {"us-gaap": {"Revenues": {"label": "l", "units": {"USD": [fact, {**fact, "val": 6, "filed": "2025-06-01"}]}}}}}
    put(tmp_path / "facts" / "a.json", json.dumps(doc))
    facts = S.facts_explode(landing.read_company_facts(spark, str(tmp_path / "facts")))
    q = S.quarterly_series(S.choose_tags(facts, S.concept_dim(spark)))
    assert [(r.entity_id, r.concept, r.val) for r in q.collect()] == [(7, "revenue", 6.0)]

    sub = {"cik": "7", "name": "E", "sic": "1", "sicDescription": "d", "filings": {"recent": {
        "accessionNumber": ["a", "b"], "form": ["8-K", "10-K"], "filingDate": ["2026-01-02", "2026-01-01"], "primaryDocument": ["p", ""], "items": ["2.02,,9.01", ""]}}}
    put(tmp_path / "subs" / "a.json", json.dumps(sub))
    rows = FO.filings_explode(landing.read_submissions(spark, str(tmp_path / "subs"))).orderBy("pos").collect()
    assert [(r.accession, r.form, str(r.filed_at), r["items"]) for r in rows] == [("a", "8-K", "2026-01-02", ["2.02", "9.01"]), ("b", "10-K", "2026-01-01", [])]

    quotes = put(tmp_path / "q.json", json.dumps({"symbol": "AA", "regularMarketPrice": 9.5, "regularMarketChangePercent": -20, "extra": 1}) + "\n" + json.dumps({"marketCap": 1}))
    r = Q.quote_normalize(landing.read_quotes(spark, quotes)).collect()
    assert len(r) == 1 and (r[0].price, r[0].day_change, r[0].market_cap, r[0].avg50, r[0].currency) == (9.5, -0.2, 0.0, None, "")

    bars = put(tmp_path / "b.json", json.dumps({"symbol": "AA", "quotes": [{"date": "2026-01-02T14:30:00Z", "close": 3.0}, {"date": "2026-01-03T14:30:00Z", "close": None}]}))
    assert [(r.symbol, str(r.bar_date), r.close) for r in Q.bars_clean(landing.read_bars(spark, bars)).collect()] == [("AA", "2026-01-02", 3.0)]

    est = put(tmp_path / "e.json", json.dumps({"symbol": "AA", "earningsTrend": {"trend": [{"period": "0y", "earningsEstimate": {"avg": 2.0}}, {"period": "+1y", "revenueEstimate": {"avg": 9.0}, "earningsEstimate": {"avg": 2.5}}]}}))
    from talus.operators.economics import eps_growth

    assert [(r.street_revenue_1y, r.eps_growth_pct) for r in eps_growth(landing.read_estimates(spark, est)).collect()] == [(9.0, 25.0)]


def test_a_run_replaces_only_its_own_day(spark, tmp_path):
    path = str(tmp_path / "gold")
    for day, n in (("2026-01-01", 3), ("2026-01-02", 2), ("2026-01-01", 5)):
        gold.write_run(spark.range(n), path, day)
    assert gold.read_runs(spark, path).count() == 7
    assert gold.read_runs(spark, path, "2026-01-02").count() == 2


def test_nightly_and_weekly_loop(spark, sf, tmp_path):
    t = Tables(spark, sf)
    keep = lambda df, name: gold.materialize(df, name, str(tmp_path / "shared"))
    f = flows.Fundamentals.from_facts(t("fx_facts"), keep=keep)
    closes = t("fx_bars_m")
    bundles = keep(flows.bundle(f, closes, t("fx_estimates"), keep=keep), "bundles")
    targets = bundles.selectExpr("entity_id", "price AS street_target")
    none = spark.sql("SELECT 0L AS n, CAST(NULL AS DOUBLE) AS mean_error_pct WHERE false")
    no_class = spark.sql("SELECT '' AS classification, 0L AS n, CAST(NULL AS DOUBLE) AS mean_error_pct WHERE false")
    guard0 = spark.sql("SELECT 0D AS extra_discount")
    first = flows.gated(bundles, t("fx_verdicts"), t("fx_scenarios"), targets, (none, no_class), guard0)
    week = flows.weekly(t("fx_ledger"), t("fx_bars_s"), 0, t("fx_filings"), t("fx_grades"), "2001-11-05", keep=keep)
    second = flows.gated(bundles, t("fx_verdicts"), t("fx_scenarios"), targets, week["calibration"], week["guard"])
    a = {r.entity_id: r for r in first.collect()}
    b = {r.entity_id: r for r in second.collect()}
    assert a.keys() == b.keys() and len(a) == t("supplier").count()
    assert not any(r.calibration_active for r in a.values()) and all(r.calibration_active for r in b.values())
    assert all(b[k].effective is None or b[k].effective <= a[k].effective for k in a)
    assert week["ledger"].count() == t("fx_ledger").count()
    assert f.bands(bundles, closes).filter("p25 > p50 OR p50 > p75").count() == 0


def test_screen_flow(spark, sf):
    t = Tables(spark, sf)
    from talus.checks.registry import queries

    got = {r.symbol for r in flows.screen(t("fx_universe"), t("fx_quotes"), t("fx_bars_d"), t("fx_sectors"), "2024-01-31").collect()}
    assert got == {r.symbol for r in queries()["severity_topk"](spark, sf).collect()}


def test_a_later_week_leaves_earlier_grades_alone(spark, sf, tmp_path):
    """Weekly at two dates: what the first run gave is unchanged after the second one, which sees other
    prices, and only what became due is new."""
    from pyspark.sql import functions as F

    from talus.operators.scoring import GRADED

    t = Tables(spark, sf)
    keep = lambda df, name: gold.materialize(df, name, str(tmp_path / name / as_of))
    fresh = t("fx_ledger").drop(*GRADED)
    bars = t("fx_bars_s")
    as_of = "1999-06-01"
    one = flows.weekly(fresh, bars.filter(f"bar_date < '{as_of}'"), 0, t("fx_filings"), t("fx_grades"), as_of, keep=keep)["ledger"]
    as_of = "2001-11-05"
    two = flows.weekly(one, bars.withColumn("close", F.col("close") * (1 + F.col("symbol") % 3)), 0, t("fx_filings"), t("fx_grades"), as_of, keep=keep)["ledger"]
    assert one.columns == two.columns and len(set(two.columns)) == len(two.columns)
    rows = {(r.ticker, r.run_date): r for r in one.collect()}
    gained = 0
    for r in two.collect():
        before = rows[r.ticker, r.run_date]
        for flag, values in {"has_drift30": ["drift30"], "has_drift90": ["drift90"], "has_1y": ["return_1y", "valuation_error_pct", "bench_return_1y"], "has_3y": ["return_3y"]}.items():
            if before[flag]:
                assert r[flag] and [r[v] for v in values] == [before[v] for v in values]
            else:
                gained += r[flag]
                assert all(before[v] is None for v in values)
    assert gained > 100 and sum(r.has_1y for r in rows.values()) > 100


def test_a_night_from_gate_to_memory_and_again(spark, sf, tmp_path):
    """The whole night twice for one day and once for the next: rows of a day are replaced, names of the
    first night are held back by the cooldown of the second one."""
    import uuid

    from pyspark.sql import functions as F

    from talus.operators import memory as R
    from talus.operators import scenarios as SC

    t = Tables(spark, sf)
    keep = lambda df, name: gold.materialize(df, f"{name}-{uuid.uuid4().hex[:6]}", str(tmp_path / "shared"))
    f = flows.Fundamentals.from_facts(t("fx_facts"), keep=keep)
    bundles = keep(flows.bundle(f, t("fx_bars_m"), t("fx_estimates"), keep=keep), "bundles")
    ids = bundles.select("entity_id", "price")
    rows = ids.selectExpr("entity_id", "price", "'sentiment' AS classification", "'wide' AS moat", "'t' AS thesis", "price * 2 AS fair", "price * 2 AS fair_adjusted", "true AS calibration_active",
                          "50D AS undervaluation_pct", "1D AS implied_growth_pct", "2D AS street_growth_pct", "3D AS epv_per_share", "4D AS street_target", "entity_id % 2 = 0 AS pass")
    merged = SC.implied_price(SC.merged_scenarios(t("fx_scenarios"), t("fx_verdicts")), bundles)
    assert merged.groupBy("entity_id", "horizon", "scenario_case").count().filter("count > 1").count() == 0
    ranking = ids.selectExpr("entity_id", "entity_id AS rank")
    documents = FO.bundle_documents(t("fx_filings"), "2024-01-31")
    hashes = ids.selectExpr("entity_id", "'h1' AS hash")
    feedback = spark.createDataFrame([], "update_id long, ts timestamp, ticker long, run_date string, up boolean")
    state = spark.createDataFrame([], "ticker long, last_digest_date date, hash string")
    ledger = t("fx_ledger").select("ticker", "run_date", "classification", "ref_price", "fair", "hash", "note")

    def night(day, predictions, cooldown, digests=hashes):
        out = flows.nightly(day, rows, bundles, merged, ranking, documents, digests, predictions, cooldown, feedback)
        return {k: keep(df, k) for k, df in out.items()}

    admitted = rows.filter("pass").count()
    one = night("2026-01-05", ledger, state)
    again = night("2026-01-05", one["predictions"], one["cooldown"])
    for name, key in (("digest", "entity_id"), ("predictions", "ticker"), ("cooldown", "ticker"), ("performance", "entity_id"), ("snapshots", "entity_id")):
        assert sorted(map(str, one[name].orderBy(key).collect())) == sorted(map(str, again[name].orderBy(key).collect())), name
    assert one["digest"].count() == admitted > 0 and one["predictions"].count() == ledger.count() + admitted
    assert one["predictions"].filter("run_date = '2026-01-05' AND ref_price IS NOT NULL AND bear <= bull").count() > 0
    two = night("2026-01-06", again["predictions"], again["cooldown"])
    assert two["digest"].count() == 0  # digested yesterday, nothing new filed
    three = night("2026-01-06", again["predictions"], again["cooldown"], hashes.withColumn("hash", F.lit("h2")))
    assert three["digest"].count() == admitted and three["digest"].filter("seen_date = '2026-01-05'").count() == admitted
    assert three["cooldown"].filter("hash = 'h2' AND last_digest_date = '2026-01-06'").count() == admitted
    later = flows.look_snapshot(bundles.withColumn("price", F.col("price") * 1.1), documents)
    changes = {r.change for r in R.look_diff(one["snapshots"].drop("run_date"), later).collect()}
    assert changes == {"price"}
    week = flows.weekly(three["predictions"], t("fx_bars_s"), 0, t("fx_filings"), t("fx_grades"), "2026-06-01", keep=keep, universe=ids.selectExpr("entity_id AS ticker"))
    # No bars reach that far: the new calls are noted for manual work, and noted ones are not due.
    assert week["ledger"].count() == three["predictions"].count() and week["ledger"].filter("run_date >= '2026-01-05' AND note IS NOT NULL").count() == 2 * admitted
    assert week["due"].count() == 0
