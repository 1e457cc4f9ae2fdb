import random

import pytest
from helpers import one
from pyspark.sql import functions as F

from talus.operators import memory as R
from talus.operators import scenarios as S
from talus.operators import validate as V

SCEN = "entity_id int, sample int, horizon string, scenario_case string, weight double, metric string, multiple double, value double, falsifier string, justification string"
GOOD = "inventory days above 95 in the report for the spring quarter"
MET = "entity_id int, shares double, net_debt double, ebitda_ttm double, revenue_ttm double, net_income_ttm double, fcf_ttm double, equity double"


#: A sound grid prices each case at MULTIPLE * VALUE / SHARES.
MULTIPLE, VALUE, SHARES = 14.0, 3.2e8, 80e6
PRICE = MULTIPLE * VALUE / SHARES


def grid(**over):
    rows = {}
    for h in ("1", "3"):
        for c, weight in (("bear", 0.3), ("base", 0.45), ("bull", 0.25)):
            rows[h, c] = dict(weight=weight, metric="EV/EBITDA", multiple=MULTIPLE, value=VALUE, falsifier=GOOD, justification="")
    for key, patch in over.items():
        for hc, r in rows.items():
            if key in ("all", f"h{hc[0]}", f"{hc[1]}{hc[0]}"):
                r.update(patch)
    return rows


def scen(spark, rows, sample=1):
    return spark.createDataFrame([(1, sample, h, c, *r.values()) for (h, c), r in rows.items()], SCEN)


def metrics(spark, shares=SHARES, net_debt=0.0, revenue=None):
    return spark.createDataFrame([(1, shares, net_debt, None, revenue, None, None, None)], MET)


def verdict(spark, **over):
    row = dict(entity_id=1, insufficient=False, cause="thesis_breaking", n_cause_sources=1, n_key_facts=1) | over
    return spark.createDataFrame([tuple(row.values())], "entity_id int, insufficient boolean, cause string, n_cause_sources int, n_key_facts int")


def broken(spark, rows, m=None, price=None, bands=None, street=None, **v):
    mk = lambda x, s: None if x is None else spark.createDataFrame(x, s)
    ctx = V.context(
        scen(spark, rows), verdict(spark, **v), m, mk(bands, "entity_id int, metric string, p25 double, p75 double"),
        mk(None if price is None else [(1, price)], "entity_id int, price double"), mk(street, "entity_id int, street_revenue_1y double"),
    )
    return {(r.rule, r.detail) for r in V.scenario_violations(ctx).collect()}


def names(x):
    return {r for r, _ in x}


def test_prices_and_anchors_against_plain_ones(spark):
    rnd, rows, companies = random.Random(6), [], []
    for i in range(80):
        companies.append((i, rnd.choice([4.0e7, 2.5e8, 0.0, None]), rnd.choice([-2e8, 0.0, 9e8, None])))
        for h in ("1", "3"):
            for c in ("bear", "base", "bull"):
                metric = rnd.choice(["EV/EBITDA", "EV/Sales", "P/E", "P/S", "P/FCF", "P/B", "none"])
                rows.append((i, 1, h, c, rnd.choice([0.0, 0.2, 0.35, 0.6]), metric, rnd.choice([0.5, 3.0, 17.0]), rnd.choice([6e7, 8e8, -1e8]), GOOD, ""))
    m = spark.createDataFrame([(i, s, d, None, None, None, None, None) for i, s, d in companies], MET)
    out = S.implied_price(spark.createDataFrame(rows, SCEN), m)
    got = {(r.entity_id, r.horizon, r.scenario_case): r.implied for r in out.collect()}
    want, of = {}, {i: (s, d) for i, s, d in companies}
    for i, _, h, c, _, metric, multiple, value, *_ in rows:
        shares, debt = of[i]
        total = None if metric == "none" else multiple * value
        if total is not None and metric.startswith("EV/"):
            total -= debt or 0.0  # unknown debt counts as none here; the gate excludes it later
        want[i, h, c] = total / shares if shares and total is not None and total > 0 else None
    unpriced = {k for k, v in want.items() if v is None or v < 0.005}
    assert {k for k, v in got.items() if v is None or v < 0.005} == unpriced and len(unpriced) < len(want)
    assert all(got[k] == pytest.approx(v, abs=0.00501) for k, v in want.items() if k not in unpriced)
    anchors = {(r.entity_id, r.horizon): r.anchor for r in S.weighted_anchor(out).collect()}
    plain = {}
    for i, _, h, c, w, *_ in rows:
        if w > 0 and got[i, h, c] is not None:
            weight, blend = plain.get((i, h), (0, 0))
            plain[i, h] = weight + w, blend + w * got[i, h, c]
    assert anchors.keys() == plain.keys() and all(anchors[k] == pytest.approx(p / w, abs=0.00501) for k, (w, p) in plain.items())


def test_entry_price(spark):
    rows = [(37.5, 1), (37.5, 3), (0.0, 1), (-4.0, 3), (None, 1)]
    got = [r[0] for r in spark.createDataFrame(rows, "e double, y int").select(S.entry_price(F.col("e"), F.col("y"))).collect()]
    assert got[2:] == [None, None, None]
    assert all(price * 1.15**years == pytest.approx(estimate, abs=0.01) for price, (estimate, years) in zip(got[:2], rows))


def test_good_grid_raises_nothing(spark):
    assert broken(spark, grid()) == set()


def test_vague_falsifier(spark):
    assert ("vague", "1y bear") in broken(spark, grid(bear1=dict(falsifier="the shares regain their momentum")))


def test_incomplete_grid(spark):
    rows = grid()
    for k in (("3", "base"), ("3", "bull")):
        rows.pop(k)
    assert "grid" in names(broken(spark, rows))


def test_bear_far_above_price(spark):
    assert "bear" in names(broken(spark, grid(), metrics(spark), PRICE / 2))
    assert "bear" not in names(broken(spark, grid(), metrics(spark), PRICE * 0.95))


def test_guidance_as_the_bar(spark):
    text = "orders of the autumn quarter fall short of management's outlook"
    assert ("guidance_bar", "1y base") in broken(spark, grid(base1=dict(falsifier=text)))
    assert "guidance_bar" not in names(broken(spark, grid(bear1=dict(falsifier=text))))


def test_weights_sum_to_one(spark):
    assert broken(spark, grid(h1=dict(weight=0.45))) == {("weights", "1y")}


def test_incoherent_horizons(spark):
    rows = grid(h1=dict(metric="P/S", multiple=30.0), h3=dict(metric="P/S", multiple=5.0))
    assert "coherence" in names(broken(spark, rows, metrics(spark)))


def test_multiple_must_fade(spark):
    assert ("fade", "base") in broken(spark, grid(base3=dict(multiple=MULTIPLE * 1.17)))
    assert "fade" not in names(broken(spark, grid(base3=dict(multiple=MULTIPLE * 1.09))))


def test_band_and_justification(spark):
    bands = [(1, "EV/EBITDA", MULTIPLE * 1.8, MULTIPLE * 2.6)]
    assert "band_low" in names(broken(spark, grid(), bands=bands))
    assert "band_low" not in names(broken(spark, grid(all=dict(justification="x" * 40)), bands=bands))
    assert "band_high" in names(broken(spark, grid(all=dict(multiple=MULTIPLE * 2.6 * 1.7, justification="x" * 40)), bands=bands))


def test_tether_and_street(spark):
    rows = grid(all=dict(metric="EV/Sales", multiple=1.0))
    assert "ttm_tether" in names(broken(spark, rows, metrics(spark, revenue=VALUE / 90)))
    assert ("street", "1y bear") in broken(spark, rows, street=[(1, VALUE * 2.1)])
    assert ("street", "3y bear") not in broken(spark, rows, street=[(1, VALUE * 2.1)])


def test_priceable_only_with_evidence(spark):
    rows = grid(all=dict(metric="none"))
    assert "priceable" in names(broken(spark, rows, metrics(spark)))
    assert "priceable" not in names(broken(spark, rows, metrics(spark), insufficient=True))


def quotes(spark, *texts):
    return spark.createDataFrame([(1, str(i), t) for i, t in enumerate(texts)], "entity_id int, quote_id string, quote string")


def test_verdict_rules(spark):
    rules = lambda *q, **v: {r.rule for r in V.verdict_rules(verdict(spark, **v), quotes(spark, *q)).collect()}
    assert rules("a long verbatim quotation") == set()
    assert rules("   n/a   ") == {"quote"}
    assert rules("a long verbatim quotation", n_cause_sources=0) == {"class_sources"}
    assert rules("a long verbatim quotation", n_cause_sources=0, cause="insufficient_evidence") == set()
    assert rules("a long verbatim quotation", n_key_facts=0) == {"keyfacts"}


def test_unknown_source_is_listed_once(spark):
    claims = spark.createDataFrame(
        [(1, "key_fact", "revenue", "raised"), (1, "cause", "0009-99", "raised"), (1, "key_fact", "0009-99", "raised"), (1, "cause", "0001-26", "raised"),
         (1, "cause", "prior:2026-01-02", "raised"), (1, "guidance", "gone", "none_given"), (1, "guidance", "", "raised")],
        "entity_id int, kind string, source string, guidance_change string")
    docs = spark.createDataFrame([(1, "0001-26")], "entity_id int, accession string")
    priors = spark.sql("SELECT 1 AS entity_id, DATE '2026-01-02' AS run_date")
    assert [r.source for r in V.val_citations(claims, docs, priors).collect()] == ["0009-99"]


def votes(spark, labels):
    return spark.createDataFrame([(1, i, x, f"s{i}") for i, x in enumerate(labels)], "entity_id int, vote_no int, label string, secondary string")


@pytest.mark.parametrize("labels, winner, share", [(["s", "s", "m"], "s", 2 / 3), (["a", "a", "a"], "a", 1), (["b", "a"], "b", 0.5), (["x", "y", "y", "x"], "x", 0.5)])
def test_majority(spark, labels, winner, share):
    r = one(S.majority_vote(votes(spark, labels), ["entity_id"]))
    assert (r["winner"], r["agreement"]) == (winner, share)
    assert one(S.winner_secondary(votes(spark, labels), ["entity_id"]))["secondary"] == f"s{labels.index(winner)}"


def test_hash_is_stable_and_sees_new_filings(spark):
    fp = spark.createDataFrame([(1, "abc")], "entity_id int, facts string")
    docs = lambda *a: spark.createDataFrame([(1, x) for x in a], "entity_id int, accession string")
    h = lambda df, **k: one(R.bundle_hash(df, fp, "14", **k))["hash"]
    assert h(docs("a", "b")) == h(docs("b", "a", "a")) and len(h(docs("a"))) == 24
    assert h(docs("a", "b")) != h(docs("a", "c"))
    note = spark.createDataFrame([(1, "objection")], "entity_id int, extra string")
    assert h(docs("a"), extra=note) != h(docs("a"))


def test_ensemble_takes_medians_of_like_metrics(spark):
    rows = []
    for sample, metric, mult in ((1, "P/E", 10.0), (2, "P/E", 20.0), (3, "P/S", 99.0)):
        rows.append((1, sample, "1", "base", 0.5, metric, mult, 1e9, GOOD, ""))
    rows.append((1, 1, "1", "bull", 0.25, "P/B", 7.0, 1e9, GOOD, ""))
    got = {r.scenario_case: (r.multiple, r.n_peers) for r in S.ensemble_median(spark.createDataFrame(rows, SCEN)).collect()}
    assert got == {"base": (15, 2), "bull": (7, 1)}
