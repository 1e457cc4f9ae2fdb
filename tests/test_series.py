"""Series operators against a plain model over generated filings: fiscal years of any start, direct and
cumulative periods, restatements, equal filing dates, rival periods for one end."""

import random
from collections import defaultdict
from datetime import date, timedelta

import pytest

from talus import params as P
from talus.operators import series as S
from talus.params import DEFAULTS

RAW = "entity_id string, taxonomy string, tag string, unit string, unit_no int, p_start date, p_end date, val double, accn string, form string, filed date, pos int"
QUARTER, ANNUAL = DEFAULTS.series.quarter_days, DEFAULTS.series.annual_days


def filings(seed, years=7):
    """(start, end, val, filed) in file order."""
    rnd = random.Random(seed)
    out, begin = [], date(2012, rnd.randint(1, 12), rnd.randint(1, 28))
    for _ in range(years):
        ends, at = [], begin
        for _ in range(4):
            at += timedelta(days=rnd.choice([84, 90, 91, 92, 98, 104]))
            ends.append(at)
        starts = [begin, *[e + timedelta(days=1) for e in ends[:3]]]
        for i, e in enumerate(ends):
            if rnd.random() < 0.6:
                out.append((starts[i], e))
            if rnd.random() < 0.7:
                out.append((begin, e))
            if rnd.random() < 0.15:  # a rival period with the same end
                out.append((starts[i] + timedelta(days=rnd.randint(-6, 6)), e))
        begin = ends[3] + timedelta(days=1)
    rows = [(s, e, float(rnd.randint(-50, 400)), date(2020, 1, 1) + timedelta(days=rnd.randint(0, 3))) for s, e in out for _ in range(rnd.choice([1, 1, 2, 3]))]
    rnd.shuffle(rows)
    return rows


def reduced(rows):
    """(start, end) -> (val, first place), the latest filed and of these the first one."""
    best, first = {}, {}
    for pos, (s, e, v, filed) in enumerate(rows):
        first.setdefault((s, e), pos)
        if (s, e) not in best or filed > best[s, e][1]:
            best[s, e] = (v, filed)
    return {k: (best[k][0], first[k]) for k in best}


def model_quarters(rows):
    facts = {k: v for k, v in reduced(rows).items() if QUARTER[0] <= (k[1] - k[0]).days <= ANNUAL[1]}
    by_start, rivals = defaultdict(list), defaultdict(list)
    for (s, e), (v, first) in facts.items():
        by_start[s].append((e, v, first))
        if (e - s).days <= QUARTER[1]:
            rivals[e].append(("direct", -first, s, v))
    for group in by_start.values():
        group.sort()
        seen = min(g[2] for g in group)
        for (e0, v0, _), (e1, v1, _) in zip(group, group[1:]):
            if QUARTER[0] <= (e1 - e0).days <= QUARTER[1]:
                rivals[e1].append(("ytd-diff", seen, e0 + timedelta(days=1), v1 - v0))
    picked = {e: min(r)[:1] + min(r)[2:] for e, r in rivals.items()}
    ends = sorted(picked)[-DEFAULTS.series.keep_quarters :]
    return [(e, picked[e][1], picked[e][2], picked[e][0], len(ends) - i, i + 1) for i, e in enumerate(ends)]


def labelled(spark, per_entity):
    data = [(k, s, e, v, f"{k}{i}", f, i) for k, rows in per_entity.items() for i, (s, e, v, f) in enumerate(rows)]
    raw = spark.createDataFrame(data, "entity_id string, p_start date, p_end date, val double, accn string, filed date, pos int")
    keyed = raw.selectExpr("*", "'revenue' AS concept", "CASE WHEN p_start IS NULL THEN 'instant' ELSE 'duration' END AS kind", "'t' AS tag", "'u' AS unit")
    return S.latest_filed(keyed, ["entity_id", "concept", "kind", "tag", "unit", "p_start", "p_end"])


def test_quarters_equal_the_model(spark):
    entities = {f"e{seed}": filings(seed, 3 + seed % 8) for seed in range(40)}
    got = defaultdict(list)
    for r in S.quarterly_series(labelled(spark, entities)).collect():
        got[r.entity_id].append((r.p_end, r.p_start, r.val, r.derived, r.rn, r.idx))
    want = {k: model_quarters(rows) for k, rows in entities.items()}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    kinds = [x[3] for v in want.values() for x in v]
    assert kinds.count("direct") > 100 and kinds.count("ytd-diff") > 100 and max(map(len, want.values())) == DEFAULTS.series.keep_quarters


def test_differences_equal_the_model(spark):
    entities = {f"e{seed}": filings(seed, 3) for seed in range(100, 115)}
    got = {(r.entity_id, r.p_end, r.val) for r in S.ytd_diff(labelled(spark, entities)).collect()}
    assert got == {(k, e, v) for k, rows in entities.items() for e, _, v, how, _, _ in model_quarters(rows) if how == "ytd-diff"}


def test_years_equal_the_model(spark):
    entities = {f"e{seed}": filings(seed, 9) for seed in range(12)}
    got = {(r.entity_id, r.p_start, r.p_end, r.val, r.rn) for r in S.annual_series(labelled(spark, entities)).collect()}
    want = set()
    for k, rows in entities.items():
        years = [(e, first, s, v) for (s, e), (v, first) in reduced(rows).items() if ANNUAL[0] <= (e - s).days <= ANNUAL[1]]
        years.sort(key=lambda y: (y[0], y[1]), reverse=True)
        want |= {(k, s, e, v, i + 1) for i, (e, _, s, v) in enumerate(years[: DEFAULTS.series.keep_annual])}
    assert got == want


def test_instants_equal_the_model(spark):
    rnd = random.Random(8)
    entities = {f"e{n}": [(None, date(2020, 1, 1) + timedelta(days=90 * rnd.randrange(30)), float(i), date(2025, 1, rnd.randint(1, 3))) for i in range(80)] for n in range(6)}
    got = {(r.entity_id, r.p_end, r.val, r.rn) for r in S.instant_series(labelled(spark, entities)).collect()}
    want = set()
    for k, rows in entities.items():
        newest = sorted(reduced(rows).items(), key=lambda x: x[0][1], reverse=True)[: DEFAULTS.series.keep_quarters]
        want |= {(k, e, v, i + 1) for i, ((_, e), (v, _)) in enumerate(newest)}
    assert got == want


CHAINS = {name: (taxonomy, unit, tags) for name, taxonomy, unit, kind, tags in P.CONCEPTS if kind == "duration" and len(tags) > 1}


def model_choice(rows, concept):
    """rows: (tag, unit, unit place, end) in file order."""
    taxonomy, preferred, chain = CHAINS[concept]
    best = None
    for place, tag in enumerate(chain):
        units = {}
        for pos, (t, u, no, e) in enumerate(rows):
            if t == tag:
                old = units.get(u, (no, pos, e))
                units[u] = (min(old[0], no), min(old[1], pos), max(old[2], e))
        if not units:
            continue
        unit = preferred if preferred in units else min(units, key=lambda u: (*units[u][:2], u))
        newest = units[unit][2]
        if best is None or newest > best[0]:
            best = (newest, tag, unit)
    return best and (best[1], best[2], best[0])


@pytest.mark.parametrize("per_unit_places", [False, True])
def test_tag_and_unit_choice_equal_the_model(spark, per_unit_places):
    """Places may be counted per file, or start anew in each unit as they do in the nested documents."""
    rnd = random.Random(3)
    data, want = [], {}
    for n in range(60):
        concept = rnd.choice(sorted(CHAINS))
        taxonomy, preferred, chain = CHAINS[concept]
        units = rnd.sample(["EUR", "CAD", "GBP", preferred], rnd.randint(1, 4))
        rows = [(rnd.choice(chain[:4]), u := rnd.choice(units), units.index(u), date(2024, rnd.randint(1, 6), 28)) for _ in range(rnd.randint(1, 8))]
        if per_unit_places:
            rows.sort(key=lambda r: r[2])
        seen = defaultdict(int)
        for pos, (t, u, no, e) in enumerate(rows):
            place = seen[t, u] if per_unit_places else pos
            seen[t, u] += 1
            data.append((f"e{n}", taxonomy, t, u, no if per_unit_places else 0, e - timedelta(days=89), e, float(pos), "a", "10-Q", date(2025, 1, 1), place))
        want[f"e{n}", concept] = model_choice([(t, u, no if per_unit_places else 0, e) for t, u, no, e in rows], concept)
    chosen = S.choose_tags(spark.createDataFrame(data, RAW), S.concept_dim(spark))
    got = {(r.entity_id, r.concept): (r.tag, r.unit, r.newest) for r in S.tag_choice(chosen).collect()}
    # Some tags serve several concepts; compare the ones that were generated.
    assert {k: got.get(k) for k in want} == want
    assert chosen.groupBy("entity_id", "concept").agg({"unit": "approx_count_distinct"}).filter("`approx_count_distinct(unit)` > 1").count() == 0


def test_every_concept_has_its_own_chain():
    names = [c[0] for c in P.CONCEPTS]
    assert len(names) == len(set(names)) and all(len(c[4]) == len(set(c[4])) > 0 for c in P.CONCEPTS)


def test_facts_are_read_once_and_dealt_out_by_entity_once(spark, tmp_path):
    rows = [("E", "us-gaap", "Revenues", "USD", date(2024, 1, 1), date(2024, 3, 31), 1.0, "a", "10-Q", date(2024, 5, 1), 0)]
    spark.createDataFrame(rows, "entity_id string, taxonomy string, tag string, unit string, p_start date, p_end date, val double, accn string, form string, filed date, pos int").write.parquet(str(tmp_path / "f"))
    facts = spark.read.parquet(str(tmp_path / "f"))
    chosen = S.choose_tags(facts, S.concept_dim(spark))
    for df in (chosen, S.quarterly_series(chosen), S.annual_series(chosen)):
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("FileScan") == 1
        assert plan.count("Exchange hashpartitioning") <= 3
    assert plan.count("Exchange hashpartitioning") == 2


def test_points_are_the_three_series_from_one_read(spark, tmp_path):
    data = []
    for n in range(8):
        pos = 0
        for s, e, v, filed in filings(40 + n):
            for tag, unit, start in (("Revenues", "USD", s), ("NetIncomeLoss", "EUR", s), ("InventoryNet", "USD", None)):
                data.append((f"e{n}", "us-gaap", tag, unit, 0, start, e, v + len(tag), f"a{pos}", "10-Q", filed, pos))
                pos += 1
    # A concept whose only fact is no quarter still has its tag.
    data.append(("short", "us-gaap", "Revenues", "USD", 0, date(2020, 1, 1), date(2020, 1, 9), 1.0, "a", "10-Q", date(2020, 2, 1), 0))
    spark.createDataFrame(data, RAW).write.parquet(str(tmp_path / "f"))
    chosen = S.choose_tags(spark.read.parquet(str(tmp_path / "f")), S.concept_dim(spark))
    points = S.series_points(chosen)
    for part, whole in zip(S.split_points(points), (S.quarterly_series(chosen), S.instant_series(chosen), S.tag_choice(chosen).select("entity_id", "concept", "tag"))):
        rows = [sorted(map(tuple, df.select(part.columns).collect()), key=str) for df in (part, whole)]
        assert rows[0] == rows[1] and rows[0]
    plan = points._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2


def test_a_short_fact_before_a_longer_one_makes_no_quarter(spark):
    day = date(2023, 1, 1)
    data = []
    for name, lengths in (("short", (30, 120)), ("chain", (30, 90, 181, 272)), ("long", (91, 182, 500))):
        for pos, n in enumerate(lengths):
            data.append((name, "us-gaap", "Revenues", "USD", 0, day, day + timedelta(days=n), float(n), "a", "10-Q", date(2025, 1, 1), pos))
    chosen = S.choose_tags(spark.createDataFrame(data, RAW), S.concept_dim(spark))
    q, _, tags = S.split_points(S.series_points(chosen))
    assert sorted(map(tuple, q.collect())) == sorted(map(tuple, S.quarterly_series(chosen).select(q.columns).collect()))
    assert sorted((r.entity_id, r.val, r.derived) for r in q.collect()) == [
        ("chain", 90.0, "direct"), ("chain", 91.0, "ytd-diff"), ("chain", 91.0, "ytd-diff"), ("long", 91.0, "direct"), ("long", 91.0, "ytd-diff")]
    assert tags.count() == 3


def test_points_take_two_orders_and_five_windows(spark, tmp_path):
    """One order serves the choice of unit and tag and the facts of a start, one the points of a series."""
    rows = [("E", "us-gaap", "Revenues", "USD", 0, date(2024, 1, 1), date(2024, 3, 31), 1.0, "a", "10-Q", date(2024, 5, 1), 0)]
    spark.createDataFrame(rows, RAW).write.parquet(str(tmp_path / "f"))
    points = S.series_points(S.choose_tags(spark.read.parquet(str(tmp_path / "f")), S.concept_dim(spark)))
    plan = points._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert sum(line.lstrip(" :+-*()0123456789").startswith("Window ") for line in plan.splitlines()) == 5
    after = plan[: plan.index("REPARTITION_BY_COL")]
    assert sum(line.lstrip(" :+-*()0123456789").startswith("Sort ") for line in after.splitlines()) == 2
