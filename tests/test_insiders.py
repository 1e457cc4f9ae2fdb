import random
from datetime import date, timedelta

from talus.operators import insiders as I
from talus.sources import landing

D0 = date(2024, 1, 1)


def buys(spark, rows):
    return spark.createDataFrame([(e, o, D0 + timedelta(d), 10.0, 2.0) for e, o, d in rows], "entity_id bigint, owner bigint, day date, shares double, price double")


def in_window(rows, entity, day, days=30):
    return len({o for e, o, d in rows if e == entity and day - days < d <= day})


def test_distinct_insiders_in_any_window(spark):
    rnd = random.Random(2)
    rows = [(1 if rnd.random() < 0.5 else rnd.randrange(2, 5), rnd.randrange(8), rnd.randrange(400)) for _ in range(300)]
    by_day = {(r.entity_id, (r.day - D0).days): r.insiders for r in I.insider_activity(buys(spark, rows)).collect()}
    for e in {r[0] for r in rows}:
        now = 0
        for day in range(0, 440):
            now = by_day.get((e, day), now)
            assert now == in_window(rows, e, day), (e, day)
    for r in I.insider_clusters(buys(spark, rows)).collect():
        best = max(range(440), key=lambda d: (in_window(rows, r.entity_id, d), -d))
        assert (r.insiders, (r.peak_day - D0).days) == (in_window(rows, r.entity_id, best), best)
        assert r.value == 20.0 * sum(e == r.entity_id and best - 30 < d <= best for e, _, d in rows) and r.cluster == (r.insiders >= 3)


def test_edges_of_the_window(spark):
    asks = spark.createDataFrame([(1, D0 + timedelta(d)) for d in (-1, 0, 29, 30)] + [(2, D0), (None, D0)], "entity_id bigint, day date")
    got = {(r.entity_id, (r.day - D0).days): (r.insiders, r.cluster) for r in I.insider_flags(asks, buys(spark, [(1, 1, 0), (1, 2, 0), (1, 3, 0), (1, 3, 1)])).collect()}
    assert got[1, -1] == (0, False) and got[1, 0] == (3, True) and got[1, 29] == (3, True) and got[1, 30] == (1, False) and got[2, 0] == (0, False)


XML = """<?xml version="1.0"?><ownershipDocument><issuer><issuerCik>0000320193</issuerCik></issuer>
<reportingOwner><reportingOwnerId><rptOwnerCik>0001</rptOwnerCik><rptOwnerName>A B</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>true</isDirector></reportingOwnerRelationship></reportingOwner>
<reportingOwner><reportingOwnerId><rptOwnerCik>0002</rptOwnerCik></reportingOwnerId></reportingOwner>
<nonDerivativeTable><nonDerivativeTransaction><transactionDate><value>2024-03-01</value></transactionDate><transactionCoding><transactionCode>P</transactionCode></transactionCoding>
<transactionAmounts><transactionShares><value>100</value></transactionShares><transactionPricePerShare><value>9.5</value></transactionPricePerShare><transactionAcquiredDisposedCode><value>A</value></transactionAcquiredDisposedCode></transactionAmounts></nonDerivativeTransaction>
<nonDerivativeHolding><x>1</x></nonDerivativeHolding></nonDerivativeTable></ownershipDocument>"""


def test_nested_documents(spark, tmp_path):
    (tmp_path / "acc-1.xml").write_text(XML)
    (tmp_path / "acc-2.xml").write_text("<ownershipDocument><issuer><issuerCik>7</issuerCik></issuer></ownershipDocument>")
    (tmp_path / "acc-3.xml").write_text("not a document")
    docs = landing.read_form4(spark, str(tmp_path))
    rows = I.form4_explode(docs.unionByName(docs)).collect()
    assert sorted((r.accession, r.entity_id, r.owner, r.is_director, str(r.day), r.shares, r.price) for r in rows) == [
        ("acc-1", 320193, 1, True, "2024-03-01", 100.0, 9.5), ("acc-1", 320193, 2, False, "2024-03-01", 100.0, 9.5)]
    assert I.insider_buys(I.form4_explode(docs)).count() == 2


def test_texts_are_read_before_they_are_exchanged(spark):
    docs = spark.createDataFrame([("a", XML), ("a", XML)], "accession string, xml string")
    rows = I.form4_explode(docs)
    once = I.form4_explode(docs.limit(1)).count()
    assert rows.count() == once > 0
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("from_xml") and plan.count("from_xml") == 1
