import random
from datetime import date, timedelta

from talus.operators import budget as B

D0 = date(2024, 1, 1)


def plain(pieces, budget, least):
    out, used, over = {}, {}, set()
    for b, p, tier, filed, n in sorted(pieces, key=lambda x: (x[2], -(x[3] or date.min).toordinal(), x[1])):
        left = budget - used.get(b, 0)
        if b not in over and n <= left:
            out[b, p] = ("kept", n)
            used[b] = used.get(b, 0) + n
        elif b not in over and left >= least:
            out[b, p] = ("partial", left)
            over.add(b)
        else:
            out[b, p] = ("dropped" if n or b in over else "kept", 0)
            over.add(b)
    return out


def test_equals_one_piece_at_a_time(spark):
    rnd = random.Random(6)
    pieces = [(rnd.choice([1, 1, 2, 3]), i, rnd.randrange(3), D0 + timedelta(rnd.randrange(200)) if rnd.random() < 0.95 else None, rnd.randrange(1, 400)) for i in range(300)]
    df = spark.createDataFrame(pieces, "bundle_id int, piece_id int, tier int, filed_at date, tokens int")
    for budget in (500, 5000, 10**6):
        told = B.within_budget(df, budget, 50)
        got = {(r.bundle_id, r.piece_id): (r.status, r.kept_tokens) for r in told.collect()}
        assert got == plain(pieces, budget, 50)
        for r in B.budget_record(told).collect():
            assert r.kept_tokens <= budget and r.kept_tokens + r.dropped_tokens == r.tokens == sum(p[4] for p in pieces if p[0] == r.bundle_id)
            assert r.kept_pieces + r.partial_pieces + r.dropped_pieces == sum(p[0] == r.bundle_id for p in pieces) and r.partial_pieces <= 1


def test_cut_texts_and_odd_pieces(spark):
    df = spark.createDataFrame([(1, 1, 0, D0, "alpha beta gamma delta"), (1, 2, 1, D0, "x" * 30), (1, 3, 0, None, None), (2, 4, 0, D0, "")], "bundle_id int, piece_id int, tier int, filed_at date, text string")
    told = B.within_budget(df.withColumn("tokens", B.estimated_tokens("text")), 4, 1)
    assert {r.piece_id: (r.status, r.kept_tokens) for r in told.collect()} == {1: ("partial", 4), 2: ("dropped", 0), 3: ("dropped", 0), 4: ("kept", 0)}
    assert {r.piece_id: r.text for r in B.cut_texts(told).collect()} == {1: "alpha beta", 4: ""}
