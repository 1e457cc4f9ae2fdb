"""Mined rows against a search through all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.llm import hard_negatives

RELABEL = "CASE WHEN id % 7 = 0 THEN (label + 1) % 10 ELSE label END"


def plain(rows, every=100, low=80, high=100):
    kept = {}
    for i, label, v in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            whole = (label, [math.floor(256 * x) for x in v])
            kept[i] = min(kept.get(i, whole), whole)
    kept = {i: ((label + 1) % 10 if i % 7 == 0 else label, v) for i, (label, v) in kept.items()}
    out = []
    for a in sorted(i for i in kept if i % every == 0):
        scored = sorted((-sum(x * y for x, y in zip(kept[a][1], v)), i) for i, (_, v) in kept.items() if i != a)
        own = [(i, -s) for s, i in scored if kept[i][0] == kept[a][0]][:5]
        for p, ps in own:
            inside = [(i, -s) for s, i in scored if kept[i][0] != kept[a][0] and low * ps <= -100 * s <= high * ps][:5]
            out += [(a, p, r, i, ps, s) for r, (i, s) in enumerate(inside, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 7) for i, label, v in rows], "vec_id long, embedding array<float>, label int, score int")


def result(spark, rows, every=100):
    df = hard_negatives.mine(frame(spark, rows), F.col("id") % every == 0, F.expr(RELABEL))
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in df.collect())


def made(n, seed, labels=10):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 6))
    return [(int(i), int(rng.integers(labels)), (centres[i % 5] + rng.normal(scale=0.4, size=6)).tolist()) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_search_through_all_rows(spark, seed, monkeypatch):
    rows = made(500, seed)
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 90)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 7)
    monkeypatch.setattr(hard_negatives, "SCORES", 200)
    assert result(spark, rows, every=20) == plain(rows, every=20)


def test_ties_and_a_frequent_vector(spark):
    """A third of all rows hold one vector, and whole small values make most scores tie."""
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(10)), (rng.integers(-1, 3, 4) / 4).tolist()) for i in range(300)]
    rows += [(1000 + i, i % 10, [0.5, 0.5, 0.5, 0.5]) for i in range(150)]
    assert result(spark, rows, every=25) == plain(rows, every=25)


def test_negative_and_zero_positive_scores(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [-1.0, 0.0]), (2, 1, [0.0, 1.0]), (3, 2, [0.0, -1.0]), (4, 2, [-2.0, 0.0]), (5, 3, [0.0, 0.0])]
    assert result(spark, rows) == plain(rows) != []


def test_odd_rows(spark):
    good = made(60, 9, labels=3)
    odd = [(100, None, [1.0] * 6), (200, 1, None), (300, 1, [None] * 6), (400, 1, [float("nan")] * 6), (500, 1, [float("inf")] * 6), (None, 1, [1.0] * 6), (600, 1, [1.0]), (700, 1, [])]
    twice = [good[3], good[3], (good[4][0], 0, good[5][2])]
    assert result(spark, good + odd + twice, every=10) == plain([r for r in good + odd + twice if r[0] not in (600, 700)], every=10)
    assert result(spark, odd[:6]) == []


def test_given_table(spark, sf):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert result(spark, rows) == plain(rows)


def test_best_keeps_order_and_ties():
    scores = np.array([[5, 9, 9, 1, 9], [0, 0, 0, 0, 0]])
    wanted = np.array([[True, True, False, True, True], [False, True, True, False, True]])
    row, col = hard_negatives.best(scores, wanted, 2)
    assert list(zip(row.tolist(), col.tolist())) == [(0, 1), (0, 4), (1, 1), (1, 2)]
