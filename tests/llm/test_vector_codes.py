"""Codes against plain Lloyd rounds over all pairs."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from talus.llm import vector_codes


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """rows: (id, label, vector or None). Every distance, in Python's whole numbers."""
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, label, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], ""
    size = len(kept[0][2]) // parts
    first, books = sorted({i: v for i, _, v in kept}.items())[:entries], []
    codes = []
    for p in range(parts):
        own = [v[p * size : (p + 1) * size] for _, _, v in kept]
        book = [v[p * size : (p + 1) * size] for _, v in first]
        for step in range(rounds + 1):
            near = [min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(book)) for x in own]
            if step == rounds:
                break
            for j in {j for _, j in near}:
                members = [x for x, (_, n) in zip(own, near) if n == j]
                book[j] = [sum(c) // len(members) for c in zip(*members)]
        books.append(book)
        codes.append(near)
    errors = [sum(codes[p][n][0] for p in range(parts)) for n in range(len(kept))]
    per_label = {}
    for (_, label, _), e in zip(kept, errors):
        per_label[label] = per_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((i, "".join(f"{codes[p][n][1]:02x}" for p in range(parts)), errors[n], per_label[label], digest) for n, (i, label, _) in enumerate(kept)), digest


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x") for i, label, v in rows], "vec_id long, embedding array<float>, label int, code string")


def result(df):
    return sorted(tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def test_equals_plain_rounds(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 16))
    rows = [(int(i) * 3, int(i) % 4 if i % 11 else None, (centres[i % 9] + rng.normal(scale=0.2, size=16)).astype(np.float32).tolist()) for i in rng.permutation(700)]
    assert result(vector_codes.compress(frame(spark, rows), entries=20)) == plain(rows, entries=20)[0]
    assert result(vector_codes.compress(frame(spark, rows))) == plain(rows)[0]


def test_ties_and_repeated_vectors(spark):
    """Few whole values: most distances tie, entries start equal, and unused ones must stay."""
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, (rng.integers(-2, 3, 8) / 1024).tolist()) for i in range(400)]
    rows += [(1000 + i, 1, rows[0][2]) for i in range(300)] + [rows[5], rows[5]]
    for n in (1, 7, 64):
        assert result(vector_codes.compress(frame(spark, rows), entries=n)) == plain(rows, entries=n)[0]


def test_odd_rows(spark):
    rows = [(1, 0, None), (2, 0, [1.0, None, 1.0, 1.0]), (3, 0, [float("nan")] * 4), (4, 0, [float("inf")] * 4), (5, None, [0.0] * 4), (6, 2, [0.5, -0.25, 0.1, 3.0]), (7, None, [0.5, 0.0, 0.0, 0.0]), (8, 1, [1.0, 2.0]), (9, 1, [])]
    found = result(vector_codes.compress(frame(spark, rows)))
    assert [r[0] for r in found] == [5, 6, 7]
    assert found == plain([r for r in rows if r[0] != 8])[0]
    assert result(vector_codes.compress(frame(spark, rows[:4]))) == []
    assert result(vector_codes.compress(frame(spark, [(None, 1, [0.5] * 4), (None, 2, [0.5] * 4)])))[0][2] == 0
    far = result(vector_codes.compress(frame(spark, [(1, 1, [3e38, 0.0, 0.0, 0.0]), (2, 1, [-3e38, 0.0, 0.0, 0.0])]), entries=1))
    assert all(r[2] >= 0 for r in far)


def test_blocks_and_trees_agree_with_all_distances():
    rng = np.random.default_rng(0)
    for n, k, w in ((1, 1, 3), (5, 256, 2), (3000, 100, 4), (900, 7, 1)):
        x, book = rng.integers(-50, 50, (n, w)), rng.integers(-50, 50, (k, w))
        near, sums, counts = np.full(n, -1), np.zeros_like(book), np.zeros(k, dtype=np.int64)
        vector_codes.assign(vector_codes.Boxes(x, 16), vector_codes.Boxes(book, 1), near, sums, counts)
        want = ((x[:, None] - book[None]) ** 2).sum(2).argmin(1)
        assert (near == want).all()
        assert (counts == np.bincount(want, minlength=k)).all()
        assert all((sums[j] == x[want == j].sum(0)).all() for j in range(k))


def test_given_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.label, r.embedding) for r in df.collect()]
    assert result(vector_codes.compress(df.withColumn("code", F.lit("a")).withColumn("error", F.lit(1)))) == plain(rows)[0]
