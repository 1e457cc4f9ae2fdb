"""Removed bytes against a dictionary of all strings."""

import hashlib
import random

import numpy as np
import pytest

from talus.llm import earlier_copies


def plain(docs, length=100):
    """docs: (id, text). Every string of every document, in the order of ids and starts."""
    data = [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t in docs]
    first = {}
    for i, b in data:
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            first[s] = min(first.get(s, (i, p)), (i, p))
    out = []
    for (doc, _), (i, b) in zip(docs, data):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < (i, p):
                gone[p : p + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc, len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def result(spark, docs, length=100):
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in docs], "doc_id long, text string, n_chars long, tag string")
    found = earlier_copies.digests(df, length)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def prose(rng, n, words="the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up".split()):
    return " ".join(rng.choice(words) for _ in range(n))


def corpus(seed):
    rng = random.Random(seed)
    passages = [prose(rng, n) for n in (20, 25, 30, 45, 80)]
    docs = []
    for i in range(60):
        t = prose(rng, rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            cut = rng.randint(0, len(t))
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            t = t[:cut] + p[a : a + rng.randint(60, 400)] + t[cut:]
        docs.append((i * 7 % 61, t))
    docs += [(100, docs[3][1]), (101, docs[3][1] + " more"), (102, docs[8][1][5:] + docs[8][1][:50])]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_dictionary_of_strings(spark, seed, monkeypatch):
    docs = corpus(seed)
    want = plain(docs)
    assert sum(r[2] for r in want) > 3000
    assert result(spark, docs) == want
    # Small chunks, slices and sorts, and names halved down to single strings, change nothing.
    monkeypatch.setattr(earlier_copies, "SLICE", 300)
    monkeypatch.setattr(earlier_copies, "CHUNK", 900)
    monkeypatch.setattr(earlier_copies, "SORTED", 500)
    monkeypatch.setattr(earlier_copies, "MOST", 2)
    assert result(spark, docs) == want


def test_other_lengths(spark):
    docs = corpus(3)[:30]
    for length in (16, 33, 64):
        assert result(spark, docs, length) == plain(docs, length)


def test_periodic_and_short_alphabets(spark):
    rng = random.Random(7)
    docs = [(1, "a" * 1000), (2, "ab" * 300), (3, "a" * 99), (4, "a" * 100), (5, "b" + "a" * 500 + "c"), (6, "abc" * 200 + "x" + "abc" * 150)]
    docs += [(10 + i, "".join(rng.choice("ab") for _ in range(50)) * rng.randint(1, 9)) for i in range(12)]
    assert result(spark, docs) == plain(docs)


def test_passage_many_documents_share(spark, monkeypatch):
    """The border of a passage has as many different blocks as documents; it is halved."""
    rng = random.Random(11)
    passage = prose(rng, 60)
    docs = [(i, prose(rng, 20) + passage + prose(rng, 20)) for i in range(150)]
    monkeypatch.setattr(earlier_copies, "MOST", 20)
    want = plain(docs)
    assert result(spark, docs) == want
    assert all(len(passage) <= r[2] < len(passage) + 60 for r in want if r[0])


def test_odd_rows(spark):
    long = prose(random.Random(2), 60_000)
    same = prose(random.Random(3), 60)
    docs = [(1, None), (2, ""), (3, "short"), (5, long), (6, long[100_000:200_000]), (7, same), (7, same), (7, "x" + same), (8, "日本語の文章です。" * 3 + same), (None, same), (None, "y" + same), (-4, "é" * 80)]
    assert result(spark, docs) == plain(docs)
    assert result(spark, docs[:3]) == plain(docs[:3])
    assert result(spark, docs[:0]) == []


def test_spans_and_kept_bytes(spark):
    same = prose(random.Random(5), 40)
    df = spark.createDataFrame([(1, same), (2, "<<" + same + ">>")], "doc_id long, text string")
    first, second = sorted(earlier_copies.remove_copies(df).collect())
    assert first.removed == [] and bytes(first.kept) == same.encode()
    assert [(s.start, s.end) for s in second.removed] == [(2, 2 + len(same))] and bytes(second.kept) == b"<<>>"


def test_previous_factors_by_definition():
    rng = np.random.default_rng(1)
    buf = rng.integers(0, 2, 400).astype(np.uint8)
    starts = np.arange(0, 370)
    place = rng.permutation(370)
    depth, text = 30, buf.tobytes()
    got = earlier_copies.previous_factors(buf, starts, place, depth)
    for i, p in zip(starts, place):
        want = 0
        for j, q in zip(starts, place):
            if q < p:
                n = 0
                while n < depth and text[i + n] == text[j + n]:
                    n += 1
                want = max(want, n)
        assert got[i] == want


def test_nearest_smaller():
    assert earlier_copies.nearest_smaller(np.array([3, 1, 2, 2, 5, 0, 4])).tolist() == [-1, -1, 1, 1, 3, -1, 5]


def test_given_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted((tuple(r) for r in earlier_copies.digests(df).collect()), key=str) == plain(docs)
