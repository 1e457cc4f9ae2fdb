import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from talus.llm import fingerprints as P

SCHEMA = "doc_id long, text string, part string, lent int, p int, before string, top int"


def plain_chunks(data: bytes) -> list[bytes]:
    """The definition, byte by byte."""
    out, start, gear = [], 0, [int(x) for x in P.gear()]
    while start < len(data):
        for end in range(start + 1, len(data) + 1):
            n = end - start
            h = sum(gear[data[end - 1 - j]] << j for j in range(min(32, end))) & 0xFFFFFFFF
            mark = int(P.STRICT) if n < P.NORMAL else int(P.LOOSE)
            if end == len(data) or n == P.MOST or (n >= P.LEAST and len(data) - start > P.LEAST and not h & mark):
                out.append(data[start:end])
                start = end
                break
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=700), max_size=4))
def test_boundaries_by_definition(texts):
    for t, ends in zip(texts, P.boundaries(texts)):
        assert [t[a:b] for a, b in zip([0, *ends], ends)] == plain_chunks(t)


def check(rows, docs):
    """docs: (doc_id, text) in descending order."""
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(docs)
    for (doc, text), (_, following) in zip(docs, [*docs[1:], *docs[:1]]):
        edited = P.edit(text, following)
        sha = hashlib.sha256(edited.encode()).hexdigest()
        r = next(x for x in got[doc] if x.edited_sha256 == sha and x.n_chars == len(text))
        own, other, after = (P.fingerprints([t.encode()])[0] for t in (text, edited, following))
        assert (r.fingerprint, r.edited_fingerprint) == (P.written(own), P.written(other))
        assert r.near_edited == P.containment(own, other) and r.near_next == P.containment(own, after)


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    docs = sorted(((r.doc_id, r.text or "") for r in df.collect()), reverse=True)
    rows = P.fingerprint_documents(df).collect()
    check(rows, docs)
    near = np.array([(r.near_edited, r.near_next) for r in rows if r.n_chars > 1000])
    assert 0.35 < near[:, 0].mean() < 0.65 and near[:, 1].mean() < 0.1


def test_edges(spark):
    rows = [(5, "same"), (5, "same"), (4, None), (3, ""), (2, "x" * 50_000), (-7, "é漢" * 400), (None, "no id"), (2**60, "large")]
    df = spark.createDataFrame([(d, t, "", 0, 0, "", 0) for d, t in rows], SCHEMA).repartition(3)
    docs = sorted(((d if d is not None else -(2**62), t or "") for d, t in rows), key=lambda x: (-x[0], x[1]))
    check(P.fingerprint_documents(df).collect(), [(None if d == -(2**62) else d, t) for d, t in docs])
    one = P.fingerprint_documents(spark.createDataFrame([(1, "alone here", "", 0, 0, "", 0)], SCHEMA)).collect()
    check(one, [(1, "alone here")])
    assert P.fingerprint_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shift_resistance_and_round_trip():
    rng = np.random.default_rng(2)
    text = bytes(rng.integers(97, 123, 20_000, dtype=np.uint8))
    a, b, c = P.fingerprints([text, b"inserted at the front " + text, text[5000:15_000]])
    assert P.containment(a, b) > 0.98 and P.containment(c, a) > 0.95 and P.containment(a, c) < 0.6
    assert P.read(P.written(a)) == a and P.written({}) == "" and P.containment({}, {}) == 1.0 and P.containment({}, a) == 0.0
