import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from talus.llm import language_id as L
from talus.llm.common import fold

SCHEMA = "doc_id long, text string, lang string, label string, id int, held_out string"


def plain_code_length(word: str, training: list[str], order: int) -> float:
    """The definition, byte by byte over dictionaries."""
    seen = defaultdict(lambda: defaultdict(int))
    for t in training:
        for w in L.words(t):
            s = b" " + w.encode() + b" "
            for i in range(1, len(s)):
                for o in range(min(i, order) + 1):
                    seen[s[i - o : i]][s[i]] += 1
    s, bits = b" " + word.encode() + b" ", 0.0
    for i in range(1, len(s)):
        for o in range(min(i, order), -1, -1):
            after = seen.get(s[i - o : i])
            if after is None:
                continue
            total, distinct = sum(after.values()), len(after)
            if s[i] in after:
                bits -= math.log2(after[s[i]] / (total + distinct))
                break
            bits -= math.log2(distinct / (total + distinct))
        else:
            bits += 8
    return bits


@pytest.mark.parametrize("order", [0, 2, 4])
def test_code_lengths_are_exact(order):
    texts = {"a": ["the cat sat on the mat", "a hat"], "b": ["der hund über dem haus", "die katze"]}
    rows = [(g, lang, n) for lang, ts in texts.items() for g, n in L.count_grams(iter(ts), order).items()]
    trees = L.Trees.build(rows, order)
    words = ["the", "hund", "xyz", "über", "a", "catdie", "字"]
    got = trees.code_lengths(words)
    for i, w in enumerate(words):
        for j, lang in enumerate(trees.languages):
            assert got[i, j] == pytest.approx(plain_code_length(w, texts[lang], order))


def test_held_out_accuracy(spark, sf):
    docs, held_out = spark.read.parquet(f"{sf}/documents.parquet"), fold("doc_id", 4) == 2
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = L.identify(docs, L.fit(docs, ~held_out), held_out).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    tested = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in tested) / len(tested) > 0.97


def test_nulls_ties_and_clashing_columns(spark):
    rows = [(1, "the cat the cat", "en", "x", 1, ""), (2, "die katze", "de", "x", 1, ""), (3, None, "en", "x", 1, ""), (None, "the the", "de", "x", 1, ""),
            (4, "12 34 !", "de", "x", 1, ""), (5, "", None, "x", 1, ""), (6, "the cat", None, "x", 1, ""), (6, "the cat", None, "x", 1, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = L.identify(docs, L.fit(docs, F.lit(True)), fold("doc_id", 4) == 2).collect()
    assert len(got) == 8 and [r.lang_pred for r in got if r.doc_id in (3, 4, 5)] == ["und"] * 3
    assert [r.lang_pred for r in got if r.doc_id == 6] == ["en", "en"]
    assert [r.held_out for r in got if r.doc_id is None] == [True]


def test_no_training_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "text", None, "", 0, "")], SCHEMA)
    got = L.identify(docs, L.fit(docs, F.lit(True)), F.lit(False)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    empty = spark.createDataFrame([], SCHEMA)
    assert L.identify(empty, L.fit(empty, F.lit(True)), F.lit(False)).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    trees = L.fit(docs, F.lit(True), per_language=10)
    starts = int((trees.grams >> 56 == 1).sum())
    assert starts > 0 and len(trees.grams) < 200
