import numpy as np
from pyspark.sql import functions as F

from talus.llm import quality as Q
from talus.llm.common import fold

DOCS, LABELS = "doc_id long, text string, label int, score string, row int", "doc_id long, quality int, toxic int, text string"


def test_held_out_accuracy_and_calibration(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held_out = fold("doc_id", 3) == 1
    rows = Q.classify(docs, Q.fit(docs, labels, ~held_out), held_out).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    tested = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in tested) / len(tested) > 0.9


def test_context_sums_by_definition():
    text = "one two three two one"
    want = np.zeros((Q.BUCKETS, Q.DIMENSIONS))
    index, rows = Q.index_matrix(), [Q.bucket(Q.features(w)[0]) for w in text.split()]
    for i, r in enumerate(rows):
        for j in range(max(0, i - Q.REACH), min(len(rows), i + Q.REACH + 1)):
            if j != i:
                want[r] += index[rows[j]]
    assert np.array_equal(Q.context_sums([text]), want)
    assert np.array_equal(Q.context_sums([text, "", "alone", text]), 2 * want)


def test_network_gradients_learn_and_temperature_helps():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 8))
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=3000) > 0).astype(float)  # no line parts these
    net = Q.Network.train(x[:2000], y[:2000])
    loss = lambda: np.mean(np.logaddexp(0, net.logits(x[2000:]) / net.temperature) - y[2000:] * net.logits(x[2000:]) / net.temperature)
    before = loss()
    net.calibrate(x[2000:], y[2000:])
    assert np.mean((net.probability(x[2000:]) > 0.5) == y[2000:]) > 0.75 and loss() <= before


def test_nulls_one_label_no_labels_empty(spark):
    docs = spark.createDataFrame([(1, None, 0, "", 0), (2, "", 0, "", 0), (3, "good words", 0, "", 0), (3, "good words", 0, "", 0), (None, "x", 0, "", 0)], DOCS)
    one = spark.createDataFrame([(3, 1, 0, ""), (3, 1, 0, ""), (2, None, 0, ""), (None, 0, 0, "")], LABELS)
    rows = Q.classify(docs, Q.fit(docs, one, F.lit(True)), fold("doc_id", 3) == 1).collect()
    assert len(rows) == 5 and all(r.score > 0.5 for r in rows) and [r.held_out for r in rows if r.doc_id is None] == [True]
    none = Q.fit(docs, spark.createDataFrame([], LABELS), F.lit(True))
    assert {r.score for r in Q.classify(docs, none, F.lit(False)).collect()} == {0.5}
    assert Q.classify(spark.createDataFrame([], DOCS), none, F.lit(False)).count() == 0


def test_scores_read_text_only(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.fit(docs, labels, F.lit(True))
    other = docs.select((F.col("doc_id") + 10**6).alias("doc_id"), "text", F.lit("zz").alias("lang"))
    a = {r.doc_id: r.score for r in Q.classify(docs, model, F.lit(False)).collect()}
    b = {r.doc_id - 10**6: r.score for r in Q.classify(other, model, F.lit(False)).collect()}
    assert a == b


def test_whole_score_from_words_to_probability():
    """Features, pooling, both layers and the temperature, one number at a time."""
    import math

    import numpy as np

    from talus.llm import quality as Q

    rng = np.random.default_rng(8)
    n = Q.DIMENSIONS
    net = Q.Network(rng.normal(size=n), rng.random(n) + 0.5, rng.normal(size=(n, 5)), rng.normal(size=5), rng.normal(size=5), 0.3, 1.7)
    model = Q.Model(rng.normal(size=(Q.BUCKETS, n)), net)
    texts = ["", "one", "The THE the quick, quick brown-fox 42 A1! x", "a a a b", "Ünïcode ΑΒΓ 日本語 don't -- \t spaced\n\nout"]
    got = net.probability(Q.pooled(texts, model))
    for text, p in zip(texts, got):
        words, x = text.split(), [0.0] * n
        for w in words:
            for f in Q.features(w):
                v = model.vectors[Q.bucket(f)]
                x = [a + float(b) / len(words) for a, b in zip(x, v)]
        if words:
            same = sum(a == b for a, b in zip(words, words[1:])) / len(words)
            again = 1 - len(set(words)) / len(words)
            for share, name in ((same, "<same as before>"), (again, "<seen before>")):
                x = [a + 4 * share * float(b) for a, b in zip(x, model.vectors[Q.bucket(name)])]
        z = [(a - m) / s for a, m, s in zip(x, net.mean, net.scale)]
        hidden = [math.tanh(sum(z[i] * net.w1[i, j] for i in range(n)) + net.b1[j]) for j in range(5)]
        logit = (sum(h * w for h, w in zip(hidden, net.w2)) + net.b2) / net.temperature
        assert abs(p - 1 / (1 + math.exp(-logit))) < 1e-5
