"""Each stage against a plain version over the rows it got."""

import public_tokenizers
from pyspark.sql import functions as F
from test_line_dedup import plain as plain_rest
from test_near_dedup import plain as plain_groups
from test_packing import check as check_packed

import corpus_pipeline as C
from talus.llm import language_id, quality
from talus.sources.gold import materialize

STAGE = dict(C.STAGES)
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, p string, d int, row string, kept int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_every_stage_on_its_own_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    by_name = {}
    for name, stage in C.STAGES:
        out = materialize(stage(spark, docs, sf), "stage")
        by_name[name] = (docs, out)
        if name != "packing":
            assert out.columns == columns
        docs = out

    before, after = by_name["language ID"]
    trees = language_id.fit(before, F.lit(True))
    kept = [r for r in before.collect() if (p := language_id.classify([r.text], trees)[0])[0] != "und" and p[1] >= C.LEAST_LANGUAGE_SCORE]
    assert rows_of(after) == sorted(map(tuple, kept), key=str) and len(kept) > 0.95 * before.count()

    before, after = by_name["quality classifier"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = {r.doc_id for r in after.collect()}
    judged = [(r.doc_id in good) == labels[r.doc_id] for r in before.collect() if r.doc_id in labels]
    assert sum(judged) / len(judged) > 0.97

    before, after = by_name["near-dedup"]
    docs = [(r.doc_id, r.text) for r in before.collect()]
    firsts = {c for _, _, c in plain_groups(docs, 5, 80)}
    assert {r.doc_id for r in after.collect()} == firsts and len(firsts) < len(docs)

    before, after = by_name["substring dedup"]
    want = {d: rest for (d, _), [(rest, _)] in plain_rest([(r.doc_id, r.text) for r in before.collect()]).items() if rest.strip(" ")}
    assert {r.doc_id: r.text for r in after.collect()} == want and all(r.n_chars == len(r.text) for r in after.collect())

    before, after = by_name["packing"]
    check_packed(after.collect(), {r.doc_id: r.text for r in before.collect()})


def test_run_gives_what_the_stages_give(spark, sf):
    a = C.run(spark, sf)
    assert a.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    again = C.run(spark, sf)
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(a) == key(again) != []


def test_stages_take_nulls_clashing_columns_and_nothing(spark, sf):
    text = "the cat sat on the mat and the dog ran after the cat"
    rows = [(1, text, "en", "s", 1, "x", 1, "y", 0), (1, text, "en", "s", 1, "x", 1, "y", 0), (2, None, "en", None, None, None, None, None, None),
            (3, "", None, "s", 0, "", 0, "", 0), (None, text + " twice", "en", "s", 1, "", 0, "", 0), (4, "12 34", "en", "s", 5, "", 0, "", 0)]
    for docs in (spark.createDataFrame(rows, EXTRA), spark.createDataFrame([], EXTRA)):
        some = docs.count() > 0
        for name, stage in C.STAGES:
            docs = materialize(stage(spark, docs, sf), "stage")
            if name != "packing":
                assert docs.columns == [c.split()[0] for c in EXTRA.split(", ")]
        assert (docs.count() > 0) == some


def test_model_of_one_fold_is_the_model_of_the_query(spark, sf):
    """Scores don't depend on how rows are spread over tasks."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    a, b = (quality.fit(d, labels, F.lit(True)).network for d in (docs, docs.repartition(7)))
    assert (a.w1 == b.w1).all() and a.temperature == b.temperature


def test_tokenizer_is_public():
    assert public_tokenizers.path("byte_bpe_50k.json").endswith("byte_bpe_50k.json")


def test_near_dedup_keeps_rows_not_ids(spark, sf):
    a, b, c = ("the cat sat on the mat and the dog ran", "a quite different text about ships and the sea", "one more text that nobody else has written so far")
    rows = [(None, a), (None, a), (2, a), (2, a), (4, a), (4, b), (4, c), (5, b), (6, ""), (6, ""), (7, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1, "x", 1, "y", 0) for d, t in rows], EXTRA)
    got = C.without_near_copies(spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(None, a), (None, a), (2, a), (4, b), (4, c), (6, ""), (7, None)], key=str)
