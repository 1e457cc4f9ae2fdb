import random

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from talus.llm import token_counts as C

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
SCHEMA = "doc_id long, text string, n_tokens string, n_bytes int"


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    docs = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
    rows = C.count_tokens(df, PATH, 1000).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {
        d: (len(t.encode()), n := len(LIBRARY.encode(t)), n > 1000) for d, t in docs.items()
    }


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" aabcdetinhers\nTHé▁\t.,!ß漢字😀\x00<s>/012"), max_size=60))
def test_random_texts(text):
    assert C.counts([text], PATH) == [len(LIBRARY.encode(text))]


def test_hard_texts():
    rng = random.Random(5)
    texts = ["a" * 5000, " " * 300, " a " * 100, "é" * 77, "\n" * 50, "<0x41>", "</s><s><unk>", "", " ", "▁", "▁▁x ▁",
             "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)), "the of and " * 20_000]
    assert C.counts(texts, PATH) == [len(x) for x in LIBRARY.encode(texts)]


def test_one_by_one_agrees_with_the_simultaneous_merges():
    m = C.Merges(C.P.load(PATH))
    words = [" ".join(random.Random(i).choices(["aaaa", "theth", "inging", "漢a", "0000"], k=4)) for i in range(50)]
    assert m.count(words) == [m.one_by_one(C.P.marked(w)) for w in words]


def test_nulls_repeated_rows_empty_table(spark):
    rows = C.count_tokens(spark.createDataFrame([(1, None, "x", 1), (1, "", "x", 1), (None, "a b", "x", 1), (2, "a b", "x", 1), (2, "a b", "x", 1)], SCHEMA), PATH, 1).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == [(0, 3, 2, True), (1, 0, 0, False), (1, 0, 0, False), (2, 3, 2, True), (2, 3, 2, True)]
    assert C.count_tokens(spark.createDataFrame([], SCHEMA), PATH, 1).count() == 0
