import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from talus.llm import packing as K

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, start string, klass int, worker string"


def check(rows, docs, capacity=K.CAPACITY):
    """Every id in one piece, pieces gapless in their sequences, checksums of the library's ids."""
    tok = Tokenizer.from_file(PATH)
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for d, t in docs.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own)) and r.doc_tokens == len(ids[r.doc_id])
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(docs)
    for groups, whole in ((by_doc, lambda k, n: n == len(ids[k])), (by_seq, lambda k, n: n <= capacity)):
        for k, parts in groups.items():
            at = 0
            for begin, n in sorted(parts):
                assert begin == at and n > 0
                at += n
            assert whole(k, at)
    return sum(capacity - sum(n for _, n in p) for p in by_seq.values()) / sum(map(len, ids.values()))


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    docs = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    assert check(K.pack(df, PATH).collect(), docs) < 0.01


def test_nulls_empty_long_and_extra_columns(spark):
    texts = [None, "", "a", "  two  spaces \n\n and\ttabs ", "x" * 30_000, "word " * 9000, "é漢字😀 <|endoftext|>    b", " lead", "trail "]
    df = spark.createDataFrame([(i, t, "s", i, None) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    check(K.pack(df, PATH).collect(), dict(enumerate(texts)))


def test_ids_of_words_marks_and_scripts():
    rng = random.Random(5)
    words = ["word", "Straße", "Ġ", "ĠĠa", "ª", "µm", "ŉ", "ɏ", "ɐ", "it's", "'s", "s'", "don't,'", "end.", "end...", "a_b", "_", "x1", "12", "漢字", "×", "a×", "İ", "ß!?",
             "<|endoftext|>", "a<|endoftext|>", "a<|", "|>", "é", "e\u0301", "a\u00ad", "\u00a0", "a.\nB", "\t", "", "\n", "d'a", "O'Neill", "$$$", "tt%%%", "a'll", "ǅ", "\x1c", "a\x85b"]
    texts = [rng.choice([" ", "  ", "", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(4000)]
    texts += ["".join(map(chr, range(lo, lo + 64))) for lo in range(0, 0x300, 64)] + [" ".join(map(chr, range(0x300)))] + [f"a{chr(i)} b{chr(i)}c {chr(i)}" for i in range(0x300)]
    tok = Tokenizer.from_file(PATH)
    for lo in range(0, len(texts), 200):
        part = texts[lo : lo + 200]
        for t, ids in zip(part, K.encode(part, PATH)):
            assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == tok.encode(t, add_special_tokens=False).ids, t


def test_a_word_is_held_once_whatever_marks_and_lines_it_meets():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeéß") for _ in range(8)) for _ in range(200)]
    marks = ["", ",", ".", ".&&&", "!?", ".\n", "\x01", ".\x01a", "\x01,", "<|endoftext|>,"]
    texts = [" ".join(w + m + (w if "\n" in m else "") for w in words) for m in marks] + ["\x01", "a \x01", "a\x01b, \x01c", ",", ", a", "\na", "a.\n\nb", "a.\nb.\nc"]
    tok = Tokenizer.from_file(PATH)
    K.encoder.cache_clear()
    for t, ids in zip(texts, K.encode(texts, PATH)):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == tok.encode(t, add_special_tokens=False).ids, t
    K.encoder.cache_clear()
    list(K.encode(texts[:6], PATH))
    assert len(K.encoder(PATH)[1].known) <= 2 * len(words) + len(marks)


def test_empty_table_and_repeated_rows(spark):
    assert K.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    rows = K.pack(spark.createDataFrame([(1, "same text", "", 0, ""), (1, "same text", "", 0, ""), (None, "no id", "", 0, "")], SCHEMA), PATH).collect()
    assert sorted(r.start for r in rows) == [0, 0, 0] and [r.doc_id for r in rows].count(None) == 1
    assert len({(r.sequence_id, r.offset) for r in rows}) == 3


@pytest.mark.parametrize("tokens", [1, 63, 64, 65, 1023, 1024, 1025, 5000])
def test_cuts_cover_a_document(tokens):
    parts = list(K.cuts(tokens))
    assert [s for s, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
    assert sum(n for _, n in parts) == tokens and all(0 < n <= K.CAPACITY for _, n in parts)


def test_full_sequences_hold_k_pieces_of_class_k(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    by_seq = defaultdict(list)
    for r in K.pack(df, PATH).collect():
        by_seq[r.sequence_id].append(K.CAPACITY // r.length)
    mixed = [k for k in by_seq.values() if len(set(k)) > 1]
    # Only the rests of the classes are mixed: fewer than k pieces of each class k.
    assert sum(map(len, mixed)) < sum(k for k in {x for ks in by_seq.values() for x in ks})
    assert sum(len(k) == k[0] and len(set(k)) == 1 for k in by_seq.values()) > len(by_seq) / 2
