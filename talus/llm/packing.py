"""Harmonic packing of tokenised documents into sequences of fixed capacity.

A piece of length n belongs to class ``capacity // n``: class k holds the lengths in
(capacity / (k + 1), capacity / k], and a sequence of class k takes exactly k pieces, whatever they
are. No search is needed, so every worker numbers its pieces on its own and only a table of counts per
worker and class is exchanged.

Documents may be cut freely: a document gives as many full sequences as it can, then pieces of
capacity / 2, / 4, ... down to ``SMALLEST`` which fill their sequences without loss, then one rest, in
classes of so many pieces that little is lost. What remains of every class in the end is fewer than k
pieces; these are bounded in number by the classes and placed together, largest first.

Nulls and empty texts have no ids, so their document is the end id alone. Rows that share a document id
are packed separately, each with its own ids. An empty table gives an empty result; other columns are
ignored."""

from __future__ import annotations

import functools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from talus.llm.common import Memo, RunMemo, held_by, python_ready, runs, single_spaced, slices, texts_of, words_with_space
from talus.sources.gold import materialize

CAPACITY = 1024
#: The shortest piece that is cut off on purpose; the rest of a document is shorter than this.
SMALLEST = 64
END_ID = 0
#: How byte-level vocabularies write a space.
SPACE_BYTE = "Ġ"
#: Latin letters; ASCII marks but for the apostrophe, which may begin a part with letters.
_LETTER, _MARK = "[A-Za-zÀ-ÖØ-öø-ɏ]", r"[!-&(-/:-@\[-`{-~]"
_WORD = re.compile(f"{_LETTER}+")
#: Begins a chunk that no space stands before.
JOINED = "\x01"
#: Entries of the memo of words; about 200 bytes each.
WORDS_KEPT = 600_000

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, klass int, worker int, nth long"


@functools.cache
def encoder(path: str) -> tuple[Memo, RunMemo, list[str]]:
    """Ids of chunks as they are, as little-endian unsigned 32-bit numbers, and of chunks after a space
    (after nothing, if they begin with ``JOINED``); what texts must not hold to be cut inside words.

    The tokenizer's first split takes a space with the letters after it as one part. So a word of Latin
    letters goes to the same model with white space as the split, written as the model spells bytes."""
    from tokenizers import Tokenizer, pre_tokenizers

    tok = Tokenizer.from_file(path)
    by_word = Tokenizer(tok.model)  # the vocabulary is in memory once
    by_word.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    begins = np.zeros(tok.get_vocab_size(), dtype=bool)  # tokens that begin with a space
    begins[[i for t, i in tok.get_vocab().items() if t.startswith(SPACE_BYTE)]] = True
    in_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    spelled = {i: in_bytes.pre_tokenize_str(chr(i))[0][0] for i in range(0xC0, 0x250)}

    def alone(chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in tok.encode_batch_fast(chunks, add_special_tokens=False)]

    def in_one_text(tokenizer: Tokenizer, text: str, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        # Words without a space of their own are encoded in one text: each begins at a token with a space.
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        edges = np.flatnonzero(begins[ids])
        assert len(edges) == len(words)
        return words, ids, np.diff(edges, append=len(ids))

    def spaced(chunks: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        words, latin, plain, other = [], [], [], []
        for c in chunks:
            if c.isascii() and c.isalpha():
                words.append(c)
            elif _WORD.fullmatch(c):
                latin.append(c)
            else:
                (other if " " in c or c[:1] == JOINED else plain).append(c)
        if words or latin:
            text = " ".join(["", *words, *" ".join(latin).translate(spelled).split()])
            yield in_one_text(by_word, text.replace(" ", f" {SPACE_BYTE}"), words + latin)
        if plain:
            yield in_one_text(tok, " " + " ".join(plain), plain)
        if other:
            ids = alone([c[1:] if c[0] == JOINED else " " + c for c in other])
            yield other, np.frombuffer(b"".join(ids), dtype="<u4"), np.array([len(x) // 4 for x in ids])

    added = [t.content for t in tok.get_added_tokens_decoder().values()]
    return Memo("packing", alone), RunMemo("packing", spaced, WORDS_KEPT), [JOINED, *added]


held_by("packing", encoder.cache_clear)


def chunks_of(texts: list[str], uncut: list[str]) -> tuple[list[int], pa.Array, np.ndarray]:
    """Texts by their place, in an order of its own; the chunks of all of them; how many each has.

    The tokenizer's first split always parts a single space from the character before it, letters from
    marks after them, and letters from a mark, or a mark and one line end, before them. It never looks
    back across, so the chunks may be encoded one by one. Texts that hold one of ``uncut`` are cut at
    spaces only, those with ``JOINED`` not at all."""
    plain, other = [], []
    for i, t in enumerate(texts):
        (plain if single_spaced(t) and not any(x in t for x in uncut) else other).append(i)
    cut = pa.array([texts[i] for i in plain], pa.large_string())
    cut = pc.replace_substring_regex(cut, f"({_LETTER})({_MARK})", rf"\1 {JOINED}\2")
    cut = pc.split_pattern(pc.replace_substring_regex(cut, f"({_MARK}\n)({_LETTER})", rf"\1 {JOINED}\2"), " ")
    rest = [[texts[i]] if JOINED in texts[i] else words_with_space(texts[i]) for i in other]
    sizes = [*pc.list_value_length(cut).to_pylist(), *map(len, rest)]
    return plain + other, pa.concat_arrays([cut.flatten(), pa.array([c for x in rest for c in x], pa.large_string())]), np.array(sizes, dtype=np.int64)


def strings(a: pa.Array) -> list[str]:
    return a.to_numpy(zero_copy_only=False).tolist()


def encode(texts: list[str], path: str) -> Iterator[bytes]:
    """Ids of each text. Each distinct chunk of a slice is looked up once."""
    heads, others, uncut = encoder(path)
    for lo, hi in slices(texts):
        places, chunks, n = chunks_of(texts[lo:hi], uncut)
        first = np.zeros(len(chunks), dtype=bool)
        first[np.cumsum(n) - n] = True
        begin = strings(chunks.filter(pa.array(first)))
        head = heads.ready([begin])
        rest = chunks.filter(pa.array(~first)).dictionary_encode()
        at = others.places(strings(rest.dictionary))[rest.indices.to_numpy()]
        sizes = others.sizes[at]
        ids = runs(others.numbers, others.starts[at], sizes).tobytes()
        ends = 4 * np.r_[0, np.cumsum(sizes)][np.cumsum(n - 1)]
        out = [b""] * len(places)
        for i, h, a, b in zip(places, begin, [0, *ends.tolist()], ends.tolist()):
            out[i] = head(h) + ids[a:b]
        yield from out


def cuts(tokens: int, capacity: int = CAPACITY, smallest: int = SMALLEST) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    at = 0
    while tokens - at >= capacity:
        yield at, capacity
        at += capacity
    size = capacity // 2
    while size >= smallest:
        if tokens - at >= size:
            yield at, size
            at += size
        size //= 2
    while tokens - at:
        yield at, min(tokens - at, smallest)
        at += min(tokens - at, smallest)


def cut_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece, numbered per worker and class."""
    python_ready(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker, seen = TaskContext.get().partitionId(), defaultdict(int)
        for b in batches:
            rows = []
            for doc, ids in zip(b["doc_id"], encode(texts_of(b["text"]), tokenizer)):
                ids += END_ID.to_bytes(4, "little")
                n = len(ids) // 4
                view = memoryview(ids)
                for start, length in cuts(n, capacity):
                    k = capacity // length
                    rows.append((doc, start, length, zlib.crc32(view[4 * start : 4 * (start + length)]), n, k, worker, seen[k]))
                    seen[k] += 1
            if rows:
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECE.split(", ")])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, PIECE)


def place_rest(capacity: int):
    """First fit, largest first, over the pieces left in all classes: fewer than k of each class k."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["length", "klass", "idx"], ascending=[False, True, True], kind="stable")
        free: list[int] = []
        number, offset = [], []
        for n in b["length"]:
            s = next((i for i, f in enumerate(free) if f >= n), len(free))
            if s == len(free):
                free.append(capacity)
            number.append(s)
            offset.append(capacity - free[s])
            free[s] -= n
        return b.assign(number=number, offset=offset)[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "number", "offset"]]

    return run


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces with the sequence they lie in and their offset there."""
    # Written once: the numbers of a piece and the counts they are built from must come from one run.
    pieces = materialize(cut_documents(df, tokenizer, id_col, text_col, capacity), "pieces")
    counts = pieces.groupBy("klass", "worker").agg(F.count("*").alias("n"))
    earlier = W.Window.partitionBy("klass").orderBy("worker").rowsBetween(W.Window.unboundedPreceding, -1)
    base = counts.select("klass", "worker", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    # One row per class, at most 2 * sqrt(capacity) of them.
    totals = counts.groupBy("klass").agg(F.sum("n").alias("total")).withColumn("full", F.expr("total div klass"))
    lower = W.Window.orderBy("klass").rowsBetween(W.Window.unboundedPreceding, -1)
    classes = totals.select("klass", "full", F.coalesce(F.sum("full").over(lower), F.lit(0)).alias("first_sequence"))
    numbered = (
        pieces.join(base, ["klass", "worker"]).join(F.broadcast(classes), "klass")
        .withColumn("idx", F.col("base") + F.col("nth")).withColumn("bin", F.expr("idx div klass"))
    )
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    in_bin = W.Window.partitionBy("klass", "bin").orderBy("idx").rowsBetween(W.Window.unboundedPreceding, -1)
    full = numbered.filter("bin < full").select(
        *out, (F.col("first_sequence") + F.col("bin")).alias("sequence_id"), F.coalesce(F.sum("length").over(in_bin), F.lit(0)).alias("offset"),
    )
    rest = (
        numbered.filter("bin >= full").select(*out, "klass", "idx", F.lit(0).alias("g")).groupBy("g")
        .applyInPandas(place_rest(capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, number long, offset long")
    )
    last = classes.agg(F.coalesce(F.sum("full"), F.lit(0)).alias("sequences"))
    rest = rest.join(F.broadcast(last)).select(*out, (F.col("sequences") + F.col("number")).alias("sequence_id"), "offset")
    return full.unionByName(rest)
