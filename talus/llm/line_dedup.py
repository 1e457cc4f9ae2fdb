"""Removal of repeated passages by hashing lines, with the offsets of what was removed.

A text is cut into units at line ends, and inside a line after a sentence of ``SENTENCE_WORDS`` words or
more, so a passage that was put into the middle of a line is still cut at the same places. Units are
normalised (lower case, single spaces) and digested with 128 bits. Over the whole corpus each digest
keeps its first occurrence in the order of document id and place; every other occurrence is a
candidate. Candidates are removed where neighbouring ones make up ``RUN_WORDS`` words or more, so
common short sentences stay in texts that only happen to use them. A line of ``LINE_WORDS`` words or
more that repeats as a whole goes by itself; lines of several units are digested as a whole too.
Characters of scripts without spaces count as half a word each, and their marks end sentences.

Digests are counted with a combinable aggregate; a unit that a large share of the documents holds is
one row per task there, and its occurrences meet the first one in an inner join that adaptive
execution splits. Repeats inside a document are found inside its own task.

Null texts stay null; empty ones stay empty. Rows that share an id count as one document and don't
take units from each other. Rows without an id are compared with themselves only. Ties in the order
cannot occur beyond that. An empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import python_ready, take_over
from talus.sources.gold import materialize

SENTENCE_WORDS = 3
RUN_WORDS = 20
LINE_WORDS = 12

#: A line end, or a sentence end with the marks that close it; full-width and other marks need no space.
_CUT = re.compile(r"\n\s*|[.!?][^\w\s]*\s+|[。！？｡؟۔।॥][」』）】”’\"')\]]*\s*")
#: Characters of scripts that put no spaces between words: Thai to Lao, Burmese, Khmer, Chinese and Japanese.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def n_words(text: str) -> int:
    """Words between white space, and half the characters of scripts without spaces."""
    found = len(text.split())
    return found if text.isascii() else found + len(_UNSPACED.findall(text)) // 2


def units(text: str) -> list[tuple[int, int]]:
    """(start, end) of the units, which cover the text; white space belongs to the unit before it."""
    out, start, sentence = [], 0, 0
    for m in _CUT.finditer(text):
        end = m.end()
        if "\n" in m.group() or n_words(text[sentence:end]) >= SENTENCE_WORDS:
            if end > start:
                out.append((start, end))
            start = end
        sentence = end
    if start < len(text):
        out.append((start, len(text)))
    return out


def digest(unit: str) -> tuple[int, int] | None:
    """Two signed 64-bit numbers; None for white space alone."""
    plain = " ".join(unit.lower().split())
    if not plain:
        return None
    n = xxhash.xxh3_128_intdigest(plain.encode("utf-8", "surrogatepass"))
    return (n >> 64) - 2**63, (n & (2**64 - 1)) - 2**63


def short_lines(text: str, cut: list[tuple[int, int]], run_words: int) -> list[tuple[int, int]]:
    """Lines of several units (first, last + 1) that may go by themselves, but are no run."""
    out, first = [], 0
    for i, (_, end) in enumerate(cut):
        if i + 1 == len(cut) or "\n" in text[cut[i][0] : end]:
            if i > first and LINE_WORDS <= n_words(text[cut[first][0] : end]) < run_words:
                out.append((first, i + 1))
            first = i + 1
    return out


def removed_spans(text: str, repeated: set[int], run_words: int = RUN_WORDS) -> list[tuple[int, int]]:
    """Spans to remove: runs of units that are repeated elsewhere (by the first half of their digest)
    or earlier in this text, and such lines."""
    cut = units(text)
    seen: set[tuple[int, int]] = set()

    def again(d: tuple[int, int] | None) -> bool:
        if d is None or d[0] in repeated or d in seen:
            return d is not None
        seen.add(d)
        return False

    # Repeated units; those of repeated lines go whatever stands beside them.
    gone, alone = [], set()
    for i, (start, end) in enumerate(cut):
        d = digest(text[start:end])
        gone.append(again(d) or d is None and bool(gone) and gone[-1])
        starts_line, ends_line = not i or "\n" in text[slice(*cut[i - 1])], i + 1 == len(cut) or "\n" in text[start:end]
        if gone[i] and starts_line and ends_line and n_words(text[start:end]) >= LINE_WORDS:
            alone.add(i)
    for first, last in short_lines(text, cut, run_words):
        if again(digest(text[cut[first][0] : cut[last - 1][1]])):
            alone.update(range(first, last))
    out, i = [], 0
    while i < len(cut):
        if not gone[i] and i not in alone:
            i += 1
            continue
        first = i
        while i < len(cut) and (gone[i] or i in alone):
            i += 1
        if n_words(text[cut[first][0] : cut[i - 1][1]]) >= run_words:
            out.append((cut[first][0], cut[i - 1][1]))
            continue
        for j in range(first, i):
            if j in alone:
                start = out.pop()[0] if out and out[-1][1] == cut[j][0] else cut[j][0]
                out.append((start, cut[j][1]))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        at = end
    return "".join([*kept, text[at:]])


def repeated_units(docs: DataFrame, run_words: int) -> DataFrame:
    """doc_id and the digests of its units and short lines that a document of smaller id holds too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        take_over("lines")
        for b in batches:
            rows = []
            for doc, t in zip(b["doc_id"], b["text"]):
                cut = units(t)
                lines = [(cut[i][0], cut[j - 1][1]) for i, j in short_lines(t, cut, run_words)]
                rows += [(*d, doc) for d in {digest(t[s:e]) for s, e in [*cut, *lines]} - {None}]
            yield pd.DataFrame(rows, columns=["d1", "d2", "doc_id"]).astype("int64")

    found = materialize(docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").mapInPandas(run, "d1 long, d2 long, doc_id long"), "units")
    first = found.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    return found.join(first, ["d1", "d2"]).filter("doc_id > first").select("doc_id", "d1")


def with_spans(df: DataFrame, run_words: int, id_col: str, text_col: str) -> DataFrame:
    """Columns row (the whole input row), doc_id, rest (remaining text) and flat (starts and ends)."""
    python_ready(df.sparkSession)
    docs = df.select(F.struct(*df.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # At most the units of one document each.
    marks = repeated_units(docs.select("doc_id", "text"), run_words).groupBy("doc_id").agg(F.collect_set("d1").alias("repeated"))

    @F.pandas_udf("rest string, flat array<int>")
    def cut(texts: pd.Series, repeated: pd.Series) -> pd.DataFrame:
        out = []
        for t, r in zip(texts, repeated):
            if t is None:
                out.append((None, []))
                continue
            spans = removed_spans(t, set() if r is None else {int(x) for x in r}, run_words)
            out.append((without(t, spans), [x for span in spans for x in span]))
        return pd.DataFrame(out, columns=["rest", "flat"])

    return docs.join(marks, "doc_id", "left").select("row", "doc_id", cut("text", "repeated").alias("c")).select("row", "doc_id", "c.*")


def remove_repeats(df: DataFrame, run_words: int = RUN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its remaining text, the removed spans (code points of the original text), their
    number and the characters they hold."""
    found = with_spans(df, run_words, id_col, text_col)
    pairs = F.expr("CASE WHEN size(flat) > 0 THEN transform(sequence(0, size(flat) - 1, 2), i -> struct(flat[i] AS start, flat[i + 1] AS end)) ELSE array() END")
    rows = found.select("doc_id", F.col("rest").alias("text"), pairs.alias("removed"))
    return rows.withColumns({
        "changed": F.size("removed") > 0, "n_removed": F.size("removed"),
        "chars_removed": F.aggregate("removed", F.lit(0), lambda a, x: a + x["end"] - x["start"]),
    })


def strip_repeats(df: DataFrame, run_words: int = RUN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows with their remaining text in place of the text."""
    found = with_spans(df, run_words, id_col, text_col)
    return found.select(F.col("row").withField(text_col, F.col("rest")).alias("row")).select("row.*")
