"""Language identification by prediction by partial matching over bytes.

For every language the training texts give a tree of byte contexts up to ``ORDER`` long, with the count
of each byte that followed. The statistics are then frozen. A byte is coded in its longest known
context: with probability count / (total + distinct) if it was seen there, else an escape of
probability distinct / (total + distinct) and the next shorter context; below the empty context all 256
bytes are alike. The exact code length of a text is the sum over its bytes, and the language that codes
it shortest is predicted.

Contexts start anew at white space (a word is coded with the space before and after it), so the code
length of a text is a sum over its words and is computed once per distinct word and worker.

The trees are fitted on a sample of at most ``PER_LANGUAGE`` whole documents of each language, the
lowest by hash of their id; the tables are therefore bounded whatever the corpus. Everything scored is
scored whole.

Null texts and texts without a letter are ``und`` with score 0. With no training rows everything is
``und``. Ties go to the first language by name. Rows without an id are never learned from and count as
held out. Repeated rows get equal results, an empty table an empty one; other columns are ignored."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import VectorMemo, bounded_sample, held_by, python_ready, slices

ORDER = 4
PER_LANGUAGE = 1500
UNDETERMINED = "und"


def words(text: str) -> list[str]:
    return text.lower().split()


def flat_bytes(chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words with a space around each, the word of each byte, its place in the word."""
    coded = [b" " + c.encode("utf-8", "replace") + b" " for c in chunks]
    size = np.array([len(c) for c in coded], dtype=np.int64)
    data = np.frombuffer(b"".join(coded), dtype=np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(coded)), size)
    place = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
    return data, owner, place


def keys(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` bytes that end at each place, as one number that also holds the length."""
    key = np.full(len(at), length << 56, dtype=np.int64)
    for back in range(length):
        key |= data[at - back] << (8 * back)
    return key


def count_grams(texts: Iterator[str], order: int) -> dict[int, int]:
    """Counts of every context and next byte, of all orders."""
    seen: Counter[str] = Counter()
    for t in texts:
        seen.update(words(t))
    chunks = list(seen)
    if not chunks:
        return {}
    data, owner, place = flat_bytes(chunks)
    weight = np.array([seen[c] for c in chunks], dtype=np.int64)[owner]
    out: dict[int, int] = {}
    for length in range(1, order + 2):
        at = np.flatnonzero(place >= max(1, length - 1))
        gram, where = np.unique(keys(data, at, length), return_inverse=True)
        out.update(zip(gram.tolist(), np.bincount(where, weights=weight[at], minlength=len(gram)).astype(np.int64).tolist()))
    return out


@dataclass
class Trees:
    """Frozen code lengths of all languages side by side, in bits."""

    languages: list[str]
    order: int
    grams: np.ndarray
    coded: np.ndarray = field(repr=False)  # of a byte in its context; inf where it wasn't seen
    contexts: np.ndarray
    escaped: np.ndarray = field(repr=False)  # 0 where the context wasn't seen
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @classmethod
    def build(cls, rows: list[tuple[int, str, int]], order: int) -> Trees:
        languages = sorted({r[1] for r in rows})
        grams = np.array(sorted({r[0] for r in rows}), dtype=np.int64)
        n = np.zeros((len(grams), len(languages)))
        if rows:
            column = {x: i for i, x in enumerate(languages)}
            at = np.searchsorted(grams, np.array([r[0] for r in rows], dtype=np.int64))
            n[at, [column[r[1]] for r in rows]] = [r[2] for r in rows]
        length = grams >> 56
        parent = ((grams & ((1 << 56) - 1)) >> 8) | ((length - 1) << 56)
        contexts, of = np.unique(parent, return_inverse=True)
        total, distinct = (np.zeros((len(contexts), len(languages))) for _ in range(2))
        np.add.at(total, of, n)
        np.add.at(distinct, of, n > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            coded = np.where(n > 0, np.log2((total + distinct)[of] / n), np.inf)
            escaped = np.where(total > 0, np.log2((total + distinct) / distinct), 0.0)
        return cls(languages, order, grams, coded, contexts, escaped)

    def code_lengths(self, chunks: list[str]) -> np.ndarray:
        """Bits of every word under every language."""
        out = np.zeros((len(chunks), len(self.languages)))
        for lo in range(0, len(chunks), 5000):
            out[lo : lo + 5000] = self._code_lengths(chunks[lo : lo + 5000])
        return out

    def _code_lengths(self, chunks: list[str]) -> np.ndarray:
        data, owner, place = flat_bytes(chunks)
        at = np.flatnonzero(place >= 1)
        bits = np.zeros((len(at), len(self.languages)))
        known = np.zeros(bits.shape, dtype=bool)
        for order in range(self.order, -1, -1):
            todo = np.flatnonzero((place[at] >= order) & ~known.all(axis=1))
            if not len(todo):
                continue
            here = at[todo]
            coded = self.find(self.grams, self.coded, keys(data, here, order + 1), np.inf)
            escaped = self.find(self.contexts, self.escaped, keys(data, here - 1, order), 0.0)
            open_ = ~known[todo]
            hit = open_ & np.isfinite(coded)
            bits[todo] += np.where(hit, coded, np.where(open_, escaped, 0.0))
            known[todo] |= hit
        bits += np.where(known, 0.0, 8.0)
        sums = np.zeros((len(chunks), len(self.languages)))
        for i in range(len(self.languages)):
            sums[:, i] = np.bincount(owner[at], weights=bits[:, i], minlength=len(chunks))
        return sums

    @staticmethod
    def find(table: np.ndarray, values: np.ndarray, key: np.ndarray, missing: float) -> np.ndarray:
        where = np.minimum(np.searchsorted(table, key), len(table) - 1)
        return np.where((table[where] == key)[:, None], values[where], missing)


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, per_language: int = PER_LANGUAGE) -> Trees:
    """Trees from the rows for which ``train`` holds and the language is known."""
    python_ready(docs.sparkSession)
    texts = docs.filter(train).select(F.col(id_col).alias("id"), F.col(lang_col).alias("label"), F.col(text_col).alias("text"))
    sample = bounded_sample(texts.select("id", "text"), texts.select("id", "label"), per_language)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for label, part in b.groupby("label"):
                grams = count_grams(part["text"], order)
                yield pd.DataFrame({"gram": list(grams), "label": label, "n": list(grams.values())})

    counts = sample.select("label", "text").mapInPandas(run, "gram long, label string, n long").groupBy("gram", "label").agg(F.sum("n").alias("n"))
    return Trees.build([(r["gram"], r["label"], r["n"]) for r in counts.toArrow().to_pylist()], order)


_SCORERS: dict[str, VectorMemo] = {}
held_by("language", _SCORERS.clear)


def scorer(trees: Trees) -> VectorMemo:
    """The worker's memo for these trees; it holds those of one model at a time."""
    if trees.key not in _SCORERS:
        for old in _SCORERS.values():
            old.forget()
        _SCORERS.clear()
        _SCORERS[trees.key] = VectorMemo("language", trees.code_lengths, len(trees.languages))
    return _SCORERS[trees.key]


def classify(texts: list[str | None], trees: Trees) -> list[tuple[str, float]]:
    """Language and its share of the evidence, 2^-bits against all languages."""
    memo = scorer(trees)
    clean = [t if isinstance(t, str) and trees.languages and any(map(str.isalpha, t)) else "" for t in texts]
    out = []
    for lo, hi in slices(clean):
        for at in memo.places([words(t) for t in clean[lo:hi]]):
            if not len(at):
                out.append((UNDETERMINED, 0.0))
                continue
            bits = memo.rows[at].sum(axis=0, dtype=np.float64)
            best = int(np.argmin(bits))
            out.append((trees.languages[best], float(1.0 / sum(math.exp2(max(-1000.0, bits[best] - b)) for b in bits))))
    return out


def predictor(spark: SparkSession, trees: Trees):
    """A column function from text to (lang_pred, score)."""
    python_ready(spark)
    shared = spark.sparkContext.broadcast(trees)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(classify(list(b), shared.value), columns=["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, trees: Trees, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, fold, language and score of every row."""
    found = predictor(docs.sparkSession, trees)(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), found.alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")
