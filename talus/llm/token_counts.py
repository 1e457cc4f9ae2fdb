"""Token counts of a piece-merging (BPE) vocabulary by rank-synchronous merging of ragged arrays.

All distinct chunks of a batch lie in one flat array of symbols. In each step every chunk finds the
lowest rank among its neighbouring pairs and merges that pair wherever it stands, left one first where
two overlap; chunks advance together, each with its own rank. When no pair is left, the surviving
symbols are counted: one token each, or one per byte for a character the vocabulary lacks.

Merging all places of the lowest rank at once equals merging them one after the other unless a merge
creates a pair of a still lower rank; a chunk where that happens is counted again one merge at a time.

Null and empty texts have no tokens. Special strings are ordinary text, as in the library. Repeated
rows are counted each; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm import pieces as P
from talus.llm.common import Memo, held_by, python_ready, slices, texts_of

NONE = np.iinfo(np.int32).max


class Merges:
    """Symbols are piece ids, and further numbers for characters that only occur inside pieces."""

    def __init__(self, vocabulary: P.Pieces):
        v = vocabulary
        self.n_pieces, self.fallback = len(v.text), bool(v.byte_ids)
        self.symbol = dict(v.normal)
        for p in v.normal:
            for c in p:
                self.symbol.setdefault(c, len(v.text) + len(self.symbol))
        order = sorted(v.normal.values(), key=lambda i: (-v.score[i], i))
        rank = {i: r for r, i in enumerate(order)}
        self.base = len(v.text) + len(self.symbol) + 1
        table = {}
        for p, i in v.normal.items():
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    table[a * self.base + b] = (rank[i], i)
        self.keys = np.array(sorted(table), dtype=np.int64)
        found = [table[k] for k in self.keys.tolist()]
        self.ranks = np.array([r for r, _ in found], dtype=np.int32)
        self.made = np.array([i for _, i in found], dtype=np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs; unknown characters are negative and never merge."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NONE), self.made[at]

    def count(self, chunks: list[str]) -> list[int]:
        """Tokens of each chunk."""
        marked = [P.marked(c) for c in chunks]
        total = np.zeros(len(marked), dtype=np.int64)
        flat = [self.symbol.get(c, -1) for m in marked for c in m]
        sym, owner = np.array(flat, dtype=np.int64), np.repeat(np.arange(len(marked)), [len(m) for m in marked])
        missing = (sym < 0) | (sym >= self.n_pieces)
        self.extra(total, marked, owner, missing & (sym < 0))
        total_known = np.zeros(len(marked), dtype=np.int64)
        again: list[int] = []
        low, several = np.full(len(marked), -1), np.zeros(len(marked), dtype=bool)
        rank, made = self.pairs(sym, owner)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            chunk = owner[starts]
            best = np.minimum.reduceat(rank, starts)
            odd = several[chunk] & (best < low[chunk])
            again += chunk[odd].tolist()
            done = (best == NONE) | odd
            if done.any():
                size = np.diff(np.r_[starts, len(sym)])
                gone = np.repeat(done, size)
                self.close(total_known, sym[gone], owner[gone])
                keep = ~gone
                sym, owner, rank, made = sym[keep], owner[keep], rank[keep], made[keep]
                continue
            size = np.diff(np.r_[starts, len(sym)])
            merge = rank == np.repeat(best, size)
            merge = leftmost(merge)
            low[chunk] = best
            several[chunk] = np.add.reduceat(merge, starts) > 1
            at = np.flatnonzero(merge)
            sym[at] = made[at]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            sym, owner, rank, made = sym[keep], owner[keep], rank[keep], made[keep]
            touched = np.unique(np.r_[place[at], np.maximum(place[at] - 1, 0)])
            self.refresh(sym, owner, rank, made, touched)
        total += total_known
        for i in again:
            total[i] = self.one_by_one(marked[i])
        return total.tolist()

    def pairs(self, sym, owner):
        rank, made = np.full(len(sym), NONE, dtype=np.int32), np.zeros(len(sym), dtype=np.int64)
        self.refresh(sym, owner, rank, made, np.arange(len(sym)))
        return rank, made

    def refresh(self, sym, owner, rank, made, at):
        """Pairs that begin at the given places; the last symbol of a chunk begins none."""
        rank[at[at == len(sym) - 1]] = NONE
        at = at[at < len(sym) - 1]
        r, m = self.look_up(sym[at], sym[at + 1])
        rank[at], made[at] = np.where(owner[at] == owner[at + 1], r, NONE), m

    def extra(self, total, marked, owner, unknown):
        """Characters without a symbol: their bytes, or one unknown token for a run of them."""
        if not unknown.any():
            return
        text = "".join(marked)
        at = np.flatnonzero(unknown)
        if self.fallback:
            n = np.array([len(text[i].encode("utf-8", "replace")) for i in at.tolist()])
        else:
            n = np.r_[1, (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])].astype(np.int64)
        np.add.at(total, owner[at], n)

    def close(self, total, sym, owner):
        """Surviving symbols with an id are one token; a lone inner character is spelled in bytes."""
        np.add.at(total, owner, (sym >= 0) & (sym < self.n_pieces))
        for i in np.flatnonzero(sym >= self.n_pieces).tolist():
            c = self.names[int(sym[i])]
            total[owner[i]] += len(c.encode()) if self.fallback else 1

    @functools.cached_property
    def names(self) -> dict[int, str]:
        return {i: s for s, i in self.symbol.items()}

    def one_by_one(self, marked: str) -> int:
        """The same count, one merge at a time."""
        sym = [self.symbol.get(c, -1) for c in marked]
        lost = sum(len(c.encode("utf-8", "replace")) if self.fallback else 1 for c in marked if c not in self.symbol)
        while len(sym) > 1:
            a = np.array(sym, dtype=np.int64)
            rank, made = self.look_up(a[:-1], a[1:])
            i = int(np.argmin(rank))
            if rank[i] == NONE:
                break
            sym[i : i + 2] = [int(made[i])]
        n = sum(0 <= s < self.n_pieces for s in sym)
        return lost + n + sum(len(self.names[s].encode()) if self.fallback else 1 for s in sym if s >= self.n_pieces)


def leftmost(merge: np.ndarray) -> np.ndarray:
    """Of pairs that overlap in a row, every other one from the left."""
    at = np.flatnonzero(merge)
    if not len(at):
        return merge
    begins = np.r_[True, at[1:] != at[:-1] + 1]
    first = at[begins][np.cumsum(begins) - 1]
    out = np.zeros_like(merge)
    out[at[(at - first) % 2 == 0]] = True
    return out


@functools.cache
def counter(path: str) -> Memo:
    return Memo("token counts", Merges(P.load(path)).count)


held_by("token counts", counter.cache_clear)
held_by("token counts", P.load.cache_clear)


def counts(texts: list[str], path: str) -> list[int]:
    memo, out = counter(path), []
    for lo, hi in slices(texts):
        parts = [P.chunks(t) for t in texts[lo:hi]]
        known = memo.ready(parts)
        out += [sum(map(known, p)) for p in parts]
    return out


def count_tokens(df: DataFrame, model: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every text, and whether the tokens exceed ``limit``."""
    python_ready(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = texts_of(b["text"])
            n = np.array(counts(texts, model), dtype=np.int64)
            yield pd.DataFrame({
                "doc_id": b["doc_id"].astype("Int64"), "n_bytes": [len(t.encode("utf-8", "replace")) for t in texts],
                "n_tokens": n, "over_limit": n > limit,
            })

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
