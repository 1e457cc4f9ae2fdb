"""Encoding and decoding with a unigram piece vocabulary: Viterbi over a double-array trie.

A text's pieces are the path of the highest summed log score. The trie over the pieces' bytes is a
double array: a step from a state with a byte is one addition and one comparison, so all places of a
batch of chunks walk it together. Spaces are written as a marker, which decoding turns back; characters
without a piece are spelled in byte pieces, at the library's price of ten below the lowest score.

Scores are those of the model file where it is a unigram model. A merge (BPE) model holds ranks in
their place, which are no log probabilities; its pieces get Zipf's law by rank, -ln(rank + 1) - ln(H),
with H the sum over all ranks.

No piece reaches across the border before a run of spaces, so the best path of a text is that of its
chunks, each found once per worker. Ties go to the longer last piece. Null and empty texts have no
pieces; repeated rows get equal results; an empty table gives an empty one; other columns are ignored."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm import pieces as P
from talus.llm.common import Memo, held_by, python_ready, slices, texts_of

UNKNOWN_PENALTY = 10.0
FREE = -1


@dataclass
class DoubleArray:
    """``check[base[s] + b] == s`` where state s goes on with byte b; ``piece`` is the id that ends in a
    state, or FREE."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray

    @classmethod
    def build(cls, words: dict[bytes, int]) -> DoubleArray:
        tree: list[dict[int, int]] = [{}]
        ends = {}
        for w, i in sorted(words.items()):
            at = 0
            for b in w:
                if b not in tree[at]:
                    tree[at][b] = len(tree)
                    tree.append({})
                at = tree[at][b]
            ends[at] = i
        size = 4 * len(tree) + 70_000
        base, check, piece = (np.full(size, FREE, dtype=np.int32) for _ in range(3))
        used = np.zeros(size, dtype=bool)
        used[0] = True  # the root's own place; no state is its parent
        state, todo, begin = {0: 0}, [0], [1] * 257
        for node in todo:
            s = state[node]
            piece[s] = ends.get(node, FREE)
            steps = list(tree[node])
            if not steps:
                continue
            # The first offset at which all steps are free; for as many steps or more, the places before it are full.
            lo, at = begin[len(steps)], None
            while at is None:
                offsets = np.flatnonzero(~used[lo : lo + 1024]) + lo - steps[0]
                offsets = offsets[offsets >= 0]
                for b in steps[1:]:
                    offsets = offsets[~used[offsets + b]]
                if len(offsets):
                    at = int(offsets[0])
                else:
                    lo += 1024
            begin[len(steps)] = lo
            base[s] = at
            for b in steps:
                used[at + b], check[at + b], state[tree[node][b]] = True, s, at + b
                todo.append(tree[node][b])
        top = int(np.flatnonzero(used).max()) + 257
        return cls(base[:top].copy(), check[:top].copy(), piece[:top].copy())

    def step(self, states: np.ndarray, bytes_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and which of them exist."""
        to = self.base[states] + bytes_
        ok = (self.base[states] >= 0) & (to < len(self.check))
        to = np.where(ok, to, 0)
        return to, ok & (self.check[to] == states)


def log_scores(v: P.Pieces, ranks: bool) -> np.ndarray:
    score = np.array(v.score, dtype=np.float64)
    if ranks:
        ids = np.array(sorted(v.normal.values(), key=lambda i: (-v.score[i], i)))
        zipf = np.arange(1, len(ids) + 1)
        score[ids] = -np.log(zipf) - np.log(np.sum(1 / zipf))
    return score


class Encoder:
    def __init__(self, v: P.Pieces, score: np.ndarray):
        self.v, self.score = v, score
        self.trie = DoubleArray.build({p.encode(): i for p, i in v.normal.items()})
        self.unknown = score[list(v.normal.values())].min() - UNKNOWN_PENALTY
        self.longest = max(len(p.encode()) for p in v.normal)

    def encode(self, chunks: list[str]) -> list[bytes]:
        """Ids of every chunk as little-endian unsigned 32-bit numbers."""
        out: list[bytes] = [b""] * len(chunks)
        coded = [P.marked(c).encode("utf-8", "replace") for c in chunks]
        order = sorted(range(len(coded)), key=lambda i: len(coded[i]))
        lo = 0
        while lo < len(order):  # chunks of similar length together, about a quarter of a million bytes
            hi, size = lo, 0
            while hi < len(order) and (hi == lo or size + len(coded[order[hi]]) <= 250_000):
                size += len(coded[order[hi]])
                hi += 1
            group = order[lo:hi]
            for i, ids in zip(group, self.paths([coded[i] for i in group])):
                out[i] = ids
            lo = hi
        return out

    def paths(self, coded: list[bytes]) -> list[bytes]:
        """Best paths of a group of chunks; place j of every chunk is settled in the same step."""
        data = np.frombuffer(b"".join(coded), dtype=np.uint8).astype(np.int64)
        size = np.array([len(c) for c in coded], dtype=np.int64)
        first = np.cumsum(size) - size
        end_of = np.repeat(first + size, size)
        begins = np.flatnonzero((data & 0xC0) != 0x80)  # pieces begin at characters
        start, stop, ids = [], [], []
        states, at = np.zeros(len(begins), dtype=np.int64), begins.copy()
        origin = begins
        while len(at):
            inside = at < end_of[origin]
            states, at, origin = states[inside], at[inside], origin[inside]
            states, ok = self.trie.step(states, data[at])
            states, at, origin = states[ok], at[ok] + 1, origin[ok]
            found = self.trie.piece[states] >= 0
            start.append(origin[found])
            stop.append(at[found])
            ids.append(self.trie.piece[states[found]])
        # A character without a piece of its own is an arc by itself.
        width = np.diff(np.r_[begins, len(data)])
        start, stop, ids = np.concatenate(start), np.concatenate(stop), np.concatenate(ids).astype(np.int64)
        single = np.zeros(len(data) + 1, dtype=bool)
        single[start[stop - start == self.width_at(begins, width, start, len(data))]] = True
        lone = ~single[begins]
        start, stop = np.r_[start, begins[lone]], np.r_[stop, (begins + width)[lone]]
        ids = np.r_[ids, np.full(lone.sum(), FREE)]
        gain = np.where(ids >= 0, self.score[ids], self.unknown)
        # Arcs in the order of their end inside the chunk; all that end at one place are compared at once.
        owner = np.repeat(np.arange(len(coded)), size)[start]
        place = stop - first[owner]
        order = np.lexsort((start, stop, place))
        start, stop, ids, gain, place = start[order], stop[order], ids[order], gain[order], place[order]
        slot = lambda pos, own: pos + own  # noqa: E731  one more slot per chunk, for its end
        own = owner[order]
        best = np.full(len(data) + len(coded), -np.inf)
        best[slot(first, np.arange(len(coded)))] = 0.0
        via = np.zeros(len(data) + len(coded), dtype=np.int64)
        edges = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True])
        for a, b in zip(edges[:-1], edges[1:]):
            total = best[slot(start[a:b], own[a:b])] + gain[a:b]
            to = slot(stop[a:b], own[a:b])
            heads = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            top = np.maximum.reduceat(total, heads)
            best[to[heads]] = top
            count = np.diff(np.r_[heads, b - a])
            hit = np.flatnonzero(total == np.repeat(top, count))
            via[to[hit[::-1]]] = a + hit[::-1]  # the first, which is the longest, is written last
        return [self.walk(int(slot(f, i)), int(slot(f + n, i)), i, start, ids, via, data) for i, (f, n) in enumerate(zip(first, size))]

    @staticmethod
    def width_at(begins, width, start, n):
        table = np.zeros(n + 1, dtype=np.int64)
        table[begins] = width
        return table[start]

    def walk(self, begin: int, end: int, own: int, start, ids, via, data) -> bytes:
        out: list[int] = []
        while end > begin:
            arc = int(via[end])
            s, i = int(start[arc]), int(ids[arc])
            if i >= 0:
                out.append(i)
            elif self.v.byte_ids:
                out += [self.v.byte_ids[int(x)] for x in data[s : end - own][::-1]]
            else:
                out.append(self.v.unknown)
            end = s + own
        return np.array(out[::-1], dtype="<u4").tobytes()


def decode(ids: list[int], v: P.Pieces) -> str:
    """The text of a sequence of ids: byte pieces joined as UTF-8, marks as spaces, and the space the
    model puts in front taken away. Bytes that are no UTF-8 become replacement characters."""
    byte_of = {i: b for b, i in enumerate(v.byte_ids)}
    raw = b"".join(bytes([byte_of[i]]) if i in byte_of else v.text[i].replace(P.MARK, " ").encode() for i in ids)
    text = raw.decode("utf-8", "replace")
    return text.removeprefix(" ")


@functools.cache
def encoder(path: str) -> tuple[Encoder, Memo]:
    v = P.load(path)
    e = Encoder(v, log_scores(v, ranks=not v.unigram))
    return e, Memo("unigram", e.encode)


held_by("unigram", encoder.cache_clear)


@functools.cache
def spellings(path: str) -> list[bytes]:
    """The bytes each id stands for."""
    v = P.load(path)
    out = [p.replace(P.MARK, " ").encode() for p in v.text]
    for b, i in enumerate(v.byte_ids):
        out[i] = bytes([b])
    return out


held_by("unigram", spellings.cache_clear)
held_by("unigram", P.load.cache_clear)


def encode(texts: list[str], path: str) -> Iterator[bytes]:
    e, memo = encoder(path)
    for lo, hi in slices(texts):
        parts = [P.chunks(t) for t in texts[lo:hi]]
        known = memo.ready(parts)
        for p in parts:
            yield b"".join(map(known, p))


def decode_bytes(ids: bytes, path: str) -> str:
    """Like ``decode``, from packed ids."""
    text = b"".join(map(spellings(path).__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")
    return text.removeprefix(" ")


def encode_documents(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids of every text."""
    python_ready(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in encode(texts_of(b["text"]), model)]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "ids": ids})

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, ids array<int>")


def decode_documents(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text that the ids stand for; null ids give null."""
    python_ready(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [None if x is None else decode_bytes(np.asarray(x, dtype="<u4").tobytes(), model) for x in b["ids"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "text": texts})

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInPandas(run, "doc_id long, text string")


def round_trip(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text in one pass: number of pieces, of byte pieces, checksum of the ids
    (little-endian unsigned 32-bit), and whether decoding gives the text back."""
    python_ready(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        byte_ids = np.array(P.load(model).byte_ids, dtype="<u4")
        for b in batches:
            texts = texts_of(b["text"])
            ids = list(encode(texts, model))
            yield pd.DataFrame({
                "doc_id": b["doc_id"].astype("Int64"), "n_pieces": [len(x) // 4 for x in ids],
                "n_bytes_spelled": [int(np.isin(np.frombuffer(x, dtype="<u4"), byte_ids).sum()) for x in ids],
                "ids_crc32": [zlib.crc32(x) for x in ids],
                "decoded_equal": [decode_bytes(x, model) == t for x, t in zip(ids, texts)],
            })

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, "doc_id long, n_pieces long, n_bytes_spelled long, ids_crc32 long, decoded_equal boolean"
    )
