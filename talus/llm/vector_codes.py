"""Product codes of vectors, learned by Lloyd's rounds over two trees.

Vectors become whole numbers and are cut into equal parts; each part position has a codebook. A round
assigns every part to its nearest entry and moves each entry to the mean of its parts. Inside a task a
tree over the block's parts (boxes halved at the median of their widest side) meets a tree over the
codebook's entries. A pair of nodes has bounds on the distances between them, from their boxes; where a
pair's lower bound lies above the smallest upper bound of the same parts' node, none of its entries can
be nearest and the pair is dropped, strictly, so that ties stay. A node of parts that is left with one
single entry is assigned whole, by its cached sums; leaves that stay uncertain compare whole-number
distances with the entries left. Everything is integer arithmetic, so any order of blocks, tasks or
retries gives the same codes.

A round reads the written vectors once and sends at most one row of sums per task and entry; the
codebooks (parts x 256 entries) are all that the driver and the broadcasts hold.

Vectors that are null, empty, hold null or non-finite components or have another length than most are
dropped; components beyond what squared sums in a long allow are brought to that edge. A length that the
parts don't divide gives its first parts one component more. The first entries are the vectors of the
256 smallest ids, one per id (the smallest vector if an id has several); with fewer ids there are fewer
entries, and rows without an id count only when there are no others. Every row counts, repeated ones too.
Ties go to the lower entry. An empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.vectors import integer_vectors
from talus.sources.gold import materialize

#: Vectors of one tree, parts of one of its leaves.
BLOCK, LEAF = 8192, 16


class Boxes:
    """A balanced tree, level by level: every node is a range of ``order``, its children the two
    halves of that range. Nodes of a level have the same size but for one, so levels are arrays."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.x, order, edges = x, np.arange(len(x)), [np.array([0, len(x)])]
        while np.diff(edges[-1]).max() > leaf:
            at, cut = edges[-1], []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
                own = order[lo:hi]
                wide = int(np.argmax(x[own].max(0) - x[own].min(0)))
                order[lo:hi] = own[np.argsort(x[own, wide], kind="stable")]
                cut += [lo, (lo + hi) // 2]
            edges.append(np.unique([*cut, len(x)]))
        self.order, self.edges = order, edges
        y = x[order]
        self.low = [np.minimum.reduceat(y, e[:-1]) for e in edges]
        self.high = [np.maximum.reduceat(y, e[:-1]) for e in edges]
        self.sums = [np.add.reduceat(y, e[:-1]) for e in edges]

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child of each node one level down, and how many there are (one if it was not cut)."""
        first = np.searchsorted(self.edges[level + 1], self.edges[level][nodes])
        return first, np.searchsorted(self.edges[level + 1], self.edges[level][nodes + 1]) - first


def expand(owner: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (owner, each of its children)."""
    begin = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return np.repeat(owner, count), begin + np.arange(count.sum())


def assign(points: Boxes, entries: Boxes, nearest: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    """Write the nearest entry of every row of ``points`` and add up each entry's rows.

    The pairs of both trees' nodes go down together, a level of the parts' tree at a time."""
    p, e, level, down = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), 0, 0
    while len(p):
        gap = np.maximum(0, np.maximum(points.low[level][p] - entries.high[down][e], entries.low[down][e] - points.high[level][p]))
        reach = np.maximum(points.high[level][p] - entries.low[down][e], entries.high[down][e] - points.low[level][p])
        lower, upper = (gap * gap).sum(1), (reach * reach).sum(1)
        begin = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        size = np.diff(np.append(begin, len(p)))
        keep = lower <= np.repeat(np.minimum.reduceat(upper, begin), size)
        p, e = p[keep], e[keep]
        if down + 1 == len(entries.edges):
            begin = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            size = np.diff(np.append(begin, len(p)))
            sure = begin[size == 1]
            whole = entries.order[e[sure]]
            for node, entry in zip(p[sure].tolist(), whole.tolist()):
                lo, hi = points.edges[level][node : node + 2]
                nearest[points.order[lo:hi]] = entry
            np.add.at(sums, whole, points.sums[level][p[sure]])
            np.add.at(counts, whole, np.diff(points.edges[level])[p[sure]])
            open_ = np.repeat(size > 1, size)
            p, e = p[open_], e[open_]
            if level + 1 == len(points.edges):
                compare(points, entries, p, e, nearest, sums, counts)
                return
        last = level + 1 == len(points.edges)
        if down + 1 < len(entries.edges):
            p, e = expand(p, *entries.children(down, e))
            down += 1
        if not last and len(p):
            first, count = points.children(level, p)
            at = np.arange(len(p))
            i, child = expand(at, first, count)
            order = np.lexsort((e[i], child))
            p, e, level = child[order], e[i][order], level + 1


def compare(points: Boxes, entries: Boxes, p: np.ndarray, e: np.ndarray, nearest: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    """Whole-number distances of leaves' rows to the entries left to them."""
    edge = points.edges[-1]
    begin = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, dtype=np.int64)
    for lo, hi in zip(begin.tolist(), np.append(begin, len(p))[1:].tolist()):
        rows = points.order[edge[p[lo]] : edge[p[lo] + 1]]
        ids = np.sort(entries.order[e[lo:hi]])
        gap = points.x[rows][:, None, :] - entries.x[ids][None, :, :]
        own = ids[(gap * gap).sum(2).argmin(1)]
        nearest[rows] = own
        np.add.at(sums, own, points.x[rows])
        np.add.at(counts, own, 1)


def bounds(length: int, parts: int) -> list[tuple[int, int]]:
    """Where the parts begin and end."""
    size, more = divmod(length, parts)
    at = np.cumsum([0, *(size + (i < more) for i in range(parts))])
    return list(zip(at[:-1].tolist(), at[1:].tolist()))


def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches put together to blocks of bounded size."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += len(b)
        if size >= BLOCK:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if size:
        yield pd.concat(held, ignore_index=True)


def next_codebooks(rows: DataFrame, books: list[np.ndarray], cut: list[tuple[int, int]]) -> list[np.ndarray]:
    """One round: every entry moves to the floor of its parts' mean; unused ones stay."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    width = max(hi - lo for lo, hi in cut)
    names = [f"s{i}" for i in range(width)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books = shared.value
        trees = [Boxes(b, 1) for b in books]
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), dtype=np.int64) for b in books]
        for block in blocks(batches):
            v = np.stack(block["v"].to_numpy())
            for i, (lo, hi) in enumerate(cut):
                assign(Boxes(np.ascontiguousarray(v[:, lo:hi]), LEAF), trees[i], np.zeros(len(v), dtype=np.int64), sums[i], counts[i])
        for i, n in enumerate(counts):
            used = np.flatnonzero(n)
            s = np.zeros((len(used), width), dtype=np.int64)
            s[:, : sums[i].shape[1]] = sums[i][used]
            yield pd.DataFrame({"part": i, "entry": used, "n": n[used], **{c: s[:, j] for j, c in enumerate(names)}})

    sent = rows.select("v").mapInPandas(run, "part int, entry int, n long, " + ", ".join(f"{c} long" for c in names))
    # At most 256 rows per part.
    moved = sent.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names)).collect()
    out = [b.copy() for b in books]
    for r in moved:
        out[r["part"]][r["entry"]] = [r[c] // r["n"] for c in names[: out[r["part"]].shape[1]]]
    shared.unpersist()
    return out


def coded(rows: DataFrame, books: list[np.ndarray], cut: list[tuple[int, int]]) -> DataFrame:
    """id, label, code and error of every row under final codebooks."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books = shared.value
        trees = [Boxes(b, 1) for b in books]
        for block in blocks(batches):
            v, error, code = np.stack(block["v"].to_numpy()), 0, np.zeros((len(block), len(cut)), dtype=np.uint8)
            for i, (lo, hi) in enumerate(cut):
                x, near = np.ascontiguousarray(v[:, lo:hi]), np.zeros(len(v), dtype=np.int64)
                assign(Boxes(x, LEAF), trees[i], near, np.zeros_like(books[i]), np.zeros(len(books[i]), dtype=np.int64))
                gap = x - books[i][near]
                error, code[:, i] = error + (gap * gap).sum(1), near
            yield pd.DataFrame({"id": block["id"], "label": block["label"], "code": [c.tobytes().hex() for c in code], "error": error})

    return rows.mapInPandas(run, "id long, label long, code string, error long")


def learn(rows: DataFrame, length: int, parts: int, entries: int, rounds: int) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """Codebooks after the rounds, and where the parts lie. At most ``entries`` rows reach the driver."""
    named = rows.filter("id IS NOT NULL").groupBy("id").agg(F.min("v").alias("v")).orderBy("id").limit(entries).collect()
    named = named or rows.orderBy("v").limit(entries).collect()
    first, cut = np.array([r["v"] for r in named], dtype=np.int64), bounds(length, parts)
    books = [np.ascontiguousarray(first[:, lo:hi]) for lo, hi in cut]
    for _ in range(rounds):
        books = next_codebooks(rows, books, cut)
    return books, cut


def compress(
    df: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """vec_id, code (two hex digits per part), error, label_error (errors summed over the rows of a
    label, nulls together) and codebooks_sha256 (of all entries' components as decimals)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    rows, length = integer_vectors(df, scale, id_col, vec_col, label_col)
    if not length:
        return rows.select(F.col("id").alias("vec_id"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books, cut = learn(rows, length, min(parts, length), entries, rounds)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    found = materialize(coded(rows, books, cut), "codes")
    per_label = found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    joined = found.join(per_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
